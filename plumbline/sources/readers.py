"""Read delimited files as typed tables and ingest them to Parquet."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from pyspark.errors import AnalysisException, ParseException, PySparkException

from plumbline.constants import (
    CSV_EXTENSION, EMPTY_UPLOAD_REASON, EXTENSION_REASON, MISSING_TEXTS, UNREADABLE_REASON,
)
from plumbline.functions.scalars import quoted, text_number
from plumbline.sources import records
from plumbline.sources.catalog import fingerprint_parts
from plumbline.sources.records import BLOCK, LENGTH, PART, PATH, PLAIN, SEQUENCE, SPLIT, TEXT
from plumbline.sources.rows import ROW_NUMBER
from plumbline.sources.storage import delete_folder, discard, folder_exists, move_folder, store

# The shapes of whole numbers and truth values in text.
INTEGER_PATTERN = r"^\s*[+-]?\d{1,19}\s*$"
BOOLEAN_TEXTS = ("True", "TRUE", "true", "False", "FALSE", "false")
REJECTED = "rejected"
CORRUPT = "__corrupt"
PARSER = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
# Spark's error conditions for input that cannot be read as text of this form.
READ_CONDITIONS = ("FAILED_READ_FILE", "MALFORMED_CSV_RECORD", "MALFORMED_RECORD_IN_PARSING")
MOST_PLANS = 3


@dataclass
class CsvScan:
    """What one pass over a delimited file tells: names, types, and for each split its records.

    ``splits`` is a stored table, one row a split: its first place and the number of its first data row.
    """

    records: DataFrame
    types: dict[str, str]
    splits: DataFrame
    rows: int
    spanning: bool  # records were put together from several lines, and are stored

    def discard(self) -> None:
        discard(self.splits)
        if self.spanning:
            discard(self.records)


def _fields(record: Column, width: int) -> Column:
    """A record as a struct: f0, f1 and so on, and the raw text of a record that does not fit."""
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(width)]
    return F.from_csv(record, T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]).simpleString(), PARSER)


def _present(text: Column) -> Column:
    """A field's text; missing texts are NULL."""
    return F.when(~text.isin(*MISSING_TEXTS), text)


def _header(line: str, spark: SparkSession) -> list[str]:
    """The names of a header record; a repeated one gets .1, .2 and so on, an empty one its place."""
    width = line.count(",") + 1
    row = spark.range(1).select(_fields(F.lit(line), width).alias("f")).select("f.*").first()
    raw = [row[f"f{i}"] for i in range(width)]
    if row[CORRUPT] is not None:  # commas inside quotes: fewer names than commas
        raw = raw[:max((i for i, n in enumerate(raw) if n is not None), default=0) + 1]
    listed, seen = [], {}
    for place, name in enumerate(raw):
        name = f"_c{place}" if name is None else name
        seen[name] = seen.get(name, -1) + 1
        listed.append(f"{name}.{seen[name]}" if seen[name] else name)
    return listed if len(set(listed)) == len(listed) else [f"_c{i}" for i in range(len(listed))]


# Which texts a column may hold: the counters by which its type is chosen.
KINDS = ("filled", "whole", "number", "truth")


def _counters(text: Column) -> list[Column]:
    value = _present(text)
    return [
        F.count(value).alias("filled"),
        F.count_if(value.rlike(INTEGER_PATTERN) & F.trim(value).try_cast("bigint").isNotNull()).alias("whole"),
        F.count(text_number(value)).alias("number"), F.count_if(value.isin(*BOOLEAN_TEXTS)).alias("truth"),
    ]


def _cells(lines: DataFrame, width: int, wanted: Column, *keep: str) -> DataFrame:
    """(kept columns, place, text) of records: the fields from 0, the whole of it at -1, and at -2 again if it
    does not fit. Of a record that is not wanted only the whole has a text."""
    fields = F.col("__fields")
    places = [(-1, F.col(TEXT)), (-2, fields.getField(CORRUPT)), *[(i, fields.getField(f"f{i}")) for i in range(width)]]
    cells = F.array(*[F.struct(F.lit(place).alias("place"), text.alias("text")) for place, text in places])
    parsed = lines.select(*keep, TEXT, F.when(wanted, _fields(F.col(TEXT), width)).alias("__fields"))
    return parsed.select(*keep, F.inline(cells))


def _types(names: list[str], facts: dict[int, dict[str, int]]) -> dict[str, str]:
    """The narrowest type that holds every non-missing value; all-missing columns are doubles."""
    types = {}
    for place, name in enumerate(names):
        filled, whole, number, truth = (facts.get(place, {}).get(kind) or 0 for kind in KINDS)
        types[name] = (
            "double" if not filled
            else "bigint" if whole == filled
            else "double" if number == filled
            else "boolean" if truth == filled
            else "string"
        )
    return types


def scan_csv(spark: SparkSession, path: str) -> CsvScan:
    """One pass over a delimited file: the types of its columns and the records of its splits.

    The pass also looks whether a quoted field spans lines. Only then are the records cut anew, by
    ``records.cut_records``, stored and looked at once more. A record with more fields than the header
    makes the file unreadable; a shorter one is filled up with missing values. Each file of a folder
    begins with a header, which is no data.
    """
    head = records.first_line(spark, path)
    if head is None:
        raise ValueError("No columns to parse from file.")
    lines = records.line_records(spark, path)
    scan = _scan(lines, head, records.line_code)
    return scan if scan is not None else _scan_spanning(spark, path)


def _scan_spanning(spark: SparkSession, path: str) -> CsvScan:
    cut = store(records.cut_records(spark, path), "csv-records")
    head = cut.filter((F.col(BLOCK) == 0) & (F.col(SEQUENCE) == 0)).orderBy(PATH).select(TEXT).first()
    scan = _scan(cut, head[0], None)
    scan.spanning = True
    return scan


def _scan(lines: DataFrame, head: str, code) -> CsvScan | None:
    """None if the code of a line says that a field spans lines.

    ``head`` is the header of one of the files. Records that equal it are kept out of the counts, so that
    where each file begins with it and has it once, as nearly always, nothing is left to correct.
    """
    names = _header(head, lines.sparkSession)
    like_head, place, text = F.col(TEXT) == F.lit(head), F.col("place"), F.col("text")
    record, whole_head = place == -1, (place == -1) & (text == F.lit(head))
    unquoted = F.regexp_replace(text, '"[^"]*"', "")
    cells = _cells(lines, len(names), ~like_head, *SPLIT, SEQUENCE)
    each = store(cells.groupBy(*SPLIT, "place").agg(
        F.count("*").alias("rows"), F.min(SEQUENCE).alias("first"),
        F.count_if(whole_head).alias("heads"), F.min(F.when(whole_head, F.col(SEQUENCE))).alias("first_head"),
        (F.lit(0) if code is None else F.count_if(record & (code(text) != PLAIN))).alias("bent"),
        F.max(F.when(place == -2, F.size(F.split(unquoted, ",")))).alias("widest"), *_counters(text),
    ), "csv-splits")
    begins = F.col(BLOCK) == F.min(BLOCK).over(Window.partitionBy(PATH))
    splits = each.filter(record).withColumn("header", begins.cast("int"))
    total = splits.agg(
        F.sum("bent").alias("bent"), F.sum("rows").alias("rows"), F.sum("heads").alias("heads"), F.sum("header").alias("files"),
        F.count_if((F.col("header") == 1) & (F.col("first") == F.col("first_head"))).alias("usual"),
    ).first()
    if total["bent"]:
        discard(each)
        return None
    sums = each.groupBy("place").agg(F.max("widest").alias("widest"), *[F.sum(k).alias(k) for k in KINDS]).collect()
    facts = {r["place"]: {k: r[k] for k in KINDS} for r in sums}
    widest = max((r["widest"] or 0 for r in sums), default=0)
    if widest > len(names):
        discard(each)
        raise ValueError(f"Expected {len(names)} fields, saw {widest}.")
    if not total["files"] == total["heads"] == total["usual"]:
        _correct(facts, lines, head, total["heads"], len(names))
    before = Window.orderBy(PATH, BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    start = F.coalesce(F.sum(F.col("rows") - F.col("header")).over(before), F.lit(0)) + 1
    placed = store(splits.select(*SPLIT, "header", "first", start.alias("start")), "csv-starts")
    discard(each)
    return CsvScan(lines, _types(names, facts), placed, (total["rows"] or 0) - (total["files"] or 0), False)


def _correct(facts: dict, lines: DataFrame, head: str, heads: int, width: int) -> None:
    """Add the records like ``head`` that are data, and take off the headers that differ from it."""
    own = lines.groupBy(PATH).agg(F.min_by(TEXT, F.struct(BLOCK, SEQUENCE)).alias(TEXT))
    like = own.limit(1).select(F.lit(head).alias(TEXT))
    for times, texts in ((heads, like), (-1, own)):
        cells = _cells(texts, width, F.lit(True)).groupBy("place").agg(*_counters(F.col("text")))
        for row in cells.filter("place >= 0").collect():
            for kind in KINDS:
                facts[row["place"]][kind] += times * row[kind]


def _typed(place: int, name: str, kind: str) -> Column:
    value = _present(F.col("__fields").getField(f"f{place}"))
    if kind == "double":
        return text_number(value).alias(name)
    if kind == "string":
        return value.alias(name)
    return F.trim(value).try_cast(kind).alias(name)


def typed_records(scan: CsvScan) -> DataFrame:
    """The data rows with their types and their number in the source.

    A split is met again by its place, length and task, so a file that is split in another way than in
    the first pass loses rows here rather than get wrong numbers: the caller compares the count.
    """
    named = scan.records.join(scan.splits, SPLIT)
    place = F.col(SEQUENCE) - F.col("first") - F.col("header")
    fields = named.filter(place >= 0).select(
        _fields(F.col(TEXT), len(scan.types)).alias("__fields"), (F.col("start") + place).alias("__number")
    )
    typed = [_typed(i, n, kind) for i, (n, kind) in enumerate(scan.types.items())]
    return fields.select(*typed, F.col("__number").cast("bigint").alias(ROW_NUMBER))


def read_typed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with inferred column types: one pass to infer, one to read, both by as many
    tasks as the file has splits. Quoted fields may span lines."""
    return read_numbered_csv(spark, path).drop(ROW_NUMBER)


def read_numbered_csv(spark: SparkSession, path: str, label: str = "csv") -> DataFrame:
    """The same with source-order row numbers, stored."""
    from_file, table = _stored_csv(spark, path, lambda df: store(df, label))
    from_file.discard()
    return table


def _stored_csv(spark: SparkSession, path: str, keep) -> tuple[CsvScan, DataFrame]:
    """(scan, what ``keep`` made of the rows); both passes are made again if the splits have changed."""
    for _ in range(MOST_PLANS):
        scan = scan_csv(spark, path)
        counted = Observation()
        kept = keep(typed_records(scan).observe(counted, F.count("*").alias("rows")))
        if counted.get["rows"] == scan.rows:
            return scan, kept
        scan.discard()
        discard(kept)
    raise RuntimeError("The file is split in another way each time it is read.")


METADATA = (
    "file_name string, file_path string, rows_count bigint, columns_count bigint, status string, reason string, "
    "content_length bigint, content_sha string, dataset_id bigint"
)


def ingest_csv(spark: SparkSession, path: str, target: str, catalog: DataFrame | None = None) -> DataFrame:
    """Normalise a delimited file to a numbered Parquet table; one row of metadata.

    One pass finds types and places, a second one writes the typed rows beside the target, once, and
    takes their fingerprint on the way. Then the folder is renamed to ``target``, or deleted: files of
    another extension, unreadable and empty ones are rejected with their reason, and with a catalog
    (id, rows_count, columns_count, content_length, content_sha) a file whose data one of its datasets
    has is answered with the newest such dataset. Neither leaves anything behind. Other errors (a full
    disk, a lost cluster, a target that exists) are raised, and leave no table either.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]

    def answer(status, reason=None, file_path=None, rows=None, columns=None, length=None, sha=None, dataset=None):
        return spark.createDataFrame([(name, file_path, rows, columns, status, reason, length, sha, dataset)], METADATA)

    if not name.lower().endswith(CSV_EXTENSION):
        return answer(REJECTED, EXTENSION_REASON)
    if folder_exists(spark, target):
        raise FileExistsError(f"{target} exists.")
    staging = f"{target.rstrip('/')}.{uuid.uuid4().hex}.staging"
    taken = Observation()

    def stage(rows: DataFrame) -> DataFrame:
        nonlocal taken
        taken = Observation()
        columns = [c for c in rows.columns if c != ROW_NUMBER]
        rows.observe(taken, *fingerprint_parts(columns)).write.mode("overwrite").parquet(staging)
        return spark.read.schema(rows.schema).parquet(staging)

    try:
        scan, _ = _stored_csv(spark, path, stage)
        scan.discard()
        rows, columns = scan.rows, len(scan.types)
        if not rows:
            return answer(REJECTED, EMPTY_UPLOAD_REASON, rows=0, columns=columns)
        facts = taken.get
        length, sha = rows * columns, f"{facts['hash_sum']}-{facts['second_hash_sum']}"
        known = None if catalog is None else _known(catalog, rows, columns, length, sha)
        if known is not None:
            return answer("reused", None, None, rows, columns, length, sha, known)
        move_folder(spark, staging, target)
        return answer("ingested", None, target, rows, columns, length, sha)
    except (ValueError, AnalysisException, ParseException) as error:
        return answer(REJECTED, UNREADABLE_REASON + str(error).splitlines()[0])
    except PySparkException as error:
        if not (error.getCondition() or "").startswith(READ_CONDITIONS):
            raise
        return answer(REJECTED, UNREADABLE_REASON + str(error).splitlines()[0])
    finally:
        delete_folder(spark, staging)


def _known(catalog: DataFrame, rows: int, columns: int, length: int, sha: str) -> int | None:
    """The newest dataset of a catalog with the same data."""
    same = (
        (F.col("rows_count") == rows) & (F.col("columns_count") == columns)
        & (F.col("content_length") == length) & (F.col("content_sha") == sha)
    )
    return catalog.filter(same).agg(F.max("id")).first()[0]
