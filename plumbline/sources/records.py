"""Delimited text as records, in many tasks: lines, put together where a quoted field spans them.

Only a quote that opens a field, and the one that closes it, count; any other quote is text. So what
a line does depends on whether it begins inside a quoted field, and a line is a function of that one
bit. The functions of a split's lines are composed, a running composition over the splits says which
of them begin inside a field, and each task then cuts its own split. Only the pieces of the records
that cross a border between splits, at most two a split, are brought together.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.sources.storage import discard, store

# Executors need not have this package installed: the cutter travels with its tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXT, PATH, BLOCK, LENGTH, PART, SEQUENCE = "__text", "__path", "__block", "__length", "__part", "__sequence"
SPLIT = [PATH, BLOCK, LENGTH, PART]
CODE, INSIDE, INDEX, KIND = "__code", "__inside", "__index", "__kind"
PLAIN = 2  # the code of a line that ends inside a field exactly where it begins inside one
WHOLE, HEAD, TAIL, MIDDLE = range(4)  # a record, and the last, first or inner piece of one
UNCLOSED_REASON = "A quoted field is not closed."


def _behind(line: Column, inside: bool) -> Column:
    """1 where a line that begins inside a quoted field, or not, ends inside one, else 0.

    The states at its quotes: 0 outside, 1 inside, 2 behind a quote that closes the field unless
    another one follows at once.
    """
    pieces = F.split(line, '"')
    first = F.element_at(pieces, 1)
    opened = F.lit(2) if inside else F.when((first == "") | F.endswith(first, F.lit(",")), 1).otherwise(0)

    def step(state: Column, piece: Column) -> Column:
        opens = F.when(F.endswith(piece, F.lit(",")), 1).otherwise(0)
        return F.when(state == 1, 2).when((state == 2) & (piece == ""), 1).otherwise(opens)

    last = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces) - 2), opened, step)
    return F.when(last == 1, 1).otherwise(0)


def line_code(line: Column) -> Column:
    """What a line does: the bit behind it if it begins outside a field, plus twice that if inside."""
    quoted = F.contains(line, F.lit('"'))
    return F.when(quoted, _behind(line, False) + 2 * _behind(line, True)).otherwise(F.lit(PLAIN)).cast("byte")


def _lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        F.col("value").alias(TEXT), F.col("_metadata.file_path").alias(PATH),
        F.col("_metadata.file_block_start").alias(BLOCK), F.col("_metadata.file_block_length").alias(LENGTH),
    )


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line that is not blank of a file, of the first one listed."""
    lines = line_records(spark, path)
    row = lines.filter(F.col(BLOCK) == 0).select(TEXT).first() or lines.orderBy(PATH, BLOCK, SEQUENCE).select(TEXT).first()
    return row[0] if row else None


def line_records(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is not blank as a record: its text, split and place in the task. Right where no
    quoted field spans lines."""
    return _lines(spark, path).filter(F.trim(TEXT) != "").select(
        TEXT, PATH, BLOCK, LENGTH, F.spark_partition_id().cast("bigint").alias(PART), F.monotonically_increasing_id().alias(SEQUENCE)
    )


def split_states(lines: DataFrame) -> DataFrame:
    """(path, block, length, inside, ends_inside), one row a split, from lines with their codes.

    The lines whose code is not ``PLAIN`` are composed within their split. Over the splits of a file the
    bit is that of the last split which sets it whatever it was, turned by the splits since that turn it.
    """
    bent = F.when(F.col(CODE) != PLAIN, F.struct(SEQUENCE, CODE))
    composed = lines.groupBy(PATH, BLOCK, LENGTH).agg(F.sort_array(F.collect_list(bent)).alias("bent"))

    def behind(start: int) -> Column:
        return F.aggregate("bent", F.lit(start), lambda s, x: F.when(s == 0, x[CODE] % 2).otherwise(F.floor(x[CODE] / 2)).cast("int"))

    effects = composed.select(PATH, BLOCK, LENGTH, behind(0).alias("from_out"), behind(1).alias("from_in"))
    order = Window.partitionBy(PATH).orderBy(BLOCK)
    turned = effects.withColumn("turns", F.sum(((F.col("from_out") == 1) & (F.col("from_in") == 0)).cast("int")).over(order))
    setting = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").alias("bit"), "turns"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = turned.withColumn("set", F.last(setting, ignorenulls=True).over(earlier)).withColumn(
        "turned", F.coalesce(F.lag("turns").over(order), F.lit(0))
    )
    bit = (F.coalesce(F.col("set.bit"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("set.turns"), F.lit(0))) % 2
    started = placed.withColumn(INSIDE, bit == 1)
    ends = F.when(F.col(INSIDE), F.col("from_in")).otherwise(F.col("from_out")) == 1
    return started.select(PATH, BLOCK, LENGTH, INSIDE, ends.alias("ends_inside"))


def bits_behind(codes: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each of the lines ends inside a field, if the first begins as given."""
    bent = np.flatnonzero(codes != PLAIN)
    own = codes[bent]
    turns = np.cumsum(own == 1)
    last_set = np.maximum.accumulate(np.where(own != 1, np.arange(len(bent)), -1))
    bits = np.where(last_set >= 0, own[last_set] == 3, inside) ^ ((turns - np.where(last_set >= 0, turns[last_set], 0)) % 2 == 1)
    place = np.searchsorted(bent, np.arange(len(codes)), "right") - 1
    return np.where(place >= 0, bits[place], inside) if len(bent) else np.full(len(codes), inside)


@dataclass
class SplitCutter:
    """Cuts the lines of one split, given in order and in parts, into records."""

    path: str
    block: int
    inside: bool
    index: int = 0
    open: list = field(default_factory=list)  # lines of a record that has not ended
    headless: bool = False  # it began in an earlier split
    rows: list = field(default_factory=list)

    def __post_init__(self):
        self.pending = self.headless = self.inside

    def _emit(self, texts: pa.Array, kind: int):
        if kind == WHOLE:
            texts = texts.filter(pc.not_equal(pc.utf8_trim_whitespace(texts), ""))
        numbered = kind in (WHOLE, TAIL)
        count = len(texts)
        self.rows.append(pa.record_batch([
            pa.array([self.path] * count, pa.string()), pa.array(np.full(count, self.block)),
            pa.array(np.arange(self.index, self.index + count) if numbered else np.full(count, -1)),
            pa.array(np.full(count, kind, np.int32)), texts.cast(pa.string()),
        ], names=[PATH, BLOCK, INDEX, KIND, TEXT]))
        self.index += count if numbered else 0

    def _emit_open(self, kinds: tuple[int, int]):
        text = "\n".join(line for part in self.open for line in part.to_pylist())
        self._emit(pa.array([text], pa.string()), kinds[self.headless])
        self.open, self.pending, self.headless = [], False, False

    def feed(self, lines: pa.Array, codes: np.ndarray):
        behind = bits_behind(codes, self.inside)
        starts = np.flatnonzero(~np.append(self.inside, behind[:-1]))
        self.inside = bool(behind[-1])
        first = int(starts[0]) if len(starts) else len(lines)
        if first:
            self.open.append(lines.slice(0, first))
        if self.pending and (len(starts) or not self.inside):
            self._emit_open((WHOLE, HEAD))
        if not len(starts):
            return
        offsets = np.append(starts, len(lines)).astype(np.int32)
        if self.inside:
            self.open, self.pending = [lines.slice(int(starts[-1]))], True
            offsets = offsets[:-1]
        if len(offsets) > 1:
            self._emit(pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n"), WHOLE)

    def close(self):
        if self.pending:
            self._emit_open((TAIL, MIDDLE))

    def taken(self):
        rows, self.rows = self.rows, []
        return rows


CUT = f"{PATH} string, {BLOCK} bigint, {INDEX} bigint, {KIND} int, {TEXT} string"


def cut_lines(batches):
    """Records and pieces of records of a task's splits, from its lines in order."""
    cutter = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if batch.column(INSIDE).null_count:
            raise RuntimeError("The file was split in another way than when its lines were looked at.")
        paths, blocks = batch.column(PATH), batch.column(BLOCK).to_numpy()
        changes = (blocks[1:] != blocks[:-1]) | pc.not_equal(paths.slice(1), paths.slice(0, len(paths) - 1)).to_numpy(zero_copy_only=False)
        marks = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        codes = batch.column(CODE).to_numpy()
        for start, stop in zip(marks, marks[1:]):
            path, block = paths[start].as_py(), int(blocks[start])
            if cutter is None or (cutter.path, cutter.block) != (path, block):
                if cutter is not None:
                    cutter.close()
                    yield from cutter.taken()
                cutter = SplitCutter(path, block, batch.column(INSIDE)[start].as_py())
            cutter.feed(batch.column(TEXT).slice(start, stop - start), codes[start:stop])
            yield from cutter.taken()
    if cutter is not None:
        cutter.close()
        yield from cutter.taken()


def cut_records(spark: SparkSession, path: str) -> DataFrame:
    """Records whose quoted fields may span lines, stored: text, split and place in the split.

    The file is read twice, by as many tasks as it has splits; one row a split goes to all tasks. A
    field that is never closed raises a ValueError.
    """
    lines = _lines(spark, path, "\n").withColumn(SEQUENCE, F.monotonically_increasing_id()).withColumn(CODE, line_code(F.col(TEXT)))
    states = store(split_states(lines), "csv-splits")
    ends = states.groupBy(PATH).agg(F.max_by("ends_inside", BLOCK).alias("unclosed"))
    if not ends.filter("unclosed").isEmpty():
        discard(states)
        raise ValueError(UNCLOSED_REASON)
    known = F.broadcast(states.select(PATH, BLOCK, LENGTH, INSIDE))
    cut = store(lines.drop(SEQUENCE).join(known, [PATH, BLOCK, LENGTH], "left").mapInArrow(cut_lines, CUT), "csv-cut")
    discard(states)
    pieces = cut.filter(F.col(KIND) != WHOLE).withColumn("late", (F.col(KIND) == TAIL).cast("int"))
    begun = Window.partitionBy(PATH).orderBy(BLOCK, "late")  # at most two rows a split
    chained = pieces.withColumn("chain", F.last(F.when(F.col(KIND) == TAIL, F.col(BLOCK)), ignorenulls=True).over(begun))
    joined = chained.groupBy(PATH, "chain").agg(
        F.max(INDEX).alias(INDEX), F.sort_array(F.collect_list(F.struct(BLOCK, TEXT))).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p[TEXT]), "\n")
    whole = cut.filter(F.col(KIND) == WHOLE).select(PATH, BLOCK, INDEX, TEXT)
    records = whole.unionAll(joined.select(PATH, F.col("chain").alias(BLOCK), INDEX, text.alias(TEXT)))
    clean = F.when(F.endswith(TEXT, F.lit("\r")), F.expr(f"left({TEXT}, length({TEXT}) - 1)")).otherwise(F.col(TEXT))
    zero = F.lit(0).cast("bigint")
    return records.select(clean.alias(TEXT), PATH, BLOCK, zero.alias(LENGTH), zero.alias(PART), F.col(INDEX).alias(SEQUENCE))
