"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.sources.storage import new_path, store

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
# Fixed values of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CELL_BYTES = 1 << 16


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are eight groups of 20 bits, four letters each."""
    digest = F.sha1(data)
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)))
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line breaks in a value become blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with ``_digest``, ``_bytes`` and ``_refers``: of payloads that are equal (length and SHA-1)
    and have ``least_bytes`` or more, the largest page_id is the response, the others refer to it.

    Groups are combined in each task and digests that occur twice are stored, so that Spark knows their
    size and moves the pages only where they are many; a payload that a third of all pages share is
    then one row against many, which Spark can split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    known = pages.select("page_id", "url", "html", base32_sha1(payload).alias("_digest"), F.octet_length(payload).cast("bigint").alias("_bytes"))
    groups = known.filter(F.col("_bytes") >= least_bytes).groupBy("_digest", "_bytes").agg(
        F.max("page_id").alias("_newest"), F.count("*").alias("_pages")
    ).filter("_pages > 1").drop("_pages")
    groups = store(groups, "warc-revisits")
    joined = known.join(groups, ["_digest", "_bytes"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_newest")) & F.col("_newest").isNotNull(), F.col("_newest"))
    return joined.select("page_id", "url", "html", "_digest", "_bytes", refers.alias("_refers"))


def record_text(pages: DataFrame) -> DataFrame:
    """One string per record without its closing line breaks."""
    revisit = F.col("_refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.col("_bytes")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce(F.col("html"), F.lit(""))))
    built = pages.withColumn("_block", block)
    header = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        _line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("_refers")))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        _line("Content-Length", F.octet_length(F.col("_block"))),
        F.lit("\r\n"),
    )
    return built.select(F.concat(header, F.col("_block")).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One record per page (page_id, url, html); a null html is an empty payload. A file per task,
    through Spark's committer, so tasks that are lost or run twice leave no half files."""
    record_text(with_revisits(pages, least_bytes)).write.option("lineSep", END).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archive cut at every magic: file, block (start of the split), seq (order in it), value.

    The magic cannot overlap itself, so splits of any size cut alike.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )


def _with_offsets(pieces: DataFrame, size: Column) -> DataFrame:
    """Add ``at``, where a piece starts in its file: sums of splits, then sums inside each split."""
    step = size + F.lit(len(MAGIC))
    sums = pieces.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("inside", F.coalesce(F.sum(step).over(inside), F.lit(0)))
    return placed.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("inside")).drop("base", "inside")


def _field(header: Column, name: str, value: str = r"([^\r\n]*)") -> Column:
    found = F.regexp_extract(header, rf"(?:^|\n)(?i:{name}):[ \t]*{value}", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> dict[str, Column]:
    """What a piece says if it is a record: its header's fields and the payload, as far as the piece has it."""
    header = F.substring_index(value, END, 1)
    head_bytes = F.octet_length(header).cast("bigint")
    body = value.cast("binary")
    length = _field(header, "Content-Length", r"(\d{1,15})[ \t]*(?:\r|\n|$)").cast("bigint")
    http_bytes = F.octet_length(F.substring_index(value, END, 2)).cast("bigint") + len(END)
    payload = F.substr(body, (http_bytes + 1).cast("int"), F.greatest(head_bytes + len(END) + length - http_bytes, F.lit(0)).cast("int"))
    return {
        "length": length,
        "record_bytes": head_bytes + len(END) + length + len(END),
        "kind": _field(header, "WARC-Type"),
        "page": _field(header, "WARC-Record-ID", r"<urn:page:(-?\d*)>").cast("bigint"),
        "refers": _field(header, "WARC-Refers-To", r"<urn:page:(-?\d*)>").cast("bigint"),
        "digest": _field(header, "WARC-Payload-Digest", r"sha1:([A-Z2-7]{32})"),
        "declared": _field(F.substring_index(F.substring_index(value, END, 2), END, -1), "Content-Length", r"(\d{1,15})").cast("bigint"),
        "payload_bytes": F.octet_length(payload).cast("bigint"),
        "payload_digest": base32_sha1(payload),
    }


def _jump(at: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For sorted offsets with successors: where each chain first leaves the given offsets.

    Pointer jumping: every round doubles the stride, so a chain of n records takes log2(n) rounds.
    """
    if not len(at):
        return following
    place = np.searchsorted(at, following)
    held = (place < len(at)) & (at[np.minimum(place, len(at) - 1)] == following)
    target = np.where(held, place, np.arange(len(at)))  # the last of a chain points at itself
    while True:
        further = target[target]
        if np.array_equal(further, target):
            return following[target]
        target = further


def _reachable(at: np.ndarray, following: np.ndarray, entry: int) -> np.ndarray:
    """Offsets on the chain from an entry, by pointer jumping over the set reached so far."""
    reached = at == entry
    place = np.searchsorted(at, following)
    held = (place < len(at)) & (at[np.minimum(place, max(len(at) - 1, 0))] == following) if len(at) else reached
    target = np.where(held, place, len(at))  # one past the end: nowhere
    target = np.append(target, len(at))
    reached = np.append(reached, False)
    while True:
        more = reached.copy()
        more[target[np.flatnonzero(reached)]] = True
        more[-1] = False
        target_next = target[target]
        if np.array_equal(more, reached) and np.array_equal(target_next, target):
            return reached[:-1]
        reached, target = more, target_next


def true_records(candidates: DataFrame) -> DataFrame:
    """Of (file, block, at, next) the candidates that the chain from offset 0 of their file reaches.

    Each split follows its chains to where they leave it; jumps between splits are joined and doubled
    until no new split is entered; then each split marks what its entries reach. A task holds the
    candidates of one split.
    """
    def leave(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        return frame.assign(next=_jump(frame["at"].to_numpy(np.int64), frame["next"].to_numpy(np.int64)))

    schema = "file string, block long, at long, next long"
    exits = store(candidates.groupBy("file", "block").applyInPandas(leave, schema), "warc-exits")
    entered = exits.select("file", F.col("next").alias("at")).distinct()
    jumps = store(exits.join(entered, ["file", "at"], "left_semi").unionByName(exits.filter("at = 0")).distinct().select("file", "at", "next"), "warc-jumps")
    reached = store(exits.filter("at = 0").select("file", "at"), "warc-reached")
    count = reached.count()
    while True:
        stepped = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = store(reached.union(stepped).distinct(), "warc-reached")
        further = jumps.select("file", "at", F.col("next").alias("via")).join(
            jumps.select("file", F.col("at").alias("via"), "next"), ["file", "via"]
        ).select("file", "at", "next")
        jumps = store(further, "warc-jumps")
        before, count = count, reached.count()
        if count == before:
            break
    entries = exits.join(reached, ["file", "at"], "left_semi").select("file", "block", "at")

    def mark(frame: pd.DataFrame, doors: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        at, following = frame["at"].to_numpy(np.int64), frame["next"].to_numpy(np.int64)
        kept = np.zeros(len(frame), bool)
        for door in doors["at"]:
            kept |= _reachable(at, following, door)
        return frame[kept][["file", "block", "at", "next"]]

    return candidates.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInPandas(mark, schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, at (offset of its magic), kind, page, refers, payload_bytes and
    payload_digest (of the payload as read; a revisit's as its header declares).

    Every magic gives a candidate, also one inside a payload; only candidates on the chain from a
    file's start are records. A payload that holds a magic is put together from its pieces.
    """
    pieces = _pieces(spark, path)
    facts = pieces.select("file", "block", "seq", F.octet_length("value").cast("bigint").alias("size"), *[c.alias(n) for n, c in _parsed(F.col("value")).items()])
    stored = store(facts, "warc-pieces")
    placed = _with_offsets(stored, F.col("size")).filter(F.col("at") > 0)
    found = store(placed.withColumn("at", F.col("at") - len(MAGIC)), "warc-candidates")
    possible = found.filter(F.col("record_bytes").isNotNull())
    chain = possible.select("file", "block", "at", (F.col("at") + len(MAGIC) + F.col("record_bytes")).alias("next"))
    records = store(possible.join(true_records(chain).select("file", "at"), ["file", "at"]), "warc-records")
    columns = ["file", "at", "kind", "page", "refers", "payload_bytes", "payload_digest"]
    revisit = F.col("kind") == "revisit"
    declared = records.withColumn("payload_bytes", F.when(revisit, F.col("declared")).otherwise(F.col("payload_bytes"))).withColumn(
        "payload_digest", F.when(revisit, F.col("digest")).otherwise(F.col("payload_digest"))
    )
    in_one = revisit | (F.col("size") >= F.col("record_bytes") - len(END))
    cut = records.filter(~in_one).select("file", "at", F.col("record_bytes").alias("bytes"), "kind", "page", "refers")
    whole = declared.filter(in_one).select(*columns)
    return whole if cut.isEmpty() else whole.unionByName(_reassembled(pieces, cut).select(*columns))


def _reassembled(pieces: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds a magic, from the pieces of their files. Pieces find their record
    through the cells of 64 KiB that it touches."""
    affected = pieces.join(cut.select("file").distinct(), "file", "left_semi")
    placed = _with_offsets(affected, F.octet_length("value").cast("bigint")).withColumn("place", F.col("at") - len(MAGIC)).drop("at")
    cells = cut.withColumn("end", F.col("at") + len(MAGIC) + F.col("bytes")).withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("at") / CELL_BYTES), F.floor(F.col("end") / CELL_BYTES)))
    )
    parts = placed.withColumn("cell", F.floor(F.col("place") / CELL_BYTES)).join(cells, ["file", "cell"])
    parts = parts.filter((F.col("place") >= F.col("at")) & (F.col("place") < F.col("end")))
    ordered = F.array_sort(F.collect_list(F.struct("place", "value")))  # the pieces of one record
    joined = parts.groupBy("file", "at", "kind", "page", "refers").agg(
        F.array_join(F.transform(ordered, lambda p: p["value"]), MAGIC).alias("value")
    )
    return joined.select("file", "at", "kind", "page", "refers", *[_parsed(F.col("value"))[n].alias(n) for n in ("payload_bytes", "payload_digest")])


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Pages equal in id and payload are all responses; pages without an id are responses only where no
    page with an id has the payload. An empty table gives an empty archive and no rows.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least_bytes)
    found = read_archives(pages.sparkSession, path)
    return found.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))
