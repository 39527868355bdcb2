"""Exact duplicate rows without shuffling whole rows and without collecting a group of copies."""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.scalars import quoted
from plumbline.sources.rows import ROW_NUMBER, data_columns
from plumbline.sources.storage import discard, store

# Executors need not have this package installed: its small helpers travel with each task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGEST_BYTES = 32
HELD_ROWS = 1 << 20  # digests a task sums before it sends them on: 32 MB
_DIGEST = "__digest"
_FIRST = "__first"
_HASH = "__hash"
_WORDS = "__words"
FILTER_PROBES = 3
MOST_WORDS = 1 << 20  # 8 MB; beyond 4 million repeated hashes the filter errs more often, never the other way


def _cell(df: DataFrame, name: str) -> Column:
    """NaN is a missing value, so it equals NULL; both zeros are one value."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(quoted(name)), quoted(name) + F.lit(0.0))
    return quoted(name)


def row_digest(df: DataFrame, names: list[str]) -> Column:
    """SHA-256 of the row's cells, each behind its length, missing ones marked: 32 bytes that stand for
    the row, since no two texts of this form are the same unless the cells are."""
    texts = [_cell(df, n).cast("string") for n in names]
    cells = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat_ws(",", *cells).cast("binary"), 256))


def _counted(parts: list[pa.Array]) -> pa.RecordBatch:
    """(digest, rows) of some digests; equal ones are one row unless two others share their first eight bytes."""
    digests = pa.concat_arrays(parts).cast(pa.binary(DIGEST_BYTES))
    words = np.frombuffer(digests.buffers()[1], np.uint64)[digests.offset * 4:(digests.offset + len(digests)) * 4].reshape(-1, 4)
    words = words[np.argsort(words[:, 0])]
    heads = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
    listed = pa.Array.from_buffers(pa.binary(DIGEST_BYTES), len(heads), [None, pa.py_buffer(words[heads].tobytes())])
    return pa.record_batch({_DIGEST: listed.cast(pa.binary()), "rows": pa.array(np.diff(np.append(heads, len(words))))})


def digest_counts(batches):
    """Digests with the number of their rows, summed over about ``HELD_ROWS`` at a time."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.column(0))
            rows += batch.num_rows
        if rows >= HELD_ROWS:
            yield _counted(held)
            held, rows = [], 0
    if held:
        yield _counted(held)


def duplicate_count(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row: how many rows repeat an earlier one.

    One scan and one grouping by digest. A row copied a million times is summed inside each task before
    it travels, a bounded number of rows at a time: most digests occur once, and a table of all that a
    task reads would not fit its memory and be spilled.
    """
    names = data_columns(df) if names is None else names
    digests = df.select(row_digest(df, names).alias(_DIGEST)).mapInArrow(digest_counts, f"{_DIGEST} binary, rows bigint")
    counted = digests.repartition(_DIGEST).groupBy(_DIGEST).agg((F.sum("rows") - 1).alias("repeats"))
    return counted.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicate_rows"))


def row_hash(df: DataFrame, names: list[str]) -> Column:
    """64 bits of a row, cheap: equal rows have equal hashes, and few others do."""
    return F.xxhash64(*[_cell(df, n) for n in names])


def repeated_hashes(df: DataFrame, names: list[str]) -> DataFrame:
    """(hash) of the rows' hashes that occur more than once; sixteen bytes a row travel, summed in each task."""
    counted = df.select(row_hash(df, names).alias(_HASH)).groupBy(_HASH).agg(F.count("*").alias("copies"))
    return counted.filter(F.col("copies") > 1).select(_HASH)


def _bits(value: Column, words: int) -> list[Column]:
    """The places of a hash in a filter of so many 64-bit words."""
    probes = [value, *[F.xxhash64(value, F.lit(i)) for i in range(1, FILTER_PROBES)]]
    return [p.bitwiseAND(F.lit(words * 64 - 1)) for p in probes]


def bloom_filter(hashes: DataFrame, rows: int) -> DataFrame:
    """One row, ``words``: a Bloom filter of the hashes, of 16 bits each and at most ``MOST_WORDS`` words."""
    words = min(MOST_WORDS, 1 << max(0, math.ceil(math.log2(max(1, rows / 4)))))
    places = hashes.select(F.explode(F.array(*_bits(F.col(_HASH), words))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    filled = places.groupBy(F.shiftrightunsigned("place", 6).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = hashes.sparkSession.range(words).join(filled, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", "bits"))), lambda w: w["bits"])
    return every.agg(listed.alias("words"), F.count("*").alias("size"))


def may_hold(words: Column, size: int, value: Column) -> Column:
    """Whether a filter's words have all bits of a hash."""
    tests = []
    for place in _bits(value, size):
        word = F.get(words, F.shiftrightunsigned(place, 6).cast("int"))
        tests.append(F.call_function("getbit", word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return reduce(lambda a, b: a & b, tests)


def possible_repeats(df: DataFrame) -> DataFrame:
    """The rows whose hash may occur twice, with their digest: all copies of repeated rows, and in about
    one of two hundred others the filter errs. Nothing but hashes is exchanged before them."""
    names = data_columns(df)
    hashes = store(repeated_hashes(df, names), "repeated-hashes")
    held = store(bloom_filter(hashes, hashes.count()), "repeat-filter")
    size = held.first()["size"]
    discard(hashes)
    rows = df.select(ROW_NUMBER, *[quoted(n) for n in names], row_hash(df, names).alias(_HASH))
    # One row of at most 8 MB goes to every task.
    tested = rows.join(F.broadcast(held.select(F.col("words").alias(_WORDS)))).filter(may_hold(F.col(_WORDS), size, F.col(_HASH)))
    return tested.drop(_WORDS, _HASH).withColumn(_DIGEST, row_digest(df, names))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """The repeats themselves: every copy but the first by row number.

    Hashes are counted first. A Bloom filter of the repeated ones goes to the scan, so only possible
    repeats leave it; these are stored. The first copy is a minimum per digest, pre-aggregated in each
    task, and is joined back one row a digest, so that Spark can split the rows of a hot one.
    """
    names = data_columns(df)
    rows = store(possible_repeats(df), "possible-repeats")
    firsts = (
        rows.groupBy(_DIGEST).agg(F.min(ROW_NUMBER).alias(_FIRST), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1).drop("copies")
    )
    repeats = rows.join(firsts, _DIGEST).filter(F.col(ROW_NUMBER) != F.col(_FIRST))
    return repeats.select(ROW_NUMBER, *[quoted(n) for n in names])
