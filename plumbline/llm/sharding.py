"""Jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.shared import md5_block, packed, unpacked
from plumbline.sources.storage import store

# Fixed value: the multiplier of the published jump hash's generator.
JUMP_MULTIPLIER = 2862933555777941757
MASK = 0xFFFFFFFF
SHORT_WALK = 12
SLOT_DIGITS = 2


def _next_state(high: Column, low: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 in 32-bit halves: no product leaves the range of a long."""
    m_low, m_high = JUMP_MULTIPLIER & MASK, JUMP_MULTIPLIER >> 32
    first = low.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_low) + F.lit(1)
    second = F.shiftrightunsigned(low, 16) * F.lit(m_low)
    whole = first + F.shiftleft(second.bitwiseAND(F.lit(0xFFFF)), 16)
    carry = F.shiftrightunsigned(whole, 32) + F.shiftrightunsigned(second, 16)
    upper = F.shiftleft((F.shiftrightunsigned(high, 16) * F.lit(m_low)).bitwiseAND(F.lit(0xFFFF)), 16)
    total = carry + high.bitwiseAND(F.lit(0xFFFF)) * F.lit(m_low) + upper + low * F.lit(m_high)
    return total.bitwiseAND(F.lit(MASK)), whole.bitwiseAND(F.lit(MASK))


def _walk(key: Column, shards: int, steps: int) -> Column:
    """(last bucket, next jump) after at most ``steps`` jumps, or fewer once beyond the last shard."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(MASK)).alias("high"),
        key.bitwiseAND(F.lit(MASK)).alias("low"),
        F.lit(-1).cast("bigint").alias("bucket"),
        F.lit(0).cast("bigint").alias("jump"),
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _next_state(state["high"], state["low"])
        span = F.lit(2147483648.0) / (F.shiftrightunsigned(high, 1) + F.lit(1)).cast("double")
        moved = F.struct(
            high.alias("high"),
            low.alias("low"),
            state["jump"].alias("bucket"),
            F.floor((state["jump"] + F.lit(1)).cast("double") * span).cast("bigint").alias("jump"),
        )
        return F.when(state["jump"] < F.lit(shards), moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a bigint key, 0 to shards - 1. A null key counts as key 0.

    A jump moves at least one shard on, so ``shards`` steps always end the walk; nearly all keys
    need about ln(shards) steps, and only the others take the long walk.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    quick = _walk(key, shards, min(shards, SHORT_WALK))
    if shards > SHORT_WALK:
        done = quick["jump"] >= F.lit(shards)
        return F.when(done, quick["bucket"]).otherwise(_walk(key, shards, shards)["bucket"]).cast("int")
    return quick["bucket"].cast("int")


def stable_key(column: Column, kind: str) -> Column:
    """A bigint key: whole numbers as they are, any other type by its hash."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    return column.cast("bigint") if whole else F.xxhash64(column)


def assign_shards(df: DataFrame, key: str, shards: int, shard: str = "shard") -> DataFrame:
    """Add the shard of every row by its key, in place: no shuffle, and rows of equal keys together.

    With one more shard a row either stays or moves into the new one. An existing column of the
    name ``shard`` is replaced. Empty tables give empty tables.
    """
    return df.withColumn(shard, jump_shard(stable_key(df[key], dict(df.dtypes)[key]), shards))


def with_slots(df: DataFrame, key: str, ties: list[str], shard: str = "shard") -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each shard, in order of the key's MD5, then ties.
    An existing column of that name is replaced.

    A shard is split into blocks of the MD5's leading digits. Blocks are counted first (combined in
    each task) and numbered by themselves, so no task holds a shard. ``df`` is read twice: store it
    if it is costly. The offsets have the rows' own partitioning, so joining them moves nothing.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    parts = {f"tie{i}": F.col(name) for i, name in enumerate([key, *ties])}
    rows = packed(df, shard=F.col(shard), block=md5_block(F.col(key), SLOT_DIGITS), digest=digest, **parts)
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("count"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("shard", "block").orderBy("digest", *parts)
    joined = rows.withColumn("rank", F.row_number().over(inside)).join(offsets, ["shard", "block"])
    return joined.select(*unpacked(joined, ("slot",)), (F.col("before") + F.col("rank") - 1).cast("bigint").alias("slot"))


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 16 for the record's frame; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("bigint")


def shard_table(documents: DataFrame, shards: int) -> DataFrame:
    """One row per document: size, CRC-32 of the text (null: of no bytes), shard, slot and the shard
    it would have with one shard more. The law is ``key``: doc_id and the number of shards decide."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    facts = documents.select("doc_id", text_size(F.col("text")).alias("size"), crc.alias("text_crc32"))
    placed = assign_shards(assign_shards(facts, "doc_id", shards), "doc_id", shards + 1, "grown_shard")
    stored = store(placed, "shards")
    numbered = with_slots(stored, "doc_id", ["size", "text_crc32"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
