"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.shared import md5_block, packed, text_hash, unpacked
from plumbline.sources.storage import store

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_DIGITS = 2
RANGES_PER_DOUBLING = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def identity(df: DataFrame, source: str = "source") -> DataFrame:
    """What tells documents apart. Rows equal in all of it are one document with several rows."""
    return df.select(
        "doc_id", F.col(source).alias("source"), word_count(F.col("text")).alias("size"),
        text_hash(F.col("text")).alias("text_hash"),
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """Target words per source from (source, source_size).

    Sources in code point order, null last, take the weights in turn and share ``share`` of all words;
    none gets more than ``repeats`` times its size, and what is above goes to the others by weight.
    That ends where every uncapped source has words = weight x level: sources are taken by rising
    size per weight, and one is capped if the level of those from it on still exceeds its cap.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    ranked = sizes.withColumn("weight", F.get(cycle, (rank % len(weights)).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, later = (rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(0))
    budget = F.floor(F.sum("source_size").over(every) * F.lit(float(share))).cast("bigint")
    level = ranked.select(
        "*", budget.alias("budget"),
        F.coalesce(F.sum("cap").over(earlier), F.lit(0)).alias("given"),
        F.sum("weight").over(later).alias("open_weight"),
    )
    capped = F.col("cap") * F.col("open_weight") <= (F.col("budget") - F.col("given")) * F.col("weight")
    marked = level.withColumn("capped", capped)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * rest).cast("double") / open_weight.cast("double")
    )
    return marked.select("source", "source_size", "weight", "budget", target.alias("target"))


def queue(documents: DataFrame, targets: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Virtual finish times: one row per document and repeat.

    Documents stand in a source in the order of their MD5; a repeat follows when all stood once.
    finish = words of the source up to the document's end / the source's target, so at time 1 each
    source has given its target. The running sum goes over blocks of MD5 digits: blocks are summed
    first, so a source with a third of all rows is spread like the others.
    """
    blocks = documents.filter(F.col("size") > 0).withColumn("block", md5_block(F.col("doc_id"), BLOCK_DIGITS))
    words = F.col("size") * F.col("rows")
    sums = blocks.groupBy("source", "block").agg(F.sum(words).alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("block").alias("b"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"),
    ).join(targets.withColumnRenamed("source", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    order = [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("doc_id"), F.col("size"), F.col("text_hash")]
    inside = Window.partitionBy("source", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumn("inside", F.sum(words).over(inside)).join(
        starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    )
    turns = summed.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    done = F.col("repeat") * F.col("source_size") + F.col("start") + F.col("inside")
    return turns.select(
        "doc_id", "source", "size", "text_hash", "rows", "repeat", "budget",
        (done.cast("double") / F.col("target")).alias("finish"),
    ).filter(F.col("finish").isNotNull())


def mix(queued: DataFrame) -> DataFrame:
    """The queue by finish time, cut where the words reach the budget.

    Finish times fall into ranges (a fixed number per doubling). Ranges are summed first; only the
    range in which the budget ends is ordered row by row.
    """
    spread = queued.withColumn("range", F.floor(F.log2("finish") * RANGES_PER_DOUBLING))
    words = F.col("size") * F.col("rows")
    sums = spread.groupBy("range").agg(F.sum(words).alias("words"), F.first("budget").alias("budget"))
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        sums.withColumn("total", F.sum("words").over(up_to)).filter(F.col("total") > F.col("budget"))
        .orderBy("range").limit(1).select(F.col("range").alias("cut"), (F.col("total") - F.col("words")).alias("base"))
    )
    edges = spread.join(F.broadcast(cut), F.lit(True), "left")  # one row
    whole = edges.filter(F.col("cut").isNull() | (F.col("range") < F.col("cut")))
    order = [F.col("finish"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("doc_id"),
             F.col("repeat"), F.col("size"), F.col("text_hash")]
    last = edges.filter(F.col("range") == F.col("cut")).withColumn(
        "inside", F.sum(words).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ).filter(F.col("base") + F.col("inside") <= F.col("budget"))
    kept = [c for c in queued.columns if c != "budget"]
    return whole.select(*kept).unionByName(last.select(*kept)).orderBy("finish")


def mixed_counts(documents: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """Per document (rows equal in doc_id, source and text together): size, its source's size and
    target, and ``copies``, how often the mix takes it (0 to ``repeats``).

    Null sources are a source, null or blank texts have size 0 and are never taken, a source
    without words has target 0. Empty tables give empty tables.
    """
    found = store(identity(documents).groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows")), "mix")
    sizes = found.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = store(source_targets(sizes, weights, repeats, share), "mix-targets")
    taken = mix(queue(found, targets, repeats)).groupBy("doc_id", "source", "size", "text_hash").agg(
        F.count("*").alias("copies")
    )
    key = ["doc_id", "source", "size", "text_hash"]
    right = taken.select(*[F.col(c).alias(f"_{c}") for c in key], "copies")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    joined = found.join(right, [*same], "left").drop(*[f"_{c}" for c in key])
    facts = targets.select(F.col("source").alias("_s"), "source_size", "target")
    return joined.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn(
        "copies", F.coalesce("copies", F.lit(0)).cast("bigint")
    )


def mixed_documents(documents: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, share: float = 1.0) -> DataFrame:
    """The documents of the mix: every one as often as the mix takes it, all columns kept."""
    counts = mixed_counts(documents, weights, repeats, share).filter("copies > 0")
    right = counts.select(F.col("doc_id").alias("id"), F.col("source").alias("origin"), F.col("text_hash").alias("hash"), "copies")
    rows = packed(documents, doc_id=F.col("doc_id"), source=F.col("source"), key=text_hash(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & F.col("source").eqNullSafe(F.col("origin")) & (F.col("key") == F.col("hash"))
    turns = rows.join(right, same).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return turns.select(*unpacked(turns))
