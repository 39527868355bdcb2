"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.sources.storage import discard, store


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _lowest(pairs: DataFrame) -> DataFrame:
    """(a, low): the least of a and its neighbours. Combined in each task, so a hub is no hot group."""
    return pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("low"))


def _large_star(links: DataFrame) -> DataFrame:
    pairs = _both_ways(links)
    linked = pairs.filter(F.col("b") > F.col("a")).join(_lowest(pairs), "a")
    return linked.select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(_lowest(down), "a")
    moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(joined.select("a", F.col("low").alias("b")))


def _state(links: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count("*"), F.sum(mixed)).first())


def component_roots(links: DataFrame) -> DataFrame:
    """(a, b): every linked node but the least of its component, with that least node.

    ``links`` has bigint columns a and b; order and repeats do not matter, loops are left out. Each
    round is written to the shared folder and read by the next until nothing changes any more.
    """
    links = store(links.filter("a <> b").distinct(), "links")
    before = _state(links)
    while True:
        moved = _small_star(_large_star(links)).filter("a <> b").distinct()
        following = store(moved, "stars")
        discard(links)
        links, after = following, _state(following)
        if after == before:
            return links
        before = after
