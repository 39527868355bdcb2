"""Exact top-k by inner product: vectors grouped by length, pruned by local cosine thresholds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.sources.storage import store

SCALE = 1024
TOP = 10
BUCKET_ROWS = 4096
MOST_BUCKETS = 1 << 16  # beyond it buckets hold more rows, so that the list of their lengths stays small
QUERY_ROWS = 512
LARGEST = 1 << 30  # of a component's size after scaling, so that products stay whole in 64 bits
SHORT_CUT = 0.3  # local threshold above which coordinates prune better than lengths alone
FOCUS = 4  # coordinates looked at


def whole_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector of floor(scale * x)). Vectors that are null or hold null, non-finite or (beyond
    what a 64-bit product can hold) huge components take no part, nor do vectors without an id."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select("vec_id", scaled.alias("vector"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors count as followed by zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in enumerate(vectors):
        out[row, :len(vector)] = vector
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every partial sum is a whole number it can hold."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(queries.shape[1], 1)
    if bound < 2.0**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


def _survivors(query: np.ndarray, size: float, rows: np.ndarray, lengths: np.ndarray, units: np.ndarray, least: float) -> np.ndarray:
    """Rows of a bucket that may reach the score ``least`` with this query.

    The local threshold is the cosine that the bucket's longest vector needs. A low one leaves only
    lengths to prune by; a high one lets the query's largest coordinates bound the rest: with
    unit vectors, the part on these coordinates plus the product of what is left of both.
    """
    everything = np.arange(len(rows))
    if least <= 0 or size == 0:
        return everything
    cosine = least / (size * lengths[0]) if lengths[0] else math.inf
    slack = 1 + 1e-9
    if cosine > slack:
        return everything[:0]
    long_enough = int(np.searchsorted(-lengths, -least / size * (1 - 1e-9), side="right"))
    if cosine < SHORT_CUT or not long_enough:
        return everything[:long_enough]
    unit = query / size
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    seen = units[:long_enough, focus]
    rest = np.sqrt(np.maximum(1 - (seen**2).sum(axis=1), 0)) * math.sqrt(max(1 - float((unit[focus] ** 2).sum()), 0))
    bound = (seen @ unit[focus] + rest) * size * lengths[:long_enough]
    return np.flatnonzero(bound * slack + 1e-6 >= least)


def search_bucket(query_ids, queries, least, ids, rows, top: int):
    """(query, id, score) of the best ``top`` of a bucket for each query, of those scoring ``least`` or more."""
    lengths = _lengths(rows)
    order = np.argsort(-lengths, kind="stable")
    ids, rows, lengths = ids[order], rows[order], lengths[order]
    units = rows / np.maximum(lengths, 1)[:, None]
    sizes = _lengths(queries)
    found: list[tuple] = []
    full = None
    for at, query in enumerate(queries):
        chosen = _survivors(query, float(sizes[at]), rows, lengths, units, float(least[at]))
        if len(chosen) * 2 > len(rows):  # most remain: one product of the whole block serves all such queries
            if full is None:
                full = _products(queries, rows)
            scores = full[at, chosen]
        else:
            scores = _products(query[None, :], rows[chosen])[0]
        keep = (scores >= least[at]) & (ids[chosen] != query_ids[at])
        chosen, scores = chosen[keep], scores[keep]
        best = np.lexsort((ids[chosen], -scores))[:top]
        found.extend((int(query_ids[at]), int(ids[chosen[b]]), int(scores[b])) for b in best)
    return found


def _blocks(vectors: DataFrame, rows: int, label: str) -> DataFrame:
    """Vectors with ``block``: ranges of falling length of about ``rows`` vectors each."""
    total = vectors.count()
    blocks = min(MOST_BUCKETS, max(1, math.ceil(total / rows)))
    parted = vectors.repartitionByRange(blocks, F.col("length").desc(), F.xxhash64("vec_id"))
    return store(parted.withColumn("block", F.spark_partition_id()), label)


def top_products(
    vectors: DataFrame, queries: DataFrame, top: int = TOP, bucket_rows: int = BUCKET_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` vectors by inner product, itself left out,
    ties to the smaller id; all if there are fewer. Both tables have vec_id and vector of whole numbers.

    Buckets hold vectors of like length. The longest bucket is searched first and gives each query a
    score it surely reaches; with it, a query goes only to buckets whose longest vector can reach
    that score. Queries travel in blocks, so a task holds a block and a bucket whatever the size.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    width = max(vectors.agg(F.max(F.size("vector"))).first()[0] or 0, queries.agg(F.max(F.size("vector"))).first()[0] or 0)
    bucketed = _blocks(vectors.select("vec_id", length.alias("length"), "vector"), bucket_rows, "buckets")
    asked = _blocks(queries.select("vec_id", length.alias("length"), "vector"), query_rows, "asked")
    shape = bucketed.groupBy("block").agg(F.max("length").alias("longest"), F.count("*").alias("rows"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in columns})
        ids, rows = right["vec_id"].to_numpy(np.int64), _matrix(right["vector"], width)
        found: list[tuple] = []
        for begin in range(0, len(left), query_rows):
            some = left.iloc[begin:begin + query_rows]
            found += search_bucket(
                some["vec_id"].to_numpy(np.int64), _matrix(some["vector"], width), some["least"].to_numpy(np.float64), ids, rows, top
            )
        return pd.DataFrame(found, columns=columns).astype(np.int64)

    def searched(sent: DataFrame, buckets: DataFrame) -> DataFrame:
        """sent: queries with ``least``, ``part`` (their block) and ``block`` (the bucket to search)."""
        parts = sent.select(F.col("block").alias("block"), F.col("part").alias("part")).distinct()
        held = buckets.join(parts, "block")
        keys = ["block", "part"]
        pairs = sent.groupBy(*keys).cogroup(held.select(*keys, "vec_id", "vector").groupBy(*keys))
        return pairs.applyInPandas(search, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    parted = asked.withColumnRenamed("block", "part")
    head = shape.filter("rows > 0").agg(F.min("block")).first()[0]
    if head is None:
        head = 0
    everywhere = F.lit(-math.inf)
    first = store(best(searched(parted.select("vec_id", "vector", "part", F.lit(head).alias("block"), everywhere.alias("least")),
                                bucketed.filter(F.col("block") == head))), "top-first")
    surely = first.filter(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
    limits = parted.join(surely, "vec_id", "left").withColumn("least", F.coalesce("least", everywhere))
    reach = shape.filter(F.col("block") != head).select("block", "longest")
    spans = reach.agg(F.collect_list(F.struct("block", "longest")).alias("buckets"))  # one small row per bucket
    reachable = F.filter("buckets", lambda b: F.col("length") * b["longest"] * (1 + 1e-9) >= F.col("least"))
    sent = limits.join(F.broadcast(spans)).withColumn("to", F.explode(reachable)).select(
        "vec_id", "vector", "part", F.col("to.block").alias("block"), "least"
    )
    rest = searched(sent, bucketed)
    ranked = best(first.select("query_id", "vec_id", "score").unionByName(rest))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embedding_neighbours(embeddings: DataFrame, every: int = 100, top: int = TOP) -> DataFrame:
    """The vectors whose id is divisible by ``every`` as queries against all vectors."""
    vectors = store(whole_vectors(embeddings), "whole")
    return top_products(vectors, vectors.filter(F.col("vec_id") % every == 0), top)
