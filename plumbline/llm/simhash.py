"""SimHash near-duplicates: fingerprints in a vantage-point tree of shards."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.components import component_roots
from plumbline.llm.shared import packed, share, text_hash, unpacked
from plumbline.sources.storage import store

SHINGLE_WORDS = 3
MOST_BITS = 2
SEED = 42
SLICE_SHINGLES = 1 << 16
SHARD_ROWS = 1 << 15  # fingerprints that live in a shard
VISITOR_ROWS = 1 << 18  # fingerprints that look for neighbours in one task
SAMPLE_ROWS = 1 << 13  # bounds what the driver reads to choose vantage points
SAMPLE_PER_SHARD = 16
LEAF_ROWS = 256
PAIR_CELLS = 1 << 22


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash as a signed number; null and blank texts have 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    count = max(1, len(words) - size + 1)
    width = min(size, len(words))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, count, SLICE_SHINGLES):
        part = range(at, min(at + SLICE_SHINGLES, count))
        hashes = b"".join([digest(joined[starts[i]:ends[i + width - 1] - 1], SEED) for i in part])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, size: int = SHINGLE_WORDS) -> Column:
    @F.pandas_udf("bigint")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, size) for t in texts], dtype="int64")

    return prints.asNondeterministic()(text)


def _distance(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


@dataclass(frozen=True)
class Node:
    """Fingerprints at most ``radius`` from ``vantage`` lie near, the others far. Leaves are shards."""

    shard: int = -1
    vantage: int = 0
    radius: int = 0
    near: "Node | None" = None
    far: "Node | None" = None


def _choose(points: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """The vantage point, of some spread over the points, whose ball parts them with the least overlap."""
    best = None
    for at in np.unique(np.linspace(0, len(points) - 1, 16).astype(int)):
        away = _distance(points, points[at])
        for radius in np.unique(np.quantile(away, [0.35, 0.45, 0.5, 0.55, 0.65]).astype(int)):
            share = np.mean(away <= radius)
            if 0.2 <= share <= 0.8:
                overlap = np.mean((away >= radius + 1 - MOST_BITS) & (away <= radius + MOST_BITS))
                cost = overlap + abs(share - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, points[at], int(radius), away)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int) -> Node:
    """A tree of about ``shards`` leaves over a sample of fingerprints (uint64)."""
    numbers = iter(range(1 << 30))

    def grow(points: np.ndarray, leaves: int) -> Node:
        chosen = _choose(points) if leaves > 1 and len(points) > 1 else None
        if chosen is None:
            return Node(shard=next(numbers))
        vantage, radius, away = chosen
        near = away <= radius
        share = min(leaves - 1, max(1, round(leaves * float(near.mean()))))
        return Node(-1, int(vantage), radius, grow(points[near], share), grow(points[~near], leaves - share))

    return grow(sample, shards)


def route(tree: Node, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of every shard that a fingerprint's ball of ``bits`` may reach into: by the
    triangle inequality a neighbour's distance from a vantage point differs by ``bits`` at most."""
    rows, shards, homes = [], [], []

    def descend(node: Node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node.near is None:
            rows.append(at), shards.append(np.full(len(at), node.shard)), homes.append(home)
            return
        away = _distance(prints[at], np.uint64(node.vantage))
        near, far = away <= node.radius + bits, away > node.radius - bits
        descend(node.near, at[near], home[near] & (away[near] <= node.radius))
        descend(node.far, at[far], home[far] & (away[far] > node.radius))

    descend(tree, np.arange(len(prints)), np.ones(len(prints), bool))
    return (np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)) if rows else (
        np.empty(0, int), np.empty(0, int), np.empty(0, bool))


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hook the sets of a[i] and b[i] together, the lower number winning, until none differ."""
    while len(a):
        x, y = labels[a], labels[b]
        while not (np.array_equal(x, labels[x]) and np.array_equal(y, labels[y])):
            x, y = labels[x], labels[y]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))


def local_links(home: np.ndarray, visitors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between home fingerprints and all visitors (home ones included).

    A vantage-point tree over the home fingerprints leads the visitors to leaves; there all pairs of a
    visitor and a resident are compared, a slice at a time, and joined in a forest, never listed.
    """
    points = np.unique(np.concatenate([home, visitors]))
    labels = np.arange(len(points))
    tree = build_tree(home[np.argsort(home * np.uint64(0x9E3779B97F4A7C15))], max(1, len(home) // LEAF_ROWS))
    at, leaf, _ = route(tree, home, 0)
    look, reached, _ = route(tree, visitors, bits)
    order, looking = np.argsort(leaf, kind="stable"), np.argsort(reached, kind="stable")
    at, leaf, look, reached = at[order], leaf[order], look[looking], reached[looking]
    home_at, visitor_at = np.searchsorted(points, home), np.searchsorted(points, visitors)
    for number in np.unique(leaf):
        mine = at[slice(*np.searchsorted(leaf, [number, number + 1]))]
        theirs = look[slice(*np.searchsorted(reached, [number, number + 1]))]
        step = max(1, PAIR_CELLS // len(mine))
        for begin in range(0, len(theirs), step):
            some = theirs[begin:begin + step]
            close = np.bitwise_count(visitors[some][:, None] ^ home[mine][None, :]) <= bits
            i, j = np.nonzero(close)
            a, b = visitor_at[some[i]], home_at[mine[j]]
            _merge(labels, a[a != b], b[a != b])
    while not np.array_equal(labels, labels[labels]):
        labels = labels[labels]
    linked = labels != np.arange(len(points))
    return points[linked], points[labels[linked]]


def near_links(prints: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``bits`` of each other, and no more
    than one per fingerprint and shard. ``prints`` has distinct bigint ``fp``."""
    spark = prints.sparkSession
    total = prints.count()
    shards = min(max(1, math.ceil(total / SHARD_ROWS)), SAMPLE_ROWS // SAMPLE_PER_SHARD)
    sample = prints.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).toArrow()["fp"]
    tree = build_tree(sample.to_numpy().astype(np.int64).view(np.uint64), shards)
    shared = share(spark, tree)

    def send(batches):
        for batch in batches:
            fps = batch["fp"].to_numpy(np.int64)
            at, shard, home = route(shared(), fps.view(np.uint64), bits)
            yield pd.DataFrame({"shard": shard.astype(np.int32), "fp": fps[at], "home": home})

    sent = store(prints.select("fp").mapInPandas(send, "shard int, fp bigint, home boolean"), "visitors")
    slices = sent.groupBy("shard").agg(F.ceil(F.count("*") / VISITOR_ROWS).cast("int").alias("slices"))
    sliced = sent.join(F.broadcast(slices), "shard")  # one row per shard, of which there are few hundred
    looks = sliced.select("shard", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int").alias("slice"), "fp", F.lit(False).alias("home"))
    lives = sliced.filter("home").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "fp", "home")

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        fps, home = frame["fp"].to_numpy(np.int64).view(np.uint64), frame["home"].to_numpy(bool)
        if not home.any():
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        a, b = local_links(fps[home], fps[~home], bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return looks.union(lives).groupBy("shard", "slice").applyInPandas(link, "a bigint, b bigint")


def near_groups(documents: DataFrame, size: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """One row per document row: doc_id, text_hash, fp (signed) and ``first``, the least (doc_id, text_hash) of its
    component as a struct, null ids last.

    Fingerprints of 64 bits link at ``bits`` or fewer differing bits, components are their closure.
    Equal fingerprints are one node, so copies never meet in pairs. Null and empty texts have the
    fingerprint zero and link like any other. Empty tables give empty tables.
    """
    hashed = text_hash(F.col("text")).alias("text_hash")
    found = store(documents.select("doc_id", hashed, fingerprint_column(F.col("text"), size).alias("fp")), "prints")
    member = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = store(found.groupBy("fp").agg(F.min(member).alias("first")), "nodes")
    roots = component_roots(near_links(nodes, bits))
    placed = nodes.join(roots.withColumnRenamed("a", "fp"), "fp", "left").withColumn("root", F.coalesce("b", "fp"))
    groups = placed.groupBy("root").agg(F.min("first").alias("first"))
    members = placed.select("fp", "root").join(groups, "root").select("fp", "first")
    return found.join(members, "fp")


def simhash_table(documents: DataFrame, size: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    groups = near_groups(documents.select("doc_id", "text"), size, bits)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def first_documents(documents: DataFrame, size: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """One document of each component, the one with the least doc_id, all columns kept."""
    groups = store(near_groups(documents, size, bits), "groups")
    first = (F.col("first.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("first.text_hash") == F.col("text_hash"))
    stay = groups.filter(first).groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.count("*").alias("_rows"))
    stay = store(stay, "stay")
    rows = packed(documents, doc_id=F.col("doc_id"), key=text_hash(F.col("text")))
    kept = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_h")))
    if not stay.filter("_rows > 1").isEmpty():  # equal rows: only one of them stays
        kept = kept.dropDuplicates(["_d", "_h"])
    return kept.select(*unpacked(kept))
