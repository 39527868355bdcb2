"""Isolation forest (Liu, Ting and Zhou, 2008): 256 rows a tree, scoring of every complete row.

Complete rows stand in the order of a seeded digest and each tree takes the next 256 of them, starting
over when all are used. The model has a fixed size, whatever the table. Splits are drawn from digests of
seed, tree and node, so the same rows give the same trees anywhere. Trees grow in parallel groups; the
finished node table is broadcast, and rows are scored once, where they lie, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.constants import (
    FOREST_CONTAMINATION,
    FOREST_MIN_ROWS,
    FOREST_TREE_ROWS,
    FOREST_TREES,
    SEED,
)
from plumbline.functions.scalars import finite_or_null, quoted
from plumbline.operators.quantiles import exact_quantiles
from plumbline.sources.rows import ROW_NUMBER
from plumbline.sources.storage import store

# Executors need not have this package installed: its small helpers travel with each task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = "tree int, node int, feature int, threshold double, path double"
SCORE_PLACES = 9
RAW_SCORE = "__raw_score"
_SAMPLE_KEY = "__sample_key"


def _average_path(rows: int) -> float:
    """Mean path length of an unsuccessful search in a tree over that many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1.0) + np.euler_gamma) - 2.0 * (rows - 1.0) / rows


@dataclass(frozen=True)
class ForestGate:
    fields: list[str]
    complete_rows: int

    @property
    def open(self) -> bool:
        return len(self.fields) >= 2 and self.complete_rows >= FOREST_MIN_ROWS


def _matrix(df: DataFrame, fields: list[str]) -> DataFrame:
    """(row number, x0..xn) of the rows whose fields are all finite."""
    values = [finite_or_null(quoted(f).cast("double")).alias(f"x{i}") for i, f in enumerate(fields)]
    return df.select(ROW_NUMBER, *values).dropna(subset=[f"x{i}" for i in range(len(fields))])


def forest_gate(df: DataFrame, usable: dict[str, tuple[int, bool]]) -> ForestGate:
    """Fields with enough varying values, and how many rows have all of them.

    ``usable`` gives, per numeric field, its number of finite values and whether they vary.
    """
    fields = [f for f, (rows, varies) in usable.items() if rows >= FOREST_MIN_ROWS and varies]
    if not fields:
        return ForestGate(fields, 0)
    complete = F.lit(True)
    for f in fields:
        complete = complete & finite_or_null(quoted(f).cast("double")).isNotNull()
    return ForestGate(fields, df.agg(F.count_if(complete)).first()[0])


def forest_sample(df: DataFrame, gate: ForestGate, trees: int = FOREST_TREES) -> DataFrame:
    """The complete rows the trees use, with their ``rank`` by a seeded digest of the row number.

    These are trees x 256 rows, or all rows where there are fewer. The digest is uniform, so a bound
    on it leaves little more than the wanted rows before the top-k; without that bound each task
    would send its own full top-k to one merge. The sample is the same with and without the bound,
    which is widened in the unlikely case of too few rows. The result is kept as literal rows.
    """
    rows = trees * FOREST_TREE_ROWS
    matrix = _matrix(df, gate.fields)
    keyed = matrix.withColumn(
        _SAMPLE_KEY, F.md5(F.concat_ws("-", F.col(ROW_NUMBER).cast("string"), F.lit(str(SEED))))
    )
    wanted = min(rows, gate.complete_rows)
    share = (rows + 10 * math.sqrt(rows)) / max(gate.complete_rows, 1)
    while True:
        bounded = keyed if share >= 1 else keyed.filter(F.col(_SAMPLE_KEY) < f"{int(share * 16 ** 8):08x}")
        first = bounded.orderBy(_SAMPLE_KEY).limit(rows).collect()
        if share >= 1 or len(first) >= wanted:
            break
        share *= 2
    fields = ", ".join(f"x{i} double" for i in range(len(gate.fields)))
    return df.sparkSession.createDataFrame(
        [(rank, *row[:-1]) for rank, row in enumerate(first)], f"rank bigint, {ROW_NUMBER} bigint, {fields}"
    )


def _draw(tree: int, node: int) -> tuple[int, float]:
    """A number to choose the field by and a share of its range, from the digest of seed, tree and node."""
    digest = hashlib.md5(f"{SEED}-{tree}-{node}".encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:20], 16) / 16.0**12


def _grow(tree: int, rows: np.ndarray) -> list[tuple]:
    """Random splits down to single rows or the depth limit; nodes numbered as in a binary heap."""
    limit = math.ceil(math.log2(max(len(rows), 2)))
    nodes, pending = [], [(0, 0, rows)]
    while pending:
        node, depth, part = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(low < high)
        if depth == limit or not len(varying):
            nodes.append((tree, node, -1, 0.0, depth + _average_path(len(part))))
            continue
        number, share = _draw(tree, node)
        feature = int(varying[number % len(varying)])
        threshold = low[feature] + share * (high[feature] - low[feature])
        if threshold >= high[feature]:  # by rounding; neither side may be empty
            threshold = low[feature]
        right = part[:, feature] > threshold
        nodes.append((tree, node, feature, float(threshold), 0.0))
        pending.append((2 * node + 2, depth + 1, part[right]))
        pending.append((2 * node + 1, depth + 1, part[~right]))
    return nodes


def forest_model(sample: DataFrame, trees: int = FOREST_TREES) -> DataFrame:
    """Node table of all trees; tree t has the ranks from 256 t on, modulo the number of ranks."""
    features = [c for c in sample.columns if c.startswith("x")]
    total = sample.count()
    each = min(FOREST_TREE_ROWS, total)
    turns = sample.sparkSession.range(trees).select(
        F.col("id").cast("int").alias("tree"),
        F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("place"),
    ).withColumn("rank", (F.col("tree") * FOREST_TREE_ROWS + F.col("place")) % total)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place")[features].to_numpy(dtype=float)
        return pd.DataFrame(
            _grow(int(pdf["tree"].iloc[0]), rows), columns=["tree", "node", "feature", "threshold", "path"]
        )

    return turns.join(sample, "rank").groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def node_arrays(nodes: pd.DataFrame, tree_rows: int) -> tuple:
    """Trees as dense (feature, threshold, path, normal path) arrays, one row per tree.

    A leaf above the last level sends every row to its left copy, so all descents have one length.
    """
    trees = int(nodes["tree"].max()) + 1
    levels = int(math.floor(math.log2(int(nodes["node"].max()) + 1)))
    slots = 2 ** (levels + 1) - 1
    feature = np.zeros((trees, slots), dtype=np.intp)
    threshold = np.full((trees, slots), np.inf)
    path = np.zeros((trees, slots))
    for row in nodes.itertuples(index=False):
        if row.feature >= 0:
            feature[row.tree, row.node] = row.feature
            threshold[row.tree, row.node] = row.threshold
        else:
            slot = row.node
            while slot < slots:
                path[row.tree, slot] = row.path
                slot = 2 * slot + 1
    return feature, threshold, path, _average_path(tree_rows)


def _score(arrays: tuple, values: np.ndarray) -> np.ndarray:
    """-2^(-E[h] / c): lower is more unusual. ``values`` has one row per feature."""
    features, thresholds, paths, normal = arrays
    levels = int(math.log2(features.shape[1] + 1)) - 1
    rows = values.shape[1]
    flat, at, total = values.ravel(), np.arange(rows), np.zeros(rows)
    for feature, threshold, path in zip(features, thresholds, paths):
        node = np.zeros(rows, dtype=np.intp)
        for _ in range(levels):
            hit = flat[feature[node] * rows + at] > threshold[node]
            node += node
            node += 1
            node += hit
        total += path[node]
    return -np.exp2(-total / len(paths) / normal)


@dataclass(frozen=True)
class Forest:
    fields: list[str]
    evaluated_rows: int
    training_rows: int
    contamination: float
    offset: float
    arrays: Broadcast  # the trees: at most 511 nodes each
    scored: DataFrame  # the stored table with its raw scores

    def score(self, df: DataFrame) -> Column:
        """The decision score of each complete row, in place; NULL for the others. Below 0 is unusual.

        Raw scores that the rows bring with them, as those of ``scored`` do, are not worked out again."""
        raw = F.col(RAW_SCORE) if RAW_SCORE in df.columns else raw_score(df, self.fields, self.arrays)
        return F.round(raw - F.lit(self.offset), SCORE_PLACES)


def raw_score(df: DataFrame, fields: list[str], arrays: Broadcast) -> Column:
    """The score of a row by the trees, rounded to nine places so that the order in which paths are added
    cannot change a result; NULL where a field is missing or not finite."""

    @F.pandas_udf("double")
    def scores(*columns: pd.Series) -> pd.Series:
        values = np.vstack([c.to_numpy(dtype=float) for c in columns])
        complete = ~np.isnan(values).any(axis=0)
        found = np.full(values.shape[1], np.nan)
        found[complete] = _score(arrays.value, np.ascontiguousarray(values[:, complete]))
        return pd.Series(found)

    values = [finite_or_null(quoted(f).cast("double")) for f in fields]
    return F.round(scores.asNondeterministic()(*values), SCORE_PLACES)


def fit_forest(df: DataFrame, gate: ForestGate, trees: int = FOREST_TREES) -> Forest | None:
    """Grow the trees; the cut-off is the exact 1 % quantile of the scores of all complete rows.

    The table is stored with its raw scores: what reads it later needs no trees. To write a row costs a
    small part of its descent through all of them, and no score is brought back to its row by a join.
    """
    if not gate.open:
        return None
    sample = forest_sample(df, gate, trees)
    nodes = forest_model(sample, trees).toPandas()  # at most 511 nodes a tree
    arrays = df.sparkSession.sparkContext.broadcast(node_arrays(nodes, min(FOREST_TREE_ROWS, gate.complete_rows)))
    scored = store(df.withColumn(RAW_SCORE, raw_score(df, gate.fields, arrays)), "scored")
    offset = exact_quantiles(scored, {RAW_SCORE: gate.complete_rows}, [FOREST_CONTAMINATION])[RAW_SCORE][0]
    used = min(trees * FOREST_TREE_ROWS, gate.complete_rows)
    return Forest(gate.fields, gate.complete_rows, used, FOREST_CONTAMINATION, offset, arrays, scored)
