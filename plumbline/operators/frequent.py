"""Exact most common values without shuffling the rare ones.

A mergeable summary of frequent items, one for each column and task, proposes candidates in one scan
of all columns. It never overlooks a value that is more common than its known error. A second scan
counts the candidates exactly, and where the k-th of them is beyond that error, no other value can be
among the first k. Columns that are too flat for that get a larger summary, and in the end are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROUNDS = (4_096, 65_536)  # items that a summary tracks
ERROR = 2.7  # a summary of m items misses no value with more than ERROR / m of the rows
COLUMNS_PER_PASS = 32
FEW = 256  # candidates a column that are compared as literals


def _candidates(df: DataFrame, texts: dict[int, Column], k: int, tracked: int) -> tuple[dict, dict, float]:
    """({ordinal: (values that may be among the first k, whether counting them may settle it)}, {ordinal: rows
    with a value}, the error)."""
    found, filled, error = {}, {}, 0.0
    places = list(texts)
    for start in range(0, len(places), COLUMNS_PER_PASS):
        chunk = places[start:start + COLUMNS_PER_PASS]
        values = df.select(*[texts[p].alias(f"v{p}") for p in chunk])
        row = values.agg(
            F.count("*").alias("rows"), *[F.count(f"v{p}").alias(f"n{p}") for p in chunk],
            *[F.expr(f"approx_top_k(v{p}, {tracked}, {tracked})").alias(f"t{p}") for p in chunk],
        ).first()
        error = ERROR * row["rows"] / tracked
        for p in chunk:
            # Missing cells are an item too. An estimate is never below a value's count.
            items = [(r["item"], r["count"]) for r in row[f"t{p}"] or [] if r["item"] is not None]
            filled[p] = row[f"n{p}"]
            least = sorted((n for _, n in items), reverse=True)[:k][-1] if items else 0
            chosen = [item for item, n in items if n >= least - error]
            found[p] = chosen, least > error or len(items) <= k
    return found, filled, error


def _whole(df: DataFrame, texts: dict[int, Column], k: int, distinct: dict[int, int]) -> list[tuple]:
    """(ordinal, value, count, position) of columns whose values all fit a summary, which then counts
    exactly: one scan, and k values a column leave it."""
    settled, places = [], list(texts)
    for start in range(0, len(places), COLUMNS_PER_PASS):
        chunk = places[start:start + COLUMNS_PER_PASS]
        sizes = {p: max(64, distinct[p] + 1) for p in chunk}  # missing cells are an item too
        counted = df.select(*[texts[p].alias(f"v{p}") for p in chunk]).agg(
            *[F.expr(f"approx_top_k(v{p}, {sizes[p]}, {sizes[p]})").alias(f"t{p}") for p in chunk])
        row = counted.select(*[F.expr(
            f"slice(array_sort(filter(t{p}, x -> x.item is not null), (a, b) -> case when a.count > b.count then -1 "
            f"when a.count < b.count then 1 when a.item < b.item then -1 when a.item > b.item then 1 else 0 end), 1, {k})"
        ).alias(f"t{p}") for p in chunk]).first()
        settled += [(p, r["item"], r["count"], place) for p in chunk for place, r in enumerate(row[f"t{p}"] or [], 1)]
    return settled


def top_counts(df: DataFrame, texts: dict[int, Column], k: int, distinct: dict[int, int] | None = None) -> DataFrame:
    """(ordinal, value, value_count, position): the k most common texts of each column, ties by value.

    ``texts`` maps ordinals to columns of text; NULL is no value. Where the caller knows how many
    ``distinct`` values a column has and they fit a summary, that counts them exactly and suffices.
    """
    spark = df.sparkSession
    known = {p: text for p, text in texts.items() if (distinct or {}).get(p, ROUNDS[-1]) < ROUNDS[-1]}
    settled = _whole(df, known, k, distinct or {})
    texts = {p: text for p, text in texts.items() if p not in known}
    open_columns = dict(texts)
    for tracked in ROUNDS:
        if not open_columns:
            break
        found, filled, error = _candidates(df, open_columns, k, tracked)
        # Of a column whose k-th estimate is within the error nothing could be said; it waits for the next round.
        wanted = {p: values for p, (values, hopeful) in found.items() if hopeful}
        best: dict[int, list[tuple]] = {p: [] for p in wanted}
        listed = {p: values for p, values in wanted.items() if values}
        if listed:
            counted = _counted(df, {p: open_columns[p] for p in listed}, listed)
            for r in _ranked(counted, k).collect():
                best[r["ordinal"]].append((r["value"], r["value_count"], r["position"]))
        for p, rows in best.items():
            certain = len(rows) == k and min(n for _, n, _ in rows) > error
            if certain or sum(n for _, n, _ in rows) == filled[p]:
                settled += [(p, *entry) for entry in rows]
                del open_columns[p]
    frame = spark.createDataFrame(settled, "ordinal int, value string, value_count bigint, position bigint")
    if open_columns:
        cells = F.array(*[F.struct(F.lit(p).alias("ordinal"), text.alias("value")) for p, text in open_columns.items()])
        every = df.select(F.inline(cells)).filter(F.col("value").isNotNull()).groupBy("ordinal", "value")
        frame = frame.unionByName(_ranked(every.agg(F.count("*").alias("value_count")), k))
    return frame


def _counted(df: DataFrame, texts: dict[int, Column], wanted: dict[int, list[str]]) -> DataFrame:
    """(ordinal, value, value_count) of the wanted values alone: at most a summary's items a column."""
    few = all(len(values) <= FEW for values in wanted.values())
    cells = F.array(*[
        F.struct(F.lit(p).alias("ordinal"), (F.when(text.isin(wanted[p]), text) if few else text).alias("value"))
        for p, text in texts.items()
    ])
    long = df.select(F.inline(cells)).filter(F.col("value").isNotNull())
    if not few:
        pairs = [(p, value) for p, values in wanted.items() for value in values]
        listed = df.sparkSession.createDataFrame(pairs, "ordinal int, value string")
        long = long.join(F.broadcast(listed), ["ordinal", "value"], "left_semi")
    return long.groupBy("ordinal", "value").agg(F.count("*").alias("value_count"))


def _ranked(counts: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ordinal").orderBy(F.col("value_count").desc(), "value")
    ranked = counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
    return ranked.withColumn("position", F.col("position").cast("bigint"))
