"""Distinct counts by bits, most common values by candidates, quantiles and histograms in few scans."""

import datetime
import math
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import distinct, distribution, frequent, profile, quantiles


def unique(df):
    places = {n: i for i, n in enumerate(df.columns, 1)}
    counts = {r["ordinal"]: r["unique_count"] for r in distinct.distinct_counts(df, places).collect()}
    return {n: counts.get(i, 0) for n, i in places.items()}


def test_distinct_counts_of_every_type(spark):
    rng = random.Random(5)
    day = datetime.datetime(2024, 3, 31, 2, 30)
    rows = [(
        rng.choice([0, 1, -1, 63, 64, -64, -65, 2**63 - 1, -(2**63), rng.randrange(-500, 500), rng.getrandbits(62)]),
        rng.choice([None, True, False]), day.date() + datetime.timedelta(days=rng.randrange(-9, 9)),
        day + datetime.timedelta(microseconds=rng.choice([0, 1, 10**6, rng.randrange(10**12)])),
        rng.choice([0.0, -0.0, math.nan, math.inf, -math.inf, 0.1, rng.randrange(9) / 7, None]),
        rng.choice(["", "a", "x" * 15, "x" * 16, "é" * 8, None, f"a long text that ends in {rng.randrange(40)}"]),
        Decimal(rng.randrange(30)) / 100, None,
    ) for _ in range(1_500)]
    df = spark.createDataFrame(rows, "i bigint, b boolean, d date, t timestamp_ntz, x double, s string, m decimal(9,2), empty int").repartition(4)
    df = df.withColumn("z", F.col("t").cast("timestamp")).withColumn("y", F.col("i").cast("string").substr(1, 2).try_cast("tinyint"))
    wanted = {}
    for name in df.columns:
        cells = [r[0] for r in df.select(name).collect()]
        if name == "z":
            cells = [r[0] for r in df.select(F.unix_micros("z")).collect()]
        wanted[name] = len({c + 0.0 if isinstance(c, float) else c for c in cells if c is not None and c == c})
    assert unique(df) == wanted and wanted["empty"] == 0 and wanted["s"] == len({r[5] for r in rows} - {None})


def test_dense_keys_travel_as_words(spark):
    df = spark.range(100_000).select("id", (F.col("id") * 977).alias("wide")).repartition(4)
    words = distinct._bits(df, {"id": 1}).count()
    assert words == math.ceil(100_000 / 64) and unique(df) == {"id": 100_000, "wide": 100_000}


def top(df, k, **settings):
    texts = {i: F.col(n) for i, n in enumerate(df.columns)}
    found = {i: [] for i in texts}
    for r in frequent.top_counts(df, texts, k, **settings).orderBy("ordinal", "position").collect():
        found[r["ordinal"]].append((r["value"], r["value_count"]))
        assert r["position"] == len(found[r["ordinal"]])
    return [found[i] for i in texts]


def wanted_top(cells, k):
    return sorted(Counter(c for c in cells if c is not None).items(), key=lambda e: (-e[1], e[0]))[:k]


@pytest.mark.parametrize("rounds", [(4_096, 65_536), (16, 64), (8,)])
def test_top_values_equal_counting(spark, monkeypatch, rounds):
    """Hot, even, scattered, constant, missing and tied columns, also with summaries far too small."""
    monkeypatch.setattr(frequent, "ROUNDS", rounds)
    rng = random.Random(2)
    rows = [(
        f"w{min(int(rng.paretovariate(0.6)), 3_000)}", f"flat{rng.randrange(700)}", f"unique{i}",
        "same", None, rng.choice(["b", "a", None]), "hot" if i % 3 else f"r{i}",
    ) for i in range(4_000)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(7))).repartition(5)
    for k in (1, 5, 12):
        assert top(df, k) == [wanted_top([r[i] for r in rows], k) for i in range(7)]
    known = {i: len({r[i] for r in rows} - {None}) for i in range(7)}
    assert top(df, 5, distinct=known) == top(df, 5) == top(df, 5, distinct={0: known[0], 5: known[5]})


def test_top_values_of_an_empty_table(spark):
    assert top(spark.createDataFrame([], "a string, b string"), 5) == [[], []]


def test_rare_values_are_not_shuffled(spark):
    rows = [("hot" if i % 2 else f"rare{i}",) for i in range(20_000)]
    df = spark.createDataFrame(rows, "v string").repartition(4)
    found, _, _ = frequent._candidates(df, {0: F.col("v")}, 1, 4_096)
    assert found[0][0] == ["hot"] and top(df, 1) == [[("hot", 10_000)]]


@pytest.mark.parametrize("gather", [1, 7, 200, 4_000])
def test_quantiles_of_many_columns(spark, gather):
    rng = random.Random(gather)
    columns = {
        "even": [rng.random() for _ in range(6_000)], "hot": [5.0] * 4_000 + [float(i) for i in range(2_000)],
        "steps": [float(rng.randrange(9)) for _ in range(6_000)], "one": [3.25] * 6_000,
        "tails": [rng.choice([1e300, -1e300, rng.gauss(0, 1)]) for _ in range(6_000)],
    }
    rows = list(zip(*columns.values()))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    found, around = quantiles.quantiles_and_neighbours(df, dict.fromkeys(columns, 6_000), shares, gather_rows=gather)
    for name, values in columns.items():
        ordered = sorted(values)
        for p, got, (low, high, below, on_low, on_high) in zip(shares, found[name], around[name]):
            place = p * 5_999
            assert (low, high) == (ordered[math.floor(place)], ordered[math.ceil(place)])
            assert (below, on_low, on_high) == (sum(v < low for v in values), values.count(low), values.count(high))
            if name != "tails":
                assert np.isclose(got, np.quantile(values, p), rtol=1e-12)


def test_two_passes_settle_ordinary_columns(spark, monkeypatch):
    passes = []
    real = quantiles._pass
    monkeypatch.setattr(quantiles, "_pass", lambda *a: passes.append(1) or real(*a))
    df = spark.range(200_000).select((F.xxhash64("id") / 1e9).alias("a"), (F.col("id") % 1_000).cast("double").alias("b"))
    row = df.agg(*[quantiles.quantile_sketch(F.col(c), [0.25, 0.75]).alias(c) for c in df.columns]).first()
    found = quantiles.exact_quantiles(df, dict.fromkeys(df.columns, 200_000), [0.25, 0.75], sketches=row.asDict())
    wanted = {c: np.quantile([r[0] for r in df.select(c).collect()], [0.25, 0.75]).tolist() for c in df.columns}
    assert len(passes) == 1 and all(np.allclose(found[c], wanted[c], rtol=1e-12) for c in df.columns)


@pytest.mark.parametrize("seed", range(3))
def test_both_histograms_equal_one_at_a_time(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.gauss(0, 10**seed), 3.0, float(rng.randrange(-40, 40))]) for _ in range(3_000)] + [math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    facts = distribution.numeric_facts(df, "v")
    both = distribution.both_histograms(df, "v", facts).collect()
    full = distribution.full_histogram(df, "v").orderBy("bin").collect()
    inner = distribution.central_histogram(df, "v").orderBy("bin").collect()
    assert [r["value_count"] for r in both] == [r["value_count"] for r in [*full, *inner]]
    finite = sorted(v for v in values if math.isfinite(v))
    low, high = np.quantile(finite, [0.01, 0.99])
    central = distribution.central_range(df, "v", facts)
    inside = [v for v in finite if low <= v <= high]
    assert abs(central.rows - len(inside)) <= 2 and sum(r["value_count"] for r in inner) == central.rows
    counts, _ = np.histogram(finite, bins=24)
    assert [r["value_count"] for r in full] == counts.tolist()


def test_discreteness_needs_no_count_where_the_sketch_proves_it(spark, monkeypatch):
    many = spark.range(5_000).select((F.col("id") % 100).cast("double").alias("v"))
    facts = distribution.numeric_facts(many, "v")
    assert len(set(facts.sketch)) > 12 and not distribution.is_discrete(many, "v", facts)
    few = spark.range(5_000).select((F.col("id") % 12).cast("double").alias("v"))
    assert distribution.is_discrete(few, "v")
    nearly = spark.range(5_000).select(F.when(F.col("id") < 13, F.col("id")).otherwise(1).cast("double").alias("v"))
    assert not distribution.is_discrete(nearly, "v")


def test_a_complete_profile_has_the_parts_one_by_one(numbered):
    rows = [(i % 7, f"w{i % 3}", i / 7 if i % 5 else None, i % 2 == 0, f"2024-0{i % 9 + 1}-11") for i in range(200)]
    df = numbered(rows, "n bigint, s string, x double, b boolean, d string")
    found, parts = profile.complete_profile(df), profile.profile_table(df)
    assert set(found) == {"summary", "columns", "dates", "samples", "numbers", "booleans", "common"}
    for name, frame in found.items():
        assert sorted(map(tuple, frame.collect())) == sorted(map(tuple, getattr(parts, name).collect())), name
    assert found["summary"].collect() == profile.profile_summary(df).collect()


def test_profile_summary_from_the_profile(numbered):
    df = numbered([(1, "a", None), (1, "a", None), (2, None, 1.5)], "n bigint, s string, x double")
    assert profile.profile_table(df).summary.collect() == profile.profile_summary(df).collect()
