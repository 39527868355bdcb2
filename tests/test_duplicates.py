import random
from collections import Counter

import pyarrow as pa

from plumbline.operators import uniqueness


def test_digests_are_summed_a_bounded_number_at_a_time(monkeypatch):
    monkeypatch.setattr(uniqueness, "HELD_ROWS", 50)
    rng = random.Random(3)
    known = [bytes([i]) + bytes(31) for i in range(9)] + [bytes(31) + bytes([i]) for i in range(1, 9)]
    listed = [rng.choice(known) for _ in range(1000)]
    batches = [pa.record_batch({"d": pa.array(listed[i:i + 17], pa.binary())}).slice(1) for i in range(0, 1000, 17)]
    kept = [d for i in range(0, 1000, 17) for d in listed[i + 1:i + 17]]
    found = list(uniqueness.digest_counts(iter([batches[0].slice(0, 0), *batches])))
    assert len(found) > 10 and all(b.num_rows <= 50 + 17 for b in found)
    sums = Counter()
    for batch in found:
        for digest, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[digest] += rows
    assert sums == Counter(kept)


def test_no_task_holds_all_its_digests(spark, capsys):
    """Nothing is grouped before the digests are exchanged, and the count is right for hot and empty tables."""
    rows = [(1, "hot")] * 3000 + [(i, None) for i in range(2000)] + [(5, None), (7, None)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(5)
    counted = uniqueness.duplicate_count(df)
    counted.explain()
    plan = capsys.readouterr().out
    assert plan.index("Exchange hashpartitioning(__digest") < plan.index("MapInArrow")
    assert "HashAggregate(keys=[__digest" not in plan[plan.index("Exchange hashpartitioning(__digest"):]
    assert counted.first()["duplicate_rows"] == 2999 + 2
    assert uniqueness.duplicate_count(df.limit(0)).first()["duplicate_rows"] == 0
