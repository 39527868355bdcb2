from collections import Counter, defaultdict

from pyspark.sql import functions as F

from plumbline.llm import mixing, sharding
from llm_rows import rows_by_id


def text_of(words):
    return " ".join(["w"] * words)


def jump(key, shards):
    """The published algorithm, in plain numbers."""
    state, bucket, following = key & (2**64 - 1), -1, 0
    while following < shards:
        bucket = following
        state = (state * 2862933555777941757 + 1) & (2**64 - 1)
        following = int((bucket + 1) * (float(1 << 31) / float((state >> 33) + 1)))
    return bucket


def test_jump_hash_is_the_published_one(spark):
    keys = [0, 1, 2, 7, 12345, -1, -(2**63), 2**63 - 1, *range(1000, 1100)]
    frame = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for shards in (1, 2, 40, 41, 1000):
        found = frame.select("k", sharding.jump_shard(F.col("k"), shards).alias("s")).collect()
        assert {r.k: r.s for r in found} == {k: jump(k, shards) for k in keys}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    frame = sharding.assign_shards(sharding.assign_shards(spark.range(3000), "id", 40), "id", 41, "grown")
    rows = frame.collect()
    assert all(r.grown in (r.shard, 40) for r in rows)
    assert 30 < sum(r.grown == 40 for r in rows) < 130


def test_shard_table_edges(docs):
    rows = [(None, None), (1, ""), (1, ""), (2, "é"), (3, "x" * 300_000)] + [(i, f"t{i}") for i in range(4, 200)]
    found = sharding.shard_table(docs(rows), 40).collect()
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r.doc_id: r for r in found}
    assert (by_id[None].size, by_id[None].text_crc32, by_id[2].size) == (16, 0, 18)
    assert sharding.shard_table(docs([]), 40).count() == 0


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # Budget 2510; a stops at 30; b, c and the null source share 2480 by 2, 1, 5; the last stops at 1500.
    assert found["a"] == 30.0 and found[None] == 1500.0
    assert abs(found["b"] - 980 * 2 / 3) < 1e-9 and abs(found["c"] - 980 / 3) < 1e-9


def test_mix_takes_near_the_targets_and_repeats(docs):
    rows = [(i, text_of(1 + i % 7), "a") for i in range(200)] + [(1000 + i, text_of(5), "b") for i in range(300)]
    rows += [(2000 + i, text_of(3), None) for i in range(50)] + [(3000, None, "a"), (3001, " \t", "b"), (3002, "", "only blank")]
    found = mixing.mixed_counts(docs(rows)).collect()
    assert len(found) == len(rows) and all(0 <= r.copies <= 3 for r in found)
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 for s in target), (taken, target)
    assert sum(taken.values()) <= sum(r.size for r in found)
    again = mixing.mixed_counts(docs(rows, 7)).collect()
    assert Counter((r.doc_id, r.copies) for r in found) == Counter((r.doc_id, r.copies) for r in again)


def test_mixed_documents_keep_columns_and_repeated_rows(docs):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, "x " * 40, "t"), (None, "n n", None)]
    frame = docs(rows)
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    copies = {(r.doc_id, r.size): r.copies * r.rows for r in mixing.mixed_counts(frame).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k[0]: n for k, n in copies.items() if n})
    assert mixing.mixed_documents(docs([])).count() == 0


def test_identity_covers_a_hot_source(docs):
    rows = [(i, text_of(2), "hot") for i in range(500)] + [(900 + i, text_of(2), f"s{i}") for i in range(5)]
    assert len(rows_by_id(mixing.mixed_counts(docs(rows)))) == len(rows)
