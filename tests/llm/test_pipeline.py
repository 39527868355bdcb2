"""The pipeline over planted documents, stage by stage and as a whole."""

import random

import corpus_pipeline
import pytest
from test_mixing_sharding import jump


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(30) for _ in range(4)]
    rows, labels = [], []
    for i in range(300):
        text = prose(120)
        if i % 3 == 0:
            text = text + " " + " ".join(rng.choice(["vile", "wretch", "scoundrel"]) for _ in range(6))
        rows.append((i, text, "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 3 == 0)))
    base = prose(400)
    rows += [(1000 + k, base if k < 4 else base + " tail", "en", "s1", 0) for k in range(5)]  # copies and a near copy
    rows += [(2000 + k, prose(40) + " " + item + " " + prose(30), "en", "s2", 0) for k, item in enumerate(items)]
    rows += [(3000, None, "en", None, 0), (3001, "", None, "s0", 0), (3002, "a lone text", "en", None, 0), (3002, "a lone text", "en", None, 0),
             (None, prose(50), "en", "s0", 0), (3003, prose(30_000), "de", "s1", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_each_stage_does_its_part(spark, planted):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        if name != "sharding":
            assert found.columns == docs.columns
        kept[name] = sorted(((r.doc_id, r.text) for r in found.collect()), key=str)
        docs = spark.createDataFrame(found.collect(), found.schema)
    ids = {name: {i for i, _ in listed} for name, listed in kept.items()}
    assert not ids["toxicity"] & {i for i in range(300) if i % 3 == 0}
    assert len({i for i in range(300) if i % 3} - ids["toxicity"]) <= 10 and 1000 in ids["toxicity"]
    assert ids["near_duplicates"] & {1000, 1001, 1002, 1003, 1004} == {1000}
    assert sum(i == 3002 for i, _ in kept["near_duplicates"]) == 1 and None in ids["near_duplicates"]
    assert ids["near_duplicates"] - ids["decontamination"] == {2000, 2001, 2002, 2003}
    assert ids["mixing"] <= ids["decontamination"] and len(kept["mixing"]) > len(set(kept["mixing"]))


def test_run_gives_shards(spark, planted):
    folder, _ = planted
    found = corpus_pipeline.run(spark, folder).collect()
    assert found and all(r.shard == jump(r.doc_id or 0, corpus_pipeline.SHARDS) for r in found)


def test_empty_corpus(spark, planted, tmp_path):
    folder, _ = planted
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
