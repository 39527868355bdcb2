import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import shared, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return toxicity.toxicity_table(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    test = scored[scored.held_out & scored.toxic.notna()]
    truth, called = test.toxic == 1, test.predicted == 1
    recall, false = (truth & called).sum() / truth.sum(), (~truth & called).sum() / (~truth).sum()
    ranks = test.score.rank()
    auc = (ranks[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())
    assert recall > 0.7 and false < 0.02 and auc > 0.85, (recall, false, auc)


def test_split_and_range(scored):
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(scored.doc_id, scored.held_out))
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.7) == (scored.predicted == 1)).all()


def rows():
    out, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        words = [f"w{(i * 7 + k * k) % 90}" for k in range(40)]
        if bad:
            words[5:5] = ["awful", f"worse{i % 3}"]
        out.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return out, labels


def test_labels_of_held_out_documents_change_nothing(spark, docs):
    texts, labels = rows()
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    results = [
        {r.doc_id: r.score for r in toxicity.toxicity_table(docs(texts), spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()}
        for x in (labels, turned)
    ]
    assert results[0] == pytest.approx(results[1])
    assert np.mean([results[0][i] > 0.7 for i, t in labels if t]) > 0.95 > 0.05 > np.mean([results[0][i] > 0.7 for i, t in labels if not t])


def test_edges(spark, docs):
    texts, labels = rows()
    odd = [(900, None), (901, ""), (902, "!!!"), (None, "awful worse1"), (903, "w1 " * 300_000), (5, texts[5][1]), (904, "unknown words only")]
    known = spark.createDataFrame(labels + [(None, 1), (5, None), (6, 7), (777777, 1), (8, 0), (8, 1)], "doc_id bigint, toxic int")
    frame = docs(texts + odd)
    found = toxicity.score_documents(frame, known)
    assert found.columns == [c for c in frame.columns if c != "score"] + ["score"]
    got = found.collect()
    assert len(got) == len(texts) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901, 902)}) == 1
    kept = toxicity.ordinary_documents(frame, known)
    assert kept.columns == frame.columns and 0 < kept.count() < len(got)
    empty = known.limit(0)
    assert {r.score for r in toxicity.score_documents(frame, empty).collect()} == {0.5}
    assert toxicity.ordinary_documents(docs([]), known).count() == 0


def test_evidence_counts_expressions_once(monkeypatch):
    model = toxicity.Model({b"a": 1, b"b": 2}, np.array([5]), np.array([[0.1, 0.4]]), np.array([[1, 1], [0.8, 0.5], [1, 1]]),
                           np.array([[0.2, 0.2], [0.5, 0.1], [0.3, 0.7]]))
    texts = ["a b a c b", None, "", "b " * 50 + "a b", "a", "a b " * 30]
    whole = model.evidence(texts)
    monkeypatch.setattr(toxicity, "SLICE_WORDS", 3)
    monkeypatch.setattr(toxicity, "plain_word_parts", lambda t: shared.plain_word_parts(t, 4))
    assert model.evidence(texts) == pytest.approx(whole)
    a, ab, ba = np.log(0.1 / 0.5), np.log(0.4 / 0.1), np.log(0.1 / 0.5)
    assert whole[4] == pytest.approx(a) and whole[5] == pytest.approx((a + ab + ba) / 3)
    assert whole[1] == whole[2] == 0


def mixed_rows(share, copies=0):
    """400 texts, some toxic, and copies of a passage that are labelled toxic."""
    out, labels = [], []
    for i in range(400):
        bad = (i * 37) % 100 < share
        words = [f"w{(i * 7 + k * k * (i % 11 + 1)) % 90}" for k in range(40)]
        words[5:5] = ["awful", f"worse{i % 3}"] if bad else ["kind", f"better{i % 3}"]
        out.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    for i in range(1_000, 1_000 + copies):
        out.append((i, " ".join(f"w{k} w{k * k % 90}" for k in range(30))))
        labels.append((i, 1))
    return out, labels


@pytest.mark.parametrize("share, copies", [(10, 0), (33, 0), (60, 0), (10, 200)])
def test_both_models_learn_at_every_class_share(spark, docs, share, copies):
    texts, labels = mixed_rows(share, copies)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model, _ = toxicity.fit_models(docs(texts), known)
    weights = {w: model.words[model.numbers[w]] for w in (b"awful", b"kind")}
    assert weights[b"awful"][1] > 1.5 * weights[b"awful"][0] and weights[b"kind"][0] > 1.2 * weights[b"kind"][1], weights
    test = [(t, r) for (i, _), (_, t), r in zip(texts, labels, model.evidence([t for _, t in texts])) if i < 1_000]
    assert min(r for t, r in test if t) > max(r for t, r in test if not t)


def test_rare_expressions_weigh_less_but_not_nothing(spark, docs):
    texts, labels = mixed_rows(33)
    turn = [i for i, t in labels if t and zlib.crc32(str(i).encode()) % 3 != 1]
    rare = {i: "oncea onceb" for i in turn}
    texts = [(i, f"{t} {rare[i]}" if i in turn[:4] else t) for i, t in texts]
    model, _ = toxicity.fit_models(docs(texts), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    once, often = (model.words[model.numbers[w]] for w in (b"oncea", b"awful"))
    assert 1 < once[1] / once[0] < often[1] / often[0]
    pair = model.numbers[b"oncea"] * len(model.words) + model.numbers[b"onceb"]  # a context of one class alone
    assert pair in model.pairs


def test_shared_counts_hold_all_words_and_pairs(spark, docs, monkeypatch):
    texts = [(i, f"a b a b x{i} y{i}") for i in range(300)] + [(900, None), (901, ""), (902, "a")]
    whole = toxicity.shared_counts(docs(texts)).toPandas()
    assert list(whole.groupby("kind").size()) == [602, 602, 302]
    a, b = toxicity.word_keys([b"a", b"b"])
    ab = toxicity.pair_keys(np.array([a]), np.array([b]))[0]
    counts = {(r.kind, np.uint64(r.key % 2**64)): r.documents for r in whole.itertuples()}
    assert counts[0, a] == 301 and counts[1, ab] == 300 and counts[2, a] == 300 and counts[2, b] == 600
    monkeypatch.setattr(toxicity, "COUNTED_KEYS", 5)
    monkeypatch.setattr(toxicity, "plain_word_parts", lambda t: shared.plain_word_parts(t, 4))
    parts = toxicity.shared_counts(docs(texts)).toPandas()
    order = ["kind", "key", "documents"]
    assert whole[order].sort_values(order).values.tolist() == parts[order].sort_values(order).values.tolist()


def test_asked_counts_are_those_of_the_whole(spark, docs, monkeypatch):
    """Of pairs and contexts only the asked ones travel, with the counts they have in all documents."""
    texts = [(i, f"a b a b x{i} y{i}") for i in range(300)] + [(900, None), (901, ""), (902, "a")]
    whole = toxicity.shared_counts(docs(texts)).toPandas()
    asked = toxicity.asked_keys(toxicity.shared_counts(docs([(1, "b a b x7 never")])))
    for keys in (1 << 20, 5):
        monkeypatch.setattr(toxicity, "COUNTED_KEYS", keys)
        found = toxicity.shared_counts(docs(texts), shared.share(spark, asked)).toPandas()
        wanted = [whole[whole.kind == 0]]
        for kind in (1, 2):
            own = whole[whole.kind == kind]
            wanted.append(own[np.isin(own.key.to_numpy(np.int64).view(np.uint64), asked[kind - 1])])
        rows = sorted(map(tuple, np.concatenate([w[["kind", "key", "documents"]].to_numpy() for w in wanted]).tolist()))
        assert sorted(map(tuple, found[["kind", "key", "documents"]].to_numpy().tolist())) == rows
    assert sum(found.kind == 1) == 3 and sum(found.kind == 2) == 3
    nothing = shared.share(spark, (np.empty(0, np.uint64), np.empty(0, np.uint64)))
    assert set(toxicity.shared_counts(docs(texts), nothing).toPandas().kind) == {0}


def test_the_counts_of_the_corpus_are_those_asked_for(spark, docs, monkeypatch):
    calls, count = [], toxicity.shared_counts
    monkeypatch.setattr(toxicity, "shared_counts", lambda d, *asked: calls.append(bool(asked)) or count(d, *asked))
    texts, labels = rows()
    toxicity.fit_models(docs(texts), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert calls == [False, True]


@pytest.mark.parametrize("toxic_share, ordinary_share", [(40, 15), (15, 40)])
def test_a_language_that_one_class_has_more_often_is_no_evidence(spark, docs, toxic_share, ordinary_share):
    """Common words of a language must not call its clean texts toxic, nor hide its toxic ones."""
    rng = np.random.default_rng(5)
    texts, labels, kinds = [], [], {}
    for i in range(1_800):
        bad = i % 3 == 0
        second = bool(rng.integers(100) < (toxic_share if bad else ordinary_share))
        words = [f"{'v' if second else 'w'}{k}" for k in rng.integers(0, 12, 60)]
        if bad:
            words[5:5] = ["awful", f"worse{i % 4}"]
        texts.append((i, " ".join(words)))
        kinds[i] = (bad, second)
        if i % 10:
            labels.append((i, int(bad)))
    found = toxicity.toxicity_table(docs(texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    for second in (False, True):
        called = {bad: np.mean([r.predicted for r in found if kinds[r.doc_id] == (bad, second)]) for bad in (False, True)}
        assert called[True] > 0.95 and called[False] < 0.05, (second, called)
