import hashlib
import random

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash, span_dedup, suffix_dedup
from plumbline.llm.components import component_roots
from llm_rows import rows_by_id


def passages():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, exact = prose(40), "Q" + prose(30)[:48] + "Z"
    texts = [
        prose(100) + shared + prose(50), prose(10) + shared, shared[10:70] + prose(40), shared[3:52], shared[3:53], shared * 3,
        None, "", "short", "a" * 300, "a" * 120 + prose(20), "ab" * 100, "-" * 500, prose(30) + exact + prose(20), exact, exact,
        prose(5) + exact[:49], "é" * 60, "é" * 25, prose(20) + "\n" + "é" * 26, prose(3000),
    ]
    texts += [texts[-1][500:700] + prose(10), texts[0]]
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, prose(30) + shared), (5, texts[5]), (2, prose(8) + shared)]
    rng.shuffle(rows)
    return rows


def brute_bytes(rows):
    first = {}
    last = 2**63
    for i, t in rows:
        data, i = (t or "").encode(), last if i is None else i
        for p in range(len(data) - 49):
            first[data[p:p + 50]] = min(first.get(data[p:p + 50], i), i)
    out = []
    for i, t in rows:
        data, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(data) - 49):
            if first[data[p:p + 50]] < (last if i is None else i):
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_suffixes_like_brute_force(docs, monkeypatch, small):
    if small:  # many batches, buckets, ranges and slices
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 2_000)
        monkeypatch.setattr(suffix_dedup, "KEYS_PER_BUCKET", 200)
        monkeypatch.setattr(suffix_dedup, "CONTEXT_SHARE", 2)
        monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
    rows = passages()
    found = suffix_dedup.suffix_table(docs(rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_bytes(rows)


def test_suffixes_of_nothing(docs):
    assert suffix_dedup.suffix_table(docs([])).count() == 0
    assert [r.n_removed for r in suffix_dedup.suffix_table(docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_multikey_order_sorts_and_groups():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (500, 21)).astype(np.uint8)
    rows[:, :17] = 7
    order, group = suffix_dedup.multikey_order(rows)
    listed = [bytes(rows[i]) for i in order]
    assert listed == sorted(listed)
    assert [a == b for a, b in zip(listed, listed[1:])] == [a == b for a, b in zip(group, group[1:])]


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(prints, bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def near_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(600)]
    rows = [None, "", " \n", "one", "ONE", "one two", "One  two", "É é", "é é", " ".join(base)]
    for change in range(25):
        copy = list(base)
        for _ in range(1 + change // 8):
            copy[rng.randrange(len(copy))] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(60)]
    listed = [(i * 3 % 101, t) for i, t in enumerate(rows)]
    return listed + [(None, " ".join(base)), (listed[9][0], listed[9][1]), (None, "only here with null id")]


def brute_groups(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    groups = closure(prints)
    least = {}
    for (i, _), g in zip(rows, groups):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted(((i, format(p, "016x"), least.get(g)) for (i, _), p, g in zip(rows, prints, groups)), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_simhash_groups_like_brute_force(docs, monkeypatch, small):
    if small:
        for name, value in (("SHARD_ROWS", 12), ("VISITOR_ROWS", 20), ("LEAF_ROWS", 4), ("SLICE_SHINGLES", 50)):
            monkeypatch.setattr(simhash, name, value)
    rows = near_rows()
    found = simhash.simhash_table(docs(rows))
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_groups(rows)


def test_first_documents(docs):
    rows = near_rows()
    frame = docs(rows)
    kept = simhash.first_documents(frame)
    groups = {c for _, _, c in brute_groups(rows) if c is not None}
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(groups)
    assert sum(r.doc_id is None for r in kept.collect()) == 1
    assert simhash.first_documents(docs([])).count() == 0


def test_vantage_tree_loses_no_link():
    rng = np.random.default_rng(8)
    points = rng.integers(0, 2**63, 400).astype(np.uint64)
    near = points[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    prints = np.unique(np.concatenate([points, near]))
    tree = simhash.build_tree(prints, 32)
    at, shard, home = simhash.route(tree, prints, 2)
    assert np.bincount(at[home]).tolist() == [1] * len(prints)
    homes = {int(i): int(s) for i, s, h in zip(at, shard, home) if h}
    seen = set(zip(at.tolist(), shard.tolist()))
    for i in range(len(prints)):
        for j in range(len(prints)):
            if int(prints[i] ^ prints[j]).bit_count() <= 2:
                assert (i, homes[j]) in seen


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)] + [(1000, 1000), (1001, 1000)]
    links = spark.createDataFrame(chain + star, "a bigint, b bigint")
    found = {r.a: r.b for r in component_roots(links).collect()}
    assert found == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}


def brute_spans(rows):
    """Removed sentences, straight from the definition."""
    places = {}
    listed = {(2**63 - 1 if i is None else i, xxhash.xxh64_intdigest((t or "").encode(), 42)): t for i, t in rows}
    order = lambda k: (k[0], k[1] - 2**64 if k[1] >= 2**63 else k[1])
    for key, t in listed.items():
        pieces = span_dedup.sentences(t or "")
        for s, e in enumerate(span_dedup.span_ends(pieces)):
            if e > 0:
                places.setdefault("\n".join(p[2] for p in pieces[s:e]), []).append((order(key), s, e))
    gone = {}
    for found in places.values():
        for key, s, e in sorted(found)[1:]:
            gone.setdefault(key, set()).update(range(s, e))
    out = []
    for i, t in rows:
        key = order((2**63 - 1 if i is None else i, xxhash.xxh64_intdigest((t or "").encode(), 42)))
        pieces = span_dedup.sentences(t or "")
        cut = gone.get(key, set())
        kept = t if not cut else "".join(t[s:e] for n, (s, e, _) in enumerate(pieces) if n not in cut)
        out.append((i, kept, len(pieces), len(cut)))
    return sorted(out, key=str)


def span_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(3, 14))) + rng.choice([". ", "! ", "?? ", ".\n", "\n"])
    prose = lambda n: "".join(sentence() for _ in range(n))
    shared, run = prose(8), " ".join(word() for _ in range(90))
    rows = [(1, prose(5) + shared + prose(4)), (2, shared), (3, prose(3) + shared[20:]), (4, None), (5, ""), (6, "one. two. three. four."),
            (7, "one. two. three. four."), (8, prose(4) + run + " " + prose(3)), (9, word() + " " + run + " " + prose(2)), (10, shared + shared),
            (2, shared), (2, shared + " x"), (None, shared), (11, "\n\n"), (12, prose(40))]
    return rows


def test_spans_like_brute_force(docs):
    rows = span_rows()
    frame = docs(rows)
    found = span_dedup.without_repeats(frame)
    assert found.columns == [*frame.columns, "kept_text", "n_sentences", "n_removed", "n_removed_words"]
    assert sorted(((r.doc_id, r.kept_text, r.n_sentences, r.n_removed) for r in found.collect()), key=str) == brute_spans(rows)
    assert span_dedup.span_table(docs([])).count() == 0


def test_passages_of_over_50_words_go_and_short_ones_stay(docs):
    by_id = {}
    for r in rows_by_id(span_dedup.span_table(docs(span_rows()))):
        by_id.setdefault(r["doc_id"], r)
    assert by_id[1]["n_removed"] == 0 and by_id[12]["n_removed"] == 0 and by_id[7]["n_removed"] == 0
    assert by_id[2]["n_removed"] == by_id[2]["n_sentences"] and by_id[3]["n_removed_words"] > 20
    assert by_id[9]["n_removed_words"] > 50  # a run without closing signs


def test_sentences_cover_the_text():
    text = "  lead. One two!  Three\n\nfour five" + " word" * 200 + " end"
    pieces = span_dedup.sentences(text)
    assert "".join(text[s:e] for s, e, _ in pieces) == text and pieces[0][2] == "lead."


@pytest.mark.parametrize("variety", [1, 2, 5, 1_000])
@pytest.mark.parametrize("signs", [False, True])
def test_passages_over_50_words_hold_a_whole_span(variety, signs):
    rng = np.random.default_rng(variety)

    def words(count, most):
        return [f"v{rng.integers(most)}" + ("." if signs and rng.random() < 0.08 else "") for _ in range(count)]

    for _ in range(300):
        passage = words(51, variety)
        spans = []
        for _ in range(2):
            text = " ".join([*words(rng.integers(60), 10**9), "x", *passage, "y", *words(rng.integers(60), 10**9)])
            pieces = span_dedup.sentences(text)
            assert "".join(text[s:e] for s, e, _ in pieces) == text
            assert max(len(p.split()) for _, _, p in pieces) <= span_dedup.LONG_SENTENCE
            spans.append(set(span_dedup.span_hashes(text)[1].tolist()))
        assert spans[0] & spans[1], passage
