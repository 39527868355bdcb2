import base64
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk, warc
from plumbline.sources.storage import new_path


def brute_top(vectors, top=10):
    whole = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[i] = [math.floor(1024 * float(np.float32(x))) for x in v]
    out = []
    for q in (i for i in whole if i % 100 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(4096, 512), (37, 3)])
def test_top_products_like_brute_force(spark, sizes):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.1, 1, 5]) * (1 + 10 * (i % 97 == 0))).tolist()) for i in range(1000)]
    rows += [(1000 + i, rows[3][1]) for i in range(15)] + [(1100, rows[0][1]), (1200, [0.0] * 12), (2001, None), (2002, [1.0, None]), (None, [1.0] * 12)]
    rows += [(2100, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2200, []), (2300, [3.0]), (2004, [-1e9] * 12)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = topk.whole_vectors(frame)
    found = topk.top_products(whole, whole.filter("vec_id % 100 = 0"), 10, *sizes)
    want = brute_top([(i, v) for i, v in rows if i != 2004])
    assert sorted(tuple(r) for r in found.collect()) == want


def test_fewer_vectors_than_asked_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in topk.embedding_neighbours(frame).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert topk.embedding_neighbours(frame.limit(0)).count() == 0
    assert topk.embedding_neighbours(frame.filter("vec_id = 0")).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a", "<p>x</p>"), (2, None, None), (3, "http://b\r\nEvil: 1", ""), (4, "u", "<p>x</p>"), (5, "u", "a\r\n\r\nb\r\n\r\n\r\n"),
    (6, "u", "head " + INNER + " tail"), (7, "u", INNER * 3), (8, "u", "WARC/1.1\r\n"), (9, "u", "WARC/1.1\r\nContent-Length: 99\r\n\r\n"),
    (10, "u", "é😀" * 30_000), (11, "u", "\r\n"), (12, "u", INNER * 3), (13, "u", "x" * 400_000 + INNER + "y" * 10), (14, "u", "WARC/1.1"),
] + [(20 + i, "u", f"<html>{i}</html>" * (i % 40)) for i in range(200)]


def want(pages, least=0):
    newest = {}
    for i, _, html in pages:
        newest[html or ""] = max(newest.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        text = html or ""
        again = newest[text] != i and len(text.encode()) >= least
        out.append((i, len(text.encode()), digest(text), "revisit" if again else "response", newest[text] if again else None))
    return sorted(out)


@pytest.mark.parametrize("split,least", [("128m", 0), ("3k", 20)])
def test_round_trip(spark, split, least):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("at", F.lit(1)).repartition(3, "page_id")
        assert sorted(tuple(r) for r in warc.round_trip(frame, least).collect()) == want(PAGES, least)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_null_ids_and_repeats(spark):
    schema = "page_id bigint, url string, html string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "u", "a"), (1, "u", "b"), (1, "u", "b"), (None, "u", "b")]
    found = warc.round_trip(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in found) == [
        ("1", "response", None), ("1", "response", None), ("None", "response", None), ("None", "revisit", 1)]


def test_archives_follow_the_format(spark):
    path = new_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(PAGES[:4], "page_id bigint, url string, html string").coalesce(1), path)
    data = b"".join(r.content for r in spark.read.format("binaryFile").load(path).collect())
    at, kinds = 0, []
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(line.split(": ", 1) for line in data[at:head_end].decode().split("\r\n")[1:] if line)
        kinds.append(fields["WARC-Type"])
        at = head_end + int(fields["Content-Length"]) + 4
        assert data[at - 4:at] == b"\r\n\r\n" and "Evil" not in fields
    assert at == len(data) and sorted(kinds) == ["response", "response", "revisit", "revisit"]


def test_pointer_jumping():
    at = np.array([0, 10, 25, 40, 90])
    following = np.array([25, 40, 40, 100, 95])
    assert warc._jump(at, following).tolist() == [100, 100, 100, 100, 95]
    assert warc._reachable(at, following, 0).tolist() == [True, False, True, True, False]
