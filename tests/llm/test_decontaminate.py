import hashlib
import random
import re

from plumbline.llm import decontaminate
from llm_rows import rows_by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(text, items):
    have, hit, ids = words(text), set(), set()
    for item, body in items:
        need = words(body)
        size = min(13, len(need))
        for s in range(len(need) - size + 1 if size else 0):
            for at in range(len(have) - size + 1):
                if have[at:at + size] == need[s:s + size]:
                    hit.update(range(at, at + size))
                    ids.add(str(item))
    joined = ",".join(sorted(ids))
    return (len(have), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(have))


def cases():
    rng = random.Random(5)
    some = [rng.choice(["ab", "Ab", "c", "é", "d9", "zz"]) for _ in range(400)]
    long = " ".join(some)
    items = [(1, long[:60]), (2, " ".join(some[5:40])), (10, "C, é"), (3, None), (4, ""), (5, "!!"), (6, " ".join(some[5:40])), (7, "zz zz zz")]
    texts = [None, "", "?!", long, long.upper(), " ".join(some[10:25]), "x " * 50 + " ".join(some[5:18]), "c É", "C é", "İ ab", "c é", "zz " * 30]
    texts += [" ".join(rng.choice(some) for _ in range(60)) for _ in range(10)]
    return list(enumerate(texts)) + [(3, long), (None, long)], items


def check(spark, docs, **options):
    rows, items = cases()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_contamination(docs(rows), bench, **options)
    return rows, items, found


def test_like_brute_force(spark, docs):
    rows, items, _ = check(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination_table(docs(rows), bench)
    want = sorted(((i, *brute(t, items)) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_parts_beyond_the_table_bound_give_the_same(spark, docs):
    *_, one = check(spark, docs)
    *_, many = check(spark, docs, table_bytes=40)
    order = lambda f: sorted((str(r.doc_id), r.text, str(r.contamination)) for r in f.collect())
    assert one.columns == many.columns
    assert [x[::2] for x in order(one)] == [x[::2] for x in order(many)]


def test_clean_documents_keep_rows_and_columns(spark, docs):
    rows, items, _ = check(spark, docs)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    frame = docs(rows)
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns
    assert len(rows_by_id(clean)) == sum(not brute(t, items)[-1] for _, t in rows)
    assert decontaminate.clean_documents(docs([]), bench).count() == 0
    assert decontaminate.clean_documents(frame, bench.limit(0)).count() == len(rows)


def test_shift_tables_skip_and_find():
    tables = decontaminate.build_tables([(1, "a b c d e f g h i j k l m n")])
    assert len(tables) == 1 and tables[0].shift[(b"m", b"n")] == 0 and tables[0].default == 12
    text = [b"x"] * 30 + [bytes([c]) for c in range(97, 111)]
    assert [(s, e) for s, e, _ in tables[0].search(text)] == [(30, 43), (31, 44)]
