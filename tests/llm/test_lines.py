from collections import Counter, defaultdict

import pytest

from plumbline.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
LONG = "This line is long enough to count, ÄÖ"


def brute(rows, least=20, documents=3):
    """(doc_id, kept text, lines, dropped) of (doc_id, text) rows; the null id is below all others."""
    def key(line):
        return line.strip(BLANKS).translate(UPPER)

    holders = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add((doc is not None, doc))
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < documents or max(holders[key(x)]) == (doc is not None, doc)]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def found(frame, **settings):
    rows = line_dedup.without_repeated_lines(frame, **settings).collect()
    return Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in rows)


ROWS = [
    (1, f"{LONG}\nown line of the first document\n{LONG}"),
    (2, f"  {LONG.replace('This', 'tHIS')}\t\r\nshort\n\nshort"),
    (3, f"{LONG}\n{LONG}\n\nkept in the largest document only"),
    (4, None), (5, ""), (6, "\n\n"), (7, "short\nshort"), (8, "short"), (9, "short"),
    (10, "exactly twenty chars\nnineteen characters"), (11, "exactly twenty chars\nnineteen characters"),
    (12, "EXACTLY twenty chars\nnineteen characters"),
    (13, "found in two documents alone"), (14, "found in two documents alone"),
    (15, "repeated row, the same line\nits other line is this one"), (15, "repeated row, the same line\nits other line is this one"),
    (16, "repeated row, the same line"), (15, "another text of the id\nrepeated row, the same line"),
    (None, "a null id is the least document"), (20, "a null id is the least document"), (21, "a null id is the least document"),
    (30, "Ä" * 20), (31, "Ä" * 20), (32, "ä" * 20), (33, "Ä" * 20),
    (40, "\n".join(f"line number {i} of a very long text" for i in range(5000))),
    (41, "\n".join(f"line number {i} of a very long text" for i in range(0, 5000, 3))),
    (42, "\n".join(f"line number {i} of a very long text" for i in range(4999, 0, -7))),
    (43, "word " * 100_000), (44, "word " * 100_000), (45, "\nword" + " word" * 99_999 + "\n"),
]


@pytest.mark.parametrize("settings", [{}, {"hot": 1}, {"hot": 3}, {"hot": 10**9}, {"sample_rows": 50, "hot": 1}])
def test_equals_brute_force_on_either_path(docs, settings):
    assert found(docs(ROWS, 5), **settings) == brute(ROWS)


def test_a_line_of_a_third_of_all_documents(docs):
    rows = [(i, f"{LONG}\nline {i} of its own, no other has it" if i % 3 == 0 else f"nothing shared in {i} here") for i in range(1500)]
    assert found(docs(rows, 7), hot=50) == brute(rows)


def test_settings_and_columns(docs):
    rows = [(1, "one two\nx"), (2, "one two\ny"), (3, "z")]
    assert found(docs(rows), min_length=3, min_documents=2) == brute(rows, 3, 2)
    frame = docs(rows)
    assert line_dedup.without_repeated_lines(frame).columns == [*frame.columns, "kept_text", "n_lines", "n_dropped"]


def test_clashing_columns_and_empty_table(spark, docs):
    frame = spark.createDataFrame([(1, LONG, 9, "b"), (2, LONG, 9, "c"), (3, LONG, 9, "d")],
                                  "doc_id bigint, text string, n_dropped int, twin string")
    rows = {r.doc_id: (r.kept_text, r.n_dropped, r.twin) for r in line_dedup.without_repeated_lines(frame).collect()}
    assert rows == {1: ("", 1, "b"), 2: ("", 1, "c"), 3: (LONG, 0, "d")}
    assert line_dedup.without_repeated_lines(docs([])).count() == 0
    assert line_dedup.keep_bitmaps(docs([(1, LONG), (2, LONG)])).count() == 0


def test_bitmaps_list_only_words_that_lose_lines(docs):
    long_text = "\n".join([f"{i} a line that only one document has" for i in range(200)] + [LONG])
    bitmaps = line_dedup.keep_bitmaps(docs([(1, long_text), (2, LONG), (3, LONG)])).collect()
    found_words = {r.doc: (r.n_dropped, [tuple(e) for e in r.bitmap]) for r in bitmaps}
    assert found_words == {1: (1, [(3, ~(1 << 8))]), 2: (1, [(0, ~1)])}


def test_native_plan(spark, docs, tmp_path, capsys):
    docs(ROWS).write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    line_dedup.line_table(stored).explain("formatted")
    places = line_dedup.line_places(stored)
    line_dedup.repeated_lines(places, places.select("high", "low").limit(0)).explain("formatted")
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert "rangepartitioning(high" in plan and "Window" in plan
