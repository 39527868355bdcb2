import csv
import io
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.sources import readers, records


@pytest.fixture
def split_size(spark):
    """Cut files into splits of few bytes."""
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield cut
    spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_csv_in_many_splits_keeps_file_order(spark, tmp_path, split_size):
    path = tmp_path / "lines.csv"
    path.write_text("n,word\n" + "".join(f"{i},w{i}\n" for i in range(20_000)))
    split_size(20_000)
    found = readers.read_numbered_csv(spark, str(path), "csv-test")
    assert found.filter(F.col("row_number") != F.col("n") + 1).count() == 0
    assert found.count() == 20_000


def test_csv_types_and_missing_texts(spark, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text('whole,number,truth,empty,word,mixed\n1,1.5,True,,"a,b",1d\nNA,inf,False,NULL,N/A,2\n3,1e3,true,nan,"q""q",3\n')
    found = readers.read_typed_csv(spark, str(path))
    assert dict(found.dtypes) == {"whole": "bigint", "number": "double", "truth": "boolean", "empty": "double",
                                  "word": "string", "mixed": "string"}
    rows = found.collect()
    assert [r["whole"] for r in rows] == [1, None, 3]
    assert [r["word"] for r in rows] == ["a,b", None, 'q"q']
    assert rows[1]["number"] == float("inf")


def rows_of(path, spark):
    found = readers.read_numbered_csv(spark, str(path)).orderBy("row_number").collect()
    assert [r["row_number"] for r in found] == list(range(1, len(found) + 1))
    return [tuple(r)[:-1] for r in found]


def test_fields_may_span_lines(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('n,note\n1,"two\nlines"\n2,"a, ""b"""\n3\n')
    assert rows_of(path, spark) == [(1, "two\nlines"), (2, 'a, "b"'), (3, None)]
    path.write_text('n,"no\nte"\n1,"\n\n"\n')
    assert readers.read_typed_csv(spark, str(path)).columns == ["n", "no\nte"]


def test_quotes_that_open_no_field_are_text(spark, tmp_path):
    path = tmp_path / "stray.csv"
    path.write_text('n,what\n1,5" pipe\n2,"6"" pipe"\n3,a"b"c"\n4,say "hi\n')
    assert rows_of(path, spark) == [(1, '5" pipe'), (2, '6" pipe'), (3, 'a"b"c"'), (4, 'say "hi')]


def written(seed, rows=400):
    """Random records as text, some quoted over lines, some with quotes that are text, and what they say."""
    rng = random.Random(seed)
    pieces = ["a", "ä", ",", "\n", "\r\n", '"', '""', "word ", " ", "\n\n\n", "x" * 40, "1,2\n3"]
    text, wanted = ["n,left,right" + rng.choice(["\n", "\r\n"])], []
    for i in range(rows):
        cells = []
        for _ in range(2):
            body = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7)))
            if rng.random() < 0.1:
                body = body * 200
            if rng.random() < 0.5:
                body = body.replace("\n", " ").replace("\r", " ").replace(",", ";").strip('" ') + "z"
                cells.append((body, body))
            else:
                body = "q" + body + "q"
                cells.append(('"' + body.replace('"', '""') + '"', body))
        text.append(f"{i},{cells[0][0]},{cells[1][0]}" + rng.choice(["\n", "\r\n"]) + rng.choice(["", "", "\n"]))
        wanted.append((i, cells[0][1], cells[1][1]))
    return "".join(text), wanted


@pytest.mark.parametrize("seed,size", [(1, 1 << 30), (2, 5_000), (3, 1_200)])
def test_records_cut_in_many_splits(spark, tmp_path, split_size, seed, size):
    text, wanted = written(seed, 400 if size > 2_000 else 80)
    assert [(int(r[0]), r[1], r[2]) for r in list(csv.reader(io.StringIO(text, newline="")))[1:] if r] == wanted
    path = tmp_path / "random.csv"
    path.write_bytes(text.encode())
    split_size(size)
    assert rows_of(path, spark) == wanted
    if size < 1 << 30:
        assert records._lines(spark, str(path), "\n").rdd.getNumPartitions() >= min(8, len(text) // size)


def test_one_field_over_many_splits_and_files(spark, tmp_path, split_size):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    long = "\n".join(f"line {i}" for i in range(800))
    (folder / "a.csv").write_text(f'n,note\n1,"{long}"\n2,b\n3,"x\ny"\n')
    (folder / "b.csv").write_text(f'n,note\n4,d\n5,"{long}"')
    split_size(1_000)
    found = rows_of(folder, spark)
    assert found == [(1, long), (2, "b"), (3, "x\ny"), (4, "d"), (5, long)]


def test_only_pieces_at_borders_are_brought_together(spark, tmp_path, split_size):
    path = tmp_path / "pieces.csv"
    path.write_text("n,note\n" + "".join(f'{i},"a\nb"\n' for i in range(2_000)))
    split_size(2_000)
    lines = records._lines(spark, str(path), "\n").withColumn(records.SEQUENCE, F.monotonically_increasing_id())
    lines = lines.withColumn(records.CODE, records.line_code(F.col(records.TEXT)))
    states = records.split_states(lines)
    cut = lines.drop(records.SEQUENCE).join(F.broadcast(states.drop("ends_inside")), [records.PATH, records.BLOCK, records.LENGTH]).mapInArrow(
        records.cut_lines, records.CUT)
    splits = states.count()
    assert splits > 10 and cut.filter(F.col(records.KIND) != records.WHOLE).count() <= 2 * splits
    plan = records.cut_records(spark, str(path))._jdf.queryExecution().toString()
    assert "multiLine" not in plan


def test_an_unclosed_field_is_refused(spark, tmp_path):
    path = tmp_path / "open.csv"
    path.write_text('n,note\n1,"never closed\n2,b\n')
    with pytest.raises(ValueError, match="not closed"):
        readers.read_typed_csv(spark, str(path))
    answer = readers.ingest_csv(spark, str(path), str(tmp_path / "out")).first()
    assert answer["status"] == "rejected" and not os.path.exists(tmp_path / "out")


@pytest.mark.parametrize("seed", range(5))
def test_line_codes_and_bits(spark, seed):
    """Codes against a character-by-character reading, and their composition against a running state."""
    rng = random.Random(seed)
    lines = ["".join(rng.choice('a,"""') for _ in range(rng.randrange(0, 9))) for _ in range(300)]

    def run(line, state):
        fresh = state == 0
        for c in line:
            if state == 1:
                state = 2 if c == '"' else 1
            elif state == 2 and c == '"':
                state = 1
            elif c == '"' and fresh:
                state = 1
            else:
                state, fresh = 0, c == ","
                continue
            fresh = False
        return int(state == 1)

    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    codes = [r[0] for r in frame.orderBy("i").select(records.line_code(F.col("line"))).collect()]
    assert codes == [run(x, 0) + 2 * run(x, 1) for x in lines]
    for inside in (False, True):
        state, wanted = int(inside), []
        for code in codes:
            state = code >> state & 1
            wanted.append(bool(state))
        assert records.bits_behind(np.array(codes, np.int8), inside).tolist() == wanted
        cutter, rows = records.SplitCutter("p", 0, inside), []
        for start in range(0, len(lines), 37):
            cutter.feed(pa.array(lines[start:start + 37]), np.array(codes[start:start + 37], np.int8))
        cutter.close()
        rows = [r for b in cutter.taken() for r in b.column(records.TEXT).to_pylist()]
        joined = [x for x in rows if x.strip()]
        assert "".join(joined).replace("\n", "") == "".join(lines)


def folders(path):
    return sorted(os.listdir(path))


def test_ingest_leaves_nothing_behind(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    out.mkdir()
    (data / "one.csv").write_text("n,w\n1,a\n2,b\n")
    (data / "two.csv").write_text("n,w\n2,b\n1,a\n")
    (data / "header.csv").write_text("n,w\n")
    (data / "empty.csv").write_text("")
    (data / "wide.csv").write_text("n,w\n1,2,3\n")
    (data / "one.txt").write_text("n,w\n1,a\n")
    first = readers.ingest_csv(spark, str(data / "one.csv"), str(out / "one"))
    assert first.first()["status"] == "ingested" and folders(out) == ["one"]
    catalog = first.withColumn("id", F.lit(7).cast("bigint"))
    for name, status in (("two", "reused"), ("header", "rejected"), ("empty", "rejected"), ("wide", "rejected"), ("none", "rejected")):
        answer = readers.ingest_csv(spark, str(data / f"{name}.csv"), str(out / name), catalog).first()
        assert (answer["status"], answer["file_path"]) == (status, None), name
        assert folders(out) == ["one"]
    assert readers.ingest_csv(spark, str(data / "one.txt"), str(out / "t")).first()["status"] == "rejected"
    assert folders(out) == ["one"]
    with pytest.raises(FileExistsError):
        readers.ingest_csv(spark, str(data / "two.csv"), str(out / "one"))
    stored = spark.read.parquet(str(out / "one")).orderBy("row_number").collect()
    assert [tuple(r) for r in stored] == [(1, "a", 1), (2, "b", 2)] and folders(out) == ["one"]


def test_a_failed_write_leaves_nothing(spark, tmp_path, monkeypatch):
    (tmp_path / "one.csv").write_text("n,w\n1,a\n")
    out = tmp_path / "out"
    out.mkdir()

    def broken(*_):
        raise OSError("no room")

    monkeypatch.setattr(readers, "move_folder", broken)
    with pytest.raises(OSError, match="no room"):
        readers.ingest_csv(spark, str(tmp_path / "one.csv"), str(out / "one"))
    assert folders(out) == []


def test_splits_that_change_between_passes_are_noticed(spark, tmp_path, split_size, monkeypatch):
    path = tmp_path / "lines.csv"
    path.write_text("n,word\n" + "".join(f"{i},w{i}\n" for i in range(5_000)))
    split_size(20_000)
    scan, sizes = readers.scan_csv, iter([3_000, 20_000])

    def changed(*arguments):
        split_size(20_000)
        found = scan(*arguments)
        split_size(next(sizes, 20_000))
        return found

    monkeypatch.setattr(readers, "scan_csv", changed)
    assert rows_of(path, spark) == [(i, f"w{i}") for i in range(5_000)]


def test_types_do_not_count_headers(spark, tmp_path):
    folder = tmp_path / "numbers.csv"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f"1,x\n{i},{i}.5\n\n  \n{i},NA\n")
    found = readers.read_typed_csv(spark, str(folder))
    assert dict(found.dtypes) == {"1": "bigint", "x": "double"} and found.count() == 6


def test_headers_that_differ_and_data_like_the_header(spark, tmp_path):
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "0.csv").write_text("n,7\n1,2\n")
    (folder / "1.csv").write_text("m,8\n3,4\n")
    found = readers.read_typed_csv(spark, str(folder))
    assert dict(found.dtypes) == {"n": "bigint", "7": "bigint"} and found.count() == 2
    path = tmp_path / "again.csv"
    path.write_text("n,7\n1,2\nn,7\n4,5\n")
    found = readers.read_numbered_csv(spark, str(path)).orderBy("row_number")
    assert dict(found.dtypes) == {"n": "string", "7": "bigint", "row_number": "bigint"}
    assert [tuple(r) for r in found.collect()] == [("1", 2, 1), ("n", 7, 2), ("4", 5, 3)]
