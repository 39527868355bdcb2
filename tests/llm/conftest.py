import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), over several partitions, with columns
    whose names operators like to use themselves."""

    def build(rows, partitions=3):
        listed = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "row", 7, "key", 1.5, "x", 3) for r in rows]
        schema = DOCS + ", row string, key bigint, text_hash string, score double, _key string, size bigint"
        frame = spark.createDataFrame(listed, schema)
        return frame.repartition(partitions) if rows else frame

    return build


