"""What several operators of this package need: words of bytes, row blocks."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Words of ASCII letters and digits and of every non-ASCII byte; A-Z become a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of UTF-8 text; ASCII signs and spaces part them. Null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def plain_word_parts(text: str | None, size: int = 1 << 20):
    """The same words of a whole text in lists, each from about ``size`` bytes: a long text is never
    held as single words."""
    data = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES) if text else b""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + size) if start + size < len(data) else len(data)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def share(spark: SparkSession, value):
    """A function that gives a broadcast value in any task; the value's classes travel with it."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    held: list = []

    def read():
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return read


def share_each(spark: SparkSession, values):
    """A function that gives any one of several broadcast values in any task. A task holds the one it asked
    for last; the others stay in the executor's files."""
    sent = [spark.sparkContext.broadcast(cloudpickle.dumps(value)) for value in values]
    held: dict = {}

    def read(number: int):
        if number not in held:
            held.clear()
            held[number] = pickle.loads(sent[number].value)
            vars(sent[number]).pop("_value", None)  # the bytes; they are read again when asked for again
        return held[number]

    return read


def md5_block(key: Column, digits: int = 2) -> Column:
    """The leading hex digits of a key's MD5: an even block that SQL engines agree on."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, digits)


def packed(df: DataFrame, **extra: Column) -> DataFrame:
    """The rows as one struct column ``row`` beside computed columns: no name of theirs can clash."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    return df.select(own, *[column.alias(name) for name, column in extra.items()])


def unpacked(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns that ``packed`` put away, but for those a new column replaces."""
    return [F.col("row").getField(c).alias(c) for c in df.schema["row"].dataType.names if c not in without]


def text_hash(text: Column) -> Column:
    """64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
