"""Line dedup: keep bitmaps of the lines that other documents repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.shared import packed, text_hash, unpacked
from plumbline.sources.storage import discard, store

MIN_LENGTH = 20
MIN_DOCUMENTS = 3
SAMPLE_ROWS = 1_000_000
HOT_SAMPLED = 100  # a key seen so often in the sample is summed first: at most SAMPLE_ROWS / HOT_SAMPLED keys
WORD_BITS = 64
# The letters whose case does not count, and the blanks that do not at a line's ends.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def text_lines(text: Column) -> Column:
    """The lines of a text, parted at line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return F.btrim(line, F.lit(BLANKS))


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else; the quick way where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_places(documents: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(high, low, doc, twin, line): 128 hash bits of the key of every line that is long enough.

    ``twin`` tells texts of one doc_id apart; no text travels on.
    """
    texts = documents.select(F.col("doc_id").alias("doc"), text_hash(F.col("text")).alias("twin"), lowered(F.col("text")).alias("text"))
    lines = texts.select("doc", "twin", F.posexplode(text_lines(F.col("text"))).alias("line", "body"))
    keys = lines.select("doc", "twin", "line", line_key(F.col("body")).alias("key")).filter(F.length("key") >= min_length)
    return keys.select(
        F.xxhash64("key").alias("high"), F.xxhash64(F.lit(1), "key").alias("low"), "doc", "twin", "line"
    )


def hot_keys(places: DataFrame, sample_rows: int = SAMPLE_ROWS, hot: int = HOT_SAMPLED) -> DataFrame:
    """(high, low) of keys found ``hot`` times or more among about ``sample_rows`` sampled lines. The sample
    steers only: a key gives the same result on either path."""
    rows = places.count()
    sampled = places if rows <= sample_rows else places.sample(fraction=sample_rows / rows, seed=11)
    return sampled.groupBy("high", "low").agg(F.count("*").alias("n")).filter(F.col("n") >= hot).select("high", "low")


def repeated_lines(places: DataFrame, hot: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(doc, twin, line) of every line to drop: its key is in ``min_documents`` documents or more, of
    which this is not the one with the largest id (null: the smallest).

    Places are range-partitioned by key hash and sorted by document, largest first, and position. In
    that stream the first document of a key is the one that keeps its lines, and the last rank is the
    number of its documents. Keys of the short list ``hot`` are not sent: their documents are counted
    with partial sums in each task, and the outcome, one row a key, goes to the places instead.
    """
    keys = ["high", "low"]
    common = places.join(F.broadcast(hot), keys, "left_semi")
    # Null documents count as one, and as the least.
    counted = common.groupBy(*keys).agg(
        (F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))).alias("documents"), F.max("doc").alias("last")
    ).filter(F.col("documents") >= min_documents)
    from_hot = places.join(F.broadcast(counted), keys).filter(~F.col("doc").eqNullSafe(F.col("last")))
    rare = places.join(F.broadcast(hot), keys, "left_anti").repartitionByRange(*keys)
    stream = Window.partitionBy(*keys).orderBy(F.col("doc").desc_nulls_last())
    whole = Window.partitionBy(*keys)
    ranked = rare.withColumn("rank", F.dense_rank().over(stream)).withColumn("documents", F.max("rank").over(whole))
    from_stream = ranked.filter((F.col("documents") >= min_documents) & (F.col("rank") > 1))
    return from_stream.select("doc", "twin", "line").unionAll(from_hot.select("doc", "twin", "line"))


def keep_bitmaps(
    documents: DataFrame, min_length: int = MIN_LENGTH, min_documents: int = MIN_DOCUMENTS,
    sample_rows: int = SAMPLE_ROWS, hot: int = HOT_SAMPLED,
) -> DataFrame:
    """(doc, twin, n_dropped, bitmap) of every text that loses lines; all other texts keep all.

    ``bitmap`` lists, by rising number, the 64-bit words in which some line goes: bit i of word w is
    1 where line 64 * w + i stays. Words that are not listed are all ones. Keys found in fewer than
    ``min_documents`` documents, or shorter than ``min_length`` code points, lose nothing. Documents
    are told apart by doc_id; rows of equal doc_id are one document.
    """
    places = store(line_places(documents, min_length), "line-places")
    common = store(hot_keys(places, sample_rows, hot), "hot-lines")
    dropped = repeated_lines(places, common, min_documents)
    word, bit = F.floor(F.col("line") / WORD_BITS).cast("int"), (F.col("line") % WORD_BITS).cast("int")
    words = dropped.groupBy("doc", "twin", word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("gone")
    )
    entry = F.struct("word", F.bitwise_not("gone").alias("keep"))
    bitmaps = store(words.groupBy("doc", "twin").agg(
        F.sum(F.bit_count("gone")).cast("bigint").alias("n_dropped"), F.sort_array(F.collect_list(entry)).alias("bitmap")
    ), "keep-bitmaps")
    discard(places)
    discard(common)
    return bitmaps


def kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps, in their order."""
    words = F.map_from_entries(bitmap)

    def stays(_, place):
        keep = F.coalesce(F.try_element_at(words, F.floor(place / WORD_BITS).cast("int")), F.lit(-1).cast("bigint"))
        return F.call_function("getbit", keep, (place % WORD_BITS).cast("int")) == 1

    return F.filter(lines, stays)


def without_repeated_lines(documents: DataFrame, **settings) -> DataFrame:
    """Documents with ``kept_text`` (null for null), ``n_lines`` and ``n_dropped``; settings as of ``keep_bitmaps``.

    Only bitmaps are joined to the texts. Null and empty texts are one empty line, which stays; rows
    that are equal lose the same lines; an empty table stays empty; very long texts are no special
    case. Other columns stay, but those of the three names are replaced.
    """
    bitmaps = keep_bitmaps(documents, **settings)
    rows = packed(documents, key_doc=F.col("doc_id"), key_twin=text_hash(F.col("text")))
    same = F.col("key_doc").eqNullSafe(F.col("doc")) & (F.col("key_twin") == F.col("twin"))
    joined = rows.join(bitmaps, same, "left")
    text = F.col("row").getField("text")
    kept = F.when(F.col("bitmap").isNull(), text).otherwise(F.array_join(kept_lines(text_lines(text), F.col("bitmap")), "\n"))
    return joined.select(
        *unpacked(joined, ("kept_text", "n_lines", "n_dropped")), kept.alias("kept_text"),
        F.size(text_lines(text)).cast("bigint").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"),
    )


def line_table(documents: DataFrame) -> DataFrame:
    found = without_repeated_lines(documents.select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))
