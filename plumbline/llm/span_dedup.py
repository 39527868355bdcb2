"""Substring dedup over sliding spans of consecutive sentences."""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.shared import packed, text_hash, unpacked
from plumbline.sources.storage import discard, store

SPAN_SENTENCES = 3
SPAN_WORDS = 20
LAST_ID = 2**63 - 1
LONG_SENTENCE = 12  # the most words of a piece; every passage of more than four times as many holds a whole span
SENTENCE_END = re.compile(r"[.!?]+[^\w\s]*\s+|\n+")
WORD = re.compile(r"\S+")


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, words) of each sentence, white space behind it included; together all of the text.

    A sentence ends after closing signs or at a line break. One of more than ``LONG_SENTENCE`` words is
    cut after the word with the least CRC-32, the last of equal ones, of any ``LONG_SENTENCE`` words in a
    row. So no piece is longer, and a passage is cut alike wherever it stands but for that many words at
    either end: one of more than 50 words keeps over 24 words between, three whole pieces or more.
    """
    found, start = [], 0
    ends = [m.end() for m in SENTENCE_END.finditer(text)]
    for end in [*ends, len(text)]:
        piece = text[start:end]
        words = piece.split()
        if len(words) > LONG_SENTENCE:
            begin = start
            stops, first = [m.end() for m in WORD.finditer(piece)], 0
            for word in cuts(words):
                found.append((begin, start + stops[word], " ".join(words[first:word + 1])))
                begin, first = start + stops[word], word + 1
            found.append((begin, end, " ".join(words[first:])))
        elif words:
            found.append((start, end, " ".join(words)))
        elif end > start and found:  # white space alone goes with the sentence before
            found[-1] = (found[-1][0], end, found[-1][2])
        else:
            continue
        start = end
    return [s for s in found if s[2]]


def cuts(words: list[str]) -> list[int]:
    """Numbers of the words of a long sentence that a piece ends with, but for the last word."""
    hashes = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words]
    found, least = [], -1
    for last in range(LONG_SENTENCE - 1, len(words)):
        first = last - LONG_SENTENCE + 1
        if least < first:
            window = hashes[first:last + 1]
            window.reverse()
            least = last - window.index(min(window))
        elif hashes[last] <= hashes[least]:
            least = last
        else:
            continue
        found.append(least)
    return found[:-1] if found[-1] == len(words) - 1 else found


def span_ends(pieces: list[tuple[int, int, str]]) -> list[int]:
    """For each sentence the end of the shortest run from it with enough sentences and words, or -1."""
    words, count = np.cumsum([0, *[p[2].count(" ") + 1 for p in pieces]]), len(pieces)
    ends = np.maximum(np.arange(count) + SPAN_SENTENCES, np.searchsorted(words, words[:-1] + SPAN_WORDS))
    return np.where(ends <= count, ends, -1).tolist()


def span_hashes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, signed hash) of every span of a text."""
    pieces = sentences(text) if text else []
    bodies = [p[2].encode("utf-8", "surrogatepass") for p in pieces]
    places = [0, *accumulate(len(b) + 1 for b in bodies)]
    joined, digest = b"\n".join(bodies), xxhash.xxh64_intdigest
    runs = [(start, end) for start, end in enumerate(span_ends(pieces)) if end > 0]
    hashes = [digest(joined[places[start]:places[end] - 1]) for start, end in runs]
    return np.array([start for start, _ in runs], np.int64), np.array(hashes, np.uint64).view(np.int64)


def without_spans(text: str | None, starts) -> tuple[str | None, int, int, int]:
    """(what is left, sentences, removed sentences, removed words) when the spans at ``starts`` go."""
    pieces = sentences(text) if text else []
    if starts is None or not len(starts):
        return text, len(pieces), 0, 0
    ends = span_ends(pieces)
    gone = np.zeros(len(pieces) + 1, np.int64)
    for start in starts:
        gone[start] += 1
        gone[ends[start]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    words = sum(p[2].count(" ") + 1 for p, g in zip(pieces, gone) if g)
    return "".join([text[s:e] for (s, e, _), g in zip(pieces, gone) if not g]), len(pieces), int(gone.sum()), words


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, twin, starts): spans that an earlier document, or an earlier place of the same one, has.

    The first place of a span is the least by doc_id (null last), text hash and position. Spans are stored once and
    counted with partial sums, so one that a third of all documents share is one row in the join.
    ``twin`` tells texts of one doc_id apart; rows equal in both are one document.
    """
    texts = documents.select(F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("doc_id"), text_hash(F.col("text")).alias("twin"), "text")

    def spans(batches):
        for batch in batches:
            parts = [span_hashes(t) for t in batch["text"]]
            counts = [len(p[0]) for p in parts]
            yield pd.DataFrame({
                "span": np.concatenate([p[1] for p in parts]), "doc_id": np.repeat(batch["doc_id"].to_numpy(np.int64), counts),
                "twin": np.repeat(batch["twin"].to_numpy(np.int64), counts), "start": np.concatenate([p[0] for p in parts]),
            })

    found = store(texts.mapInPandas(spans, "span long, doc_id long, twin long, start int"), "all-spans")
    place = F.struct("doc_id", "twin", "start")
    firsts = found.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    firsts = store(firsts.select("span", "first"), "first-places")  # a plain join side, so that Spark can split a hot span
    later = found.join(firsts, "span").filter(place != F.col("first"))
    hits = store(later.groupBy("doc_id", "twin").agg(F.sort_array(F.collect_set("start")).alias("starts")), "spans")
    discard(found)
    discard(firsts)
    return hits


def without_repeats(documents: DataFrame) -> DataFrame:
    """Documents with ``kept_text`` (null for null), ``n_sentences``, ``n_removed`` and ``n_removed_words``.

    A span is a run of at least ``SPAN_SENTENCES`` sentences and ``SPAN_WORDS`` words; sentences inside
    any but its first occurrence go. Texts shorter than a span keep everything. Other columns stay.
    """
    hits = repeated_spans(documents)
    rows = packed(documents, doc_id=F.coalesce(F.col("doc_id"), F.lit(LAST_ID)), twin=text_hash(F.col("text")))
    joined = rows.join(hits, ["doc_id", "twin"], "left")

    @F.pandas_udf("kept_text string, n_sentences bigint, n_removed bigint, n_removed_words bigint")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [without_spans(t, s) for t, s in zip(texts, starts)]
        return pd.DataFrame(rows, columns=["kept_text", "n_sentences", "n_removed", "n_removed_words"])

    done = joined.withColumn("cut", cut.asNondeterministic()(F.col("row").getField("text"), "starts"))
    return done.select(*unpacked(done, ("kept_text", "n_sentences", "n_removed", "n_removed_words")), "cut.*")


def span_table(documents: DataFrame) -> DataFrame:
    found = without_repeats(documents.select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("kept_text"), F.lit("")).cast("binary"), 256)
    return found.select("doc_id", "n_sentences", "n_removed", "n_removed_words", kept.alias("kept_sha256"))
