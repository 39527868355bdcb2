"""Benchmark decontamination by Wu-Manber search for many word sequences at once."""

from __future__ import annotations

import math
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.shared import packed, plain_words, share, unpacked
from plumbline.sources.storage import store

WINDOW_WORDS = 13
BLOCK_WORDS = 2
TABLE_BYTES = 32 << 20
MATCHES = "hits array<struct<start:bigint,end:bigint>>, items array<string>, n_words bigint"


class ShiftTables:
    """Wu-Manber tables for test strings of one length, in words.

    ``shift`` says for a block of words how far the window may move on: to the nearest place where
    a test string holds the block, or past it if none does. Where that is 0, ``buckets`` gives the
    test strings ending in the block.
    """

    def __init__(self, strings: dict[tuple, set]):
        self.length = len(next(iter(strings)))
        self.block = min(BLOCK_WORDS, self.length)
        self.default = self.length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list] = defaultdict(list)
        for string, items in strings.items():
            for end in range(self.block, self.length + 1):
                block = string[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.default), self.length - end)
            self.buckets[string[-self.block:]].append((list(string), items))

    def search(self, words: list) -> list[tuple[int, int, set]]:
        """(start, end, items) of every occurrence, starts rising."""
        found, shift, default = [], self.shift.get, self.default
        length, block, last = self.length, self.block, len(words)
        end = length
        while end <= last:
            suffix = tuple(words[end - block:end])
            move = shift(suffix, default)
            if move:
                end += move
                continue
            for string, items in self.buckets[suffix]:
                if words[end - length:end] == string:
                    found.append((end - length, end, items))
            end += 1
        return found


def test_windows(texts: list[tuple], size: int = WINDOW_WORDS) -> dict[tuple, set]:
    """Windows of ``size`` words with the ids of their items; a shorter item is one window."""
    windows: dict[tuple, set] = defaultdict(set)
    for item, text in texts:
        words = plain_words(text.encode() if text else None)
        for start in range(max(1, len(words) - size + 1) if words else 0):
            windows[tuple(words[start:start + size])].update([] if item is None else [str(item)])
    return windows


def build_tables(texts: list[tuple], size: int = WINDOW_WORDS) -> list[ShiftTables]:
    by_length: dict[int, dict] = defaultdict(dict)
    for window, items in test_windows(texts, size).items():
        by_length[len(window)][window] = items
    return [ShiftTables(strings) for _, strings in sorted(by_length.items())]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [(s, e) for s, e in merged]


def _matcher(spark, tables: list[ShiftTables]):
    shared = share(spark, tables)

    def match(texts: pd.Series, earlier: pd.Series, known: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans, items in zip(texts, earlier, known):
            words = plain_words(text.encode("utf-8", "surrogatepass") if text else None)
            found = [hit for table in shared() for hit in table.search(words)]
            every = [(s, e) for s, e, _ in found] + [(x["start"], x["end"]) for x in (spans if spans is not None else [])]
            ids = set(items if items is not None else []).union(*[i for _, _, i in found])
            rows.append(([{"start": s, "end": e} for s, e in _union(every)], sorted(ids), len(words)))
        return pd.DataFrame(rows, columns=["hits", "items", "n_words"])

    return F.pandas_udf(match, MATCHES).asNondeterministic()  # or a filter would run it twice


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "contamination",
    window: int = WINDOW_WORDS, table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """Add ``column``: struct of ``hits`` (merged spans of words inside occurrences of test windows),
    ``items`` (their item_ids as text, sorted) and ``n_words``.

    Documents are searched where they lie. The test strings are measured first: up to ``table_bytes``
    go to the tasks in one piece, more of them in as many hashed parts as it takes, each one pass over
    the documents whose finds the next pass extends. Null or empty texts have no words; items without
    words match nothing; an item without an id marks words but is not listed. Other columns stay, but
    one of the name ``column`` is replaced.
    """
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("body"))
    size = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = max(1, math.ceil(size / table_bytes))
    struct = MATCHES.replace(" ", ":", 1).replace(", items ", ",items:").replace(", n_words ", ",n_words:")
    found = packed(documents, text=F.col(text), found=F.lit(None).cast(f"struct<{struct}>"))
    for part in range(parts):
        share = items.filter(F.pmod(F.xxhash64("item", "body"), F.lit(parts)) == part)
        match = _matcher(spark, build_tables([tuple(r) for r in share.collect()], window))
        previous: Column = F.col("found")
        found = found.withColumn("found", match(F.col("text"), previous["hits"], previous["items"]))
        if part < parts - 1:
            found = store(found, "decontaminate")
    return found.select(*unpacked(found, (column,)), F.col("found").alias(column))


def hit_words(found: Column) -> Column:
    return F.aggregate(found["hits"], F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])


def is_contaminated(found: Column) -> Column:
    """At least a twentieth of the words, and at least one, lie inside test windows."""
    hit = hit_words(found)
    return (hit > 0) & (20 * hit >= found["n_words"])


def contamination_table(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of its items, and whether it is contaminated."""
    marked = find_contamination(documents.select("doc_id", "text"), benchmark).drop("text")
    found = F.col("contamination")
    return marked.select(
        "doc_id",
        found["n_words"].alias("n_words"),
        hit_words(found).alias("n_hit"),
        F.size(found["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(found["items"], ",").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(found).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    marked = find_contamination(packed(documents, text=F.col("text")), benchmark)
    clean = marked.filter(~is_contaminated(F.col("contamination")))
    return clean.select(*unpacked(clean))
