"""Secret scans over a trigram index: rules are matched only where their trigrams occur."""

from __future__ import annotations

import re._constants as sre
import re._parser as regex_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.shared import packed, unpacked
from plumbline.sources.storage import store

MOST_STRINGS = 64
MOST_CLASS = 8
ANYTHING = frozenset([frozenset()])
Query = frozenset  # of sets of trigrams: any set suffices, all of its trigrams are needed


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` means the same in Java and Python; matches are taken leftmost and
    without overlap, and kept if group ``value`` has at least ``least`` characters."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0
    base: bool = False


# The rules. A minimum length at the end of a greedy run is part of the pattern.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("private_key", r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,256}:[^\s/:@]{1,256}@"),
]


def _both(a: Query, b: Query) -> Query:
    if a == ANYTHING or b == ANYTHING:
        return b if a == ANYTHING else a
    return frozenset(x | y for x, y in product(a, b)) if len(a) * len(b) <= MOST_STRINGS else a


def _either(parts: list[Query]) -> Query:
    return ANYTHING if ANYTHING in parts else frozenset().union(*parts)


def _of_strings(strings: set[str]) -> Query:
    needed = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
    return ANYTHING if frozenset() in needed else frozenset(needed)


def _class_strings(members) -> set[str] | None:
    found: set[str] = set()
    for kind, value in members:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MOST_CLASS:
            found.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return found if len(found) <= MOST_CLASS else None


def _node(kind, value) -> tuple[set[str] | None, Query]:
    """(all strings the node matches, if few; what its matches need)."""
    if kind is sre.LITERAL:
        return {chr(value).lower()}, ANYTHING
    if kind is sre.AT:
        return {""}, ANYTHING
    if kind is sre.IN:
        return _class_strings(value), ANYTHING
    if kind is sre.SUBPATTERN:
        return _sequence(value[3])
    if kind is sre.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(strings is not None for strings, _ in parts):
            return set().union(*[strings for strings, _ in parts]), ANYTHING
        return None, _either([q if strings is None else _of_strings(strings) for strings, q in parts])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = value
        strings, needed = _sequence(body)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {""}, ANYTHING
        if least == 0:
            return None, ANYTHING
        return None, needed if strings is None else _of_strings(strings)
    return None, ANYTHING


def _sequence(nodes) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, ANYTHING, True
    for kind, value in nodes:
        found, needed = _node(kind, value)
        if found is not None and len(found) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in found}
            continue
        whole = False
        query = _both(_both(query, _of_strings(strings)), needed)
        strings = found if found is not None else {""}
    return (strings, ANYTHING) if whole else (None, _both(query, _of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """Which lower-case trigrams a text must hold for the pattern to match; ANYTHING if none is sure."""
    strings, query = _sequence(regex_parser.parse(pattern))
    query = query if strings is None else _of_strings(strings)
    return frozenset(needed for needed in query if not any(other < needed for other in query))


def trigram_index(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, key): which texts hold which of the trigrams the rules ask for."""
    folded = keyed.select("_key", F.lower("_text").alias("folded"))
    held = F.array_compact(F.array(*[F.when(F.col("folded").contains(t), F.lit(t)) for t in trigrams]))
    return folded.select("_key", F.explode(held).alias("trigram")).select("trigram", "_key")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(key, kinds): the rules whose Boolean query a text's postings satisfy.

    The postings of a conjunction are intersected by counting them per text. The clauses are as few
    as the rules; texts holding a common trigram are spread by their key.
    """
    spark = index.sparkSession
    clauses = [
        (kind, number, trigram, len(needed))
        for kind, query in queries.items() for number, needed in enumerate(sorted(query, key=sorted)) for trigram in needed
    ]
    asked = spark.createDataFrame(clauses, "kind string, clause int, trigram string, needed int")
    pairs = index.distinct().join(F.broadcast(asked), "trigram")
    met = pairs.groupBy("_key", "kind", "clause", "needed").agg(F.count("*").alias("n")).filter("n = needed")
    return met.groupBy("_key").agg(F.collect_set("kind").alias("_kinds"))


def match_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of a rule's kept matches as (start, rank, end) in code points, end exclusive.

    A text is its pieces between matches with the matches in between, so their lengths give the
    places; no function gives them directly.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else found
    zipped = F.arrays_zip(F.split(text, rule.pattern, -1).alias("piece"), found.alias("match"), values.alias("value"))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def step(state: Column, part: Column) -> Column:
        start = state["place"] + F.length(part["piece"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"))
        kept = part["match"].isNotNull() & (F.length(part["value"]) >= rule.least)
        return F.struct(end.alias("place"), F.when(kept, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("place"), nothing.alias("spans"))
    return F.when(text.rlike(rule.pattern), F.aggregate(zipped, start, step)["spans"]).otherwise(nothing)


def find_secrets(documents: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Add ``secrets``: array of (start, rank, end) by start then rank, rank being the rule's place.

    A null text is empty. Every rule with mandatory trigrams is matched only in texts that the index
    gives for it; a rule without is matched in all. Texts are found again by a 64-bit hash: were two
    to share it, one more text would be matched, with the same result. Other columns
    stay, but one named ``secrets`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = packed(documents, _text=whole, _key=F.xxhash64(*[F.col(c) for c in documents.columns if c == "doc_id"], whole))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if query != ANYTHING}
    trigrams = sorted({t for query in indexed.values() for needed in query for t in needed})
    index = store(trigram_index(keyed, trigrams), "trigrams")
    joined = keyed.join(candidates(index, indexed), "_key", "left")
    kinds = F.coalesce(F.col("_kinds"), F.array().cast("array<string>"))
    nothing = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = [
        F.when(F.array_contains(kinds, rule.kind), match_spans(F.col("_text"), rule, rank)).otherwise(nothing)
        if rule.kind in indexed else match_spans(F.col("_text"), rule, rank)
        for rank, rule in enumerate(rules)
    ]
    return joined.select(*unpacked(joined, ("secrets",)), F.array_sort(F.concat(*parts)).alias("secrets"))


def span_text(spans: Column, rules: list[Rule] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))
    ), ",")


def secret_table(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of their spans, and all spans."""
    found = find_secrets(documents.select("doc_id", "text"), rules=rules).select("doc_id", "secrets")
    secrets = F.col("secrets")
    ranks = {rule.kind: rank for rank, rule in enumerate(rules)}
    base = F.filter(secrets, lambda s: s["rank"].isin([ranks[r.kind] for r in rules if r.base]))

    def count(kind: str) -> Column:
        return F.size(F.filter(secrets, lambda s: s["rank"] == ranks[kind])).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(rule.kind) for rule in rules if rule.base],
        F.sha2(span_text(base, rules).cast("binary"), 256).alias("base_sha256"),
        span_text(secrets, rules).alias("spans"),
    )
