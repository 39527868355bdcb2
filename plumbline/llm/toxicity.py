"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.llm.shared import packed, plain_word_parts, share, unpacked
from plumbline.sources.storage import discard, store

CLASSES = ("ordinary", "toxic")
ROWS_PER_CLASS = 3_000  # the bound of the labelled sample: rows of each class
CALIBRATION_SHARE = 3  # one in so many sampled rows only calibrates
DISCOUNT = 10.0  # of so many documents the discount leaves an eighth, of fewer less, of many more nearly all
MARGIN = 2.0  # times as often as the other class has an expression is no evidence yet
CONTEXT_DOCUMENTS = 100  # added to those of each context, so that pairs after rare contexts weigh less
COPY_KEYS = 4
COPY_WORDS = 5
THRESHOLD = 0.7
SLICE_WORDS = 1 << 18
COUNTED_KEYS = 1 << 20  # counts that a task holds before it adds them up or hands them on
NEWTON_STEPS = 50


def held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == 1


@dataclass
class Model:
    """Word numbers, and for each class (columns) how many times as likely as in the shared distribution a
    word is after a context: where the class's pairs say something of their own (``pairs``), else the weight
    of the backoff after a context times that of the word. Word 0 stands for the words that are not known,
    whose shared counts are the same in both classes."""

    numbers: dict[bytes, int]
    pairs: np.ndarray  # context * words + word, sorted
    pair_words: np.ndarray
    backoff: np.ndarray
    words: np.ndarray

    def ratios(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Log of the toxic over the ordinary likelihood of words after contexts."""
        likelihood = self.backoff[context] * self.words[word]
        if len(self.pairs):
            key = context * len(self.words) + word
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            seen = self.pairs[at] == key
            likelihood[seen] = self.pair_words[at[seen]]
        logs = np.log(likelihood)
        return logs[:, 1] - logs[:, 0]

    def evidence(self, texts) -> np.ndarray:
        """Log-likelihood ratio of every text over its number of expressions; 0 without words.

        As in training, an expression (a word with the one before it) counts once a text. The first
        word follows an unknown one.
        """
        size = len(self.words)
        out = np.zeros(len(texts))
        waiting: list[tuple[int, np.ndarray]] = []
        total = 0

        def settle() -> None:
            keys = np.concatenate([k for _, k in waiting])
            starts = np.cumsum([0, *[len(k) for _, k in waiting[:-1]]])
            sums = np.add.reduceat(self.ratios(keys // size, keys % size), starts)
            for (row, k), value in zip(waiting, sums):
                out[row] = value / len(k)
            waiting.clear()

        for row, text in enumerate(texts):
            ids = text_ids(text, self.numbers)
            if len(ids):
                waiting.append((row, np.unique(np.concatenate([[0], ids[:-1]]) * size + ids)))
                total += len(ids)
                if total >= SLICE_WORDS:
                    settle()
                    total = 0
        if waiting:
            settle()
        return out


def _ids(words, numbers: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(numbers.get, words, repeat(0)), np.int64, len(words))


def text_ids(text: str | None, numbers: dict[bytes, int]) -> np.ndarray:
    """The numbers of a whole text's words."""
    parts = [_ids(words, numbers) for words in plain_word_parts(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _expected(single: np.ndarray, seen: np.ndarray, context: np.ndarray, word: np.ndarray, sizes: np.ndarray):
    """The counts of words and pairs that each class (columns) would have if it were like the other one: by
    their numbers of documents or, where that is more, by what follows the same contexts. A class with
    more texts of one language or subject has more of all their words, but not more of them after a context."""
    words, pairs = (counts[:, ::-1] * (sizes / sizes[::-1]) for counts in (single, seen))
    for kind in range(2):
        own, other = (np.bincount(context, seen[:, k], len(single)) for k in (kind, 1 - kind))
        after = seen[:, 1 - kind] * (own / np.maximum(other, 1.0))[context]
        words[:, kind] = np.maximum(words[:, kind], np.bincount(word, after, len(single)))
        pairs[:, kind] = np.maximum(pairs[:, kind], after)
    return words, pairs


def _excess(found: np.ndarray, expected: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What the discount leaves of the counts of two classes (columns): of a rare expression little, though
    never nothing, and no more than what a class has beyond ``MARGIN`` times what is expected of it. In the
    larger class more documents count as rare, as the smaller one's share says less."""
    rare = DISCOUNT * np.maximum(sizes / sizes[::-1], 1.0)
    left = found / (found + rare)
    left **= 3
    left *= found
    left -= MARGIN * expected
    return np.maximum(left, 0.0, out=left)


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(class, calibrates, text) of at most ``rows`` labelled documents of each class, the first by the MD5
    of their id, whole texts, without near copies. Several labels of one document count as toxic if one says so."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("class"))
    digest = F.md5(F.col("doc_id").cast("string"))
    named = known.join(documents.select("doc_id").distinct(), "doc_id").select("doc_id", "class", digest.alias("digest"))
    named = store(named, "labelled")
    picked = [named.filter(F.col("class") == c).orderBy("digest").limit(rows) for c in (0, 1)]
    sample = picked[0].union(picked[1]).withColumn(
        "calibrates", F.conv(F.substring("digest", 9, 4), 16, 10).cast("int") % CALIBRATION_SHARE == 0
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most 2 * rows
    return _without_copies(texts).select("class", "calibrates", "text")


def copy_keys(text: str | None) -> list[int]:
    """The least hash of the text's runs of words under a few seeds; near copies share one nearly always."""
    words = [w for part in plain_word_parts(text) for w in part]
    runs = [b" ".join(words[i:i + COPY_WORDS]) for i in range(max(1, len(words) - COPY_WORDS + 1))]
    return [min(xxhash.xxh64_intdigest(run, seed) for run in runs) >> 1 for seed in range(COPY_KEYS)]


def _without_copies(texts: DataFrame) -> DataFrame:
    """One text of each group of near copies: counts of documents mean little where copies count. The
    sample's rows bound the groups."""
    names = [f"key{i}" for i in range(COPY_KEYS)]

    def keyed(batches):
        for batch in batches:
            keys = np.array([copy_keys(t) for t in batch["text"]], np.int64).reshape(-1, COPY_KEYS)
            yield batch.assign(**{name: keys[:, i] for i, name in enumerate(names)})

    schema = texts.schema.simpleString()[7:-1].replace(":", " ")
    marked = texts.mapInPandas(keyed, schema + "".join(f", {name} long" for name in names))
    first = F.lit(True)
    for name in names:
        place = F.row_number().over(Window.partitionBy(name).orderBy("digest", "doc_id"))
        marked = marked.withColumn(f"at_{name}", place)
        first = first & (F.col(f"at_{name}") == 1)
    return marked.filter(first)


def _vocabulary(sample: DataFrame) -> dict[bytes, int]:
    """Numbers of the words to learn from."""

    def per_batch(batches):
        for batch in batches:
            yield pd.DataFrame({"word": list({word for text in batch["text"] for part in plain_word_parts(text) for word in part})})

    learnt = sample.filter(~F.col("calibrates")).select("text")
    words = learnt.mapInPandas(per_batch, "word binary").distinct().toArrow()["word"]  # bounded by the sample
    return {word: number for number, word in enumerate(sorted(words.to_pylist()), 1)}


def _columns(frame: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a bounded frame, through Arrow."""
    table = frame.toArrow()
    return {name: table[name].to_numpy() for name in table.column_names}


def _class_counts(sample: DataFrame, numbers) -> dict[str, np.ndarray]:
    """(class, pair, n): documents to learn from that have a word after a context, by class. Pair -1
    counts the documents, a pair with context -1 those that have the word at all."""

    def per_batch(batches):
        size = len(numbers()) + 1
        for batch in batches:
            for kind, group in batch.groupby("class"):
                keys = [np.full(len(group), -1)]
                for text in group["text"]:
                    ids = text_ids(text, numbers())
                    pairs = ids[:-1] * size + ids[1:]
                    keys += [np.unique(pairs[(ids[:-1] > 0) & (ids[1:] > 0)]), np.unique(ids) - size - 1]
                pair, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pd.DataFrame({"class": kind, "pair": pair, "n": n})

    learnt = sample.filter(~F.col("calibrates")).select("class", "text")
    counts = learnt.mapInPandas(per_batch, "class int, pair long, n long")
    return _columns(counts.groupBy("class", "pair").agg(F.sum("n").alias("n")))  # bounded by the sample


def word_keys(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def pair_keys(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs from those of their words."""
    mixed = (contexts * np.uint64(0x9E3779B97F4A7C15)) ^ (words + (contexts >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def shared_counts(documents: DataFrame, asked=None) -> DataFrame:
    """(kind, key, documents), stored: in how many documents of the whole corpus each word (0) and each pair
    (1) is, and how many pairs the documents have after each context (2). Tasks add up what they hold
    before the shuffle. ``asked`` gives in any task the sorted pairs and contexts that are wanted: all
    documents are counted for these, and no others travel; a task sends each once. Without it the
    table holds all that the corpus has."""

    def per_task(batches):
        held: list[list[np.ndarray]] = [[], [], []]
        size = 0
        known = dict(zip((1, 2), asked())) if asked else {}
        totals = {kind: np.zeros(len(keys), np.int64) for kind, keys in known.items()}

        def places(kind, keys):
            at = np.searchsorted(known[kind], keys)
            at[at == len(known[kind])] = 0
            return at[known[kind][at] == keys] if len(known[kind]) else at[:0]

        def added(last=False):
            keys, counts = [], []
            for kind in range(3):
                if kind in known:
                    at = np.concatenate([*held[kind], np.empty(0, np.int64)])
                    totals[kind] += np.bincount(at, minlength=len(totals[kind]))
                    found = np.flatnonzero(totals[kind]) if last else np.empty(0, np.int64)
                    key, n = known[kind][found], totals[kind][found]
                else:
                    key, n = np.unique(np.concatenate([*held[kind], np.empty(0, np.uint64)]), return_counts=True)
                keys.append(key)
                counts.append(n)
                held[kind].clear()
            kinds = np.repeat(np.arange(3, dtype=np.int8), [len(k) for k in keys])
            return pd.DataFrame({"kind": kinds, "key": np.concatenate(keys).view(np.int64), "documents": np.concatenate(counts)})

        for batch in batches:
            for text in batch["text"]:
                words, pairs, last = [], [], np.empty(0, np.uint64)
                for part in plain_word_parts(text):
                    distinct = {word: number for number, word in enumerate(set(part))}
                    keys = word_keys(list(distinct))
                    line = np.concatenate([last, keys[np.fromiter(map(distinct.get, part), np.int64, len(part))]])
                    words.append(keys)
                    if len(line) > 1:
                        key, at = np.unique(pair_keys(line[:-1], line[1:]), return_index=True)
                        pairs.append((key, line[at]))
                    last = line[-1:]
                if words:
                    held[0].append(np.unique(np.concatenate(words)))
                    size += len(held[0][-1])
                if pairs:
                    key, at = np.unique(np.concatenate([k for k, _ in pairs]), return_index=True)
                    context = np.concatenate([c for _, c in pairs])[at]
                    if known:
                        key, context = places(1, key), places(2, context)
                    held[1].append(key)
                    held[2].append(context)
                    size += len(key) + len(context)
                if size >= COUNTED_KEYS:
                    yield added()
                    size = 0
        if size or any(t.any() for t in totals.values()):
            yield added(last=True)

    parts = documents.select("text").mapInPandas(per_task, "kind byte, key long, documents long")
    return store(parts.groupBy("kind", "key").agg(F.sum("documents").alias("documents")), "shared-counts")


def asked_keys(wanted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted pairs and contexts of a table of counts."""
    listed = _columns(wanted.filter("kind > 0").select("kind", "key"))  # bounded by the sample
    pairs, contexts = (np.sort(listed["key"][listed["kind"] == kind].astype(np.int64).view(np.uint64)) for kind in (1, 2))
    return pairs, contexts


def _looked_up(counts: DataFrame, wanted: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of the shared counts the sorted keys the sample asks for, and their counts."""
    found = _columns(counts.join(wanted.select("kind", "key"), ["kind", "key"]))  # bounded by the sample
    out = []
    for kind in range(3):
        own = found["kind"] == kind
        key = found["key"][own].astype(np.int64).view(np.uint64)
        order = np.argsort(key)
        out.append((key[order], found["documents"][own].astype(float)[order]))
    return out


def _count(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The counts of keys; 0 for those that are not in the table."""
    known, counts = table
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, counts[at], 0.0)


def fit_models(documents: DataFrame, labels: DataFrame, rows: int = ROWS_PER_CLASS) -> tuple[Model, DataFrame]:
    """The two models, and the stored sample, part of which is left to calibrate them.

    As Kneser-Ney counts contexts, not uses, an expression counts once a document. With shared
    distributions S over all documents, a class's words are P(word) = own + rest * S(word), and its pairs
    P(word | context) = own + rest * S(word | context) * P(word) / S(word): the shared pairs, adapted by the
    class's words. ``own`` is what the discount leaves. Where neither class has something of its own, S
    is the same factor of both and leaves the ratio, so that only the sample's words and pairs have to
    be looked up in the shared counts, however many these are.
    """
    spark = documents.sparkSession
    sample = store(labelled_sample(documents, labels, rows), "toxicity-sample")
    vocabulary = _vocabulary(sample)
    size = len(vocabulary) + 1
    counts = _class_counts(sample, share(spark, vocabulary))
    wanted = shared_counts(sample.filter(~F.col("calibrates")).select("text"))
    corpus = shared_counts(documents, share(spark, asked_keys(wanted)))
    known_words, known_pairs, known_contexts = _looked_up(corpus, wanted)
    discard(wanted)
    whole = corpus.filter("kind = 0").agg(F.sum(F.col("documents") + 1)).first()[0] or 1
    discard(corpus)
    keys = np.concatenate([np.zeros(1, np.uint64), word_keys(list(vocabulary))])
    shared = (_count(known_words, keys) + 1.0) / whole

    pairs = np.unique(counts["pair"][counts["pair"] >= 0].astype(np.int64))
    sizes, single, seen = np.ones(2), np.zeros((size, 2)), np.zeros((len(pairs), 2))
    for kind in range(2):
        own = counts["class"] == kind
        pair, n = counts["pair"][own].astype(np.int64), counts["n"][own].astype(np.int64)
        sizes[kind] = max(n[pair == -1].sum(), 1)
        single[pair[pair < -1] + size + 1, kind] = n[pair < -1]
        seen[np.searchsorted(pairs, pair[pair >= 0]), kind] = n[pair >= 0]
    del counts, own, pair, n

    context, word = pairs // size, pairs % size
    like_words, like_pairs = _expected(single, seen, context, word, sizes)
    own = _excess(single, like_words, sizes) / np.maximum(single.sum(axis=0), 1.0)
    words = own / shared[:, None] + 1 - own.sum(axis=0)
    mass = _excess(seen, like_pairs, sizes)
    del like_pairs
    backoff = np.ones((size, 2))
    for kind in range(2):
        mass[:, kind] /= (np.bincount(context, seen[:, kind], size) + CONTEXT_DOCUMENTS)[context]
        backoff[:, kind] -= np.bincount(context, mass[:, kind], size)
    worth = mass.sum(axis=1) > 0
    pairs, context, word, mass = pairs[worth], context[worth], word[worth], mass[worth]
    after = _count(known_pairs, pair_keys(keys[context], keys[word])) + shared[word]
    after /= _count(known_contexts, keys[context]) + 1.0
    mass /= after[:, None]
    mass += backoff[context] * words[word]
    return Model(vocabulary, pairs, mass, backoff, words), sample


def evidence_column(spark: SparkSession, model: Model, text: Column) -> Column:
    shared = share(spark, model)

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(shared().evidence(list(texts)))

    return evidence.asNondeterministic()(text)  # or a filter would run it twice


def spread(values: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Middle and median distance from it of the ordinary texts' evidence."""
    ordinary = values[~toxic]
    if not len(ordinary):
        return 0.0, 1.0
    middle = float(np.median(ordinary))
    return middle, float(np.median(np.abs(ordinary - middle))) or 1.0


def calibrate(values: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, both classes weighing the same; slightly damped so that
    separated classes keep a finite slope."""
    if not len(values):
        return 1.0, 0.0
    scale = float(values.std()) or 1.0
    x = np.stack([values / scale, np.ones(len(values))], axis=1)
    share = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1)) * len(values)
    beta, damping = np.zeros(2), np.diag([1e-2, 1e-6]) * len(values) / 100
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (share * (toxic - p)) - damping @ beta
        curve = (x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + damping
        beta = beta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(beta[0] / scale), float(beta[1])


def score_documents(
    documents: DataFrame, labels: DataFrame, text: str = "text", score: str = "score", rows: int = ROWS_PER_CLASS,
) -> DataFrame:
    """Add ``score``, 0 to 1: how sure the text is of label 1.

    Labels of held-out documents are never read. Null and empty texts have no evidence and get the
    curve's middle value. Without labels every score is 0.5. A column named ``score`` is replaced.
    """
    spark = documents.sparkSession
    model, sample = fit_models(documents, labels, rows)
    tested = sample.filter("calibrates").select("class", evidence_column(spark, model, F.col("text")).alias("x"))
    known = _columns(tested)
    values, toxic = known["x"].astype(float), known["class"] == 1
    middle, width = spread(values, toxic)  # toxic texts' evidence varies with their length: few are far out
    slope, offset = calibrate(np.arcsinh((values - middle) / width), toxic)
    found = packed(documents, evidence=evidence_column(spark, model, F.col(text)))
    place = F.asinh((F.col("evidence") - F.lit(middle)) / F.lit(width))
    curve = 1.0 / (1.0 + F.exp(-(F.lit(slope) * place + F.lit(offset))))
    return found.select(*unpacked(found, (score,)), curve.alias(score))


def toxicity_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(documents.select("doc_id", "text"), labels).drop("text")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def ordinary_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    rows = packed(documents, doc_id=F.col("doc_id"), text=F.col("text"))
    kept = score_documents(rows, labels).filter(F.col("score") < THRESHOLD)
    return kept.select(*unpacked(kept))
