"""Removal of repeated 50-byte strings with a sparse suffix array.

All windows of 50 bytes would be far more than the text. Here every window belongs to an anchor: the
position in it whose 16-byte hash is the least. Equal windows have equal anchors at equal places, so it is
enough to sort the suffixes that start at anchors, each with the bytes of its windows around it: up to 34
before, up to 50 from the anchor on.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WINDOW = 50
GRAM = 16
BEFORE = WINDOW - GRAM  # windows of an anchor start up to so many bytes before it
CONTEXT = BEFORE + WINDOW
OFFSETS = BEFORE + 1
BATCH_BYTES = 8 << 20  # text of one task's group
SLICE_BYTES = 2 << 20
KEYS_PER_BUCKET = 4 << 20
CONTEXT_SHARE = 2  # batches whose shared contexts meet in one range, on average
SPLITTER_SAMPLE = 1 << 14  # bounds what the driver reads to choose the splitters
ALL_OFFSETS = (1 << OFFSETS) - 1
LAST_ID = 2**63 - 1


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every ``width`` neighbours, doubling the reach."""
    reach = 1
    while reach * 2 <= width:
        values = pick(values[:-reach], values[reach:])
        reach *= 2
    return pick(values[:reach - width], values[width - reach:]) if reach < width else values


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    words = np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,))
    mixed = words[:len(data) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed += words[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    return mixed | np.uint64(1)  # never 0


def _slice_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, hash, least and greatest offset of its windows) of the anchors of texts laid end to
    end; windows over an end of a text do not count. Positions of one hash in a window share it."""
    if len(data) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = _gram_hashes(data)
    lowest = _slide(hashes, OFFSETS, np.minimum)  # by window start
    real = np.zeros(len(lowest) + 1, np.int64)
    fits = ends - starts >= WINDOW
    np.add.at(real, starts[fits], 1)
    np.add.at(real, ends[fits] - WINDOW + 1, -1)
    lowest[np.cumsum(real)[:-1] <= 0] = 0
    edge = np.zeros(BEFORE, np.uint64)
    chosen = _slide(np.concatenate([edge, lowest, edge]), OFFSETS, np.maximum) == hashes
    at = np.flatnonzero(chosen)
    hashes = hashes[at]
    # Runs of windows with one least hash; an anchor's own run is the last one of its hash that begins by it.
    begins = np.flatnonzero(np.concatenate([[True], lowest[1:] != lowest[:-1]]))
    finishes = np.append(begins[1:], len(lowest)) - 1
    run = np.searchsorted(begins, at, side="right") - 1
    while True:
        foreign = lowest[begins[run]] != hashes
        if not foreign.any():
            break
        run[foreign] -= 1
    return at, hashes, at - np.minimum(finishes[run], at), at - np.maximum(begins[run], at - BEFORE)


class Batch:
    """The texts of a group as bytes, sorted by doc_id, with their anchors: document, position, hash,
    and the offsets from ``near`` to ``far`` at which their windows start before them."""

    def __init__(self, table: pa.Table):
        ids = np.array([LAST_ID if i is None else i for i in table["doc_id"].to_pylist()], np.int64)
        order = np.argsort(ids, kind="stable")
        column = table["text"].combine_chunks()
        self.ids = ids[order]
        self.names = [table["doc_id"][int(i)].as_py() for i in order]
        self.texts = [column[int(i)].as_py() or b"" for i in order]
        sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        found, first = [], 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + SLICE_BYTES)))
            last = min(last, len(sizes))
            begin, end = self.starts[first], self.starts[last]
            at, *rest = _slice_anchors(self.data[begin:end], self.starts[first:last] - begin, self.starts[first + 1:last + 1] - begin)
            found.append((at + begin, *rest))
            first = last
        self.at, self.hash, self.near, self.far = (np.concatenate(parts) for parts in zip(*found))
        self.doc = np.searchsorted(self.starts, self.at, side="right") - 1

    def contexts(self, chosen: np.ndarray) -> np.ndarray:
        """The bytes of the anchors' windows, 0 beyond them, and their greatest and least offset."""
        at, left, near = self.at[chosen], self.far[chosen], self.near[chosen]
        right = WINDOW - near
        steps = np.arange(-BEFORE, WINDOW)
        out = np.zeros((len(at), CONTEXT + 2), np.uint8)
        for begin in range(0, len(at), 1 << 15):
            part = slice(begin, begin + (1 << 15))
            place = at[part, None] + steps
            inside = (steps >= -left[part, None]) & (steps < right[part, None])
            out[part, :CONTEXT] = np.where(inside, self.data[np.clip(place, 0, max(len(self.data) - 1, 0))], 0)
        out[:, CONTEXT], out[:, CONTEXT + 1] = left, near
        return out


def _short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(24)


def _pack(keys: np.ndarray) -> bytes:
    """40-bit keys, five bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of equal rows of bytes, eight bytes at a time: a pass sorts only rows that are
    still tied, each tied run for itself, as multikey quicksort does with single letters."""
    count, width = rows.shape
    padded = np.zeros((count, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8")
    order, group = np.arange(count), np.zeros(count, np.int64)
    for column in range(words.shape[1]):
        tied = np.flatnonzero(np.bincount(group, minlength=count)[group] > 1)
        if not len(tied):
            break
        key = words[order[tied], column].astype(np.uint64)
        inner = np.lexsort((key, group[tied]))
        order[tied] = order[tied][inner]
        key, old = key[inner], group[tied]
        changed = np.zeros(count, bool)
        changed[0] = True
        changed[1:] = group[1:] != group[:-1]
        differs = np.zeros(len(tied), bool)
        differs[1:] = (key[1:] != key[:-1]) & (old[1:] == old[:-1])
        changed[tied[differs]] = True
        group = np.cumsum(changed) - 1
    return order, group


def _least_by_group(order: np.ndarray, group: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row the least document of its group."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(docs[order], starts)
    out = np.empty(len(docs), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return out


def shared_offsets(contexts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context a mask of the offsets whose window a smaller document has too.

    First equal contexts are grouped: all but their least document have every window. Then, for the
    least ones, each offset's windows are sorted and compared among contexts with the same 16 bytes.
    """
    masks = np.zeros(len(docs), np.uint64)
    if not len(docs):
        return masks
    order, group = multikey_order(contexts)
    least = _least_by_group(order, group, docs)
    masks[docs > least] = ALL_OFFSETS
    heads = order[np.concatenate([[True], group[1:] != group[:-1]])]
    one, owner = contexts[heads], least[heads]
    gram_order, gram_group = multikey_order(one[:, BEFORE:BEFORE + GRAM])
    sizes = np.bincount(gram_group)[gram_group]
    open_ = np.sort(gram_order[sizes > 1])
    one, owner, heads = one[open_], owner[open_], heads[open_]
    flags = np.zeros(len(heads), np.uint64)
    for offset in range(OFFSETS):
        real = np.flatnonzero((one[:, CONTEXT] >= offset) & (one[:, CONTEXT + 1] <= offset))
        if len(real):
            windows = one[real, BEFORE - offset:BEFORE - offset + WINDOW]
            found = _least_by_group(*multikey_order(windows), owner[real])
            flags[real[owner[real] > found]] |= np.uint64(1 << offset)
    head_flags = np.zeros(len(docs), np.uint64)
    head_flags[heads] = flags
    first = np.concatenate([[True], group[1:] != group[:-1]])
    by_group = head_flags[order[first]]
    spread = np.empty(len(docs), np.uint64)
    spread[order] = by_group[group]
    return np.where(docs > least, masks, spread)


def _cover(batch: Batch, chosen: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes of the batch the flagged windows cover."""
    marks = np.zeros(len(batch.data) + 1, np.int64)
    at, near, far = batch.at[chosen], batch.near[chosen], batch.far[chosen]
    for offset in range(OFFSETS):
        hit = ((masks >> np.uint64(offset)) & np.uint64(1)).astype(bool) & (far >= offset) & (near <= offset)
        start = at[hit] - offset
        np.add.at(marks, start, 1)
        np.add.at(marks, start + WINDOW, -1)
    return np.cumsum(marks)[:-1] > 0


class _Shared:
    """What a batch sends and what comes back, worked out alike in every pass over the batch."""

    def __init__(self, batch: Batch, repeated: np.ndarray):
        """repeated: the short keys that another batch has too."""
        short = _short(batch.hash)
        order = np.lexsort((batch.doc, batch.hash))
        key, doc = batch.hash[order], batch.doc[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        group = np.cumsum(first) - 1
        many = np.zeros(len(key), bool)
        if len(key):
            many[order] = (np.maximum.reduceat(doc, np.flatnonzero(first)) != np.minimum.reduceat(doc, np.flatnonzero(first)))[group]
        elsewhere = np.isin(short, repeated)
        self.chosen = np.flatnonzero(many | elsewhere)
        self.contexts = batch.contexts(self.chosen)
        self.docs = batch.ids[batch.doc[self.chosen]]
        self.order, self.group = multikey_order(self.contexts) if len(self.chosen) else (np.empty(0, np.int64), np.empty(0, np.int64))
        starts = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]])) if len(self.chosen) else np.empty(0, np.int64)
        self.heads = self.order[starts]  # one per distinct context
        self.owner = np.minimum.reduceat(self.docs[self.order], starts) if len(starts) else np.empty(0, np.int64)

    def masks(self, flags: np.ndarray) -> np.ndarray:
        """Masks of the chosen anchors, from those of the distinct contexts' least documents."""
        out = np.zeros(len(self.chosen), np.uint64)
        if len(out):
            out[self.order] = np.where(self.docs[self.order] > self.owner[self.group], np.uint64(ALL_OFFSETS), flags[self.group])
        return out


def _leading(contexts: np.ndarray) -> np.ndarray:
    """The first eight bytes of the suffix as a number that sorts like them."""
    return np.ascontiguousarray(contexts[:, BEFORE:BEFORE + 8]).view(">u8").ravel().astype(np.uint64)


def _bytes_of(column: pa.ChunkedArray) -> np.ndarray:
    """All bytes of a binary column, one value after the other, where they lie."""
    values = pa.concat_arrays(column.chunks)
    marks = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[marks[0]:marks[-1]]


def _table(schema: pa.Schema, **columns) -> pa.Table:
    return pa.table([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


_KEYS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("keys", pa.binary())])
_SENT = pa.schema([("range", pa.int32()), ("batch", pa.int32()), ("part", pa.binary()), ("docs", pa.binary()), ("numbers", pa.binary())])
_BACK = pa.schema([("batch", pa.int32()), ("kind", pa.int32()), ("numbers", pa.binary()), ("masks", pa.binary())])


def splitters(documents: DataFrame, ranges: int) -> np.ndarray:
    """Leading bytes that part suffixes into even ranges, from a bounded sample of documents: the places
    sampled spread over each whole text."""
    if ranges < 2:
        return np.empty(0, np.uint64)
    sample = documents.filter(F.octet_length("text") >= 64).orderBy(F.xxhash64("doc_id")).limit(SPLITTER_SAMPLE // 16)
    places = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.hex(F.substr(
        F.col("text"), (F.floor((F.octet_length("text") - 8) * i / 16) + 1).cast("int"), F.lit(8))))
    rows = sample.select(F.explode(places).alias("lead")).collect()
    values = np.sort(np.array([int(r["lead"].ljust(16, "0"), 16) for r in rows], np.uint64))
    if not len(values):
        return np.empty(0, np.uint64)
    return np.unique(values[(np.arange(1, ranges) * len(values)) // ranges])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id (null ids
    come last, equal ids never count). Null texts are empty. Texts are grouped into batches by hash.
    Batches send their anchors' hashes to buckets and learn which ones another batch has; of those
    they send the distinct contexts, with the least doc_id of each, to the range of their leading bytes.
    There suffixes are sorted and compared, and the flags go back. A string that a third of all documents
    share is sent once a batch. Equal suffixes have equal leading bytes and meet in one range, so no
    pair lies across a boundary. Batches are bounded; a range holds what ``CONTEXT_SHARE`` batches send on
    average, and all suffixes with the same eight leading bytes, however many.
    """
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / BATCH_BYTES))
    buckets = max(1, math.ceil(size / 17 / KEYS_PER_BUCKET))
    ranges = max(1, math.ceil(batches / CONTEXT_SHARE))
    raw = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    bounds = splitters(raw, ranges)
    batch_of = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int")
    texts = raw.withColumn("batch", batch_of)

    def send_keys(table: pa.Table) -> pa.Table:
        batch = Batch(table)
        key = np.unique(batch.hash)
        bucket = (key >> np.uint64(1)) % np.uint64(buckets)
        short, parts = _short(key), []
        for number in range(buckets):
            mine = short[bucket == number]
            parts.append(_pack(mine))
        numbers = [i for i, p in enumerate(parts) if p]
        where = table["batch"][0].as_py()
        return _table(_KEYS, bucket=numbers, batch=[where] * len(numbers), keys=[parts[i] for i in numbers])

    def repeated_keys(table: pa.Table) -> pa.Table:
        parts = [np.unique(_unpack(k)) for k in table["keys"].to_pylist()]
        every = np.sort(np.concatenate(parts))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        replies = [_pack(p[np.isin(p, twice, assume_unique=True)]) for p in parts]
        return _table(_BACK, batch=table["batch"].to_pylist(), kind=[0] * len(replies), numbers=replies, masks=[b""] * len(replies))

    def replied(table: pa.Table, kind: int) -> list[dict]:
        return [r for r in table.to_pylist() if r["kind"] == kind]

    def shared_of(left: pa.Table, right: pa.Table) -> tuple[Batch, _Shared]:
        batch = Batch(left)
        known = [_unpack(r["numbers"]) for r in replied(right, 0)]
        return batch, _Shared(batch, np.concatenate(known) if known else np.empty(0, np.uint64))

    def send_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SENT.empty_table()
        _, shared = shared_of(left, right)
        contexts = shared.contexts[shared.heads]
        place = np.searchsorted(bounds, _leading(contexts), side="right") if len(contexts) else np.empty(0, int)
        numbers = np.unique(place)
        at = [np.flatnonzero(place == n) for n in numbers]
        where = left["batch"][0].as_py()
        return _table(_SENT, range=numbers.tolist(), batch=[where] * len(at), part=[contexts[i].tobytes() for i in at],
                      docs=[shared.owner[i].tobytes() for i in at], numbers=[i.astype(np.int32).tobytes() for i in at])

    def compare(table: pa.Table) -> pa.Table:
        masks = shared_offsets(_bytes_of(table["part"]).reshape(-1, CONTEXT + 2), _bytes_of(table["docs"]).view(np.int64))
        back, at = [], 0
        for batch, sent in zip(table["batch"].to_pylist(), table["numbers"]):
            numbers = np.frombuffer(sent.as_buffer(), np.int32)
            own = masks[at:at + len(numbers)]
            at += len(numbers)
            back.append((batch, numbers[own > 0].tobytes(), own[own > 0].tobytes()))
        return _table(_BACK, batch=[b[0] for b in back], kind=[1] * len(back), numbers=[b[1] for b in back], masks=[b[2] for b in back])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _RESULT.empty_table()
        batch, shared = shared_of(left, right)
        flags = np.zeros(len(shared.heads), np.uint64)
        for r in replied(right, 1):
            flags[np.frombuffer(r["numbers"], np.int32)] = np.frombuffer(r["masks"], np.uint64)
        covered = _cover(batch, shared.chosen, shared.masks(flags))
        removed, spans, kept = [], [], []
        for number, text in enumerate(batch.texts):
            mine = covered[batch.starts[number]:batch.starts[number + 1]]
            count = int(mine.sum())
            removed.append(count)
            spans.append(int(mine[:1].sum()) + int(np.count_nonzero(mine[1:] & ~mine[:-1])) if count else 0)
            kept.append(np.frombuffer(text, np.uint8)[~mine].tobytes() if count else text)
        return _table(_RESULT, doc_id=batch.names, n_bytes=[len(t) for t in batch.texts], n_removed=removed, n_spans=spans, kept=kept)

    by_batch = texts.groupBy("batch")
    keys = by_batch.applyInArrow(send_keys, "bucket int, batch int, keys binary")
    known = keys.groupBy("bucket").applyInArrow(repeated_keys, "batch int, kind int, numbers binary, masks binary")
    sent = by_batch.cogroup(known.groupBy("batch")).applyInArrow(send_contexts, "range int, batch int, part binary, docs binary, numbers binary")
    flags = sent.groupBy("range").applyInArrow(compare, "batch int, kind int, numbers binary, masks binary")
    both = known.unionByName(flags)
    return by_batch.cogroup(both.groupBy("batch")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def suffix_table(documents: DataFrame) -> DataFrame:
    found = remove_repeats(documents.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
