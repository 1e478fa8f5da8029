"""Character n-gram ids of whole Arrow columns: words are cut and n-grams hashed in numpy passes over UTF-8 bytes.

A word is a run of bytes other than the token breaks (0x20, 0x09-0x0D), put between < and >.
The hash of an n-gram is its 32-bit FNV-1a, bytes from 0x80 on extended by their sign; that
of n characters goes on from that of the first n - 1. Work is cut at words, so memory
doesn't grow with the length of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of text whose n-grams are made at a time
CHUNK = 1 << 17
#: counts that a task holds
HELD = 1 << 22
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_OFFSET, _PRIME = np.uint32(2166136261), np.uint32(16777619)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session in bytes, unless it has a bound of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    column = pc.fill_null(column, "") if column.null_count else column
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _breaks(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | (data - np.uint8(9) < 5)


def _signed(data: np.ndarray) -> np.ndarray:
    """Bytes as 32-bit numbers, extended by their sign."""
    return data.view(np.int8).astype(np.int32).view(np.uint32)


def word_ranges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every word."""
    solid = ~_breaks(data)
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    finish[:-1] &= ~solid[1:]
    full = off[1:] > off[:-1]
    heads, tails = off[:-1][full], off[1:][full] - 1
    begin[heads], finish[tails] = solid[heads], solid[tails]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(finish) + 1, np.searchsorted(off, start, side="right") - 1


def _hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, minn: int, maxn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([characters, lengths] hashes, which of them are n-grams, characters of each word) of the words between < and >.

    Hashes run on over the ends of words, in whole passes; those that do are no n-grams.
    """
    size = end - start + 2
    at = np.cumsum(size) - size
    text = np.full(int(size.sum()), ord("<"), np.uint8)
    text[at + size - 1] = ord(">")
    piece = data[start[0] : end[-1]]
    piece = piece[~_breaks(piece)]  # all between the words are breaks
    text[np.repeat(2 * np.arange(len(start)) + 1, size - 2) + np.arange(len(piece))] = piece
    opens = (text & 0xC0) != 0x80
    if opens.all():  # all characters are single bytes
        lead, count, more = None, size, []
    else:
        lead = np.flatnonzero(opens)
        count = np.diff(np.searchsorted(lead, np.append(at, len(text))))
        wide = np.diff(np.append(lead, len(text)))
        more = [np.flatnonzero(wide > k) for k in range(1, 4)]
    value = _signed(text if lead is None else text[lead])
    rest = [(own, _signed(text[lead[own] + k])) for k, own in enumerate(more, 1) if len(own)]
    left = np.repeat(np.cumsum(count), count) - np.arange(len(value))  # characters from each to the end of its word
    hashes, valid = np.zeros((len(value), maxn - minn + 1), np.uint32), np.zeros((len(value), maxn - minn + 1), bool)
    h = np.full(len(value), _OFFSET)
    for n in range(1, maxn + 1):
        reach = max(0, len(value) - n + 1)
        if not reach:
            break
        h = h[:reach]
        h ^= value[n - 1 :]
        h *= _PRIME
        for own, byte in rest:
            far = int(np.searchsorted(own, n - 1))
            into = own[far:] - (n - 1)
            h[into] = (h[into] ^ byte[far:]) * _PRIME
        if n >= minn:
            hashes[:reach, n - minn], valid[:, n - minn] = h, left >= n
    return hashes, valid, count


def ngram_ids(data: np.ndarray, off: np.ndarray, minn: int, maxn: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, id) of every n-gram of minn to maxn characters of the words, by word, start and length, some words at a time."""
    start, end, text = word_ranges(data, off)
    upto = np.cumsum(end - start + 2)
    at = 0
    while at < len(start):
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + CHUNK, side="right")))
        hashes, valid, count = _hashed(data, start[at:to], end[at:to], minn, maxn)
        each = sum(np.maximum(count - n + 1, 0) for n in range(minn, maxn + 1))
        yield np.repeat(text[at:to], each), (hashes[valid] % np.uint32(buckets)).astype(np.int64)
        at = to


def document_features(docs: DataFrame, key: Column, text: Column, minn: int, maxn: int, buckets: int, split: int) -> DataFrame:
    """key, part, ids, ns: the distinct n-gram ids of each text and how often each occurs, in parts of `split` ids.

    A long text may have several rows of one part, whose counts add up. A text without words
    has no row.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            for owner, ids in ngram_ids(data, off, minn, maxn, buckets):
                both, ns = np.unique(owner * buckets + ids, return_counts=True)
                owner, ids = both // buckets, both % buckets
                head = np.flatnonzero(np.diff(owner * buckets + ids // split * split, prepend=-1))  # a new text or part
                bounds = pa.array(np.append(head, len(ids)), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).take(pa.array(owner[head])),
                    "part": pa.array(ids[head] // split, pa.int32()),
                    "ids": pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32())),
                    "ns": pa.ListArray.from_arrays(bounds, pa.array(ns, pa.int32())),
                })

    return docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, "key long, part int, ids array<int>, ns array<int>")


def label_features(docs: DataFrame, label: Column, text: Column, minn: int, maxn: int, buckets: int) -> DataFrame:
    """label, id, n: how often the texts of each label have each n-gram id; with id null, how many rows the label has.

    A task counts in a row of numbers per label and sends them when it would hold more than HELD, and at the end.
    """
    small_batches(docs.sparkSession)

    def sent(counts):
        for label, row in counts.items():
            ids = np.flatnonzero(row)
            own = pa.array(ids, pa.int64(), mask=ids == buckets)
            yield pa.RecordBatch.from_pydict({"label": pa.array([label] * len(ids), pa.string()), "id": own, "n": pa.array(row[ids], pa.int64())})

    def run(batches):
        counts: dict[str | None, np.ndarray] = {}  # rows of texts are counted behind the ids
        for batch in batches:
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            names, own = codes.dictionary.to_pylist(), np.asarray(codes.indices)
            order = np.argsort(own, kind="stable")
            data, off = utf8(batch.column(1).take(pa.array(order)))
            own = own[order]

            def row(code):
                if names[code] not in counts:
                    if (len(counts) + 1) * buckets > HELD:
                        yield from sent(counts)
                        counts.clear()
                    counts[names[code]] = np.zeros(buckets + 1, np.int64)

            for code, n in zip(*np.unique(own, return_counts=True), strict=True):
                yield from row(code)
                counts[names[code]][buckets] += n
            for owner, ids in ngram_ids(data, off, minn, maxn, buckets):
                code = own[owner]
                head = np.flatnonzero(np.diff(code, prepend=-1))
                for a, b in zip(head, np.append(head[1:], len(ids)), strict=True):
                    yield from row(code[a])
                    counts[names[code[a]]][:buckets] += np.bincount(ids[a:b], minlength=buckets)
        yield from sent(counts)

    partial = docs.select(label.alias("label"), text.alias("text")).mapInArrow(run, "label string, id long, n long")
    return partial.groupBy("label", "id").agg(F.sum("n").alias("n"))


def feature_sums(docs: DataFrame, key: Column, text: Column, minn: int, maxn: int, buckets: int, first: int = 0) -> DataFrame:
    """key, n, total, low, high over all n-gram ids of each text, which start at `first`; a text without words has no row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            for owner, ids in ngram_ids(data, off, minn, maxn, buckets):
                head = np.flatnonzero(np.diff(owner, prepend=-1))
                ids = ids + first
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).take(pa.array(owner[head])),
                    "n": pa.array(np.diff(np.append(head, len(ids))), pa.int64()),
                    "total": pa.array(np.add.reduceat(ids, head), pa.int64()),
                    "low": pa.array(np.minimum.reduceat(ids, head), pa.int64()),
                    "high": pa.array(np.maximum.reduceat(ids, head), pa.int64()),
                })

    partial = docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, "key long, n long, total long, low long, high long")
    return partial.groupBy("key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def ordered_features(docs: DataFrame, key: Column, text: Column, minn: int, maxn: int, buckets: int, first: int = 0, slice_ids: int = 1 << 16) -> DataFrame:
    """key, offset, ids: all n-gram ids of each text in order, in slices of at most slice_ids; offset counts the ids before a slice.

    What a slice holds depends on the text alone. Rows that share a key keep their own
    offsets. A text without words has no row.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column(1))
            at, last = 0, -1  # ids of the text `last` that have been sent
            for owner, ids in ngram_ids(data, off, minn, maxn, buckets):
                head = np.flatnonzero(np.diff(owner, prepend=-1))
                size = np.diff(np.append(head, len(ids)))
                before = np.zeros(len(head), np.int64)
                if owner[0] == last:
                    before[0] = at
                last, at = int(owner[-1]), int(before[-1] + size[-1])
                slices = -(-size // slice_ids)
                run_of = np.repeat(np.arange(len(head)), slices)
                inner = (np.arange(len(run_of)) - np.repeat(np.cumsum(slices) - slices, slices)) * slice_ids
                cuts = pa.array(np.append(head[run_of] + inner, len(ids)), pa.int32())
                yield pa.RecordBatch.from_pydict({"key": batch.column(0).take(pa.array(owner[head][run_of])), "offset": pa.array(before[run_of] + inner, pa.int64()), "ids": pa.ListArray.from_arrays(cuts, pa.array(ids + first, pa.int64()))})

    return docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, "key long, offset long, ids array<long>")


def ordered_digests(docs: DataFrame, key: Column, text: Column, minn: int, maxn: int, buckets: int, first: int = 0) -> DataFrame:
    """key, n_ids, h: how many n-gram ids each row's text has, and the md5 of them in order, in decimal with a space between; a text without words has no row.

    The slices of a text follow each other where they are made, so the digest takes them one
    by one and nothing is exchanged.
    """

    def run(batches):
        key, n, h = None, 0, None
        for batch in batches:
            texts = pc.binary_join(batch.column(2).cast(pa.list_(pa.string())), " ").to_pylist()
            sizes = pc.list_value_length(batch.column(2)).to_pylist()
            out = []
            for k, offset, size, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sizes, texts, strict=True):
                if offset == 0:
                    if h is not None:
                        out.append((key, n, h.hexdigest()))
                    key, n, h = k, 0, hashlib.md5(usedforsecurity=False)
                h.update((" " + t if n else t).encode())
                n += size
            if out:
                yield _digests(out)
        if h is not None:
            yield _digests([(key, n, h.hexdigest())])

    return ordered_features(docs, key, text, minn, maxn, buckets, first).mapInArrow(run, "key long, n_ids long, h string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    keys, ns, hs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ns, pa.int64()), pa.array(hs, pa.string())], names=["key", "n_ids", "h"])
