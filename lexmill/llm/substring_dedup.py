"""Exact repeated passages across documents, by fixed-block anchors.

A repeat of `window` = 13 words contains, wherever it starts, one whole block of
`block` = 7 words of the reference document's non-overlapping blocks (2 * 7 - 1 = 13). So:

1. Index the non-overlapping blocks of every document and probe them with every rolling
   7-word window of every document. A hash is an anchor if it is a block somewhere and
   occurs in two documents.
2. Extend: every 13-word window that contains an anchor is compared, by a 96-bit
   fingerprint, with the same windows elsewhere; the smallest doc_id that starts it is its
   first holder. Runs of confirmed windows are the maximal exact repeats.
3. Words covered by a window whose first holder is a smaller doc_id are removed.

The texts are dealt once into buckets by a hash of doc_id (an exchange that all three steps
share). Between the steps only packed arrays of distinct hashes travel, one row per
(bucket, hash range): a passage shared by a third of all documents costs one entry per
bucket, and no pairs are formed. The number of buckets and of hash ranges follows the
bytes of text, so memory per group stays the same at every size.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import bucketed, pack, small_batches, squeeze, text_bytes, unpack, unsqueeze

U64, U32, I64 = np.uint64, np.uint32, np.int64
LAST = np.iinfo(np.int64).max
_PACKED = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])
_SPAN = "part int, bucket int, packed binary"


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)


def _rows(out: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[k] for r in out], t.type) for k, t in enumerate(_PACKED)], schema=_PACKED)


def _ids(table: pa.Table) -> np.ndarray:
    """doc_id, where a null comes after every other and so neither takes words away nor is told to be first."""
    column = table.column("doc_id").combine_chunks()
    return np.asarray(column.fill_null(LAST)).astype(I64)


def _hashed_words(table: pa.Table, seeds: tuple[int, ...]) -> tuple[wh.Words, list[np.ndarray]]:
    data, off = wh.utf8(table.column("text"))
    starts, ends, counts, hashes = [], [], [], [[] for _ in seeds]
    for a, b in wh.pieces(off, 1 << 20, 1 << 30):
        w = wh.words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        starts.append(w.start + off[a])
        ends.append(w.end + off[a])
        counts.append(w.counts)
        for k, seed in enumerate(seeds):
            hashes[k].append(wh.span_hashes(data[off[a] : off[b]], w.start, w.end, seed))
    cat = lambda xs, kind=I64: np.concatenate(xs) if xs else np.zeros(0, kind)
    return wh.Words(cat(starts), cat(ends), np.concatenate(([0], np.cumsum(cat(counts))))), [cat(h, U64) for h in hashes]


def _anchors_of(table: pa.Table, block: int, keys: tuple[int, ...]) -> tuple[wh.Words, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """words, word hashes by key, and per rolling window its hash by the first key, its first word and its document."""
    w, h = _hashed_words(table, keys)
    at, doc = wh.gram_starts(w.first, block)
    return w, h, wh.gram_hashes(h[0], block, key=keys[0])[at], at, doc


def _probe(block: int, parts: int, keys: tuple[int, int]):
    """Per hash range: the bucket's distinct window hashes, as four classes (in one document or several; as a block or not)."""

    def run(table: pa.Table) -> pa.Table:
        w, _, grams, at, doc = _anchors_of(table, block, keys[:1])
        order = np.argsort(grams)
        grams, doc, is_block = grams[order], doc[order], ((at - w.first[doc]) % block == 0)[order]
        if not len(grams):
            return _rows([])
        head = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        several = np.maximum.reduceat(doc, head) != np.minimum.reduceat(doc, head)
        kind = several.astype(np.int8) + 2 * np.logical_or.reduceat(is_block, head)
        grams = grams[head]
        cuts = np.searchsorted(_part(grams, parts), np.arange(parts + 1))
        # hash ranges follow the hash, so each range is one slice; its low 32 bits are sorted per class
        bucket, out = table.column("bucket")[0].as_py(), []
        for p in np.flatnonzero(np.diff(cuts)):
            low, k = (grams[cuts[p] : cuts[p + 1]] & U64(0xFFFFFFFF)).astype(U32), kind[cuts[p] : cuts[p + 1]]
            out.append((int(p), bucket, pack(*(squeeze(np.sort(low[k == c])) for c in range(4)))))
        return _rows(out)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The hashes of one range that are a block somewhere and occur in two documents, told to each bucket that has them."""
    low, kind, own = [], [], []
    for i, blob in enumerate(table.column("packed")):
        for c, planes in enumerate(unpack(blob.as_py(), *["u1"] * 4)):
            values = unsqueeze(planes)
            low.append(values)
            kind.append(np.full(len(values), c, np.int8))
            own.append(np.full(len(values), i, np.int32))
    low, kind, own = map(np.concatenate, (low, kind, own))
    order = np.argsort(low, kind="stable")
    low, kind, own = low[order], kind[order], own[order]
    first = np.concatenate(([True], low[1:] != low[:-1]))
    head = np.flatnonzero(first)
    held = np.diff(np.append(head, len(low)))
    anchor = ((held > 1) | (np.bitwise_or.reduceat(kind, head) & 1 > 0)) & (np.bitwise_or.reduceat(kind, head) & 2 > 0)
    keep = np.repeat(anchor, held)
    low, own = low[keep], own[keep]
    order = np.argsort(own, kind="stable")
    low, own = low[order], own[order]
    cuts = np.searchsorted(own, np.arange(table.num_rows + 1))
    part, buckets = table.column("part")[0].as_py(), table.column("bucket").to_pylist()
    return _rows([(part, buckets[i], pack(squeeze(low[cuts[i] : cuts[i + 1]]))) for i in np.flatnonzero(np.diff(cuts))])


def _known(replies: pa.Table, parts: int) -> np.ndarray:
    """Sorted (range, low bits) keys of the anchors a bucket was told."""
    keys = [np.zeros(0, U64)]
    for part, blob in zip(replies.column("part").to_pylist(), replies.column("packed"), strict=True):
        keys.append((U64(part) << U64(32)) | unsqueeze(unpack(blob.as_py(), "u1")[0]).astype(U64))
    return np.sort(np.concatenate(keys))


def _member(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def _fingerprints(h: list[np.ndarray], window: int, begin: np.ndarray, keys: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each window, from two hashes of each word under two keys, which know nothing of each other."""
    return wh.gram_hashes(h[0], window, key=keys[0])[begin], (wh.gram_hashes(h[1], window, key=keys[1])[begin] >> U64(32)).astype(U32)


def _candidates(block: int, window: int, parts: int, keys: tuple[int, int]):
    """Per hash range: the fingerprints of the bucket's windows that contain an anchor, with the smallest doc_id of each."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _rows([])
        w, h, grams, at, _ = _anchors_of(table, block, keys)
        hit = np.zeros(len(h[0]) + 1, np.int64)
        hit[at] = _member((_part(grams, parts).astype(U64) << U64(32)) | (grams & U64(0xFFFFFFFF)), _known(replies, parts))
        sums = np.concatenate(([0], np.cumsum(hit)))
        begin, doc = wh.gram_starts(w.first, window)
        near = sums[begin + window - block + 1] > sums[begin]
        begin, doc = begin[near], doc[near]
        one, two = _fingerprints(h, window, begin, keys)
        ids = _ids(table)[doc]
        order = np.lexsort((ids, two, one))
        one, two, ids = one[order], two[order], ids[order]
        if not len(one):
            return _rows([])
        head = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
        several = np.maximum.reduceat(ids, head) > ids[head]
        one, two, ids = one[head], two[head], ids[head]
        cuts = np.searchsorted(_part(one, parts), np.arange(parts + 1))
        bucket, out = table.column("bucket")[0].as_py(), []
        for p in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[p], cuts[p + 1])
            by_doc = np.argsort(ids[part], kind="stable")
            docs, runs = np.unique(ids[part], return_counts=True)
            out.append((int(p), bucket, pack(docs, runs.astype(U32), one[part][by_doc], two[part][by_doc], several[part][by_doc])))
        return _rows(out)

    return run


def _first_holders(table: pa.Table) -> pa.Table:
    """Per bucket: the windows that start in a document larger than their first holder, with that holder's doc_id."""
    ids, one, two, many, own = [], [], [], [], []
    for i, blob in enumerate(table.column("packed")):
        docs, runs, a, b, several = unpack(blob.as_py(), I64, U32, U64, U32, "?")
        ids.append(np.repeat(docs, runs))
        one.append(a)
        two.append(b)
        many.append(several)
        own.append(np.full(len(a), i, np.int32))
    ids, one, two, many, own = map(np.concatenate, (ids, one, two, many, own))
    order = np.lexsort((ids, two, one))
    ids, one, two, many, own = ids[order], one[order], two[order], many[order], own[order]
    head = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
    lowest = np.repeat(ids[head], np.diff(np.append(head, len(one))))
    keep = (ids > lowest) | many
    one, two, own, lowest = one[keep], two[keep], own[keep], lowest[keep]
    order = np.lexsort((lowest, own))
    one, two, own, lowest = one[order], two[order], own[order], lowest[order]
    cuts = np.searchsorted(own, np.arange(table.num_rows + 1))
    part, buckets = table.column("part")[0].as_py(), table.column("bucket").to_pylist()
    out = []
    for i in np.flatnonzero(np.diff(cuts)):
        own_part = slice(cuts[i], cuts[i + 1])
        docs, runs = np.unique(lowest[own_part], return_counts=True)
        out.append((part, buckets[i], pack(docs, runs.astype(U32), one[own_part], two[own_part])))
    return _rows(out)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def _cut(window: int, with_text: bool, carry: tuple[str, ...], keys: tuple[int, int]):
    """Per document of the bucket: what is left once the covered words are gone."""

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.schema([*_KEPT, *(table.schema.field(c) for c in carry)]).empty_table()
        data, off = wh.utf8(table.column("text"))
        keep = None
        if replies.num_rows:
            w, h = _hashed_words(table, keys)
            told, second, holder = [], [], []
            for blob in replies.column("packed"):
                docs, runs, one, two = unpack(blob.as_py(), I64, U32, U64, U32)
                told.append(one)
                second.append(two)
                holder.append(np.repeat(docs, runs))
            told, second, holder = np.concatenate(told), np.concatenate(second), np.concatenate(holder)
            order = np.lexsort((second, told))
            told, second, holder = told[order], second[order], holder[order]
            begin, doc = wh.gram_starts(w.first, window)
            grams, twos = _fingerprints(h, window, begin, keys)
            ids = _ids(table)[doc]
            at, gone = np.searchsorted(told, grams), np.zeros(len(grams), bool)
            here = np.flatnonzero(at < len(told))
            while len(here):  # nearly always one step: told windows that share their first 64 bits follow each other
                here = here[told[at[here]] == grams[here]]
                gone[here] |= (second[at[here]] == twos[here]) & (holder[at[here]] < ids[here]) & (ids[here] != LAST)
                at[here] += 1
                here = here[at[here] < len(told)]
            cover = np.zeros(len(h[0]) + 1, np.int32)
            np.add.at(cover, begin[gone], 1)
            np.add.at(cover, begin[gone] + window, -1)
            keep = np.cumsum(cover)[:-1] == 0
        raw, out = data.tobytes(), [[], [], [], []]
        for i in range(table.num_rows):
            found = raw[off[i] : off[i + 1]].split()
            left = found if keep is None else list(compress(found, keep[w.first[i] : w.first[i + 1]]))
            joined = b" ".join(left)
            if with_text:
                text = table.column("text")[i].as_py() if len(left) == len(found) else joined.decode()
            for column, value in zip(out, (len(found), len(found) - len(left), hashlib.sha256(joined).hexdigest(), text if with_text else None), strict=True):
                column.append(value)
        return pa.table([table.column("doc_id").cast(pa.int64()), *(pa.array(c, t.type) for c, t in zip(out, list(_KEPT)[1:], strict=True)), *(table.column(c) for c in carry)], names=[*_KEPT.names, *carry])

    return run


def remove_repeats(docs: DataFrame, window: int = 13, block: int = 7, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text and the carried columns for every row of docs (doc_id, text).

    A word is `[^\\x20\\x09-\\x0D]+`, unchanged. A window is `window` consecutive words of one
    document; each word covered by a window whose word sequence also starts in a document
    with a smaller doc_id is removed. Windows are judged on the input. kept_text is the
    text itself where nothing was removed, else the kept words joined by one space; it is
    null with with_text=False.

    Null or empty text: no words (kept_text null stays null). Null doc_id: keeps all and
    takes nothing from others. Rows that share a doc_id take nothing from each other. Texts
    shorter than a window keep all. Other columns are ignored. An empty table gives no rows.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at every offset: window >= 2 * block - 1")
    inner = tuple(f"_carry{k}" for k in range(len(carry)))  # so that carried names don't meet ours
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(k) for c, k in zip(carry, inner, strict=True)])
    small_batches(docs.sparkSession)
    size = text_bytes(docs)[1]
    dealt, tasks = bucketed(docs, size)
    parts = max(8, -(-size // (16 << 20)))
    keys = wh.fresh_key(), wh.fresh_key()
    grouped = dealt.groupBy("bucket")
    by_bucket = lambda df: df.repartition(tasks, "bucket").groupBy("bucket")
    shared = grouped.applyInArrow(_probe(block, parts, keys), _SPAN).groupBy("part").applyInArrow(_shared, _SPAN)
    windows = grouped.cogroup(by_bucket(shared)).applyInArrow(_candidates(block, window, parts, keys), _SPAN)
    holders = windows.groupBy("part").applyInArrow(_first_holders, _SPAN)
    ddl = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string" + "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in inner)
    out = grouped.cogroup(by_bucket(holders)).applyInArrow(_cut(window, with_text, inner, keys), ddl)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", *[F.col(k).alias(c) for c, k in zip(carry, inner, strict=True)])
