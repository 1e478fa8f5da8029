"""Language-model scores by prediction by partial matching, and the unigram base score.

The model is a byte-context trie of order 5 over lower-cased text, kept as counts of 6-byte
grams (context and next byte): the node of a shorter context is the sum over the bytes
before it, so orders 4 to 0 follow from the same table. Escape estimation is method C: in a
context with n symbols, d of them different, a symbol seen c times has c / (n + d) and an
escape d / (n + d). On an escape the next shorter context is asked without the symbols
already ruled out (symbol exclusion); below order 0 every byte left is equally likely.

Spark carries it so: texts are dealt into buckets; each bucket sends its distinct grams
(and distinct words) with their training counts to ranges of a hash of the context, so the
children of a node meet in one task. Grams seen in training are settled there. The others,
a few in a hundred, are settled by the lower orders: one join after the other, of the grams
still open with the contexts of that order, a row of at most 256 symbols each. Orders 1 and 0
are a table of 256 x 256 counts, small by construction. Every bucket is told one number per
distinct gram and sums them over its texts. Counts cover all training texts.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import pack, scratch, small_batches, tasks_for, text_bytes, unpack

U64, U32, I64 = np.uint64, np.uint32, np.int64
ORDER = 5
PAD, END = 0xFE, 0xFF  # bytes that UTF-8 doesn't have
END_WORD = U64(0x5BD1E9955BD1E995)
_SPAN = "part int, bucket int, packed binary"
_SPAN_SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])


def is_training(doc_id: int | None) -> bool:
    """By the checksum of the id as text; a null id counts as an empty text and so is held out."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def dealt_blobs(docs: DataFrame, size: int, each: int = 4 << 20) -> tuple[DataFrame, int]:
    """(bucket, packed): documents of a bucket as compressed blobs, dealt by bucket; and over how many tasks."""
    n = tasks_for(size, 4 * each, docs.sparkSession)
    buckets = max(4 * n, -(-size // each))
    keyed = docs.select(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), "text")

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, off = wh.utf8(batch.column(2))
            own = np.asarray(batch.column(0))
            ids = batch.column(1)
            known = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0)).astype(I64)
            order = np.argsort(own, kind="stable")
            heads = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1]))) if len(order) else []
            rows, raw = [], data.tobytes()
            for a, b in zip(heads, [*heads[1:], len(order)], strict=True):
                docs_here = order[a:b]
                text = squeeze.compress(b"".join(raw[off[d] : off[d + 1]] for d in docs_here))
                rows.append((int(own[docs_here[0]]), pack(ids[docs_here], known[docs_here], np.diff(off)[docs_here], np.frombuffer(text, np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "packed"])

    return keyed.mapInArrow(run, "bucket int, packed binary").repartition(n, "bucket"), n


def _open(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, known, bytes, offsets) of a bucket, in an order that doesn't depend on how its blobs came."""
    grow, parts = zstandard.ZstdDecompressor(), []
    for blob in table.column("packed"):
        ids, known, sizes, text = unpack(blob.as_py(), I64, "?", I64, "u1")
        parts.append((ids, known, sizes, np.frombuffer(grow.decompress(text.tobytes()), np.uint8)))
    ids, known, sizes, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    return ids, known, wh.LOWER[data], np.concatenate(([0], np.cumsum(sizes)))


def _grams(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The 6-byte gram of every byte and of the end of every text, in order."""
    n = len(off) - 1
    size = np.diff(off)
    wide = np.full(len(data) + (ORDER + 1) * n, PAD, np.uint8)
    shift = (ORDER + 1) * np.arange(n) + ORDER
    wide[np.arange(len(data)) + np.repeat(shift, size)] = data
    wide[off[1:] + shift] = END
    total = len(wide) - ORDER
    g = np.zeros(max(total, 0), U64)
    for j in range(ORDER + 1):
        g <<= U64(8)
        g |= wide[j : total + j]
    return g[wide[ORDER:] != PAD]


def _merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of several ascending lists, ascending, with their summed counts."""
    v, c = np.concatenate(values), np.concatenate(counts)
    if len(values) > 1:
        order = np.argsort(v, kind="stable")
        v, c = v[order], c[order]
    if not len(v):
        return v, c
    head = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    return v[head], np.add.reduceat(c, head)


def _ranged(h: np.ndarray, parts: int) -> np.ndarray:
    return (((h >> U64(32)) * U64(parts)) >> U64(32)).astype(I64)


PIECE, MOST_DOCS = 1 << 20, 1 << 16


class _Piece:
    """Some texts of a bucket. grams: distinct, ascending; a sort of (gram, document) pairs in one integer gives them and their places at once."""

    def __init__(self, data: np.ndarray, off: np.ndarray, training: np.ndarray):
        self.n = len(off) - 1
        size = np.diff(off) + 1
        pairs = _grams(data, off)
        pairs <<= U64(16)
        pairs |= np.repeat(np.arange(self.n, dtype=U64), size)
        pairs.sort()
        self.doc = (pairs & U64(0xFFFF)).astype(np.uint16)
        pairs >>= U64(16)
        head = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        self.gram, self.runs = pairs[head], np.diff(np.append(head, len(pairs)))
        self.gram_n = np.add.reduceat(training[self.doc].astype(I64), head)
        w = wh.words(data, off)
        self.counts = w.counts + 1
        first = np.concatenate(([0], np.cumsum(self.counts)))
        words = np.full(first[-1], END_WORD, dtype=U64)
        words[np.arange(len(w.start)) + w.owner()] = wh.span_hashes(data, w.start, w.end)
        self.first = first[:-1]
        self.word, self.word_at = np.unique(words, return_inverse=True)
        self.word_n = np.bincount(self.word_at, np.repeat(training, self.counts), len(self.word)).astype(I64)

    def gram_sums(self, scores: np.ndarray) -> np.ndarray:
        """Per text, the sum of scores (one per distinct gram) over its grams."""
        return np.bincount(self.doc, np.repeat(scores, self.runs), self.n)


class _Bucket:
    """Distinct grams and words of a bucket in the order in which they are sent: by range, then by value."""

    def __init__(self, table: pa.Table, parts: int):
        self.ids, self.known, self.data, self.off = _open(table)
        self.training = np.array([is_training(i if k else None) for i, k in zip(self.ids.tolist(), self.known.tolist(), strict=True)], bool)
        grams, gram_n, words, word_n = [], [], [], []
        for p in self.pieces():
            grams.append(p.gram)
            gram_n.append(p.gram_n)
            words.append(p.word)
            word_n.append(p.word_n)
        self.gram, self.gram_n = _merged(grams, gram_n)
        self.word, self.word_n = _merged(words, word_n)
        gram_part, word_part = _ranged(wh.mix(self.gram >> U64(8)), parts), _ranged(self.word, parts)
        self.gram_order, self.word_order = np.argsort(gram_part, kind="stable"), np.argsort(word_part, kind="stable")
        self.gram_cuts = np.searchsorted(gram_part[self.gram_order], np.arange(parts + 1))
        self.word_cuts = np.searchsorted(word_part[self.word_order], np.arange(parts + 1))

    def pieces(self):
        for a, b in wh.pieces(self.off, PIECE, MOST_DOCS):
            yield _Piece(self.data[self.off[a] : self.off[b]], self.off[a : b + 1] - self.off[a], self.training[a:b])


def _planes(values: np.ndarray) -> np.ndarray:
    """Integers as byte planes; the shuffle's codec squeezes the empty ones."""
    return np.ascontiguousarray(values.astype(U64).view(np.uint8).reshape(-1, 8).T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(U64).ravel()


def _send(parts: int):
    def run(table: pa.Table) -> pa.Table:
        b, out = _Bucket(table, parts), []
        for p in np.flatnonzero((np.diff(b.gram_cuts) > 0) | (np.diff(b.word_cuts) > 0)):
            g, w = b.gram_order[b.gram_cuts[p] : b.gram_cuts[p + 1]], b.word_order[b.word_cuts[p] : b.word_cuts[p + 1]]
            out.append((int(p), pack(_planes(np.diff(b.gram[g], prepend=U64(0))), _planes(b.gram_n[g]), _planes(np.diff(b.word[w], prepend=U64(0))), _planes(b.word_n[w]))))
        bucket = table.column("bucket")[0].as_py()
        return pa.table([pa.array([p for p, _ in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], schema=_SPAN_SCHEMA)

    return run


class _Range:
    """All grams and words of one range, with their counts over all buckets."""

    def __init__(self, table: pa.Table):
        blobs = [[_from_planes(x) for x in unpack(blob.as_py(), *["u1"] * 4)] for blob in table.column("packed")]
        self.gram_sizes, self.word_sizes = [len(b[0]) for b in blobs], [len(b[2]) for b in blobs]
        grams = np.concatenate([np.cumsum(b[0], dtype=U64) for b in blobs])
        self.gram, self.gram_at = np.unique(grams, return_inverse=True)
        self.gram_n = np.bincount(self.gram_at, np.concatenate([b[1] for b in blobs]).astype(float), len(self.gram)).astype(I64)
        words = np.concatenate([np.cumsum(b[2], dtype=U64) for b in blobs])
        self.word, self.word_at = np.unique(words, return_inverse=True)
        self.word_n = np.bincount(self.word_at, np.concatenate([b[3] for b in blobs]).astype(float), len(self.word)).astype(I64)
        context = self.gram >> U64(8)
        self.head = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, I64)
        self.of = np.repeat(np.arange(len(self.head)), np.diff(np.append(self.head, len(context))))
        if len(self.head):
            self.n = np.add.reduceat(self.gram_n, self.head)
            self.d = np.add.reduceat((self.gram_n > 0).astype(I64), self.head)
        else:
            self.n = self.d = np.zeros(0, I64)


_PARTS = pa.schema([("kind", pa.int32()), ("gram", pa.int64()), ("n", pa.int64()), ("score", pa.float64()), ("ruled_out", pa.binary())])


def _count(table: pa.Table) -> pa.Table:
    """kind 0: training words (n) and distinct ones (gram) of the range; 1: counts of 5-byte grams, for the lower orders; 2: grams not seen, with the cost of the first escape and the symbols ruled out."""
    r = _Range(table)
    seen = r.gram_n > 0
    low, at = np.unique(r.gram[seen] & U64((1 << 40) - 1), return_inverse=True)
    low_n = np.bincount(at, r.gram_n[seen].astype(float), len(low)).astype(I64)
    open_grams = np.flatnonzero(~seen)
    own = r.of[open_grams]
    n, d = r.n[own], r.d[own]
    cost = np.where(n > 0, np.log10(np.maximum(d, 1) / np.maximum(n + d, 1)), 0.0)
    asked, back = np.unique(own, return_inverse=True)
    marks = np.zeros((len(asked), 256), bool)
    inside = np.isin(r.of, asked) & seen
    marks[np.searchsorted(asked, r.of[inside]), (r.gram[inside] & U64(255)).astype(I64)] = True
    bits = np.packbits(marks, axis=1)
    blobs = [x.tobytes() for x in bits]
    kinds = np.repeat([0, 1, 2], [1, len(low), len(open_grams)])
    grams = np.concatenate(([int((r.word_n > 0).sum())], low.view(I64), r.gram[open_grams].view(I64)))
    ns = np.concatenate(([int(r.word_n.sum())], low_n, np.zeros(len(open_grams), I64)))
    scores = np.concatenate((np.zeros(1 + len(low)), cost))
    return pa.table([pa.array(kinds, pa.int32()), pa.array(grams, pa.int64()), pa.array(ns, pa.int64()), pa.array(scores), pa.array([None] * (1 + len(low)) + [blobs[k] for k in back], pa.binary())], schema=_PARTS)


_OPEN = "part int, gram long, score double, ruled_out binary"
_OPEN_SCHEMA = pa.schema([("part", pa.int32()), ("gram", pa.int64()), ("score", pa.float64()), ("ruled_out", pa.binary())])
SLICE = 2048


def _tried(rows: np.ndarray, symbol: np.ndarray, score: np.ndarray, ruled: np.ndarray) -> np.ndarray:
    """Which grams are found among the counts of their contexts (rows), in which score and ruled (symbols ruled out) advance in place."""
    rows = np.where(ruled, 0.0, rows)
    n, d = rows.sum(axis=1), (rows > 0).sum(axis=1)
    c = rows[np.arange(len(rows)), symbol]
    found = c > 0
    score[found] += np.log10(c[found] / (n + d)[found])
    escape = ~found & (n > 0)
    score[escape] += np.log10(d[escape] / (n + d)[escape])
    ruled |= rows > 0
    return found


def _settle(parts: int, pairs: np.ndarray | None):
    """One order of unseen grams (gram, score, ruled_out, symbols: the counts of its context): range, gram, score and what is ruled out now, null once settled.

    With pairs (pairs[a, b]: how often b follows a) orders 1 and 0 and even shares come after it, so all are settled.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                grams = np.asarray(batch.column("gram")).view(U64)
                score = np.array(batch.column("score"))
                ruled = np.unpackbits(np.frombuffer(b"".join(batch.column("ruled_out").to_pylist()), np.uint8).reshape(-1, 32), axis=1).astype(bool)
                symbol = (grams & U64(255)).astype(I64)
                lists = batch.column("symbols")
                own = np.repeat(np.arange(len(grams)), np.asarray(lists.value_lengths()))
                held = lists.flatten()
                rows = np.zeros((len(grams), 256))
                rows[own, np.asarray(held.field(0)).astype(I64)] = np.asarray(held.field(1))
                todo = ~_tried(rows, symbol, score, ruled)
                for table in () if pairs is None else (pairs[((grams >> U64(8)) & U64(255)).astype(I64)], np.broadcast_to(pairs.sum(axis=0), rows.shape)):
                    mine = np.flatnonzero(todo)
                    own_score, own_ruled = score[mine], ruled[mine]
                    found = _tried(table[mine].astype(float), symbol[mine], own_score, own_ruled)
                    score[mine], ruled[mine] = own_score, own_ruled
                    todo[mine[found]] = False
                if pairs is not None:
                    score[todo] -= np.log10(256 - ruled[todo].sum(axis=1))
                    todo[:] = False
                masks = [x.tobytes() if left else None for x, left in zip(np.packbits(ruled, axis=1), todo.tolist(), strict=True)]
                part = _ranged(wh.mix(grams >> U64(8)), parts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("gram"), pa.array(score), pa.array(masks, pa.binary())], schema=_OPEN_SCHEMA)

    return run


def _settled(model: DataFrame, parts: int, pairs: np.ndarray) -> DataFrame:
    """part, gram, score of all unseen grams of the model, by orders 4, 3 and 2, each of which gets what the one before left open.

    A context is one row of at most 256 symbols, so this is a join in which no row is large and a common context may be split.
    """
    spark, done = model.sparkSession, None
    left = model.where("kind = 2").select("gram", "score", "ruled_out")
    for order in (4, 3, 2):
        mask = F.lit((1 << (8 * order)) - 1)
        context = F.shiftright("gram", 8).bitwiseAND(mask).alias("context")
        counts = model.where("kind = 1").groupBy(context, F.col("gram").bitwiseAND(255).cast("short").alias("s")).agg(F.sum("n").alias("n"))
        table = counts.groupBy("context").agg(F.collect_list(F.struct("s", "n")).alias("symbols"))
        none = F.array().cast("array<struct<s:smallint,n:bigint>>")
        met = left.withColumn("context", F.shiftright("gram", 8).bitwiseAND(mask)).join(table, "context", "left").select("gram", "score", "ruled_out", F.coalesce("symbols", none).alias("symbols"))
        path = scratch(spark, f"ppm-order-{order}")
        met.mapInArrow(_settle(parts, pairs if order == 2 else None), _OPEN).write.parquet(path)
        tried = spark.read.schema(_OPEN).parquet(path)
        now = tried.where("ruled_out is null").select("part", "gram", "score")
        done, left = now if done is None else done.union(now), tried.where("ruled_out is not null")
    return done


def _answer(table: pa.Table, settled: pa.Table) -> pa.Table:
    """Per bucket: the score of each gram it sent and the training count of each word."""
    if not table.num_rows:
        return _SPAN_SCHEMA.empty_table()
    r = _Range(table)
    score = np.zeros(len(r.gram))
    seen = r.gram_n > 0
    score[seen] = np.log10(r.gram_n[seen] / (r.n + r.d)[r.of[seen]])
    if settled.num_rows:
        grams = np.asarray(settled.column("gram").combine_chunks()).view(U64)
        score[np.searchsorted(r.gram, grams)] = np.asarray(settled.column("score").combine_chunks())
    gram_cuts, word_cuts = np.cumsum([0, *r.gram_sizes]), np.cumsum([0, *r.word_sizes])
    told, counts = score.astype(np.float32)[r.gram_at], r.word_n[r.word_at]
    blobs = [pack(told[gram_cuts[k] : gram_cuts[k + 1]], _planes(counts[word_cuts[k] : word_cuts[k + 1]])) for k in range(table.num_rows)]
    return pa.table([table.column("part"), table.column("bucket"), pa.array(blobs, pa.binary())], schema=_SPAN_SCHEMA)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("score", pa.float64())])


def _score(parts: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _SCORED.empty_table()
        b = _Bucket(table, parts)
        replies = replies.sort_by("part")
        told = [unpack(x.as_py(), np.float32, "u1") for x in replies.column("packed")]
        scores, counts = np.empty(len(b.gram)), np.empty(len(b.word), I64)
        scores[b.gram_order] = np.concatenate([t[0] for t in told])
        counts[b.word_order] = np.concatenate([_from_planes(t[1]) for t in told]).astype(I64)
        score, known, logs, size = [], [], [], []
        for p in b.pieces():
            score.append(p.gram_sums(scores[np.searchsorted(b.gram, p.gram)]))
            c = counts[np.searchsorted(b.word, p.word)]
            known.append(np.add.reduceat((c > 0)[p.word_at].astype(I64), p.first))
            logs.append(np.add.reduceat(np.log10(c + 0.1)[p.word_at], p.first))
            size.append(p.counts)
        score, known, logs, size = map(np.concatenate, (score, known, logs, size))
        ids = pa.array(b.ids, mask=~b.known)
        return pa.table([ids, pa.array(~b.training), pa.array(size.astype(I64)), pa.array(known), pa.array(logs), pa.array(score)], schema=_SCORED)

    return run


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    The texts whose crc32(doc_id as text) is not divisible by 10 are learnt from; all are
    scored. score is the log10 probability of the lower-cased bytes and the end of the text.
    base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1))) over words and the end.

    Null text: empty, so its end alone. Null doc_id: held out. Repeated rows count once
    each. Other columns are ignored. An empty table gives no rows; without training texts
    every byte costs log10(256) or less.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = text_bytes(docs)[1]
    parts = max(8, -(-size // (8 << 20)))
    dealt, n = dealt_blobs(docs, size)
    buckets = dealt.groupBy("bucket")
    sent = buckets.applyInArrow(_send(parts), _SPAN)
    path = scratch(spark, "ppm")
    sent.groupBy("part").applyInArrow(_count, "kind int, gram long, n long, score double, ruled_out binary").write.partitionBy("kind").parquet(path)
    model = spark.read.schema("gram long, n long, score double, ruled_out binary, kind int").parquet(path)
    totals = model.where("kind = 0").agg(F.sum("n").alias("n"), F.sum("gram").alias("v")).first()
    train, kinds = totals["n"] or 0, totals["v"] or 0
    pairs = np.zeros((256, 256), I64)
    for row in model.where("kind = 1").groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("p")).agg(F.sum("n").alias("n")).collect():  # at most 65,536 rows
        pairs[row["p"] >> 8, row["p"] & 255] = row["n"]
    settled = _settled(model, parts, pairs)
    replies = sent.groupBy("part").cogroup(settled.groupBy("part")).applyInArrow(_answer, _SPAN)
    scored = buckets.cogroup(replies.repartition(n, "bucket").groupBy("bucket")).applyInArrow(_score(parts), "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double")
    base = F.col("log_counts") - F.col("n_tokens") * F.lit(float(np.log10(train + 0.1 * (kinds + 1))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), base.alias("base_score"), "score")

