"""Best-fit packing of token pieces by patterns of lengths.

Documents longer than a sequence are cut into whole sequences, a shorter first piece left
over. What is to be packed is then a histogram of at most `room` lengths, however large the
corpus. On that histogram alone:

1. enumerate the patterns of two or three lengths that fill a sequence exactly;
2. fit how often to use each by non-negative least squares (A x = histogram, x >= 0; the
   multiplicative update keeps x non-negative and lowers the residual every step);
3. round down, within what is left of each length;
4. pack the residual by best fit decreasing, all pieces of a length at a time, which gives
   further patterns with counts.

Pieces then take their places by joins: pieces of one length are numbered without gaps
(salted, so that a length which holds a third of all pieces is numbered by many tasks), and
a small table of number ranges says which pattern, repeat and offset each number has.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import numbered, scratch, small_batches
from lexmill.llm.tokens import BatchEncoder

FIT_STEPS = 200


def fill_patterns(room: int) -> np.ndarray:
    """[n, 3] lengths a >= b >= c >= 0 with a + b + c = room, a < room."""
    b = np.repeat(np.arange(1, room), np.arange(1, room) + 1)
    c = np.concatenate([np.arange(k + 1) for k in range(1, room)])
    a = room - b - c
    fits = (a >= b) & (c <= b)
    return np.stack([a[fits], b[fits], c[fits]], axis=1)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """x >= 0 that brings the histogram of the patterns' lengths near the given one, by least squares."""
    goal = histogram.astype(float).copy()
    goal[0] = 0
    some = goal[patterns[:, 0]] * goal[patterns[:, 1]] * np.where(patterns[:, 2] > 0, goal[patterns[:, 2]], 1) > 0
    x = np.zeros(len(patterns))
    if not some.any():
        return x
    p = patterns[some]
    used = p > 0
    y = np.where(p[:, 2] == 0, np.minimum(goal[p[:, 0]], goal[p[:, 1]]), 1e-2 * goal[p].min(axis=1, where=used, initial=np.inf))
    top = np.where(used, goal[p], 0).sum(axis=1)
    for _ in range(steps):
        made = np.bincount(p.ravel(), np.repeat(y, 3), len(goal))
        made[0] = 0
        y *= top / np.maximum(made[p].sum(axis=1), 1e-12)
    x[some] = y
    return x


def plan_packing(histogram: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up the histogram of lengths 1..room exactly."""
    left = histogram.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[room]:
        plan.append(((room,), int(left[room])))
        left[room] = 0
    patterns = fill_patterns(room)
    x = fit_counts(patterns, left)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 1:
            break
        own = [int(v) for v in patterns[k] if v]
        n = min(int(x[k]), *(int(left[v]) // own.count(v) for v in set(own)))
        if n > 0:
            for v in own:
                left[v] -= n
            plan.append((tuple(own), n))
    # best fit decreasing over counts: open[s] lists (lengths so far, how many sequences have s tokens of space)
    open_bins: list[defaultdict] = [defaultdict(int) for _ in range(room + 1)]
    for v in range(room - 1, 0, -1):
        n, space = int(left[v]), v
        while n > 0:
            while space <= room and not open_bins[space]:
                space += 1
            if space > room:
                # sequences of this length alone, as many of it in each as fit
                each = room // v
                full, rest = divmod(n, each)
                if full:
                    open_bins[room - each * v][(v,) * each] += full
                if rest:
                    open_bins[room - rest * v][(v,) * rest] += 1
                n = 0
                break
            own, have = open_bins[space].popitem()
            take = min(n, have)
            if have > take:
                open_bins[space][own] = have - take
            open_bins[space - v][own + (v,)] += take
            n -= take
            space = v if space - v >= v else space
    for bins in open_bins:
        plan += bins.items()
    return plan


def _pieces(tokenizer: str, room: int, end_id: int, with_ids: bool):
    def run(batches):
        encoder = BatchEncoder.of(tokenizer, special=True)
        for batch in batches:
            data, off = wh.utf8(batch.column(1))
            for a, b in wh.pieces(off, 1 << 20, 1 << 20):
                ids, bounds = encoder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a], end_id)
                size = np.diff(bounds)
                n = -(-size // room)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = (size - (n - 1) * room)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * room)
                length = np.where(piece == 0, head, room)
                raw, at = memoryview(ids.astype("<u4").tobytes()), (bounds[:-1][doc] + start) * 4
                sums = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                out = {"doc_id": batch.column(0).slice(a, b - a).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                if with_ids:
                    cuts = pa.array(np.append(at // 4, len(ids)), pa.int32())
                    out["ids"] = pa.ListArray.from_arrays(cuts, pa.array(ids))
                yield from pa.table(out).to_batches()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): every piece of every row of docs (doc_id, text).

    Null or empty text: the end id alone, one piece of length 1. Null doc_id: packed like
    any other. Repeated rows are packed once each. Other columns are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    path = scratch(spark, "pieces")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer, room, end_id, with_ids), ddl).write.parquet(path)
    pieces = spark.read.parquet(path)
    histogram = np.zeros(room + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most `room` rows
        histogram[row["length"]] = row["count"]
    plan = plan_packing(histogram, room)

    used, first, places = np.zeros(room + 1, np.int64), 0, []
    for lengths, n in plan:
        offset = 0
        for v in lengths:
            places.append((int(v), int(used[v]), int(used[v] + n), first, offset))
            used[v] += n
            offset += v
        first += n
    columns = zip(*places, strict=True) if places else [[]] * 5
    table = spark.createDataFrame(pa.table({c: pa.array(list(v), pa.int64()) for c, v in zip(("length", "low", "high", "first", "offset"), columns, strict=True)}))
    salt = max(1, int(histogram.max()) // 50_000)
    columns = ["doc_id", "piece", "start", "ids_crc32"]
    ranked = numbered(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt)).cast("int")), "length", "salt", columns, "number")
    out = ranked.join(F.broadcast(table), "length").where("number >= low and number < high")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("number") - F.col("low")).alias("sequence_id"), "offset", *["ids"] * with_ids)
