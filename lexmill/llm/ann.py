"""Nearest neighbours by multi-index hashing.

Codes: vectors are normalised and centred, and several rotations are learnt (iterative
quantisation, each from another start) on a bounded sample; the signs of all rotated
coordinates are the code. A code is cut into substrings of 8 bits and each is indexed. By
the pigeonhole principle a code within Hamming radius r of a query is within
floor(r / substrings) of it in one of its substrings (one less from the substring after
the remainder on), so probing those keys retrieves every code within r. Those are reranked
by the exact measure on the original vectors.

The radius is fitted on the same sample so that a given share of true neighbours lies
within it. Spark deals queries and rows in blocks: each pair of a query block and an index
block is one task's work and gives each query at most k candidates, so what is shuffled
grows with queries times index blocks, never with pairs of rows. Equal vectors are indexed
once, with their k + 1 smallest ids, so a vector that a third of all rows share is one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 8
#: popcount of a byte, and the keys of a substring by distance from 0
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Codes:
    """center, and learnt rotations that give a code of rotations * dimensions bits (cut down to whole bytes)."""

    def __init__(self, sample: np.ndarray, rotations: int = 2, steps: int = 20, seed: int = 3):
        unit = _unit(sample)
        self.center = unit.mean(axis=0)
        x = unit - self.center
        rng = np.random.default_rng(seed)
        self.rotations = []
        for _ in range(rotations):
            r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
            for _ in range(steps):
                u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
                r = (u @ v).T
            self.rotations.append(r)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        x = _unit(vectors) - self.center
        bits = np.concatenate([x @ r > 0 for r in self.rotations], axis=1)
        pad = -bits.shape[1] % BITS
        return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1)


def hamming(codes: np.ndarray, query: np.ndarray) -> np.ndarray:
    return POPCOUNT[codes ^ query].sum(axis=1, dtype=np.int64)


def fit_radius(codes: Codes, sample: np.ndarray, k: int, share: float, queries: int = 300) -> int:
    """The Hamming distance within which the given share of the true k nearest of the sample lie."""
    mine, packed = sample[:queries], codes.encode(sample)
    near = []
    for q in range(len(mine)):
        score = sample @ mine[q]
        score[q] = -np.inf
        top = np.argpartition(-score, min(k, len(score) - 1))[:k]
        near.append(hamming(packed[top], packed[q]))
    return int(np.quantile(np.concatenate(near), share, method="higher")) if near else 0


class MultiIndex:
    """One table per substring, from key to the codes that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.shape[1]
        self.rows = [np.argsort(codes[:, j], kind="stable") for j in range(self.parts)]
        self.cuts = [np.searchsorted(codes[self.rows[j], j], np.arange(257)) for j in range(self.parts)]
        self.keys = [np.array([k for k in range(256) if self.cuts[j][k + 1] > self.cuts[j][k]], np.uint8) for j in range(self.parts)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows of every code within the radius of the query's code."""
        each, rest = divmod(radius, self.parts)
        marked = np.zeros(len(self.codes), bool)
        for j in range(self.parts):
            reach = each if j <= rest else each - 1
            if reach < 0:
                break
            keys = self.keys[j][POPCOUNT[self.keys[j] ^ query[j]] <= reach]
            for a, b in zip(self.cuts[j][keys].tolist(), self.cuts[j][keys.astype(np.int64) + 1].tolist(), strict=True):
                marked[self.rows[j][a:b]] = True
        found = np.flatnonzero(marked)
        return found[hamming(self.codes[found], query) <= radius]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


_FOUND = pa.schema([("query_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def _search(codes: Codes, radius: int, k: int):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return _FOUND.empty_table()
        x, q = _matrix(index.column("v")), _matrix(queries.column("v"))
        ids = index.column("ids").to_pylist()
        table, asked = MultiIndex(codes.encode(x)), codes.encode(q)
        names, found, scores = queries.column("vec_id").to_pylist(), [], []
        for i, name in enumerate(names):
            reach, rows = radius, table.within(asked[i], radius)
            while len(rows) <= k and len(rows) < len(x):  # too few within the radius: widen it
                reach += 2 * BITS
                rows = table.within(asked[i], reach)
            score = np.einsum("ij,j->i", x[rows], q[i])
            keep = np.argsort(-score, kind="stable")[: k + 1]
            if len(rows) > k + 1:  # ties with the last one stay in
                keep = np.flatnonzero(score >= score[keep[-1]])
            best = sorted((-s, v) for s, r in zip(score[keep].tolist(), rows[keep].tolist(), strict=True) for v in ids[r] if v != name)[:k]
            found.append([v for _, v in best])
            scores.append([-s for s, _ in best])
        return pa.table([pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], schema=_FOUND)

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, sample_rows: int = 10_000, share: float = 0.98, rotations: int = 2, block_queries: int = 4096, block_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of vectors (vec_id, embedding) whose id is divisible by `every`.

    Nearness is the inner product in double precision on the vectors as they are, ties to
    the smaller vec_id; candidates are all rows but the query's own. Rotations and radius
    are fitted on at most sample_rows distinct vectors, every row is indexed. A query with
    k or fewer codes in reach in a block widens its radius there.

    Null ids and vectors that are null, empty, zero, of another length than most, or hold a
    null or non-finite component take no part. Rows that share a vec_id are one candidate
    with several vectors; their best score counts, and as queries each id is asked with its
    greatest vector. Other columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if widths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("embedding") == widths["w"])
    # equal vectors are one entry with their smallest ids
    classes = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    classes = classes.groupBy("embedding").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")).withColumnRenamed("embedding", "v")
    total = classes.count()
    taken = classes.select("v").orderBy(F.xxhash64("v")).limit(sample_rows).collect()  # at most sample_rows vectors
    sample = np.array([r["v"] for r in taken], float)
    codes = Codes(sample, rotations)
    radius = fit_radius(codes, sample, k, share)

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max("embedding").alias("v"))
    n_index = max(1, -(-total // block_rows))
    n_query = max(1, -(-queries.count() // block_queries))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(n_query)).cast("int")).withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(n_index - 1))))
    index = classes.withColumn("ib", F.pmod(F.xxhash64("v"), F.lit(n_index)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    found = asked.groupBy("qb", "ib").cogroup(index.groupBy("qb", "ib")).applyInArrow(_search(codes, radius, k), "query_id long, ids array<long>, scores array<double>")
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("p")).select("query_id", F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
