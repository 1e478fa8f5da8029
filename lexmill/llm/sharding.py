"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows are dealt into buckets by a hash of the row: bucket i has n_i rows.
2. The matrix A, A[i][j] = rows of bucket i that go to shard j, is drawn from the law that
   a uniform random permutation gives it, with row sums n_i and column sums m_j (the shard
   sizes, at most one apart). Each entry is a hypergeometric draw given those before it.
   Only the n_i come to the driver: at most MOST_ENTRIES / shards of them, however many rows
   there are, so buckets grow with the table (and are sorted by Spark, which spills).
3. Each bucket permutes its rows (by a second hash) and sends the first A[i][0] to shard 0,
   the next A[i][1] to shard 1, and so on.
4. Each shard permutes what it got (by a third hash). A shard is cut into ranges of that
   hash, numbered side by side; running totals of their counts give the slots.

DataFrame operations alone; a row's bucket, order and slot depend on the row and the seed,
so tasks that run again give the same answer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.cluster import numbered

BUCKET_ROWS = 100_000
RANGE_ROWS = 100_000
#: entries of the communication matrix
MOST_ENTRIES = 1 << 17


def hypergeometric(u: float, good: int, bad: int, n: int) -> int:
    """The number of good ones among n drawn from good + bad without replacement, by inversion of u in [0, 1)."""
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    width = int(14 * (n * (good / total) * (bad / total) * ((total - n) / max(total - 1, 1))) ** 0.5) + 40
    a, b = max(low, mode - width), min(high, mode + width)
    k = np.arange(a + 1, b + 1, dtype=float)
    steps = np.log(good - k + 1) + np.log(n - k + 1) - np.log(k) - np.log(bad - n + k)
    log_p = np.concatenate(([0.0], np.cumsum(steps)))
    p = np.exp(log_p - log_p.max())
    cdf = np.cumsum(p)
    return a + int(np.searchsorted(cdf, u * cdf[-1], side="right"))


def communication_matrix(bucket_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """A[i][j] with the given row and column sums, as a uniform random permutation would have it."""
    rng = np.random.default_rng(seed)
    left = [int(m) for m in shard_rows]
    out = np.zeros((len(bucket_rows), len(left)), np.int64)
    for i, n in enumerate(bucket_rows):
        rest, need = sum(left), int(n)
        for j, m in enumerate(left):
            rest -= m
            out[i, j] = k = hypergeometric(rng.random(), m, rest, need)
            need -= k
            left[j] -= k
    return out


def _hash(seed: int, turn: int, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(turn), *columns)


def _range_of(h: Column, n: Column | int) -> Column:
    """The range, of n equal ones, of a 64-bit hash; it grows with the hash."""
    return F.floor((F.shiftright(h, 32) + F.lit(1 << 31)) * F.lit(n) / F.lit(1 << 32)).cast("int")


def shuffle_into_shards(df: DataFrame, n_shards: int, keys: list[str], seed: int = 17) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (0.. in its shard): a uniform shuffle with shard sizes at most one apart.

    keys name columns that tell rows apart, null allowed; rows that agree in all of them are
    interchangeable only if they are equal in every column, as repeated rows are. Columns
    named shard or slot are replaced; any other name may occur. With fewer rows than shards
    some shards stay empty. An empty table gives no rows.
    """
    df = df.drop("shard", "slot")
    total = df.count()
    buckets = min(max(32, -(-total // BUCKET_ROWS)), max(1, MOST_ENTRIES // n_shards))
    ranges = max(4, -(-total // (n_shards * RANGE_ROWS)))
    df = df.select(F.struct("*").alias("row"))
    keys = [f"row.`{k}`" for k in keys]
    columns = [F.col(k) for k in keys]
    dealt = df.withColumn("_bucket", F.pmod(_hash(seed, 1, columns), F.lit(buckets)).cast("int")).withColumn("_first", _hash(seed, 2, columns)).withColumn("_second", _hash(seed, 3, columns))
    counts = {r["_bucket"]: r["count"] for r in dealt.groupBy("_bucket").count().collect()}  # `buckets` rows at most
    sizes = [total // n_shards + (j < total % n_shards) for j in range(n_shards)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(buckets)], sizes, seed)
    bounds = df.sparkSession.createDataFrame([(i, [int(x) for x in np.cumsum(row)]) for i, row in enumerate(matrix)], "_bucket int, _bounds array<long>")
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy("_first", *keys)) - 1
    sent = dealt.withColumn("_rank", local).join(F.broadcast(bounds), "_bucket").withColumn("shard", F.size(F.filter("_bounds", lambda b: b <= F.col("_rank"))).cast("int"))
    sent = sent.withColumn("_range", _range_of(F.col("_second"), ranges)).drop("_bucket", "_first", "_rank", "_bounds")
    return numbered(sent, "shard", "_range", ["_second", *keys], "slot").select("row.*", "shard", "slot")


def shard_table(docs: DataFrame, n_shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs (doc_id, text).

    size: UTF-8 bytes of the text (null: none) plus 1. The law is `rows`: shard counts are at
    most one apart; grown_shard is null. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(narrow, n_shards, ["doc_id", "text_crc32", "size"], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
