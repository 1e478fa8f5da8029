"""What several operators share: the shared folder, document buckets, packed arrays, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: bytes of one Arrow batch on its way to a Python worker
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of the session in bytes, unless it has a bound of its own; by rows alone a batch of long texts has none."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of the texts)."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return row["n"], row["b"] or 0


def tasks_for(size: int, each: int, spark: SparkSession) -> int:
    """Number of partitions for `size` bytes at `each` bytes a task, but no fewer than two per core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // each))


def bucketed(docs: DataFrame, size: int, each: int = 4 << 20) -> tuple[DataFrame, int]:
    """docs (doc_id, text) dealt by a hash of doc_id into buckets of about `each` bytes of text, and over how many tasks.

    The bucket is a function of the row alone, so a lost task that runs again puts every
    row back into the same bucket. Buckets are many to a task, so tasks are even.
    """
    spark = docs.sparkSession
    n = tasks_for(size, 6 * each, spark)
    buckets = max(4 * n, -(-size // each))
    key = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(buckets)).cast("int")
    return docs.withColumn("bucket", key).repartition(n, "bucket"), n


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: their lengths in bytes, then their bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(blob, kind, size // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def squeeze(ascending: np.ndarray) -> np.ndarray:
    """Ascending uint32 values as byte planes of their differences, which the shuffle's codec compresses."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype(np.uint32)
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)


def unsqueeze(planes: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(steps, dtype=np.uint32)


def numbered(df: DataFrame, by: str, salt: str, order: list[str], name: str) -> DataFrame:
    """df with a number from 0 without gaps in each value of `by`, in the order of (salt, order).

    Rows are numbered within (by, salt); what comes before a salt is a running total of counts.
    """
    counts = df.groupBy(by, salt).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy(salt)) - F.col("_n")
    own = F.row_number().over(Window.partitionBy(by, salt).orderBy(*order))
    return df.withColumn("_own", own).join(counts.select(by, salt, before.alias("_before")), [by, salt]).withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_own", "_before")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star contraction: each round is two aggregations and
    two joins on the edge table, hubs are pre-aggregated before their rows meet, and the
    number of rounds grows with the logarithm of the number of nodes. Lineage is cut by a
    checkpoint after each round. Nothing but a count and a checksum comes to the driver.
    """
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(low.select("a", "m"))
        edges = saved(small.select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
