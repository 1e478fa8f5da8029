"""Sparse rows times dense tables, in blocks: embedding sums, logits and softmax without a row per document, feature and label.

The weights of a model of at most TABLE numbers go to all workers, which sum them up where the
texts are; only sums are exchanged. Of a larger one features travel packed, a row per document and range of ids, and meet the weights of that
range in a cell (range, column block, salt). A cell is one numpy product; its partial sums
are added up by Spark, element by element, on the map side first. Neither a feature that
every document has nor a long list of labels makes one task larger than others, and nothing
but counts and weights of at most TABLE numbers comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import ngrams

#: ids and columns of a block of weights, labels of a block of outputs, documents of a cell
IDS, COLUMNS, LABELS, KEYS = 8192, 16, 1024, 20_000
#: numbers of a table of weights that every worker holds
TABLE = 1 << 23
#: products that are held at a time
_HELD = 1 << 16
_ROWS = 2048


def _matrix(lists: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of at most `width` numbers as rows, zeros behind."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(lists.flatten(), float)
    return out


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _cell_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each row of left (key, ids, ns) the sum of ns, and that of n * weights[id] in one block of weights (id, vec)."""
    if not left.num_rows:
        return pa.table({"key": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
    base = left.column("part")[0].as_py() * IDS
    weights = np.zeros((IDS, COLUMNS))
    if right.num_rows:
        weights[np.asarray(right.column("id")) - base] = _matrix(right.column("vec"), COLUMNS)
    ids, ns = (left.column(c).combine_chunks() for c in ("ids", "ns"))
    bounds = np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths()))))
    ids, ns = np.asarray(ids.flatten()) - base, np.asarray(ns.flatten()).astype(np.int64)
    out = np.zeros((left.num_rows, COLUMNS))
    at = 0
    while at < left.num_rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _HELD, side="right")) - 1)
        a, b = bounds[at], bounds[to]
        out[at:to] = np.add.reduceat(weights[ids[a:b]] * ns[a:b, None], bounds[at:to] - a, axis=0)
        at = to
    return pa.table({"key": left.column("key"), "block": pa.array([left.column("block")[0].as_py()] * left.num_rows, pa.int32()), "n": np.add.reduceat(ns, bounds[:-1]), "vec": _lists(out)})


def in_blocks(weights: DataFrame, width: int) -> DataFrame:
    """id, block, vec of weights (id, vec): `width` numbers in blocks of COLUMNS."""
    block = F.explode(F.sequence(F.lit(0), F.lit((width - 1) // COLUMNS)))
    return weights.withColumn("block", block).withColumn("vec", F.expr(f"slice(vec, block * {COLUMNS} + 1, {COLUMNS})"))


def sparse_dense(features: DataFrame, weights: DataFrame, width: int, keys: int) -> DataFrame:
    """key, block, n, vec: by key the sum of all ns, and of n times the weights of each id, in blocks of COLUMNS columns, zeros behind the last.

    features: key, part (id // IDS), ids, ns, no row without ids; rows of one key and part add up.
    weights: id, block, vec (COLUMNS numbers at most); ids without weights count as zeros. keys: how many keys there are, about.
    """
    salts = max(1, -(-keys // KEYS))
    block = F.explode(F.sequence(F.lit(0), F.lit((width - 1) // COLUMNS)))
    left = features.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).withColumn("block", block)
    right = weights.select(F.col("id").cast("long").alias("id"), "block", "vec").withColumn("part", F.floor(F.col("id") / IDS).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cell = ["part", "block", "salt"]
    partial = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell_sums, "key long, block int, n long, vec array<double>")
    return _added(partial)


def _rows_sums(table: np.ndarray, ids: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The sums of rows of table by ids, of runs of ids that begin at head, some products at a time."""
    step = max(1, _HELD // table.shape[1])
    out = np.zeros((len(head), table.shape[1]))
    for a in range(0, len(ids), step):
        first, last = np.searchsorted(head, [a, a + step], side="right")  # the run at a is first - 1
        cuts = np.maximum(head[first - 1 : last], a)
        cuts = cuts[cuts < min(a + step, len(ids))]
        out[first - 1 : first - 1 + len(cuts)] += np.add.reduceat(table.take(ids[a : a + step], axis=0), cuts - a, axis=0)
    return out


def text_sums(docs: DataFrame, key: Column, text: Column, size: int, buckets: int, weights: DataFrame, width: int) -> DataFrame:
    """sparse_dense of the ids of all n-grams of `size` characters of each text; rows of one key add up."""
    if buckets * width > TABLE:
        features = ngrams.document_features(docs, key, text, size, size, buckets, IDS)
        return sparse_dense(features, weights, width, docs.count())
    ngrams.small_batches(docs.sparkSession)
    found = weights.where(F.col("id") < buckets).select(F.col("id").cast("long").alias("id"), "block", "vec").toArrow()
    width = max(1, width)
    blocks = (width - 1) // COLUMNS + 1
    table = np.zeros((buckets, blocks, COLUMNS))
    table[np.asarray(found.column("id")), np.asarray(found.column("block"))] = _matrix(found.column("vec"), COLUMNS)
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.reshape(buckets, -1)[:, :width]))

    def run(batches):
        for batch in batches:
            data, off = ngrams.utf8(batch.column(1))
            for owner, ids in ngrams.ngram_ids(data, off, size, size, buckets):
                head = np.flatnonzero(np.diff(owner, prepend=-1))
                sums = np.zeros((len(head), blocks * COLUMNS))
                sums[:, :width] = _rows_sums(shared.value, ids, head)
                yield pa.RecordBatch.from_pydict({
                    "key": batch.column(0).take(pa.array(np.repeat(owner[head], blocks))),
                    "block": pa.array(np.tile(np.arange(blocks), len(head)), pa.int32()),
                    "n": pa.array(np.repeat(np.diff(np.append(head, len(ids))), blocks), pa.int64()),
                    "vec": _lists(sums.reshape(-1, COLUMNS)),
                })

    partial = docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, "key long, block int, n long, vec array<double>")
    return _added(partial)


def _added(partial: DataFrame) -> DataFrame:
    return partial.groupBy("key", "block").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("vec")[k]) for k in range(COLUMNS)]).alias("vec"))


def hidden_means(features: DataFrame, weights: DataFrame, width: int, keys: int) -> DataFrame:
    """key, hidden: the mean of the weights of all ids of each key, `width` numbers."""
    return means_of(sparse_dense(features, in_blocks(weights, width), width, keys), width)


def means_of(sums: DataFrame, width: int) -> DataFrame:
    """key, hidden: `width` means from sums (key, block, n, vec)."""
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "vec"))), lambda b: b["vec"]))  # width numbers, however many ids
    return sums.groupBy("key").agg(F.max("n").alias("n"), F.slice(whole, 1, width).alias("v")).select("key", F.transform("v", lambda x: x / F.col("n")).alias("hidden"))


def _cell_logits(width: int, k: int):
    """In one block of labels: of each key the logarithm of the sum of exponentials, and the k best labels."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "lse": pa.array([], pa.float64()), "labels": pa.array([], pa.list_(pa.string())), "logits": pa.array([], pa.list_(pa.float64()))})
        right = right.sort_by("label")
        labels, out = right.column("label").to_pylist(), _matrix(right.column("vec"), width)
        hidden = _matrix(left.column("hidden"), width)
        lse, best, tops = [], [], []
        for at in range(0, len(hidden), _ROWS):
            x = hidden[at : at + _ROWS]
            logits = np.zeros((len(x), len(labels)))
            for d in range(width):  # in this order in every block, so that equal labels tie exactly
                logits += x[:, d, None] * out[:, d]
            top = logits.max(axis=1)
            lse.append(top + np.log(np.exp(logits - top[:, None]).sum(axis=1)))
            order = np.argsort(-logits, axis=1, kind="stable")[:, :k]  # of equal ones the first by name
            best += [[labels[j] for j in row] for row in order]
            tops.append(np.take_along_axis(logits, order, axis=1))
        return pa.table({"key": left.column("key"), "lse": np.concatenate(lse), "labels": pa.array(best, pa.list_(pa.string())), "logits": _lists(np.concatenate(tops))})

    return run


def softmax_top(hidden: DataFrame, outputs: DataFrame, width: int, k: int, keys: int) -> DataFrame:
    """key, label, p, rank: the k most likely labels by softmax of hidden times outputs (label, vec); the first by name on a tie."""
    n = outputs.count()
    blocks, salts = max(1, -(-n // LABELS)), max(1, -(-keys // KEYS))
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = hidden.select("key", "hidden", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("salt"), each("block", blocks))
    right = outputs.select("label", "vec", F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("block"), each("salt", salts))
    part = left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt")).applyInArrow(_cell_logits(width, k), "key long, lse double, labels array<string>, logits array<double>")
    best = F.transform(F.arrays_zip("logits", "labels"), lambda x: F.struct((-x["logits"]).alias("cost"), x["labels"].alias("label")))
    # a row per key and block of labels
    merged = part.withColumn("best", best).groupBy("key").agg(F.max("lse").alias("top"), F.collect_list("lse").alias("lse"), F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    total = F.col("top") + F.log(F.aggregate("lse", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    return merged.select("key", total.alias("total"), F.posexplode("best").alias("r", "b")).select("key", F.col("b.label").alias("label"), F.exp(-F.col("b.cost") - F.col("total")).alias("p"), (F.col("r") + 1).alias("rank"))


def seeded(index: Column, width: int, seed: int) -> Column:
    """`width` fixed numbers in [-1, 1) for an integer from 0 to 2**28: stand-ins for weights that a model would bring."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: ((index * 7919 + d.cast("long") * 104729 + seed) * 2654435761 % 4294967296) / 2147483648.0 - 1)
