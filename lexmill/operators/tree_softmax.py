"""Hierarchical softmax: a Huffman tree over label counts, a classifier at each node, probabilities by path products.

The tree is made in rounds over a table of nodes. All nodes lighter than the sum of the two
lightest are taken before any new one, so they pair up in one round, and rounds are about as
many as the tree is deep. Node classifiers are fitted by Newton steps: each step is one
pass over all rows that sums gradients and curvatures by node, and the driver holds these and
the node vectors alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators import product
from lexmill.operators.shared import saved, small

RIDGE, STEPS = 0.01, 12
#: probabilities of a branch are kept off 0
LEAST = 1e-12


def _ranked(nodes: DataFrame) -> DataFrame:
    """nodes with their rank from 0 by weight, joined ones first among equals; counted within the weights of one length in bits."""
    size = F.length(F.bin("weight"))
    nodes = nodes.withColumn("bits", size)
    counts = nodes.groupBy("bits").agg(F.count(F.lit(1)).alias("m"))  # 64 rows at most
    before = counts.select("bits", (F.sum("m").over(Window.orderBy("bits")) - F.col("m")).alias("before"))
    own = F.row_number().over(Window.partitionBy("bits").orderBy("weight", F.desc("joined"), "turn")) - 1
    return nodes.withColumn("own", own).join(F.broadcast(before), "bits").withColumn("r", F.col("own") + F.col("before")).drop("own", "before", "bits")


def huffman_tree(counts: DataFrame) -> DataFrame:
    """label_idx, pos, node, bit: the path of each label from its leaf to the root of a Huffman tree over counts (label_idx, n).

    The lightest two are joined again and again; of equal weights joined ones come first, in
    the order they were made, then labels from the last to the first, and the second of a
    pair has the bit set. Nodes are numbered as they are made. One label has no path; an empty
    table gives no rows.
    """
    leaves = counts.select(F.col("label_idx").cast("long").alias("id"), F.col("n").cast("long").alias("weight"), F.lit(False).alias("joined"), (-F.col("label_idx").cast("long")).alias("turn"))
    nodes, made = saved(leaves), 0
    total = left = nodes.count()
    members = counts.select("label_idx", F.lit(0).alias("pos"), F.col("label_idx").cast("long").alias("root"))
    steps = counts.select(F.col("label_idx").cast("int").alias("label_idx"), F.lit(0).alias("pos"), F.lit(0).alias("node"), F.lit(False).alias("bit")).limit(0)
    while left > 1:
        ranked = saved(_ranked(nodes))
        pair_weight = ranked.where("r < 2").agg(F.sum("weight")).first()[0]
        ready = ranked.where((F.col("r") < 2) | (F.col("weight") < pair_weight) | (F.col("joined") & (F.col("weight") == pair_weight))).count()
        pairs = ready // 2
        taken = ranked.where(F.col("r") < 2 * pairs).withColumn("turn", F.lit(made) + F.floor(F.col("r") / 2))
        parents = taken.groupBy("turn").agg(F.sum("weight").alias("weight")).select((F.lit(total) + F.col("turn")).alias("id"), "weight", F.lit(True).alias("joined"), "turn")
        edges = taken.select(F.col("id").alias("root"), F.col("turn").alias("node"), (F.col("r") % 2 == 1).alias("bit"))
        climbed = saved(members.join(edges, "root", "left"))
        steps = steps.unionByName(climbed.where("node is not null").select(F.col("label_idx").cast("int").alias("label_idx"), "pos", F.col("node").cast("int").alias("node"), "bit"))
        members = climbed.select("label_idx", (F.col("pos") + F.col("node").isNotNull().cast("int")).alias("pos"), F.coalesce(F.lit(total) + F.col("node"), F.col("root")).alias("root"))
        nodes = saved(ranked.where(F.col("r") >= 2 * pairs).drop("r").unionByName(parents))
        made, left = made + pairs, left - pairs
    return steps


def _newton_sums(vectors: np.ndarray):
    """By node: gradient, curvature and loss of the rows (hidden, nodes, bits) of a partition."""
    width = vectors.shape[1]

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = product._matrix(batch.column("hidden"), width)
            nodes, bits = batch.column("nodes"), batch.column("bits")
            row = np.repeat(np.arange(len(x)), np.asarray(nodes.value_lengths()))
            flat, bit = np.asarray(nodes.flatten()), np.asarray(bits.flatten().cast(pa.int8())).astype(float)
            order = np.argsort(flat, kind="stable")
            cuts = np.flatnonzero(np.diff(flat[order], prepend=-1))
            for own in np.split(order, cuts[1:]) if len(order) else []:
                xs, y, node = x[row[own]], bit[own], int(flat[own[0]])
                z = xs @ vectors[node]
                p = 1 / (1 + np.exp(-z))
                loss = np.logaddexp(0, np.where(y > 0, -z, z)).sum()
                value = np.concatenate(((y - p) @ xs, ((xs * (p * (1 - p))[:, None]).T @ xs).ravel(), [loss]))
                sums[node] = sums[node] + value if node in sums else value
        if sums:
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(sums), pa.int32()), "sums": pa.array(list(sums.values()), pa.list_(pa.float64()))})

    return run


def _added(part: pa.Table) -> pa.Table:
    """The sums of one node, of which each task has sent a row."""
    sums = part.column("sums").combine_chunks()
    whole = np.asarray(sums.flatten()).reshape(len(sums), -1).sum(axis=0)
    return pa.table({"node": part.column("node").slice(0, 1), "sums": product._lists(whole[None, :])})


def fit_nodes(rows: DataFrame, n_nodes: int, width: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, list[float]]:
    """(a vector per node, the loss before each step) from rows (hidden, nodes, bits): logistic regression at every node by damped Newton steps.

    A step that doesn't lower the ridged loss of a node is halved. Nodes without rows stay zero.
    """
    vectors, losses = np.zeros((n_nodes, width)), []
    step, best = np.zeros_like(vectors), np.full(n_nodes, np.inf)
    for _ in range(steps):
        part = rows.mapInArrow(_newton_sums(vectors + step), "node int, sums array<double>")
        found = part.groupBy("node").applyInArrow(_added, "node int, sums array<double>").toArrow()  # nodes times width squared
        table = np.zeros((n_nodes, width + width * width + 1))
        table[np.asarray(found.column("node"))] = product._matrix(found.column("sums"), table.shape[1])
        trial = vectors + step
        loss = table[:, -1] + ridge / 2 * (trial**2).sum(axis=1)
        good = loss <= best
        best[good], vectors[good] = loss[good], trial[good]
        slope = table[:, :width] - ridge * trial
        curve = table[:, width:-1].reshape(n_nodes, width, width) + ridge * np.eye(width)
        step = np.where(good[:, None], np.linalg.solve(curve, slope[:, :, None])[:, :, 0], step / 2)
        losses.append(float(best.sum()))
        if np.abs(step).max(initial=0) < 1e-9:
            break
    return vectors, losses


def vectors_table(spark: SparkSession, vectors: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "node int, vec array<double>")


def _block_probabilities(hidden: pa.ChunkedArray, right: pa.Table, width: int):
    """(label indexes of a block, an iterator of the probabilities of some rows of hidden after others): at each node the branch a label takes, multiplied along its path."""
    labels, place = np.unique(np.asarray(right.column("label_idx")), return_inverse=True)
    used = right.column("node").combine_chunks()
    steps = np.flatnonzero(np.asarray(used.is_valid()))
    nodes, first, at = np.unique(np.asarray(used.fill_null(0))[steps], return_index=True, return_inverse=True)
    vectors = product._matrix(right.column("vec").combine_chunks().take(pa.array(steps[first])), width)
    bits = np.asarray(right.column("bit").combine_chunks().fill_null(False).cast(pa.int8())).astype(bool)[steps]
    takes, turns = np.zeros((len(nodes), len(labels))), np.zeros((len(nodes), len(labels)))
    takes[at[bits], place[steps][bits]], turns[at[~bits], place[steps][~bits]] = 1, 1

    def rows():
        for k in range(0, len(hidden), product._ROWS):
            yes = 1 / (1 + np.exp(-(product._matrix(hidden.slice(k, product._ROWS), width) @ vectors.T)))
            yield np.exp(np.log(np.maximum(yes, LEAST)) @ takes + np.log(np.maximum(1 - yes, LEAST)) @ turns)

    return labels, rows()


def _cell_paths(width: int):
    """Of each key the probabilities of a block of labels."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"key": pa.array([], pa.int64()), "labels": pa.array([], pa.list_(pa.int32())), "ps": pa.array([], pa.list_(pa.float64()))}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        labels, rows = _block_probabilities(left.column("hidden"), right, width)
        return pa.table({"key": left.column("key"), "labels": pa.array([labels.tolist()] * left.num_rows, pa.list_(pa.int32())), "ps": product._lists(np.concatenate(list(rows)))})

    return run


def _cell_scores(width: int):
    """Of each key in one block of labels: the probability of its own label, if it is there, the best one, the first by name on a tie, and the sum."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "label_idx": pa.array([], pa.int32()), "p": pa.array([], pa.float64()), "best": pa.array([], pa.string()), "p_best": pa.array([], pa.float64()), "total": pa.array([], pa.float64())})
        labels, rows = _block_probabilities(left.column("hidden"), right, width)
        name_of = dict(zip(right.column("label_idx").to_pylist(), right.column("label").to_pylist(), strict=True))
        names = [name_of[k] for k in labels.tolist()]
        by_name = np.array(sorted(range(len(names)), key=names.__getitem__))
        own = np.asarray(left.column("label_idx"))
        place = np.minimum(np.searchsorted(labels, own), len(labels) - 1)
        here, ps, best, p_best, total, at = labels[place] == own, [], [], [], [], 0
        for block in rows:
            every = np.arange(len(block))
            top = by_name[block[:, by_name].argmax(axis=1)]
            ps.append(block[every, place[at : at + len(block)]])
            best.append(top)
            p_best.append(block[every, top])
            total.append(block.sum(axis=1))
            at += len(block)
        return pa.table({
            "key": left.column("key"),
            "label_idx": left.column("label_idx"),
            "p": pa.array(np.concatenate(ps), mask=~here),
            "best": pa.array(names, pa.string()).take(pa.array(np.concatenate(best))),
            "p_best": np.concatenate(p_best),
            "total": np.concatenate(total),
        })

    return run


def _cells(hidden: DataFrame, labels: DataFrame, tree: DataFrame, vectors: DataFrame, keys: int):
    """Rows of hidden beside the paths of labels, in cells of keys and blocks of labels."""
    n = labels.count()
    blocks, salts = max(1, -(-n // product.LABELS)), max(1, -(-keys // product.KEYS))
    left = hidden.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paths = labels.withColumn("label_idx", F.col("label_idx").cast("int")).join(tree, "label_idx", "left").join(vectors, "node", "left")  # a lone label has no step
    right = paths.withColumn("block", F.col("label_idx") % blocks).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.groupBy("block", "salt").cogroup(right.groupBy("block", "salt"))


def label_probabilities(hidden: DataFrame, labels: DataFrame, tree: DataFrame, vectors: DataFrame, width: int, keys: int) -> DataFrame:
    """key, label_idx, p for every key of hidden (key, hidden) and every one of labels (label_idx), in cells of keys and blocks of labels."""
    cells = _cells(hidden.select("key", "hidden"), labels.select("label_idx"), tree, vectors, keys).applyInArrow(_cell_paths(width), "key long, labels array<int>, ps array<double>")
    return cells.select("key", F.explode(F.arrays_zip("labels", "ps")).alias("x")).select("key", F.col("x.labels").alias("label_idx"), F.col("x.ps").alias("p"))


def label_scores(hidden: DataFrame, labels: DataFrame, tree: DataFrame, vectors: DataFrame, width: int, keys: int) -> DataFrame:
    """key, label_idx, p, best, p_best, total of every row of hidden (key, hidden, label_idx; each pair once) over labels (label_idx, label): a row per pair and block of labels is exchanged, not one per label.

    p: of the row's own label_idx, null if no label has it; the best is the first by name on a tie.
    """
    cells = _cells(hidden.select("key", "hidden", "label_idx"), labels.select("label_idx", "label"), tree, vectors, keys)
    part = cells.applyInArrow(_cell_scores(width), "key long, label_idx int, p double, best string, p_best double, total double")
    top = part.groupBy("key", "label_idx").agg(F.max("p").alias("p"), F.min(F.struct((-F.col("p_best")).alias("cost"), "best")).alias("b"), F.sum("total").alias("total"))
    return top.select("key", "label_idx", "p", F.col("b.best").alias("best"), (-F.col("b.cost")).alias("p_best"), "total")


def with_index(labels: DataFrame) -> DataFrame:
    """label, n, label_idx: labels by descending count, then name."""
    order = labels.select("label", F.col("n").alias("weight"), F.lit(False).alias("joined"), F.row_number().over(Window.partitionBy("n").orderBy(F.desc("label"))).alias("turn"))
    ranked, total = _ranked(order), labels.count()
    return ranked.select("label", F.col("weight").alias("n"), (F.lit(total - 1) - F.col("r")).cast("int").alias("label_idx"))


def held_out_scores(docs: DataFrame, hidden: DataFrame, width: int) -> DataFrame:
    """doc_id, label, p, best, p_best, total of every row of docs (doc_id, label, training) that isn't for training and has a hidden vector (key, hidden).

    p: what the tree gives the row's own label, null if training has not seen it; total: the sum over all labels.
    """
    spark, wide = docs.sparkSession, width + 1
    docs = saved(docs.select(F.col("doc_id").alias("key"), "label", "training"))  # texts are read once
    biased = hidden.select("key", F.concat("hidden", F.array(F.lit(1.0))).alias("hidden"))
    counts = docs.where("training").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labels = saved(with_index(counts))
    tree = saved(huffman_tree(labels))
    path = tree.groupBy("label_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "node", "bit"))).alias("path"))  # as deep as the tree
    path = labels.join(path, "label_idx").select("label", F.col("path.node").alias("nodes"), F.col("path.bit").alias("bits"))
    m = labels.count()
    own = docs.where("training").select("key", "label").join(small(path, m), "label")
    rows = saved(own.join(biased, "key").select("hidden", "nodes", "bits"))
    vectors, _ = fit_nodes(rows, max(0, m - 1), wide)
    held = docs.where("not training").join(small(labels.select("label", "label_idx"), m), "label", "left").withColumn("label_idx", F.coalesce("label_idx", F.lit(-1)))
    pairs = held.select("key", "label_idx").distinct()  # rows may share a key
    scored = label_scores(pairs.join(biased, "key"), labels, tree, vectors_table(spark, vectors), wide, docs.count())
    return held.join(scored, ["key", "label_idx"]).select(F.col("key").alias("doc_id"), "label", "p", "best", "p_best", "total")
