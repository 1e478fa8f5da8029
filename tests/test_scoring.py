"""N-gram ids, blocked products, trees and node classifiers against plain versions."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import ngrams
from lexmill.functions import text as T
from lexmill.operators import product, tree_softmax

BUCKETS = 4096
TEXTS = ["the cat  sat", "é日本\tÿ😀 ñ", "", None, " \n ", "a", "ab abc", "x" * 3000, "words and words " * 300, "<a> >b<"]


def plain_fnv(s):
    h = 2166136261
    for b in s.encode():
        h = ((h ^ (b if b < 128 else b + 0xFFFFFF00)) * 16777619) & 0xFFFFFFFF
    return h


def plain_ids(text, minn, maxn, buckets=BUCKETS):
    out = []
    for w in re.findall(r"[^ \t\n\x0b\f\r]+", text or ""):
        w = f"<{w}>"
        out += [plain_fnv(w[i : i + n]) % buckets for i in range(len(w)) for n in range(minn, maxn + 1) if i + n <= len(w)]
    return out


@pytest.mark.parametrize("sizes", [(3, 3), (2, 5), (1, 1)])
def test_ngram_ids_are_in_order_however_texts_are_cut(monkeypatch, sizes):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab é日😀 \n") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    for chunk in (1, 7, 1 << 19):
        monkeypatch.setattr(ngrams, "CHUNK", chunk)
        got = {}
        data, off = ngrams.utf8(pa.array(["skipped", *texts], pa.string()).slice(1))
        for owner, ids in ngrams.ngram_ids(data, off, *sizes, BUCKETS):
            for o, i in zip(owner.tolist(), ids.tolist()):
                got.setdefault(o, []).append(i)
        assert [got.get(k, []) for k in range(len(texts))] == [plain_ids(t, *sizes) for t in texts]


def test_the_hash_is_that_of_the_columns(spark):
    df = spark.createDataFrame([(t,) for t in ("", "abc", "é日😀", "<x>")], "t string")
    assert [r.h for r in df.select(T.fnv1a(F.col("t")).alias("h")).collect()] == [plain_fnv(t) for t in ("", "abc", "é日😀", "<x>")]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def test_ordered_slices_and_sums(spark, docs, monkeypatch):
    want = {r.doc_id: plain_ids(r.text, 2, 4) for r in docs.collect()}
    got = {}
    for r in sorted(ngrams.ordered_features(docs, F.col("doc_id"), F.col("text"), 2, 4, BUCKETS, first=5, slice_ids=100).collect(), key=lambda r: (r.key, r.offset)):
        assert r.offset == len(got.setdefault(r.key, [])) and 0 < len(r.ids) <= 100
        got[r.key] += [i - 5 for i in r.ids]
    assert got == {k: v for k, v in want.items() if v}
    sums = {r.key: (r.n, r.total, r.low, r.high) for r in ngrams.feature_sums(docs, F.col("doc_id"), F.col("text"), 2, 4, BUCKETS).collect()}
    assert sums == {k: (len(v), sum(v), min(v), max(v)) for k, v in want.items() if v}


def test_hidden_means_and_softmax_equal_numpy(spark, docs, monkeypatch):
    monkeypatch.setattr(product, "LABELS", 7)  # several blocks of labels
    monkeypatch.setattr(product, "KEYS", 11)
    width = 21  # two blocks of columns
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(BUCKETS, width))
    table = spark.createDataFrame([(k, weights[k].tolist()) for k in range(BUCKETS)], "id long, vec array<double>")
    features = ngrams.document_features(docs, F.col("doc_id"), F.col("text"), 3, 3, BUCKETS, product.IDS)
    hidden = product.hidden_means(features, table, width, 60).cache()
    got = {r.key: r.hidden for r in hidden.collect()}
    want = {r.doc_id: weights[plain_ids(r.text, 3, 3)].mean(axis=0) for r in docs.collect() if plain_ids(r.text, 3, 3)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(got[k], v, atol=1e-12)
    outputs = rng.normal(size=(30, width))
    outputs[9] = outputs[4]  # a tie
    names = [f"l{k:02d}" for k in range(30)]
    labels = spark.createDataFrame([(n, o.tolist()) for n, o in zip(names, outputs)], "label string, vec array<double>")
    best = {}
    for r in product.softmax_top(hidden, labels, width, 4, 60).collect():
        best.setdefault(r.key, {})[r["rank"]] = r.label, r.p
    for k, v in want.items():
        z = outputs @ v
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        order = sorted(range(30), key=lambda j: (-p[j].round(12), names[j]))[:4]
        assert [best[k][j + 1][0] for j in range(4)] == [names[j] for j in order]
        assert np.allclose([best[k][j + 1][1] for j in range(4)], p[order], atol=1e-9)


def test_ids_without_weights_count_as_zero(spark):
    features = spark.createDataFrame([(1, 0, [1, 5], [2, 3]), (2, 1, [product.IDS], [4])], "key long, part int, ids array<int>, ns array<int>")
    weights = spark.createDataFrame([(1, [10.0])], "id long, vec array<double>")
    got = {r.key: (r.n, r.vec[0]) for r in product.sparse_dense(features, product.in_blocks(weights, 1), 1, 2).collect()}
    assert got == {1: (5, 20.0), 2: (4, 0.0)}


def plain_tree(counts):
    """{label: [(node, bit)]} by one heap; equal weights: joined ones first, then labels from the last."""
    heap = [(n, 1, -k, k) for k, n in counts]
    heapq.heapify(heap)
    above, made = {}, 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        above[a[3]], above[b[3]] = (made, False), (made, True)
        heapq.heappush(heap, (a[0] + b[0], 0, made, ("node", made)))
        made += 1
    out = {}
    for k, _ in counts:
        at, out[k] = k, []
        while at in above:
            node, bit = above[at]
            out[k].append((node, bit))
            at = ("node", node)
    return out


def test_trees_made_in_rounds_are_huffman_trees(spark):
    rng = random.Random(6)
    cases = [[1], [1, 1], [3, 2, 1, 1, 1], [1] * 9, [2**k for k in range(12, -1, -1)], [21, 13, 8, 5, 3, 2, 1, 1], sorted((rng.randint(1, 9) for _ in range(40)), reverse=True)]
    for counts in cases:
        rows = list(enumerate(counts))
        got = {k: [] for k, _ in rows}
        for r in tree_softmax.huffman_tree(spark.createDataFrame(rows, "label_idx int, n long")).orderBy("label_idx", "pos").collect():
            assert r.pos == len(got[r.label_idx])
            got[r.label_idx].append((r.node, r.bit))
        assert got == plain_tree(rows)
    assert tree_softmax.huffman_tree(spark.createDataFrame([], "label_idx int, n long")).count() == 0


def test_labels_are_numbered_by_count_then_name(spark):
    rows = [("b", 3), ("a", 3), ("c", 7), ("d", 1), ("e", 1), ("é", 300)]
    got = sorted(tree_softmax.with_index(spark.createDataFrame(rows, "label string, n long")).collect(), key=lambda r: r.label_idx)
    assert [(r.label, r.label_idx) for r in got] == [("é", 0), ("c", 1), ("a", 2), ("b", 3), ("d", 4), ("e", 5)]


def test_node_classifiers_equal_gradient_descent(spark):
    rng = np.random.default_rng(5)
    n, width, nodes = 300, 3, 4
    x = np.hstack([rng.normal(size=(n, width - 1)), np.ones((n, 1))])
    rows = []
    for k in range(n):
        own = sorted(rng.choice(nodes - 1, size=2, replace=False).tolist())  # the last node has no rows
        rows.append((x[k].tolist(), own, [bool(x[k, 0] + rng.normal() > j - 1) for j in own]))
    vectors, losses = tree_softmax.fit_nodes(spark.createDataFrame(rows, "hidden array<double>, nodes array<int>, bits array<boolean>").repartition(3), nodes, width)
    assert all(a >= b - 1e-9 for a, b in zip(losses, losses[1:]))
    assert not vectors[-1].any()
    for node in range(nodes - 1):
        own = [(np.array(h), b[ns.index(node)]) for h, ns, b in rows if node in ns]
        xs, y = np.array([h for h, _ in own]), np.array([b for _, b in own], float)
        slope = (y - 1 / (1 + np.exp(-xs @ vectors[node]))) @ xs - tree_softmax.RIDGE * vectors[node]
        assert np.abs(slope).max() < 1e-6


def test_path_products_are_probabilities(spark, monkeypatch):
    monkeypatch.setattr(product, "LABELS", 3)
    monkeypatch.setattr(product, "KEYS", 4)
    counts = spark.createDataFrame(list(enumerate([9, 5, 3, 3, 2, 1, 1])), "label_idx int, n long")
    tree = tree_softmax.huffman_tree(counts).cache()
    rng = np.random.default_rng(8)
    vectors, hidden = rng.normal(size=(6, 4)), rng.normal(size=(20, 4))
    table = spark.createDataFrame([(k, h.tolist()) for k, h in enumerate(hidden)], "key long, hidden array<double>")
    got = {(r.key, r.label_idx): r.p for r in tree_softmax.label_probabilities(table, counts, tree, tree_softmax.vectors_table(spark, vectors), 4, 20).collect()}
    paths = plain_tree([(r.label_idx, r.n) for r in counts.collect()])
    for k, h in enumerate(hidden):
        f = 1 / (1 + np.exp(-vectors @ h))
        for label, path in paths.items():
            assert math.isclose(got[k, label], math.prod(f[j] if b else 1 - f[j] for j, b in path), rel_tol=1e-9)
        assert math.isclose(sum(got[k, j] for j in paths), 1, rel_tol=1e-9)


def test_held_out_scores_beat_the_counts(spark):
    from lexmill.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["tree_softmax_scores"](spark, sf).collect()
    assert rows and all(math.isclose(r.total, 1, rel_tol=1e-9) for r in rows)
    docs = {r.doc_id: f"{r.lang}/{r.source}" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {r.doc_id for r in rows}
    counts = Counter(v for k, v in docs.items() if k not in held)
    seen = [r for r in rows if r.p is not None]
    loss = sum(-math.log(r.p) for r in seen) / len(seen)
    prior = sum(-math.log(counts[r.label] / sum(counts.values())) for r in seen) / len(seen)
    assert loss < prior - 0.4


@pytest.mark.parametrize("fits", [True, False])
def test_sums_of_texts_equal_numpy(spark, docs, monkeypatch, fits):
    monkeypatch.setattr(product, "_HELD", 50)  # runs of ids are cut
    monkeypatch.setattr(ngrams, "CHUNK", 97)
    if not fits:
        monkeypatch.setattr(product, "TABLE", 0)
    width = 21
    weights = np.random.default_rng(3).normal(size=(BUCKETS, width))
    some = [(k, weights[k].tolist()) for k in range(0, BUCKETS, 2)]  # the others count as zeros
    weights[1::2] = 0
    table = product.in_blocks(spark.createDataFrame(some, "id long, vec array<double>"), width)
    twice = docs.union(docs.where("doc_id = 6"))
    sums = product.text_sums(twice, F.col("doc_id"), F.col("text"), 3, BUCKETS, table, width)
    assert ("FlatMapCoGroupsInArrow" in sums._jdf.queryExecution().executedPlan().toString()) != fits
    got = {}
    for r in sums.collect():
        got.setdefault(r.key, {})[r.block] = r.n, r.vec
    want = {r.doc_id: plain_ids(r.text, 3, 3) for r in docs.collect()}
    assert got.keys() == {k for k, v in want.items() if v}
    for k, v in got.items():
        times = 2 if k == 6 else 1
        assert [v[b][0] for b in (0, 1)] == [times * len(want[k])] * 2
        assert np.allclose((v[0][1] + v[1][1])[:width], times * weights[want[k]].sum(axis=0), atol=1e-9)


def test_label_counts_are_sent_before_they_are_too_many(spark, docs, monkeypatch):
    labelled = docs.select("text", F.when(F.col("doc_id") % 4 != 3, F.concat(F.lit("l"), F.col("doc_id") % 4)).alias("label")).cache()
    want = Counter()
    for r in labelled.collect():
        want[r.label, None] += 1
        want.update((r.label, i) for i in plain_ids(r.text, 3, 3))
    for held in (1, 2 * BUCKETS, 1 << 22):
        monkeypatch.setattr(ngrams, "HELD", held)
        got = {(r.label, r.id): r.n for r in ngrams.label_features(labelled, F.col("label"), F.col("text"), 3, 3, BUCKETS).collect()}
        assert got == want


def test_rows_of_one_key_get_their_own_labels_score(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"l{k % 3}" if k % 7 else "rare", k % 5 != 0) for k in range(60)] + [(5, "l0", False), (5, "new", False), (10, "l1", False)]
    docs = spark.createDataFrame(rows, "doc_id long, label string, training boolean")
    hidden = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(60)], "key long, hidden array<double>")
    got = [tuple(r) for r in tree_softmax.held_out_scores(docs, hidden, 4).collect()]
    assert sorted(r[:2] for r in got) == sorted((k, x) for k, x, training in rows if not training)
    by_key = {}
    for key, label, p, best, p_best, total in got:
        assert math.isclose(total, 1, rel_tol=1e-9) and (p is None) == (label == "new")
        assert p is None or p <= p_best and (p == p_best or best != label)
        by_key.setdefault(key, set()).add((best, p_best, total))
    assert all(len(v) == 1 for v in by_key.values())


def test_held_out_scores_exchange_no_features_and_no_row_per_label(spark):
    from lexmill.plans.queries import QUERIES

    for name in ("tree_softmax_scores", "lid_predict"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "ns#" not in plan and "arrays_zip" not in plan
