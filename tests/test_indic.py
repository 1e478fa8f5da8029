"""Placeholders by a plain loop, and trees against plain Huffman coding."""

import heapq
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import indic as I
from lexmill.operators.detect import tree_faults, word_features
from lexmill.operators.tree_softmax import huffman_tree


def wrap(text):
    entities = []
    for kind, pattern in I.ORDER:
        for match in dict.fromkeys(m.group() for m in re.finditer(pattern.removeprefix("(?U)"), text)):
            if kind in I.UNCOUNTED and len(re.sub(I.UNCOUNTED[kind], "", match)) < 4:
                continue
            entities.append(match)
            text = text.replace(match, f"<ID{len(entities)}>")
    return re.sub(r"\s+", " ", text).replace(">/", ">").replace("]/", "]"), entities


TEXTS = ["mail a.b@c.org now", "see https://example.org/x?y=1 and www.site.net", "on 12/05/2020 or 1,234.5 %", "#tag and @me", "a@b.co a@b.co 1.5", "", "nothing  here\n", "1.2.3.4 x.y"]


@pytest.mark.parametrize("text", TEXTS)
def test_wrapping(spark, text):
    row = spark.createDataFrame([(text,)], "s string").select(I.wrap_placeholders(F.col("s")).alias("w")).first()["w"]
    assert (row.text, row.entities) == wrap(text)


def test_restoring_knows_all_spellings(spark):
    rows = [(s.replace("@", "2") + " and <ID1>", ["one", "two"], "two and one") for s in I.SPELLINGS] + [("plain", [], "plain"), (None, ["a"], None)]
    out = spark.createDataFrame(rows, "s string, e array<string>, want string").select(I.restore_placeholders(F.col("s"), F.col("e")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in out)


@pytest.mark.parametrize("counts", [[5], [3, 2], [9, 5, 4, 2, 1, 1], [1] * 7, [100, 50, 50, 25, 25, 3]])
def test_tree_is_optimal_and_sound(spark, counts):
    df = spark.createDataFrame(list(enumerate(counts)), "label_idx int, n long")
    tree = huffman_tree(df).collect()
    depth = {k: sum(r.label_idx == k for r in tree) for k in range(len(counts))}
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert sum(n * depth[k] for k, n in enumerate(counts)) == cost
    codes = {tuple(r.bit for r in sorted((r for r in tree if r.label_idx == k), key=lambda r: -r.pos)) for k in depth}
    assert len(codes) == len(counts) and all(a == b or a != b[: len(a)] for a in codes for b in codes)
    assert tree_faults(huffman_tree(df), len(counts)).collect() == []


def test_known_words(spark):
    words = spark.createDataFrame([("ab",), ("cd",), ("</s>",), ("ab",)], "token string")
    vocabulary = spark.createDataFrame([("ab", 3), ("</s>", 0)], "word string, word_id long")
    got = {r.token: (r.known, len(r.ids), list(r.ids[:1])) for r in word_features(words, vocabulary, 10, 100).collect()}
    assert got["ab"] == (True, 1 + 6, [3]) and got["</s>"] == (True, 1, [0]) and got["cd"][:2] == (False, 6)
    assert {r.token: list(r.ids) for r in word_features(words, vocabulary, 10, 100, maxn=0).collect()} == {"ab": [3], "cd": [], "</s>": [0]}
