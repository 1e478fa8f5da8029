"""Digests of ordered ids without an exchange."""

import hashlib

from pyspark.sql import functions as F

from lexmill.functions import ngrams
from lexmill.plans.queries import QUERIES


def test_digests_are_those_of_the_slices_put_together(spark):
    rows = [(1, "one two"), (2, None), (3, "word " * 9000), (4, ""), (5, "é 日本 x"), (6, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {}
    for r in sorted(ngrams.ordered_features(docs, F.col("doc_id"), F.col("text"), 2, 5, 1 << 16).collect(), key=lambda r: (r.key, r.offset)):
        ids.setdefault(r.key, []).extend(r.ids)
    got = {r.key: (r.n_ids, r.h) for r in ngrams.ordered_digests(docs, F.col("doc_id"), F.col("text"), 2, 5, 1 << 16).collect()}
    assert got == {k: (len(v), hashlib.md5(" ".join(map(str, v)).encode()).hexdigest()) for k, v in ids.items()}
    assert len(ids[3]) > 1 << 16


def test_texts_are_not_exchanged(spark):
    plan = QUERIES["ordered_feature_ids"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_rows_of_one_id_share_a_digest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (2, "d")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_ids for r in QUERIES["ordered_feature_ids"](spark, str(tmp_path)).collect()}
    parts = {r.key: r.n for r in ngrams.feature_sums(docs, F.col("doc_id"), F.col("text"), 2, 5, 1 << 16).collect()}
    assert got == parts


def test_sums_of_known_words_are_those_of_the_words_one_by_one(spark):
    from lexmill.operators import detect

    texts = ["one two one", "</s>", "one </s>\ttwo</s> x</s>y </s></s>", "</s> </s> é", None, " \n", "</s>\n</s>two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for known in (["one", "two"], ["</s>", "one"]):
        vocabulary = spark.createDataFrame([(w, i) for i, w in enumerate(known)], "word string, word_id int")
        words = docs.select("doc_id", F.explode(detect.words_of(F.col("text"))).alias("token"))
        per = {r.token: r for r in detect.word_features(words, vocabulary, 1000, 64).collect()}
        want = {}
        for r in words.collect():
            a = want.setdefault(r.doc_id, [0, 0, 0])
            for i, x in enumerate((int(per[r.token].known), len(per[r.token].ids), sum(per[r.token].ids))):
                a[i] += x
        made = detect.known_word_sums(docs, F.col("doc_id"), F.col("text"), vocabulary, 1000, 64)
        assert {r.key: [r.n_known, r.n_ids, r.id_sum] for r in made.collect()} == want
