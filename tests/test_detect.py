"""Training over whole texts, and held-out documents that the guards turn away."""

import hashlib
from collections import Counter

from lexmill.plans.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _side(training, stem):
    """A text that starts with stem and falls on that side."""
    k = 0
    while (int(hashlib.md5(f"{stem} {k}".encode()).hexdigest()[:2], 16) % 5 != 0) != training:
        k += 1
    return f"{stem} {k}"


def test_long_texts_are_trained_on_and_refused_ones_are_returned(spark, tmp_path):
    train = [("en", _side(True, "the cat sat on the mat")), ("en", _side(True, "many words " * 600)), ("gl", _side(True, "o gato na casa")), ("gl", _side(True, "x" * 10_001)), ("gl", " ")]
    held = [("en", _side(False, "the mat"), "OK"), ("gl", _side(False, "words " * 1025), "TOO_MANY_TOKENS"), ("en", _side(False, "y" * 10_001), "TOO_MANY_CHARS"), ("gl", None, "EMPTY_INPUT")]
    rows = [(k, t, lang, "s", len(t or "")) for k, (lang, t, *_) in enumerate(train + held)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()

    # a token in its two marks has as many trigrams as letters
    want = {lang: (2, sum(len(w) for x, t in train if x == lang for w in t.split())) for lang in ("en", "gl")}
    assert {r.lang: (r.n_docs, r.total) for r in run("lid_train")} == want
    # the blank text is held out if its hash says so, else it is not trained on
    blank = [(4, "EMPTY_INPUT")] if int(hashlib.md5(b" ").hexdigest()[:2], 16) % 5 == 0 else []
    status = sorted([*blank, *((5 + k, s) for k, (*_, s) in enumerate(held))])
    found = run("lid_predict")
    assert sorted((r.doc_id, r.status) for r in found) == status
    assert all((r.predicted is None) == (r.score is None) == (r.status != "OK") for r in found)
    assert {(r.doc_id, r.status) for r in run("lid_probs_topk")} == set(status)
    langs = {k: r[2] for k, r in enumerate(rows)}
    confusion = Counter()
    for r in run("lid_confusion"):
        confusion[r.lang, r.status] += r.n
    assert confusion == Counter((langs[i], s) for i, s in status)
    (r,) = run("lid_accuracy_by_source")
    assert (r.n, r.refused) == (1, len(status) - 1)


def test_ties_go_to_the_first_name(spark):
    from lexmill.operators.detect import predict

    rows = [(1, "zh-Hant", 5), (1, "zh", 5), (2, "eng", 3), (2, "en", 3), (2, "a", 1), (3, "é", 2), (3, "z", 2)]
    got = {r.doc_id: (r.predicted, r.score) for r in predict(spark.createDataFrame(rows, "doc_id long, lang string, score long")).collect()}
    assert got == {1: ("zh", 5), 2: ("en", 3), 3: ("z", 2)}


def test_without_training_texts_only_refused_ones_are_returned(spark, tmp_path):
    rows = [(1, _side(False, "the mat"), "en", "s", 1), (2, None, "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["lid_predict"](spark, str(tmp_path)).collect()] == [(2, None, None, "EMPTY_INPUT")]
