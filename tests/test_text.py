import random

import pytest
from pyspark.sql import functions as F

from lexmill.functions import labels as L
from lexmill.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = ((h ^ (b | 0xFFFFFF00 if b >= 128 else b)) * 16777619) & 0xFFFFFFFF
    return h


@pytest.mark.parametrize("word", ["a", "abc", "é", "日本", "😀x", "Straße"])
def test_fnv(spark, word):
    assert one(spark, T.fnv1a(F.col("s")), s=word) == fnv(word.encode())


def test_subwords_by_start_then_length(spark):
    assert one(spark, T.subwords(F.col("s"), 2, 3), s="ab") == ["<a", "<ab", "ab", "ab>", "b>"]


@pytest.mark.parametrize("text,seen", [("", False), (" \n\t", False), ("​", False), ("​ ⁠", False), ("\x1c\x1d", False), (" ", False), ("a", True), ("​x", True)])
def test_visible(spark, text, seen):
    assert one(spark, T.has_visible_content(F.col("s")), s=text) is seen


def test_guards_allow_their_limits(spark):
    rows = [("x" * 10_000,), ("x" * 10_001,), ("a " * 1024,), ("a " * 1025,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, ["s"]).select(T.guard_status(F.col("s"))).collect()]
    assert got == ["OK", "TOO_MANY_CHARS", "OK", "TOO_MANY_TOKENS", "EMPTY_INPUT"]


def test_tokens_keep_no_break_spaces(spark):
    assert one(spark, T.tokens(F.col("s")), s="a b  c\n") == ["a b", "c", "</s>"]


@pytest.mark.parametrize("line,parts", [("One. Two.", ["One.", "Two."]), ("1. First item", ["1. First item"]), ("Dr. Smith came. He left.", ["Dr. Smith came.", "He left."]), ("e.g. this one", ["e.g. this one"]), ("日本。語", ["日本。", "語"]), ("", [""])])
def test_sentences(spark, line, parts):
    assert [p["sentence"] for p in one(spark, T.split_sentences(F.col("s")), s=line)] == parts


def test_sentences_join_back(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("aB. !?\n”)。 1") for _ in range(30)) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in [*lines, None]], "s string").withColumn("p", T.split_sentences(F.col("s")))
    assert [r["p"] for r in df.where("s is null").collect()] == [None]
    assert all("".join(p["sentence"] + p["gap"] for p in r["p"]) == r["s"] for r in df.where("s is not null").collect())
    # an inner sentence ends with a stop and closing signs, has a letter, and white space or an unspaced stop after it
    for r in df.where("s is not null").collect():
        for p in r["p"][:-1]:
            assert any(map(str.isalpha, p["sentence"])) and p["sentence"].rstrip("”)")[-1] in ".!?。" and (p["gap"] or "。" in p["sentence"])


@pytest.mark.parametrize("text,left", [("un@@ do @@ ne", "undo ne"), ("ab@ cd", "abcd"), ("x@\u00a0\u2003y", "xy"), ("plain", "plain")])
def test_markers(spark, text, left):
    assert one(spark, T.drop_bpe_markers(F.col("s")), s=text) == left


@pytest.mark.parametrize("text,plain", [("nbsp;a", "a"), ("anBsp;b", "anBsp;b"), ("anbsp;b", "a b"), ("« oui »", '" oui "'), ("(a ) ,", "(a),"), ('"x", y', '"x," y')])
def test_punctuation(spark, text, plain):
    assert one(spark, T.normalize_punctuation(F.col("s")), s=text) == plain


@pytest.mark.parametrize("label,tag", [("eng_Latn", "en"), ("__label__pt", "pt"), ("arb_Arab", "ar"), ("zho_Hans", "zh-Hans"), ("srp_Cyrl", "sr-Cyrl"), ("ell_Latn", "el-Latn"), ("nan_lang", "und"), ("ajp_Arab", "ajp"), ("xyz_Latn", "xyz")])
def test_tags(spark, label, tag):
    assert one(spark, L.to_tag(F.col("s")), s=label) == tag


@pytest.mark.parametrize("tag,macro", [("ajp-Arab", "ar"), ("yue-Hani", "zh-Hani"), ("cmn-Hans", "zh-Hans"), ("pt", "pt")])
def test_varieties(spark, tag, macro):
    assert one(spark, L.collapse_variety(F.col("s")), s=tag) == macro


def test_repeat_bans_match_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [([rng.randint(1, 4) for _ in range(rng.randint(3, 12))],) for _ in range(60)]
    for n in (2, 3):
        got = spark.createDataFrame(rows, "ids array<int>").select("ids", T.repeated_ngram_bans(F.col("ids"), n)).collect()
        for ids, bans in got:
            tail = ids[len(ids) - n + 1 :]
            assert bans == sorted({ids[i + n - 1] for i in range(len(ids) - n + 1) if ids[i : i + n - 1] == tail})
