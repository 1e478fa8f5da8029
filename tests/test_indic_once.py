"""Placeholders are wrapped once, and punctuation rules run where their sign is."""

import random

from pyspark.sql import functions as F

from lexmill.functions import indic as I


def test_each_kind_is_looked_for_once(spark):
    df = spark.createDataFrame([("x",)], "s string")
    plan = df.select(I.wrap_placeholders(F.col("s")).alias("w"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(") == len(I.ORDER)


def test_rules_with_signs_equal_the_plain_chain(spark):
    rng = random.Random(5)
    signs = ["\r", "(", ")", ":", ";", "`", "´", "‘", "‚", "’", "„", "“", "«", "»", "–", "—", "%", "?", "!", ",", ".", '"', " ", " ", "  ", "1", "٣", "a", "\n", " ", "nº ", "ºC", "..."]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randrange(14)))) for i in range(3000)] + [(3000, None), (3001, "")]
    df = spark.createDataFrame(rows, "i int, s string")
    plain = F.col("s")
    for pattern, replacement in I.PUNCTUATION:
        plain = F.regexp_replace(plain, pattern, replacement)
    plain = F.regexp_replace(plain, f"^{I.S}+|{I.S}+$", "")
    made = df.select("i", I.normalize_punctuation(F.col("s")).alias("a"), plain.alias("b"))
    assert made.where("not a <=> b").collect() == []
    assert made.where("a is null").count() == 1
