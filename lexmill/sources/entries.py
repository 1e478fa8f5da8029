"""Registry entries of many shapes, read from JSON as VARIANT values instead of one schema for all.

An entry names what it covers in one of several ways: a pair, a list of languages (or one
string of them), separate lists for the two sides, or such lists below `coverage`. Fields
may be absent, null, or of another type in some entries; a field of the wrong kind counts
as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(rows: DataFrame, column: str = "json") -> DataFrame:
    """rows with v, the value of their JSON; null where it isn't JSON."""
    return rows.withColumn("v", F.try_parse_json(column))


def number(path: str) -> Column:
    """A number at a path of v, also if it is written as a string."""
    return F.coalesce(F.try_variant_get("v", path, "double"), F.expr(f"try_cast(try_variant_get(v, '{path}', 'string') as double)"))


def strings(path: str) -> Column:
    """The strings of a list at a path of v, or the words of one string; null if there is neither."""
    one = F.try_variant_get("v", path, "string")
    listed = F.filter(F.try_variant_get("v", path, "array<string>"), lambda x: x.isNotNull())
    return F.coalesce(listed, F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.filter(F.split(one, "[ ,]+"), lambda x: x != "")))


def coverage(entries: DataFrame) -> DataFrame:
    """model_id, side, lang of entries with v: every language of each side, once.

    Of several ways of naming them the first counts: pair, src_languages or tgt_languages,
    coverage, languages; a list of languages alone stands for both sides.
    """
    pair = strings("$.pair")
    pair = F.when(F.size(pair) == 2, pair)
    side = lambda own, nested, at: F.coalesce(F.when(pair.isNotNull(), F.array(F.get(pair, F.lit(at)))), strings(own), strings(nested), strings("$.languages"))
    sides = F.array(
        F.struct(F.lit("source").alias("side"), side("$.src_languages", "$.coverage.src", 0).alias("langs")), F.struct(F.lit("target").alias("side"), side("$.tgt_languages", "$.coverage.tgt", 1).alias("langs"))
    )
    each = entries.select(F.try_variant_get("v", "$.model_id", "string").alias("model_id"), F.explode(sides).alias("s"))
    return each.where("model_id is not null").select("model_id", "s.side", F.explode("s.langs").alias("lang")).distinct()


def shapes(entries: DataFrame) -> DataFrame:
    """key, kind, n: the top-level fields of entries with v, what kinds of value they hold and how often."""
    fields = entries.select("v").lateralJoin(entries.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    named = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").when(kind == "STRING", "string").when(kind == "ARRAY", "list").when(kind == "OBJECT", "object").when(kind == "BOOLEAN", "boolean").otherwise("null")
    return fields.where("key is not null").groupBy("key", named.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def schema(entries: DataFrame) -> str:
    """One schema that all values of v agree with."""
    return entries.agg(F.schema_of_variant_agg("v")).first()[0]
