"""Code fences of Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def code_fences(spark: SparkSession, path: str, language: str = "python") -> DataFrame:
    """path, pos, code, directive (skip, norun or none) of each fence of a language; the directive is an HTML comment on the line before."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    pattern = rf"(?ms)^(?:<!--\s*(skip|norun)\s*-->\n)?```{language}\n(.*?)^```"
    matches = F.regexp_extract_all("value", F.lit(pattern), F.lit(0))
    each = whole.select("path", F.posexplode(matches).alias("pos", "m"))
    return each.select("path", "pos", F.regexp_extract("m", pattern, 2).alias("code"), F.coalesce(F.nullif(F.regexp_extract("m", pattern, 1), F.lit("")), F.lit("none")).alias("directive"))
