"""Recency of models in caches, for caches of every size at once.

A least-recently-used cache of k models holds a model that is asked for just if fewer than k
others were used since its last use. That distance is found by windows: of every model of a cache
its last use so far, then how many of these lie after the model's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recency(log: DataFrame) -> DataFrame:
    """cache, seq, model_id, distance of log (cache, seq, model_id): other models used since the last use of this one, null for a first use.

    seq orders the accesses of a cache and is unique in it. Work grows with the accesses
    times the distinct models of their cache. Accesses without a cache, seq or model are left out.
    """
    log = log.where("cache is not null and seq is not null and model_id is not null").select("cache", "seq", "model_id")
    before = F.lag("seq").over(Window.partitionBy("cache", "model_id").orderBy("seq"))
    asked = log.withColumn("before", before)
    models = log.select("cache", F.col("model_id").alias("other")).distinct()
    each = asked.join(models, "cache")
    # the last use of each model up to an access, its own set aside
    used = F.max(F.when(F.col("model_id") == F.col("other"), F.col("seq"))).over(Window.partitionBy("cache", "other").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    since = F.col("other").isNotNull() & (F.col("other") != F.col("model_id")) & (F.col("used") > F.col("before"))
    per = each.withColumn("used", used).groupBy("cache", "seq", "model_id", "before").agg(F.sum(since.cast("int")).cast("long").alias("n"))
    return per.select("cache", "seq", "model_id", F.when(F.col("before").isNotNull(), F.coalesce("n", F.lit(0))).alias("distance"))


def hits(found: DataFrame, max_models: int) -> DataFrame:
    """found (distance) with hit: whether a cache of max_models models would have held the model."""
    return found.withColumn("hit", F.coalesce(F.col("distance") < max_models, F.lit(False)))
