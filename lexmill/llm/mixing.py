"""Mixing sources to target weights by Poisson replication.

A document of source s is repeated k times, k the Poisson quantile, at mean rate
(target rows of s) / (rows of s), of a uniform number that a hash of the document and a
seed gives. So counts are reproducible, need no state, and documents are independent of
each other; copies are exploded and put in a global random order by a second hash.
Sources meet their share on average, with a relative error near 1 / sqrt(rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.cluster import numbered

#: A larger rate is drawn as the sum of several equal ones, so that exp(-rate) stays a normal number.
MOST_RATE = 500.0


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None) -> DataFrame:
    """source, rate: mean copies of a document of each source.

    weights gives each source's share of the output (they are scaled to sum to 1; sources
    left out get none); without it shares follow rows ** temperature. total is the number
    of output rows to aim at, by default as many as come in. Null is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        shares = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, w double")
        shares = counts.join(table, "source", "left").fillna({"w": 0.0})
    sums = shares.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()  # one row of totals
    all_w, goal = sums["w"] or 0.0, float(total if total is not None else sums["n"] or 0)
    rate = F.col("w") / F.lit(all_w) * F.lit(goal) / F.col("n") if all_w else F.lit(0.0)
    return shares.select("source", rate.alias("rate"))


_CDF = """aggregate(sequence(1, cast(ceil(rate + 12 * sqrt(rate)) as int) + 30),
    named_struct('p', exp(-rate), 'c', array(exp(-rate))),
    (a, k) -> named_struct('p', a.p * rate / k, 'c', concat(a.c, array(element_at(a.c, -1) + a.p * rate / k))),
    a -> a.c)"""


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 23) -> DataFrame:
    """docs (doc_id, text, source and any others) with every row repeated; adds copies, copy (from 1) and shuffle_key.

    A document is told from others by doc_id and text. Null doc_id or text is as good as any
    value; null source is a source. Repeated rows get the same number of copies. Rows with
    no copy are left out, as their rate has it. Columns named copies, copy or shuffle_key
    are replaced; any other name may occur. An empty table gives no rows. The order of
    shuffle_key is the global order.
    """
    docs = docs.drop("copies", "copy", "shuffle_key")
    whole = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    rates = source_rates(docs, weights, temperature, total).withColumn("parts", F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("int")).withColumn("rate", F.col("rate") / F.col("parts")).select(F.col("source").alias("_source"), "parts", F.expr(_CDF).alias("_cdf"))
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit("-")).cast("binary")))
    uniform = lambda k: F.conv(F.substring(F.md5(k.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    drawn = whole.withColumn("_key", key).join(rates.withColumnRenamed("parts", "_parts"), F.col("source").eqNullSafe(F.col("_source")))
    drawn = drawn.withColumn("_u", F.transform(F.sequence(F.lit(1), "_parts"), lambda j: uniform(F.when(j == 1, F.col("_key")).otherwise(F.concat_ws("#", F.col("_key"), j.cast("string"))))))
    drawn = drawn.withColumn("copies", F.expr("aggregate(_u, 0, (s, u) -> s + size(filter(_cdf, c -> c <= u)))")).where("copies > 0")
    out = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("row.*", "copies", "copy", F.md5(F.concat_ws("|", "_key", F.col("copy").cast("string")).cast("binary")).alias("shuffle_key"))


def shuffled(mixed: DataFrame, parts: int) -> DataFrame:
    """The rows in the global order: dealt by ranges of shuffle_key, and sorted in each."""
    cut = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(parts) / F.lit(1 << 32)).cast("int")
    return mixed.repartition(parts, cut).sortWithinPartitions("shuffle_key")


def mix_table(docs: DataFrame, seed: int = 23) -> DataFrame:
    """doc_id, source, copies, copy, shuffle_key and position (from 0 without gaps in the order of shuffle_key)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    mixed = poisson_mix(narrow, seed=seed).drop("text")
    ranges = max(8, docs.count() // 50_000)
    cut = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * F.lit(ranges) / F.lit(1 << 32)).cast("int")
    out = numbered(mixed.withColumn("_all", F.lit(0)).withColumn("_cut", cut), "_all", "_cut", ["shuffle_key", "doc_id"], "position")
    return out.select("doc_id", "source", F.col("copies").cast("long").alias("copies"), F.col("copy").cast("long").alias("copy"), "shuffle_key", F.col("position").cast("long").alias("position"))
