"""Beam search as rounds of joins: all rows' beams take a step together.

A step model is a table of successors. In each round the open beams meet the successors of
their last token, and a window keeps the best of each row; a beam that has ended
competes on as it is. A row has at most beams * beams candidates, however large the
vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.shared import saved

UNIT = 1_000_000


def successors(pairs: DataFrame, keep: int) -> DataFrame:
    """prev, next, cost (micro-nats) of the `keep` most frequent followers of each token in pairs (prev, next), the first by name among equals."""
    counts = pairs.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("prev")
    ranked = counts.withColumn("all", F.sum("c").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("c"), "next")))
    return ranked.where(F.col("r") <= keep).select("prev", "next", F.round(-F.log(F.col("c") / F.col("all")) * UNIT).cast("long").alias("cost"))


def word_pairs(text: Column, end: str) -> Column:
    """Neighbouring words of a text, the end token after the last, as an array of (prev, next)."""
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.arrays_zip(words.alias("prev"), F.concat(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), F.array(F.lit(end))).alias("next"))


def beam_search(starts: DataFrame, model: DataFrame, beams: int, steps: int, end: str) -> DataFrame:
    """row_id, tokens, cost, rank: the best `beams` sequences of each row of starts (row_id, token), after at most `steps` tokens more.

    model: what successors gives, at least `beams` a token. Less cost is better, of equal
    cost the first by its tokens. Rows whose token the model doesn't know have none; repeated rows count once.
    """
    open_ = starts.where("row_id is not null and token is not null").select("row_id", F.array("token").alias("tokens"), F.lit(0).cast("long").alias("cost")).distinct()
    model = saved(model)
    for _ in range(steps):
        last = F.element_at("tokens", -1)
        live = open_.withColumn("prev", last).where(F.col("prev") != end).join(model, "prev").select("row_id", F.concat("tokens", F.array("next")).alias("tokens"), (open_["cost"] + model["cost"]).alias("cost"))
        both = live.unionByName(open_.where(last == end))
        best = F.row_number().over(Window.partitionBy("row_id").orderBy("cost", "tokens"))
        open_ = saved(both.withColumn("r", best).where(F.col("r") <= beams).drop("r"))
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy("cost", "tokens"))
    return open_.withColumn("rank", rank)
