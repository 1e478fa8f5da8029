"""Measured-quality and language flags of a model registry.

entries: model_id, precision, chrf (null: not measured), corpus, n, and others. flags:
model_id, lang, reason, side. What holds for one precision of a model holds for the other
(ids differ by the suffix -int8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR, GAP = 40.0, 2.0


def twin_id(model_id: Column) -> Column:
    return F.when(model_id.endswith("-int8"), F.regexp_replace(model_id, "-int8$", "")).otherwise(F.concat(model_id, F.lit("-int8")))


def quality_flags(entries: DataFrame) -> DataFrame:
    """model_id, reasons (array), flagged: below the floor by its own measure or else its twin's; int8 too far behind its twin."""
    twin = entries.select(F.col("model_id").alias("t"), F.col("chrf").alias("t_chrf"), F.col("precision").alias("t_precision"), F.col("corpus").alias("t_corpus"), F.col("n").alias("t_n"))
    both = entries.join(twin, twin_id(entries.model_id) == twin.t, "left")
    own = F.col("chrf").isNotNull()
    used = lambda c: F.when(own, F.col(c)).otherwise(F.col(f"t_{c}"))
    one = lambda c: F.format_string("%.1f", c)
    build = F.when(own, "").otherwise(F.concat(F.lit(" of the "), F.coalesce("t_precision", F.lit("None")), F.lit(" build")))
    low = F.when(
        used("chrf") < FLOOR,
        F.concat(F.lit("chrF-vs-reference "), one(used("chrf")), build, F.lit(f" is below the {FLOOR:.0f} floor ("), F.coalesce(used("corpus"), F.lit("unknown corpus")), F.lit(", n="), F.coalesce(used("n").cast("string"), F.lit("?")), F.lit(")")),
    )
    gap = F.col("t_chrf") - F.col("chrf")
    behind = F.when(
        own & (F.col("precision") == "int8") & (gap > GAP),
        F.concat(F.lit("int8 chrF-vs-reference "), one(F.col("chrf")), F.lit(" trails fp32's "), one(F.col("t_chrf")), F.lit(" by "), one(gap), F.lit(f", over the {GAP:.1f} threshold")),
    )
    reasons = F.array_compact(F.array(low, behind))
    return both.select("model_id", reasons.alias("reasons"), (F.size(reasons) > 0).alias("flagged"))


def language_flags(entries: DataFrame, flags: DataFrame, side: str = "target") -> DataFrame:
    """model_id, lang, reason for each entry and flagged language, its own flag before its twin's; a flag without a side is on the target's."""
    if side not in ("target", "source", "both"):
        raise ValueError("side must be target, source or both")
    told = flags.where(F.coalesce("side", F.lit("target")).isin(side, "both")).select(F.col("model_id").alias("of"), "lang", F.coalesce(F.nullif("reason", F.lit("")), F.lit("flagged, no reason recorded")).alias("reason"))
    asked = entries.select("model_id", F.explode(F.array(F.struct(F.col("model_id").alias("of"), F.lit(0).alias("turn")), F.struct(twin_id(F.col("model_id")).alias("of"), F.lit(1).alias("turn")))).alias("a")).select("model_id", "a.of", "a.turn")
    return asked.join(told, "of").groupBy("model_id", "lang").agg(F.min_by("reason", "turn").alias("reason"))


def target_languages(entries: DataFrame) -> DataFrame:
    """model_id, lang: what each model can write: its pair's second language, else its target languages, else its languages."""
    return entries.select("model_id", F.explode(F.coalesce(F.when(F.col("pair").isNotNull(), F.array(F.element_at("pair", 2))), "tgt_languages", "languages")).alias("lang"))


def all_flagged_targets(entries: DataFrame, flags: DataFrame) -> DataFrame:
    """lang, reasons: languages for which every model that can write them is flagged."""
    found = language_flags(entries, flags).withColumnRenamed("reason", "why")
    told = target_languages(entries).join(found, ["model_id", "lang"], "left")
    return told.groupBy("lang").agg(F.every(F.col("why").isNotNull()).alias("all"), F.array_sort(F.collect_list(F.concat("model_id", F.lit(": "), "why"))).alias("reasons")).where("all").select("lang", "reasons")


def selection(entries: DataFrame, flagged: DataFrame, precision: str | None = None, include_noncommercial: bool = True, exclude_flagged: bool = False, min_chrf: float | None = None, models: list[str] | None = None) -> DataFrame:
    """model_id, left_out: the first filter that drops a model, null if it stays. Named models override every filter; an unmeasured score never drops one."""
    if models is not None:
        return entries.select("model_id", F.when(~F.col("model_id").isin(models), "not named").alias("left_out"))
    both = entries.drop("flagged").join(flagged.select("model_id", "flagged"), "model_id", "left")
    out = F.when(F.lit(not include_noncommercial) & (F.col("license_tier") == "non-commercial"), "licence")
    if precision is not None:
        out = out.when(F.col("precision").isNotNull() & (F.col("precision") != precision), "precision")
    out = out.when(F.lit(exclude_flagged) & F.col("flagged"), "flagged")
    if min_chrf is not None:
        out = out.when(F.col("chrf") < min_chrf, "min_chrf")
    return both.select("model_id", out.alias("left_out"))
