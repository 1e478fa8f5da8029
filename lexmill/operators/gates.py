"""Gates: rows are judged by named rules in one pass, kept and quarantined rows are written side by side, counts come with them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lexmill.operators.shared import scratch


@dataclass
class Gated:
    """kept: rows as they came; quarantined: rows with reasons; counts: rows, kept, and how many rows each rule turned away."""

    kept: DataFrame
    quarantined: DataFrame
    counts: dict[str, int]


def judged(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(row, reasons): the names of the rules that turn a row away, in their order; a rule that is null doesn't."""
    return rows.select(F.struct("*").alias("row"), F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])).cast("array<string>").alias("reasons"))


def gate(rows: DataFrame, rules: dict[str, Column], path: str | None = None) -> Gated:
    """Splits rows by rules (name: what turns a row away) with one scan of them, into a folder that keeps both sides.

    Columns of any name may occur. An empty table gives two empty sides and counts of 0.
    """
    path = path or scratch(rows.sparkSession, "gate")
    told, seen = judged(rows, rules), Observation(f"gate-{uuid.uuid4().hex}")
    open_ = F.size("reasons") == 0
    each = [F.coalesce(F.sum(F.array_contains("reasons", name).cast("long")), F.lit(0)).alias(f"rule_{k}") for k, name in enumerate(rules)]
    told.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(open_.cast("long")), F.lit(0)).alias("kept"), *each).withColumn("open", open_).write.partitionBy("open").parquet(path)
    found = seen.get
    counts = {"rows": found["rows"], "kept": found["kept"]} | {name: found[f"rule_{k}"] for k, name in enumerate(rules)}
    both = rows.sparkSession.read.schema(told.withColumn("open", open_).schema).parquet(path)
    return Gated(both.where("open").select("row.*"), both.where("not open").select("row.*", "reasons"), counts)
