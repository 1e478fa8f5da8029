"""Small dimension tables as literals, behind a check of their size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_rows(df: DataFrame, bound: int = 10_000) -> Column:
    """The rows of a small table as an array of structs; more than `bound` rows are an error."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} rows; join this table instead")
    kind = "array<" + df.schema.simpleString() + ">"
    if not rows:
        return F.array().cast(kind)
    return F.array(*[F.struct(*[F.lit(v).alias(f.name) for v, f in zip(r, df.schema, strict=True)]) for r in rows]).cast(kind)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then names it; a bare Column is copied to each place."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
