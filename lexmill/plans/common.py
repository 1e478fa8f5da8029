"""How queries are registered, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.plans.derived import values_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *tables: str):
    """Registers a query under its own name; the SQL may use the named registry tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = values_sql(*tables) if tables else ""
            body = sql.strip()
            if head and body.upper().startswith("WITH "):
                body = ", " + body[5:]
            ORACLES[f.__name__] = f"{head}\n{body}"
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(template: str, *values) -> str:
    """The SQL template with @0, @1, ... filled in."""
    for k, v in enumerate(values):
        template = template.replace(f"@{k}", str(v))
    return template


BLANK = "".join(f"\\x{{{c:x}}}" for c in [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
INVISIBLE = "\\x{200B}-\\x{200F}\\x{2028}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}"
SEEN = f"coalesce(regexp_matches(regexp_replace(@0, '[{INVISIBLE}]', '', 'g'), '[^{BLANK}]'), false)"
TOKENS = "list_filter(regexp_split_to_array(@0, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
STATUS = f"case when not {SEEN} then 'EMPTY_INPUT' when length(@0) > 10000 then 'TOO_MANY_CHARS' when len({TOKENS}) > 1024 then 'TOO_MANY_TOKENS' else 'OK' end"
BYTES = "list_transform(range(1, octet_length(encode(@0)) + 1), lambda i: ('0x' || substr(hex(encode(@0)), (2 * i - 1)::int, 2))::bigint)"
FNV = f"list_reduce(list_prepend(2166136261::bigint, {BYTES}), lambda h, b: ((xor(h, case when b >= 128 then b + 4294967040 else b end) * 16777619) & 4294967295)::bigint)"
GRAMS = "flatten(list_transform(range(1, length(@0) + 1), lambda i: list_transform(list_filter(range(@1, @2 + 1), lambda n: i + n - 1 <= length(@0)), lambda n: substr(@0, i::int, n::int))))"
