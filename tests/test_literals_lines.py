"""Literals and lines against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.operators import lines, literals

ROWS = "doc_id long, text string, matches int, pieces string, row int"


def plain_split(text, table):
    pattern = re.compile("|".join(re.escape(x) for x in sorted(table, key=len, reverse=True)))
    out, at = [], 0
    for m in pattern.finditer(text or ""):
        if m.start() > at:
            out.append((text[at : m.start()], None))
        out.append((m.group(), table[m.group()]))
        at = m.end()
    return out + ([(text[at:], None)] if text and at < len(text) else [])


@pytest.mark.parametrize("lot", [4 << 20, 300])
def test_texts_are_split_as_by_the_longest_alternative(spark, monkeypatch, lot):
    monkeypatch.setattr(literals, "LOT_CHARS", lot)
    rng = random.Random(lot)
    table = {}
    while len(table) < 1500:  # overlaps, prefixes of each other, one inside another
        table.setdefault("".join(rng.choice("abé😀 .*") for _ in range(rng.randint(1, 6))), len(table))
    table = dict(list(table.items())[: 1500 if lot > 300 else 40])
    texts = ["".join(rng.choice("abé😀 .*xyz") for _ in range(rng.randint(0, 80))) for _ in range(150)] + ["", None, "abab" * 5000]
    docs = spark.createDataFrame([(k, t, 1, "p", 2) for k, t in enumerate(texts)] + [(0, texts[0], 1, "p", 2)], ROWS).repartition(3)
    rows = [(x, k) for x, k in table.items()] + [("", 7), (None, 8), ("ab", None)] + [(x, k + 5000) for x, k in list(table.items())[:9]]
    found = literals.split_at_literals(docs, spark.createDataFrame(rows, "literal string, id long").repartition(4))
    assert found.columns == ["doc_id", "text", "row", "pieces"]
    for r in found.collect():
        assert [tuple(p) for p in r.pieces] == plain_split(texts[r.doc_id], table)
    assert found.count() == len(texts) + 1


def test_no_literals_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "ab c")], "doc_id long, text string")
    none = spark.createDataFrame([], "literal string, id long")
    assert [tuple(p) for p in literals.split_at_literals(docs, none).first().pieces] == [("ab c", None)]
    assert literals.split_at_literals(docs.limit(0), none).count() == 0


def test_added_token_lists(spark):
    rows = [("<pad>", 1, True), ("<pad>", 2, False), ("__gl__", 3, True), ("__gl__", 9, True), ("x", None, True), (None, 4, True), ("<s>", 5, None), ("▁", 6, False), ("", 7, True)]
    got = {tuple(r) for r in literals.literals_of(spark.createDataFrame(rows, "content string, id long, special boolean")).collect()}
    assert got == {("<pad>", 2), ("__gl__", 9), ("▁", 6)}


def test_lines_are_mapped_once_and_come_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(lines, "SLICE", 4)
    monkeypatch.setattr(lines, "HOT", 5)
    rng = random.Random(3)
    pool = ["one", "two ", " three", "", " ", "​", "é 日", "same line", "\r", "drop me"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["", None, "\n", "\n\n\n", "same line", "lone"]
    docs = spark.createDataFrame([(k, t, 1, "p", 2) for k, t in enumerate(texts)] + [(0, texts[0], 1, "p", 2)] * 2, ROWS).repartition(4)
    calls = spark.sparkContext.accumulator(0)

    def rule(batches):
        import pyarrow as pa

        for batch in batches:
            calls.add(batch.num_rows)
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"line": own, "out": pa.array([None if x == "drop me" else f"<{x}>" for x in own], pa.string())})

    got = lines.map_lines(docs, lambda t: t.mapInArrow(rule, "line string, out string")).collect()
    shown = re.compile("[^\\s​]")
    want = lambda t: None if t is None else "\n".join(f"<{x}>" if shown.search(x) and x != "drop me" else x for x in t.split("\n"))
    assert sorted((r.doc_id, r.mapped or "") for r in got) == sorted((r.doc_id, want(r.text) or "") for r in got)
    assert len(got) == len(texts) + 2 and all((r.mapped is None) == (r.text is None) for r in got)
    assert calls.value == len({x for t in texts if t for x in t.split("\n") if shown.search(x)})


def test_rules_of_columns_exchange_nothing(spark):
    from lexmill.plans.queries import QUERIES

    assert "Exchange" not in QUERIES["line_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    texts = ["one\n\n \nee  e ", "", None, "\n", "​\ntwo", "drop\nkept", "e\r\né"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rule = lambda c: F.when(c != "drop", F.concat(F.trim(F.replace(c, F.lit("e"), F.lit("3"))), F.lit(".")))
    here, there = ({r.doc_id: r.mapped for r in lines.map_lines(docs, f(rule)).collect()} for f in (lines.in_place, lines.by_column))
    assert here == there and len(here) == len(texts)


def test_each_distinct_line_travels_once(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (2, "b")], "doc_id long, text string")
    plan = lines.map_lines(docs, lines.by_column(lambda c: F.concat(c, c)))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2(" in plan  # places travel with a digest in place of their line
