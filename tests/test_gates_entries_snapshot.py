"""Gates, entries of many shapes, snapshots."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lexmill.operators import gates
from lexmill.sources import entries, snapshot


def test_gates_split_in_one_pass_and_count(spark, tmp_path):
    rows = [(k, None if k % 5 == 0 else k, "x") for k in range(100)]
    df = spark.createDataFrame(rows, "id long, v long, reasons string").repartition(3)
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    found = gates.gate(df.mapInArrow(counted, df.schema), {"odd": F.col("v") % 2 == 1, "high": F.col("id") > 90, "never": F.lit(False)}, str(tmp_path / "g"))
    odd, high = {k for k in range(100) if k % 5 and k % 2}, set(range(91, 100))
    assert scans.value == 100
    assert found.counts == {"rows": 100, "kept": 100 - len(odd | high), "odd": len(odd), "high": len(high), "never": 0}
    assert sorted(tuple(r) for r in found.kept.collect()) == [r for r in rows if r[0] not in odd | high]
    assert {r[0]: r[3] for r in found.quarantined.collect()} == {k: ["odd"] * (k in odd) + ["high"] * (k in high) for k in odd | high}
    empty = gates.gate(df.limit(0), {"odd": F.col("v") % 2 == 1})
    assert empty.counts == {"rows": 0, "kept": 0, "odd": 0} and empty.kept.count() == empty.quarantined.count() == 0


SHAPES = [
    {"model_id": "pair", "pair": ["a", "b"], "languages": ["x"]},
    {"model_id": "list", "languages": ["a", "b", "a", None]},
    {"model_id": "words", "languages": "a b, c"},
    {"model_id": "sides", "src_languages": ["a"], "languages": ["b", "c"]},
    {"model_id": "nested", "coverage": {"src": ["a"], "tgt": None}, "languages": ["z"]},
    {"model_id": "odd", "pair": ["a"], "languages": 7},
    {"model_id": "none"},
    {"pair": ["no", "name"]},
    {"model_id": 5, "pair": ["a", "b", "c"], "languages": []},
]


def test_entries_of_many_shapes(spark):
    texts = [json.dumps(x) for x in SHAPES] + ["not json", None, "[1]", '"text"', ""]
    rows = entries.parsed(spark.createDataFrame([(t,) for t in texts], "json string").repartition(2))
    both = lambda m, *langs: {(m, s, x) for s in ("source", "target") for x in langs}
    want = {("pair", "source", "a"), ("pair", "target", "b"), ("sides", "source", "a"), ("sides", "target", "b"), ("sides", "target", "c"), ("nested", "source", "a"), ("nested", "target", "z")}
    want |= both("list", "a", "b") | both("words", "a", "b", "c")
    got = [tuple(r) for r in entries.coverage(rows).collect()]
    assert len(got) == len(set(got)) and {r for r in got if r[0] != "5"} == want
    shapes = {(r.key, r.kind): r.n for r in entries.shapes(rows).collect()}
    assert shapes == {("model_id", "string"): 7, ("model_id", "number"): 1, ("pair", "list"): 4, ("languages", "list"): 5, ("languages", "string"): 1, ("languages", "number"): 1, ("src_languages", "list"): 1, ("coverage", "object"): 1}
    numbers = spark.createDataFrame([('{"n": 3}',), ('{"n": "4.5"}',), ('{"n": 2.25}',), ('{"n": "x"}',), ('{"n": null}',), ("{}",), ('{"n": [1]}',)], "json string")
    assert [r.n for r in entries.parsed(numbers).select(entries.number("$.n").alias("n")).collect()] == [3.0, 4.5, 2.25, None, None, None, None]
    assert "OBJECT" in entries.schema(entries.parsed(spark.createDataFrame([(json.dumps(x),) for x in SHAPES], "json string")))


SCHEMA = "doc_id long, lang string, text string"


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(snapshot.SnapshotSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield "lexmill_snapshot"
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def _bytes(path):
    out = {}
    for folder, _, names in sorted(os.walk(path)):
        for n in sorted(names):
            if n.endswith(".jsonl"):
                out[os.path.basename(folder)] = out.get(os.path.basename(folder), b"") + open(os.path.join(folder, n), "rb").read()
    return out


def test_snapshots_are_stable_sorted_and_pruned(spark, source, tmp_path):
    rows = [(k, lang, f"é {k}\n") for k in range(60) for lang in ("en", "de", "a/b", None)] + [(3, "en", None), (None, "en", "x"), (3, "en", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    save = lambda d, path, files, mode="overwrite": snapshot.sorted_for_snapshot(d, "lang", "doc_id", files).write.format(source).option("path", str(path)).option("group", "lang").mode(mode).save()
    save(df.repartition(5), tmp_path / "one", 3)
    save(df.repartition(2).orderBy(F.desc("text")), tmp_path / "two", 7)
    save(df, tmp_path / "two", 2)  # again, over the old one
    assert _bytes(tmp_path / "one") == _bytes(tmp_path / "two")
    assert set(_bytes(tmp_path / "one")) == {"group=en", "group=de", "group=a%2Fb", "group=__null__"}
    load = lambda schema=SCHEMA: spark.read.format(source).option("path", str(tmp_path / "one")).option("group", "lang").schema(schema).load()
    order = lambda rs: sorted(map(tuple, rs), key=repr)
    assert order(load().collect()) == order(rows)
    for where, keep in (("lang = 'a/b'", lambda x: x == "a/b"), ("lang in ('en', 'de')", lambda x: x in ("en", "de")), ("lang is null", lambda x: x is None), ("lang = 'en' and lang = 'de'", lambda x: False), ("lang = 'en' and doc_id < 9", None)):
        got = load().where(where)
        if keep:
            assert order(got.collect()) == order(r for r in rows if keep(r[1]))
        else:
            assert order(got.collect()) == order(r for r in rows if r[1] == "en" and r[0] is not None and r[0] < 9)
    one = load("doc_id long, lang string").where("lang = 'de'")
    assert one.rdd.getNumPartitions() < load().rdd.getNumPartitions()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(lang" in plan and "= de" not in plan and "text" not in plan  # the source alone answers for the equality
    assert not os.path.exists(tmp_path / "one" / snapshot.STAGED) or not os.listdir(tmp_path / "one" / snapshot.STAGED)


def test_a_failed_task_leaves_nothing(spark, source, tmp_path):
    broken = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row")).cast("string")).otherwise("t").alias("text"))
    with pytest.raises(Exception, match="broken row"):
        broken.coalesce(2).write.format(source).option("path", str(tmp_path)).option("group", "lang").mode("append").save()
    assert _bytes(tmp_path) == {} and not os.listdir(tmp_path / snapshot.STAGED)


def test_two_appends_add_up(spark, source, tmp_path):
    df = spark.createDataFrame([(1, "en", "x")], SCHEMA)
    for _ in range(2):
        df.write.format(source).option("path", str(tmp_path)).option("group", "lang").mode("append").save()
    assert spark.read.format(source).option("path", str(tmp_path)).option("group", "lang").schema(SCHEMA).load().count() == 2
