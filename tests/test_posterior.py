"""The running posterior of conversations: as the batch has it, late turns, closing, restart."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexmill.operators import detect
from lexmill.streaming import posterior

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
SCHEMA = "conv_id long, ts timestamp, text string"


@pytest.fixture(scope="module")
def model(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", posterior.PROVIDER)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return detect.packed(*detect.train(docs.where(detect.is_training(F.col("text")))))


def run(spark, model, tmp_path, files, gap_ms=3_600_000):
    """The rows that the stream sends out, batch by batch; a file is a batch. Called again, it goes on where it stopped."""
    folder = tmp_path / "in"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"made-{len(list(tmp_path.glob('made-*')))}"))
        part = next((tmp_path / f"made-{len(list(tmp_path.glob('made-*'))) - 1}").glob("part-*.parquet"))
        folder.mkdir(exist_ok=True)
        part.rename(folder / f"{len(list(folder.glob('*.parquet'))):03d}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))
    out = posterior.running_posterior(stream, *model, gap_ms=gap_ms)
    sent = []
    query = out.writeStream.outputMode("update").foreachBatch(lambda df, n: sent.extend((n, *r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return sent


def last(sent):
    return {conv: (lang, round(p, 9), size) for _, conv, lang, p, size, _ in sent}


def test_the_stream_ends_where_the_batch_is(spark, model, tmp_path):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    rows = [(r.conv_id, START + timedelta(seconds=r.turn), r.text) for r in turns]
    sent = run(spark, model, tmp_path, [rows[2::3], rows[0::3]])
    sent += run(spark, model, tmp_path, [rows[1::3]])  # stopped and started again
    whole = posterior.batch_posterior(spark.createDataFrame(rows, SCHEMA), *model).collect()
    assert last(sent) == {r.conv_id: (r.lang, round(r.p, 9), r.size) for r in whole}
    assert not any(r[-1] for r in sent) and len({r[0] for r in sent}) >= 3


def test_late_turns_are_dropped_and_silent_conversations_close(spark, model, tmp_path):
    at = lambda minutes: START + timedelta(minutes=minutes)
    early = [(1, at(0), "the rest and there"), (2, at(1), "die und der")]
    later = [(3, at(120), "les que et")]
    more = [(1, at(5), "too late to count"), (3, at(121), "vous les"), (4, at(119), "in time")]
    sent = run(spark, model, tmp_path, [early, later, more, [(3, at(400), "end")]], gap_ms=30 * 60_000)
    whole = {r.conv_id: (r.lang, round(r.p, 9), r.size) for r in posterior.batch_posterior(spark.createDataFrame(early + later + more[1:] + [(3, at(400), "end")], SCHEMA), *model).collect()}
    closed = {conv: (lang, round(p, 9), size) for _, conv, lang, p, size, done in sent if done}
    assert {1, 2, 4} <= set(closed)
    for conv in (1, 2, 4):
        assert closed[conv] == whole[conv]
    assert max(size for _, conv, _, _, size, _ in sent if conv == 1) == len("therestandthere")


def test_equal_scores_go_to_the_first():
    assert posterior.posterior([5.0, 5.0]) == (0, 0.5)
    k, p = posterior.posterior([0.0, detect.UNIT * 1.0])
    assert k == 1 and math.isclose(p, 1 / (1 + math.exp(-1)))
