"""A running language posterior per conversation, with state.

Turns arrive in any order. Each trigram of a turn meets the model in a stream-static join, and
a conversation's state is the sum of what its turns add, so the answer doesn't depend on the
order. Turns older than the watermark are dropped. A conversation that has been silent for `gap` of event
time is closed: its last answer is sent with closed set, and its state goes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexmill.functions import ngrams
from lexmill.operators import detect, product

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "conv_id long, lang string, p double, size long, closed boolean"


def posterior(scores: list[float]) -> tuple[int, float]:
    """(place, probability) of the largest of some micro-nats; of equal ones the first."""
    best = max(range(len(scores)), key=lambda k: (scores[k], -k))
    return best, 1 / sum(math.exp((s - scores[best]) / detect.UNIT) for s in scores)


class RunningPosterior(StatefulProcessor):
    """Sums of gains by language; langs: (lang, prior, floor) in the order of the model."""

    def __init__(self, langs: list[tuple[str, int, int]], gap_ms: int):
        self.langs, self.gap_ms = langs, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "size long, last_ms long, gains array<double>")

    def _answer(self, key, size: int, gains: list[float], closed: bool) -> pd.DataFrame:
        scores = [gains[k] + size * floor + prior for k, (_, prior, floor) in enumerate(self.langs)]
        k, p = posterior(scores)
        return pd.DataFrame({"conv_id": [key[0]], "lang": [self.langs[k][0]], "p": [p], "size": [size], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.sums.get() if self.sums.exists() else None
        size, last, gains = (0, None, [0.0] * len(self.langs)) if held is None else (held[0], held[1], list(held[2]))
        late = timerValues.getCurrentWatermarkInMs()
        seen = False
        for batch in rows:
            ms = batch["ts_ms"]
            batch = batch[ms >= late]
            if batch.empty:
                continue
            seen = True
            size += int(batch["n"][batch["block"] == 0].sum())
            newest = int(batch["ts_ms"].max())
            last = newest if last is None else max(last, newest)
            for n, block, vec in zip(batch["n"], batch["block"], batch["vec"], strict=True):
                if vec is not None:
                    for k, gain in enumerate(vec):
                        place = block * product.COLUMNS + k
                        if place < len(gains):
                            gains[place] += n * gain
        if not seen:
            return
        self.sums.update((size, last, gains))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(last, late) + self.gap_ms)
        yield self._answer(key, size, gains, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, _, gains = self.sums.get()
        self.sums.clear()
        yield self._answer(key, size, list(gains), True)


def _terms(turns: DataFrame, weights: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """conv_id, ts, n, block, vec: one row per trigram id of a turn and block of the model; vec is null for ids that the model hasn't."""
    ngrams.small_batches(turns.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data, off = ngrams.utf8(batch.column(2))
            for owner, ids in ngrams.ngram_ids(data, off, 3, 3, buckets):
                both, ns = np.unique(owner * buckets + ids, return_counts=True)
                at = pa.array(both // buckets)
                yield pa.RecordBatch.from_pydict({"conv_id": batch.column(0).take(at), "ts": batch.column(1).take(at), "id": pa.array(both % buckets, pa.int64()), "n": pa.array(ns, pa.int64())})

    flat = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "ts", "text").mapInArrow(run, "conv_id long, ts timestamp, id long, n long")
    each = flat.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.join(weights, ["id", "block"], "left").select("conv_id", "ts", "n", "block", "vec")


def running_posterior(turns: DataFrame, langs: DataFrame, weights: DataFrame, delay: str = "10 minutes", gap_ms: int = 3_600_000, buckets: int = detect.BUCKETS) -> DataFrame:
    """conv_id, lang, p, size, closed after every batch of a stream of turns (conv_id, ts, text), for the conversations it touched or closed.

    langs and weights are those of detect.packed. The session needs the RocksDB state store (PROVIDER).
    Turns without words say nothing.
    """
    model = [(r["lang"], r["prior"], r["floor"]) for r in langs.orderBy("idx").collect()]  # a row per language
    terms = _terms(turns.withWatermark("ts", delay), weights, (len(model) - 1) // product.COLUMNS + 1, buckets)
    timed = terms.withColumn("ts_ms", F.unix_millis("ts"))
    return timed.groupBy("conv_id").transformWithStateInPandas(RunningPosterior(model, gap_ms), _OUT, "Update", "EventTime")


def batch_posterior(turns: DataFrame, langs: DataFrame, weights: DataFrame, buckets: int = detect.BUCKETS) -> DataFrame:
    """conv_id, lang, p, size of whole conversations (conv_id, text): what the stream says once all turns are in."""
    n = langs.count()
    sums = product.text_sums(turns, F.col("conv_id"), F.col("text"), 3, buckets, weights, n)
    each = sums.select(F.col("key").alias("conv_id"), "n", "block", F.posexplode("vec").alias("k", "gain")).withColumn("idx", F.col("block") * product.COLUMNS + F.col("k"))
    scored = each.join(detect.small(langs, n), "idx").select("conv_id", "lang", "n", (F.col("n") * F.col("floor") + F.col("gain") + F.col("prior")).alias("score"))
    best = scored.groupBy("conv_id").agg(F.min(F.struct((-F.col("score")).alias("cost"), "lang")).alias("b"), F.max("n").alias("size"), F.collect_list("score").alias("scores"))  # a score per language
    total = F.aggregate("scores", F.lit(0.0), lambda s, x: s + F.exp((x + F.col("b.cost")) / detect.UNIT))
    return best.select("conv_id", F.col("b.lang").alias("lang"), (1 / total).alias("p"), "size")
