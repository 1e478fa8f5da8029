"""Autoregressive decoding over a pluggable step function, batched by Spark.

A step takes the sequences so far ([rows, length] ids) and the input ids, and gives
[rows, vocabulary] scores before normalisation. Any runtime may stand behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Step = Callable[[np.ndarray, list[int]], np.ndarray]


@dataclass(frozen=True)
class DecodeConfig:
    """Limits are checked here; a repeat ban of one token is refused, since it would forbid every word twice."""

    num_beams: int = 1
    max_new_tokens: int = 32
    length_penalty: float = 1.0
    no_repeat_ngram: int = 0
    start_id: int = 3
    eos_id: int = 2
    banned: tuple[int, ...] = ()
    forced_first: int | None = None

    def __post_init__(self):
        if not 1 <= self.num_beams <= 32 or self.max_new_tokens < 1 or not -10 <= self.length_penalty <= 10 or self.no_repeat_ngram < 0 or self.no_repeat_ngram == 1:
            raise ValueError("a decoding limit is out of range")


def log_softmax(x: np.ndarray) -> np.ndarray:
    """By row; rows that are all -inf stay so."""
    top = x.max(axis=-1, keepdims=True)
    alive = np.isfinite(top)
    shifted = np.where(alive, x - np.where(alive, top, 0), -np.inf)
    with np.errstate(divide="ignore"):
        total = np.log(np.exp(shifted).sum(axis=-1, keepdims=True))
    return np.where(alive, shifted - np.where(alive, total, 0), -np.inf)


def repeat_bans(ids: list[int], n: int) -> set[int]:
    if n < 2 or len(ids) < n - 1:
        return set()
    tail = ids[len(ids) - n + 1 :]
    return {ids[i + n - 1] for i in range(len(ids) - n + 1) if ids[i : i + n - 1] == tail}


def _scores(step: Step, beams: list[list[int]], source: list[int], c: DecodeConfig) -> np.ndarray:
    scores = log_softmax(step(np.array(beams), source).astype(float))
    if c.forced_first is not None and len(beams[0]) == 1:
        only = np.full_like(scores, -np.inf)
        only[:, c.forced_first] = 0.0
        return only
    for row, ids in zip(scores, beams, strict=True):
        row[list(set(c.banned) | repeat_bans(ids, c.no_repeat_ngram))] = -np.inf
    return scores


def decode(step: Step, source: list[int], c: DecodeConfig) -> tuple[str, list[int], float]:
    """(status, ids without start and end, normalised score): OK, EMPTY_OUTPUT or OUTPUT_TRUNCATED.

    Each step looks at twice as many candidates as beams; ends that rank below the beam width
    are dropped. The search stops when the finished hypotheses can't be beaten. At the budget
    unfinished beams compete too, and a win by one of those is a truncated output.
    """
    norm = lambda total, length: total / max(length, 1) ** c.length_penalty
    beams, totals, done = [[c.start_id]], [0.0], []
    for _ in range(c.max_new_tokens):
        scores = _scores(step, beams, source, c) + np.array(totals)[:, None]
        flat = scores.ravel()
        order = np.argsort(-flat, kind="stable")[: 2 * c.num_beams]
        nxt, sums = [], []
        for rank, k in enumerate(order):
            if not np.isfinite(flat[k]):
                break
            row, token = divmod(int(k), scores.shape[1])
            if token == c.eos_id:
                if rank < c.num_beams:
                    done.append((norm(float(flat[k]), len(beams[row])), beams[row][1:]))
            elif len(nxt) < c.num_beams:
                nxt.append([*beams[row], token])
                sums.append(float(flat[k]))
        done = sorted(done, key=lambda d: -d[0])[: c.num_beams]
        beams, totals = nxt, sums
        if not beams or len(done) == c.num_beams and done[-1][0] >= norm(max(totals), len(beams[0])):
            break
    open_beams = [(norm(t, len(b) - 1), b[1:]) for b, t in zip(beams, totals, strict=True)]
    best = max(done, key=lambda d: d[0], default=None)
    rest = max(open_beams, key=lambda d: d[0], default=None)
    if best is None or rest is not None and len(rest[1]) >= c.max_new_tokens and rest[0] > best[0]:
        return ("OUTPUT_TRUNCATED", rest[1] if rest else [], rest[0] if rest else float("-inf"))
    return ("OK" if best[1] else "EMPTY_OUTPUT", best[1], best[0])


def table_step(table: np.ndarray) -> Step:
    """The toy model: a state, the sum of all ids modulo the rows of a table, chooses a row of scores."""

    def step(beams: np.ndarray, source: list[int]) -> np.ndarray:
        return table[(beams.sum(axis=1) + sum(source)) % len(table)]

    return step


def decode_rows(rows: DataFrame, make_step: Callable[[], Step], config: DecodeConfig) -> DataFrame:
    """row_id, status, ids, score for rows (row_id, source array<int>); the step is made once per Python worker's batch stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = make_step()
        for batch in batches:
            out = [decode(step, [int(x) for x in s], config) for s in batch.source]
            yield pd.DataFrame({"row_id": batch.row_id, "status": [o[0] for o in out], "ids": [o[1] for o in out], "score": [o[2] for o in out]})

    return rows.select("row_id", "source").mapInPandas(run, "row_id long, status string, ids array<int>, score double")


def verdicts(outputs: DataFrame):
    """model_id, status of a sweep (model_id, sample, output, error): skipped without a sample, error, empty, verbatim or ok."""
    from pyspark.sql import functions as F

    from lexmill.functions.text import has_visible_content

    status = F.when(F.col("sample").isNull(), "skipped-no-sample").when(F.col("error").isNotNull(), "error").when(~has_visible_content(F.col("output")), "empty").when(F.trim("output") == F.trim("sample"), "verbatim").otherwise("ok")
    return outputs.select("*", status.alias("status"))
