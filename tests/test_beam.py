"""Beam search against a plain one."""

import math
import random
from collections import Counter

from lexmill.operators import beam


def test_beams_are_those_of_a_plain_search(spark):
    rng = random.Random(7)
    tokens = [f"t{k}" for k in range(9)]
    pairs = [(rng.choice(tokens), rng.choice([*tokens, "</s>"])) for _ in range(300)] + [("only", "t1")]
    model = spark.createDataFrame(pairs, "prev string, next string").repartition(3)
    counts = Counter(pairs)
    follow = {p: sorted(((n, c) for (q, n), c in counts.items() if q == p), key=lambda x: (-x[1], x[0])) for p, _ in pairs}
    starts = [(k, t) for k, t in enumerate([*tokens, "only", "unknown", "</s>"])] + [(0, "t0"), (None, "t1"), (50, None)]
    for beams in (1, 3):
        steps = beam.successors(model, beams)
        got = {}
        for r in beam.beam_search(spark.createDataFrame(starts, "row_id long, token string"), steps, beams, 4, "</s>").collect():
            got.setdefault(r.row_id, []).append((r["rank"], r.cost, list(r.tokens)))
        want = {}
        for k, t in starts:
            if k is None or t is None:
                continue
            held = [(0, [t])]
            for _ in range(4):
                wide = [h for h in held if h[1][-1] == "</s>"]
                for cost, seq in held:
                    if seq[-1] != "</s>":
                        every = sum(c for _, c in follow.get(seq[-1], []))
                        wide += [(cost + round(-math.log(c / every) * beam.UNIT), [*seq, n]) for n, c in follow.get(seq[-1], [])[:beams]]
                held = sorted(wide)[:beams]
            if held:
                want[k] = [(i + 1, *h) for i, h in enumerate(held)]
        assert {k: sorted(v) for k, v in got.items()} == want


def test_pairs_of_words(spark):
    df = spark.createDataFrame([("a b  c",), ("one",), ("",), (None,), (" \n",)], "t string")
    got = [[tuple(p) for p in r.p] if r.p is not None else None for r in df.select(beam.word_pairs(df.t, "E").alias("p")).collect()]
    assert got[:2] == [[("a", "b"), ("b", "c"), ("c", "E")], [("one", "E")]]
    assert all(p is None or all(x[0] is None for x in p) for p in got[2:])
