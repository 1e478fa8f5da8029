"""Recency distances against a cache that is kept step by step."""

import random

from lexmill.operators.cache import hits, recency


def test_hits_are_those_of_least_recently_used_caches(spark):
    rng = random.Random(4)
    rows = [(c, s, f"m{rng.randint(0, 6)}") for c in range(4) for s in sorted(rng.sample(range(1000), 60))] + [(None, 1, "m1"), (1, None, "m1"), (1, 2000, None), (9, 1, "lone")]
    df = spark.createDataFrame(rows, "cache long, seq long, model_id string").repartition(3)
    found = recency(df)
    for size in (1, 3, 7):
        got = {(r.cache, r.seq): r.hit for r in hits(found, size).collect()}
        want = {}
        for c in (0, 1, 2, 3, 9):
            held = []
            for _, s, m in sorted(r for r in rows if r[0] == c and None not in r):
                want[c, s] = m in held
                held = [m] + [x for x in held if x != m][: size - 1]
        assert got == want
    assert recency(df.limit(0)).count() == 0
