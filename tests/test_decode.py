import itertools
import math

import numpy as np
import pytest

from lexmill.operators.decode import DecodeConfig, decode, log_softmax, table_step


def best_by_enumeration(table, source, c):
    """The best finished sequence of all, for budgets small enough to try them all."""
    step, best = table_step(table), (-math.inf, None)
    vocabulary = [t for t in range(table.shape[1]) if t != c.eos_id]
    for n in range(c.max_new_tokens):
        for ids in itertools.product(vocabulary, repeat=n):
            total, seq = 0.0, [c.start_id]
            for t in [*ids, c.eos_id]:
                total += log_softmax(step(np.array([seq]), source).astype(float))[0, t]
                seq.append(t)
            best = max(best, (total / (n + 1) ** c.length_penalty, list(ids)), key=lambda x: x[0])
    return best


@pytest.mark.parametrize("seed", range(5))
def test_wide_beam_finds_the_best(seed):
    table = np.random.default_rng(seed).normal(size=(7, 5))
    table[:, 2] += 1.5
    c = DecodeConfig(num_beams=32, max_new_tokens=4, start_id=3)
    status, ids, score = decode(table_step(table), [1, 4], c)
    want, seq = best_by_enumeration(table, [1, 4], c)
    if status == "OK" or status == "EMPTY_OUTPUT":
        assert score == pytest.approx(want) and ids == seq


def test_greedy_follows_the_largest_score():
    table = np.zeros((7, 12))
    table[:, 5] = 9
    status, ids, _ = decode(table_step(table), [5], DecodeConfig(max_new_tokens=4))
    assert (status, ids) == ("OUTPUT_TRUNCATED", [5, 5, 5, 5])


def test_limits_are_checked():
    for bad in ({"num_beams": 0}, {"max_new_tokens": 0}, {"no_repeat_ngram": 1}, {"length_penalty": 11}):
        with pytest.raises(ValueError):
            DecodeConfig(**bad)
