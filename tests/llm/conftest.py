import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, part int, kept string, n int, rate double, salt int, copies int, shard int, slot string, packed binary, ids string, number int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randint(0, vocabulary)}" for _ in range(n)]


def corpus():
    """Rows with what operators must stand: nulls, empty and long texts, exact and near copies, shared passages, repeated rows, clashing columns."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    base = words(rng, 120)
    texts = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(25)]
    texts += [passage, f"{texts[0]} {passage}", f"{passage} {texts[1]}\n{passage}", texts[2], texts[2], texts[3].upper()]
    for edits in (1, 1, 2, 3, 5, 8):  # near copies, some of them only linked through others
        near = list(base)
        for _ in range(edits):
            near[rng.randrange(len(near))] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(near))
    texts += [None, "", " \n\t ", "one", "one two", "one two three four five", "One  two\tthree\x0bfour five", "é日本 ÿ😀 ñ", "a b c d e " * 40, "l1 x\nl1 x\nl1 x\n\nother line", "*** ### $$$ | | |" * 5, " ".join(words(rng, 9000)), "x" * 30_000, "SHOUT " * 30 + "A B C D"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, texts[5]), (None, None), (3, texts[3]), (3, texts[3]), (900, texts[7]), (901, texts[7])]
    rng.shuffle(rows)
    return [(i, t, None if k % 7 == 0 else "en", None if k % 11 == 0 else ("hot" if k % 3 else f"s{k % 4}"), None if t is None else len(t), 1, 2, "no", 3, 0.5, 4, 5, 6, "seven", None, "eight", 9) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
