"""Pieces of texts are made by offsets, in whole batches."""

import random

import pyarrow as pa

from lexmill.operators import literals


def _plain(text, matches):
    out, at = [], 0
    for m in matches:
        if m["start"] > at:
            out.append({"piece": text[at : m["start"]], "id": None})
        at = m["start"] + m["length"]
        out.append({"piece": text[m["start"] : at], "id": m["id"]})
    return out + ([{"piece": text[at:], "id": None}] if text and at < len(text) else [])


def test_pieces_equal_cuts_one_by_one():
    rng = random.Random(3)
    texts, matches = [None, "", "", "é", None, ""], [[]] * 6
    for _ in range(200):
        text = "".join(rng.choice("ab é日𝄞\n") for _ in range(rng.randrange(12)))
        found, at = [], 0
        while at < len(text):
            n = rng.randint(1, 3)
            if rng.random() < 0.5 and at + n <= len(text):
                found.append({"start": at, "length": n, "id": rng.randrange(5)})
                at += n
            else:
                at += 1
        texts.append(text)
        matches.append(found)
    rows = pa.array([{"k": i} for i in range(len(texts))])
    for cut in (slice(0, None), slice(3, 50), slice(0, 2), slice(0, 0)):
        batch = pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string()), pa.array(matches, literals._ARROW)], names=["row", "text", "matches"])
        batch = batch.slice(cut.start, len(texts[cut]))
        (got,) = literals._pieces([batch])
        assert got.column("pieces").to_pylist() == [_plain(t, m) for t, m in zip(texts[cut], matches[cut], strict=True)]


def test_numbers_stand_for_the_smallest_id_of_equal_literals():
    own, lengths, ids = literals._numbered("t", [("ab", 9), ("ab", 4), ("", 1), ("abc", 7)])
    assert [(e, int(lengths[k]), int(ids[k])) for e, k in own.iter_long("xababc")] == [(2, 2, 4), (5, 3, 7)]
