"""Words that a linear hash modulo a power of two can't tell apart, through every operator that hashes words."""

import hashlib
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n):
    """The Thue-Morse word of n letters over a and b, and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


PAIRS = [thue_morse(1024), thue_morse(2048)]
PADDING = " ".join(f"p{k}" for k in range(20))


@pytest.fixture(scope="module")
def texts():
    out = []
    for one, two in PAIRS:
        out += [one, two, f"{one}\n{two}\n{one} {two} {PADDING}", f"{PADDING} {two} x {PADDING}", f"{PADDING} {one} x {PADDING}"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def test_word_hashes_differ():
    from lexmill.llm import wordhash as wh

    for one, two in PAIRS:
        data = np.frombuffer((one + two).encode(), np.uint8)
        at = np.array([0, len(one)])
        for seed in (11, 12):
            a, b = wh.span_hashes(data, at, at + len(one), seed)
            assert a != b
    # all ranges of one size up to 8 bytes have hashes of their own, and the hash depends on nothing but the bytes
    data = np.frombuffer(b"".join(bytes([97 + i, 97 + j, 97 + k]) for i in range(26) for j in range(26) for k in range(26)), np.uint8)
    at = np.arange(0, len(data), 3)
    assert len(np.unique(wh.span_hashes(data, at, at + 3))) == 26**3
    h = np.arange(40, dtype=np.uint64)
    assert len({*wh.gram_hashes(h, 13).tolist(), *wh.gram_hashes(h, 13, salt=9).tolist()}) == 56
    raw = b"abcdefghij" * 80
    data = np.frombuffer(raw + b"-" + raw + b"+", np.uint8)
    for size in (1, 7, 8, 9, 16, 511, 512, 513, 800):
        a, b, c = wh.span_hashes(data, np.array([0, 801, 1]), np.array([size, 801 + size, 1 + size]))
        assert a == b != c


def test_ids_of_both_words(spark, texts, docs):
    from lexmill.llm.packing import pack_documents
    from lexmill.llm.token_output import token_files

    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    want = [library.encode(t, add_special_tokens=False).ids + [2] for _, t in texts]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files(docs, TOKENIZER).collect()} == {k: (len(w), crc(w)) for k, w in enumerate(want)}
    got = [[] for _ in texts]
    for r in sorted(pack_documents(docs, TOKENIZER, with_ids=True).collect(), key=lambda r: r.start):
        got[r.doc_id] += r.ids
    assert got == want


def test_table_collisions_are_told_apart_by_bytes(texts):
    from lexmill.llm import tokens, wordhash
    from lexmill.llm.tokens import BatchEncoder

    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    encoder, real = BatchEncoder(TOKENIZER), wordhash.span_hashes
    wordhash.span_hashes = lambda data, start, end, seed=11: np.zeros(len(start), np.uint64)  # every pre-token in one slot
    try:
        for _ in range(2):
            text = "one two two three antidisestablishmentarianism one " + texts[0][1]
            data = np.frombuffer(text.encode(), np.uint8)
            assert encoder.encode(data, np.array([0, len(data)]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    finally:
        wordhash.span_hashes = real
    assert tokens.HELD * 8 == 24


def test_repeats_and_groups_and_counts(texts, docs):
    from lexmill.llm.near_dedup import near_duplicate_groups
    from lexmill.llm.quality import quality_cascade
    from lexmill.llm.substring_dedup import remove_repeats

    sets = {i: brute.shingles(t) for i, t in texts}
    groups = brute.components(sets, brute.near)
    assert {r.doc_id: r.component_id for r in near_duplicate_groups(docs).collect()} == groups
    assert groups[0] == 0 and groups[1] == 1
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_cascade(docs, counts=True).collect()} == {i: brute.quality(t) for i, t in texts}
    kept = brute.kept_words(texts)
    want = {i: hashlib.sha256(" ".join(k).encode()).hexdigest() for (i, _), k in zip(texts, kept)}
    assert {r.doc_id: r.kept_sha256 for r in remove_repeats(docs).collect()} == want


def test_word_counts(texts, docs):
    from lexmill.llm.ppm import language_scores

    training = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 10:
            training.update([*t.split(), None])
    got = {r.doc_id: (r.n_tokens, r.n_known) for r in language_scores(docs).collect()}
    assert got == {i: (len(t.split()) + 1, sum(training[w] > 0 for w in [*t.split(), None])) for i, t in texts}


#: words found by inverting the word hash of the default seed: their differences cancelled in the run hash as it once was
CRAFTED = ("k=w6|hu_ d.'bka~@", "d]_j[{0% \"$od`s5g")


def test_crafted_words_neither_remove_nor_link(spark):
    from lexmill.llm.near_dedup import near_duplicate_groups
    from lexmill.llm.quality import quality_cascade
    from lexmill.llm.substring_dedup import remove_repeats

    one, two = CRAFTED
    tail = " ".join(f"t{k}" for k in range(11))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"a b {one} c"), (4, f"a b {two} c"), (5, f"x {one} y z {two} y z x {one} y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = brute.kept_words(rows)
    want = {i: hashlib.sha256(" ".join(k).encode()).hexdigest() for (i, _), k in zip(rows, kept)}
    assert {r.doc_id: r.kept_sha256 for r in remove_repeats(df).collect()} == want
    assert {r.doc_id: r.component_id for r in near_duplicate_groups(df).collect()} == brute.components({i: brute.shingles(t) for i, t in rows}, brute.near)
    assert {r.doc_id: r.n_repeat_words for r in quality_cascade(df, counts=True).collect()} == {i: brute.quality(t)[4] for i, t in rows}


def test_differences_of_word_hashes_do_not_cancel():
    from lexmill.llm import wordhash as wh

    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 64, size=(2000, 13), dtype=np.uint64)
    plain = wh.gram_hashes(h.ravel(), 13, key=7)[::13]
    for a in range(12):  # top bits, low bits and sparse differences in two neighbours
        for d, e in [(1 << 63, (1 << 63) | (1 << 31)), (1 << 63, 1 << 63), (8, 8), (1 << 31, 1 << 32), *rng.integers(8, 1 << 63, size=(20, 2)).tolist()]:
            other = h.copy()
            other[:, a] ^= np.uint64(d)
            other[:, a + 1] ^= np.uint64(e)
            assert not (wh.gram_hashes(other.ravel(), 13, key=7)[::13] == plain).any()


def test_run_hashes_are_polynomials_modulo_the_prime():
    from lexmill.llm import wordhash as wh

    prime = (1 << 61) - 1
    rng = np.random.default_rng(1)
    h = np.concatenate((rng.integers(0, 1 << 64, size=60, dtype=np.uint64), np.array([0, 1, 7, 8, (1 << 64) - 1, (1 << 64) - 8, prime << 3, (prime - 1) << 3], np.uint64)))
    for width in (1, 2, 3, 5, 7, 8, 13, 30):
        for key, salt in ((0, 0), (wh.fresh_key(), 0), (5, 9)):
            point = wh.run_point(salt, key)
            got = wh.gram_hashes(h, width, salt, key)
            assert len(got) == len(h) - width + 1
            for k in range(len(got)):
                value = 0
                for x in h[k : k + width]:
                    value = (value * point + (int(x) >> 3)) % prime
                assert got[k] == wh.mix(np.array([value | (width & 7) << 61], np.uint64))[0]
    assert len(wh.gram_hashes(h[:4], 5)) == 0


def test_carried_columns_may_have_any_name(spark):
    from lexmill.llm.substring_dedup import remove_repeats

    df = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, bucket string, part int")
    (row,) = remove_repeats(df, carry=("bucket", "part")).collect()
    assert (row.bucket, row.part, row.kept_text) == ("x", 2, "a b")
