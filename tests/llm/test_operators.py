import hashlib
import math
import os
import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

tokenizers = pytest.importorskip("tokenizers")
import public_tokenizers  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- words and tokens --------------------------------------------------------------------------


def test_words_are_those_of_the_pattern(rows):
    import pyarrow as pa

    from lexmill.llm import wordhash as wh

    texts = [r[1] for r in rows]
    data, off = wh.utf8(pa.array(texts, pa.string()))
    w = wh.words(data, off)
    raw = data.tobytes()
    for k, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]])]
        assert got == brute.words(t)


def test_batch_encoder_equals_the_library(library):
    import pyarrow as pa

    from lexmill.llm import wordhash as wh
    from lexmill.llm.tokens import BatchEncoder

    rng, encoder = random.Random(2), BatchEncoder.of(TOKENIZER)
    letters = "aB'  \n\tsdt1é!. ’ñvemlr日ſ'’"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> x", "don't 's 'source it's '' ''s", None, "  a", "x ῰ y"]
    data, off = wh.utf8(pa.array(texts, pa.string()))
    ids, bounds = encoder.encode(data, off, 2)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == library(t), repr(t)


def test_special_tokens_are_read_as_the_library_does(spark, tmp_path):
    import pyarrow as pa

    from lexmill.llm import wordhash as wh
    from lexmill.llm.packing import pack_documents
    from lexmill.llm.token_output import read_tokens, write_tokens
    from lexmill.llm.tokens import BatchEncoder

    plain = tokenizers.Tokenizer.from_file(TOKENIZER)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endo", "ftext|> y", "<|endoftext|><|endoftext|> z 日", "none", "", None]
    want = [plain.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert want[0] == [64, 50256, 65, 2]
    data, off = wh.utf8(pa.array(texts, pa.string()))
    ids, bounds = BatchEncoder.of(TOKENIZER, special=True).encode(data, off, 2)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
    # texts that only make the string together stay apart
    data, off = wh.utf8(pa.array(["x <|endo", "ftext|>"], pa.string()))
    ids, bounds = BatchEncoder.of(TOKENIZER, special=True).encode(data, off, 2)
    assert 50256 not in ids.tolist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in pack_documents(df, TOKENIZER).collect()) == [(k, len(w), crc(w)) for k, w in enumerate(want)]
    out = read_tokens(write_tokens(df, f"file://{tmp_path}/out", TOKENIZER)).collect()
    starts = np.concatenate(([0], np.cumsum([len(w) for w in want])))
    assert sorted(tuple(r)[:4] for r in out) == [(k, int(starts[k]), len(w), crc(w)) for k, w in enumerate(want)]


# --- 1 packing ---------------------------------------------------------------------------------


def check_packing(out, rows, library, room):
    per = defaultdict(list)
    for r in out:
        per[r.sequence_id].append((r.offset, r.length))
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    want = Counter()
    for i, t in rows:
        ids = library(t)
        n = -(-len(ids) // room)
        cuts = [0] + [len(ids) - room * k for k in range(n - 1, -1, -1)]
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[i, p, a, b - a, crc(ids[a:b])] += 1
    assert pieces == want


@pytest.mark.parametrize("room", [64, 1024])
def test_packing(docs, rows, library, room):
    from lexmill.llm.packing import pack_documents

    out = pack_documents(docs, TOKENIZER, room).collect()
    check_packing(out, [r[:2] for r in rows], library, room)


def test_packing_nothing(no_docs):
    from lexmill.llm.packing import pack_documents

    assert pack_documents(no_docs, TOKENIZER).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plans_use_up_the_histogram_and_stay_near_the_bound(seed):
    from lexmill.llm.packing import plan_packing

    rng, room = np.random.default_rng(seed), 256
    h = np.bincount(np.minimum(room, rng.geometric(1 / 60, 5000)), minlength=room + 1)
    h[150] += 2000 * (seed % 2)
    used, n = np.zeros_like(h), 0
    for lengths, k in plan_packing(h, room):
        assert sum(lengths) <= room
        n += k
        for v in lengths:
            used[v] += k
    assert (used == h).all()
    bound = max(-(-(h * np.arange(room + 1)).sum() // room), h[room // 2 + 1 :].sum())
    assert n <= 1.03 * bound + 2


def test_fit_lowers_the_residual():
    from lexmill.llm.packing import fill_patterns, fit_counts

    h = np.bincount(np.random.default_rng(0).integers(1, 64, 4000), minlength=65)
    p = fill_patterns(64)
    assert (p.sum(axis=1) == 64).all()

    def residual(x):
        made = np.bincount(p.ravel(), np.repeat(x, 3), 65)
        return ((made - h)[1:64] ** 2).sum()

    steps = [residual(fit_counts(p, h, k)) for k in (1, 10, 200)]
    assert steps[0] >= steps[1] >= steps[2] and steps[2] < 0.05 * residual(np.zeros(len(p)))


# --- 2 substring dedup -------------------------------------------------------------------------


def test_repeats(docs, rows):
    from lexmill.llm.substring_dedup import remove_repeats

    out = remove_repeats(docs, carry=("lang", "kept")).collect()
    plain = [r[:2] for r in rows]
    want = Counter((i, len(brute.words(t)), len(brute.words(t)) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, t), k in zip(plain, brute.kept_words(plain)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sum(r.n_removed for r in out) > 100
    for r in out:
        assert r.n_removed or r.kept_text in {t for i, t in plain if i == r.doc_id}
        assert r.kept == "no"


def test_repeats_of_other_sizes(spark):
    from lexmill.llm.substring_dedup import remove_repeats

    rng = random.Random(3)
    plain = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    out = remove_repeats(spark.createDataFrame(plain, "doc_id long, text string"), window=5, block=3).collect()
    want = {i: hashlib.sha256(" ".join(k).encode()).hexdigest() for (i, _), k in zip(plain, brute.kept_words(plain, 5))}
    assert {r.doc_id: r.kept_sha256 for r in out} == want
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame(plain, "doc_id long, text string"), window=5, block=4)


def test_repeats_of_nothing(no_docs):
    from lexmill.llm.substring_dedup import remove_repeats

    assert remove_repeats(no_docs).collect() == []


# --- 3 sharding --------------------------------------------------------------------------------


def test_shards(docs, rows):
    from lexmill.llm.sharding import shard_table

    out = shard_table(docs, 4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in (r[:2] for r in rows))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert Counter(tuple(r) for r in out) == Counter(tuple(r) for r in shard_table(docs.repartition(3), 4).collect())


def test_clashing_names_stay(spark):
    from lexmill.llm.mixing import poisson_mix
    from lexmill.llm.sharding import shuffle_into_shards

    names = ["_bucket", "_first", "_second", "_rank", "_range", "_own", "_n", "_before", "_key", "_source", "_parts", "_cdf", "_u", "_cut", "row", "copy", "shard", "a b"]
    plain = [(i, f"t{i}", "s", *(f"{c}{i}" for c in names)) for i in range(40)]
    df = spark.createDataFrame(plain, ["doc_id", "text", "source", *names])
    out = shuffle_into_shards(df, 3, ["doc_id"])
    kept = [c for c in df.columns if c != "shard"]
    assert out.columns == [*kept, "shard", "slot"]
    assert sorted(out.select(*[F.col(f"`{c}`") for c in kept]).collect()) == sorted(df.drop("shard").collect())
    mixed = poisson_mix(df, total=200)
    kept = [c for c in df.columns if c != "copy"]
    assert mixed.columns == [*kept, "copies", "copy", "shuffle_key"]
    assert set(mixed.select(*[F.col(f"`{c}`") for c in kept]).collect()) <= set(df.drop("copy").collect())


def test_matrix_stays_small_however_many_rows():
    from lexmill.llm import sharding

    assert max(1, sharding.MOST_ENTRIES // 16) == 8192


def test_shards_of_nothing(no_docs):
    from lexmill.llm.sharding import shard_table

    assert shard_table(no_docs).collect() == []


def test_matrix_margins_and_law():
    from lexmill.llm.sharding import communication_matrix, hypergeometric

    a = communication_matrix([7, 0, 13, 20], [10, 10, 20], 1)
    assert a.sum(axis=1).tolist() == [7, 0, 13, 20] and a.sum(axis=0).tolist() == [10, 10, 20]
    good, bad, n = 12, 30, 9
    pmf = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)]
    cdf = np.cumsum(pmf)
    for u in np.linspace(0.0005, 0.9995, 400):
        k = hypergeometric(u, good, bad, n)
        assert cdf[k] > u - 1e-9 and (k == 0 or cdf[k - 1] <= u + 1e-9)
    assert hypergeometric(0.5, 5_000_000_000, 5_000_000_000, 1_000_000) == pytest.approx(500_000, abs=2)


# --- 4 mixing ----------------------------------------------------------------------------------


def test_mixing_counts_follow_the_quantile(docs, rows):
    from lexmill.llm.mixing import poisson_mix

    out = poisson_mix(docs, weights={"hot": 2.0, "s0": 1.0}, total=300).collect()
    n = Counter(r[3] for r in rows)
    rate = {"hot": 2 / 3 * 300 / n["hot"], "s0": 1 / 3 * 300 / n["s0"]}
    want = Counter()
    for r in rows:
        if r[3] not in rate:
            continue
        key = f"23|{'-' if r[0] is None else r[0]}|" + hashlib.md5(("-" if r[1] is None else r[1]).encode()).hexdigest()
        u, k = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52, 0
        p = c = math.exp(-rate[r[3]])
        while c <= u:
            k += 1
            p *= rate[r[3]] / k
            c += p
        want[r[0], r[1]] += k
    assert Counter((r.doc_id, r.text) for r in out) == +want
    assert all(1 <= r["copy"] <= r.copies for r in out)


def test_mixing_table_is_gapless(docs, no_docs):
    from lexmill.llm.mixing import mix_table

    out = mix_table(docs).collect()
    assert sorted(r.position for r in out) == list(range(len(out)))
    assert [r.shuffle_key for r in sorted(out, key=lambda r: r.position)] == sorted(r.shuffle_key for r in out)
    assert mix_table(no_docs).collect() == []


def test_mixing_meets_its_target(spark):
    from lexmill.llm.mixing import poisson_mix

    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 < 9, "hot").otherwise("rare").alias("source"))
    got = {r["source"]: r["count"] for r in poisson_mix(big, weights={"hot": 1, "rare": 1}).groupBy("source").count().collect()}
    assert abs(got["hot"] - 10_000) < 400 and abs(got["rare"] - 10_000) < 400
    few = big.where("doc_id < 40")  # large rates are drawn in parts
    n = poisson_mix(few, weights={"hot": 1.0}, total=60_000).count()
    assert abs(n - 60_000) < 1500


# --- 5 token files -----------------------------------------------------------------------------


def test_token_files(docs, rows, library, tmp_path):
    from lexmill.llm.token_output import FrameReader, read_tokens, write_tokens

    index = write_tokens(docs, f"file://{tmp_path}/out", TOKENIZER)
    out = read_tokens(index).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    want, at = [], 0
    for r in sorted(rows, key=key):
        ids = library(r[1])
        want.append((r[0], at, len(ids), crc(ids), ids))
        at += len(ids)
    assert sorted([tuple(r) for r in out], key=lambda r: r[1]) == want
    assert [tuple(r) for r in read_tokens(index.where("doc_id = 12"), False).collect()] == [w[:4] for w in want if w[0] == 12]
    # the frames alone, by any zstandard reader, hold the ids in order; a broken byte is found
    import pyarrow.fs
    import zstandard

    fs = pyarrow.fs.LocalFileSystem()
    ids = []
    for row in index.select("part", "path").distinct().orderBy("part").collect():
        path = row.path.removeprefix("file://")
        reader = FrameReader(fs.open_input_file(path))
        ids += [np.frombuffer(reader.frame(k), "<u4") for k in range(len(reader.sizes))]
        with open(path, "rb") as f:
            whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert whole == b"".join(x.tobytes() for x in ids[-len(reader.sizes) :])
        reader.sums = reader.sums + 1
        with pytest.raises(ValueError):
            reader.frame(0)
    assert np.concatenate(ids).tolist() == [i for w in want for i in w[4]]


def test_token_files_of_nothing(no_docs):
    from lexmill.llm.token_output import token_files

    assert token_files(no_docs, TOKENIZER).collect() == []


# --- 6 quality ---------------------------------------------------------------------------------


def test_quality(docs, rows):
    from lexmill.llm.quality import default_rules, quality_cascade

    out = quality_cascade(docs, counts=True, carry=("doc_id", "source")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == Counter((r[0], *brute.quality(r[1])) for r in rows)
    names = [r.name for r in default_rules()]
    other = quality_cascade(docs, order=names[::-1]).collect()
    assert Counter((r.doc_id, r.kept) for r in out) == Counter((r.doc_id, r.kept) for r in other)
    assert {r.kept for r in out} == {True, False}


def test_quality_order_counts_shared_columns_once():
    from lexmill.llm.quality import greedy_order

    needs, columns = {"a": {"words"}, "b": {"words", "hashes"}, "c": {"bytes"}}, {"words": 1.0, "hashes": 0.1, "bytes": 0.5}
    own = dict.fromkeys("abc", 0.0)
    # a and b overlap: once b has rejected what a does too, c is worth more
    patterns = {0b011: 50, 0b010: 20, 0b100: 20, 0: 10}
    assert greedy_order(list("abc"), patterns, own, columns, needs, set()) == ["b", "c", "a"]
    assert greedy_order(list("abc"), patterns, own, columns, needs, {"words"}) == ["a", "b", "c"]
    assert greedy_order(list("abc"), {0b100: 1, 0b001: 1}, own, columns, needs, set())[0] == "c"
    assert greedy_order(list("abc"), {}, {}, {}, {}, set()) == list("abc")


def test_quality_order_puts_the_most_rejections_a_second_first(docs, no_docs):
    import time

    from lexmill.llm.quality import Rule, quality_cascade, rule_order

    def slow(t):
        time.sleep(0.05)
        return t.n_words < 10

    rules = (Rule("slow", slow), Rule("never", lambda t: t.n_words < 0), Rule("fast", lambda t: t.n_words < 10))
    order = rule_order(docs, rules)
    assert order[0] == "fast" and order[-1] == "never"
    assert rule_order(no_docs, rules) == ["slow", "never", "fast"]
    assert quality_cascade(no_docs).collect() == []


# --- 7 language scores -------------------------------------------------------------------------


def test_ppm(docs, rows):
    from lexmill.llm.ppm import language_scores

    plain = [r[:2] for r in rows]
    training = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0 for i, _ in plain]
    low = [(t or "").translate(brute.LOWER).encode() for _, t in plain]
    count, trie = Counter(), [defaultdict(Counter) for _ in range(6)]
    for b, k in zip(low, training):
        if k:
            count.update(b.split() + [None])
            s = b"\xfe" * 5 + b + b"\xff"
            for p in range(5, len(s)):
                for o in range(6):
                    trie[o][s[p - o : p]][s[p]] += 1
    n, v = sum(count.values()), len(count)

    def score(b):
        s, total = b"\xfe" * 5 + b + b"\xff", 0.0
        for p in range(5, len(s)):
            out = set()
            for o in range(5, -1, -1):
                here = {y: c for y, c in trie[o].get(s[p - o : p], {}).items() if y not in out}
                m, d = sum(here.values()), len(here)
                if s[p] in here:
                    total += math.log10(here[s[p]] / (m + d))
                    break
                if m:
                    total += math.log10(d / (m + d))
                    out |= set(here)
            else:
                total -= math.log10(256 - len(out))
        return total

    out = language_scores(docs).collect()
    assert {r.train_tokens for r in out} == {n}
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in out)
    want = []
    for (i, _), b, k in zip(plain, low, training):
        tokens = b.split() + [None]
        want.append((str(i), not k, len(tokens), sum(count[t] > 0 for t in tokens), round(sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), 4)))
    assert got == sorted(want)
    scores = defaultdict(list)
    for r in out:
        scores[r.doc_id, r.n_tokens].append(r.score)
    for (i, _), b in zip(plain, low):
        if len(b) < 3000:
            assert min(abs(x - score(b)) for x in scores[i, len(b.split()) + 1]) < 1e-3


def test_ppm_of_nothing(no_docs, spark):
    from lexmill.llm.ppm import language_scores

    assert language_scores(no_docs).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = language_scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert row.held_out and row.train_tokens == 0 and row.score == pytest.approx(-3 * math.log10(256))


# --- 8 nearest neighbours ----------------------------------------------------------------------


def vectors(n, seed=0, d=16):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(20, d))
    return centers[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, d))


def test_neighbours(spark):
    from lexmill.llm.ann import nearest_neighbours

    x = vectors(3000)
    x[100:400] = x[100]  # one vector that many rows share
    table = [(i, [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]
    bad = [(5000, None, 1), (5020, [], 1), (5040, [0.0] * 16, 1), (5060, [float("nan")] + [1.0] * 15, 1), (5080, [None] + [1.0] * 15, 1), (5100, [1.0] * 15, 1), (None, [1.0] * 16, 1), (5120, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(table + bad, "vec_id long, embedding array<float>, label int").repartition(4)
    out = nearest_neighbours(df, block_queries=100, block_rows=900).collect()
    y = np.array([r[1] for r in table])
    per = defaultdict(list)
    for r in out:
        per[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(per) == list(range(0, 3000, 20))
    hits = 0
    for q, found in per.items():
        s = y @ y[q]
        s[q] = -np.inf
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s[v] - z) < 1e-9 for _, v, z in found)
        assert [(-z, v) for _, v, z in found] == sorted((-z, v) for _, v, z in found)
        hits += len({v for _, v, _ in found} & set(np.lexsort((np.arange(3000), -np.round(s, 12)))[:20].tolist()))
    assert hits / (20 * len(per)) >= 0.9


def test_within_is_exact():
    from lexmill.llm.ann import MultiIndex, hamming

    codes = np.random.default_rng(1).integers(0, 256, (500, 6), dtype=np.uint8)
    index = MultiIndex(codes)
    for radius in (0, 3, 7, 13, 20):
        for q in codes[:20]:
            assert index.within(q, radius).tolist() == np.flatnonzero(hamming(codes, q) <= radius).tolist()


def test_few_or_no_vectors(spark):
    from lexmill.llm.ann import nearest_neighbours

    schema = "vec_id long, embedding array<float>"
    assert nearest_neighbours(spark.createDataFrame([], schema)).collect() == []
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], schema)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nearest_neighbours(three).collect()) == [(0, 1, 1), (0, 2, 2)]


# --- 9 near-duplicates -------------------------------------------------------------------------


def check_groups(out, plain):
    sets = {}
    for i, t in plain:
        if i is not None:
            sets.setdefault(i, brute.shingles(t))
    comp = brute.components(sets, brute.near)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out)
    want = Counter((i, len(brute.shingles(t)), comp.get(i), i is None or comp[i] == i) for i, t in plain)
    assert got == want


def test_near_groups(docs, rows):
    from lexmill.llm.near_dedup import near_duplicate_groups

    check_groups(near_duplicate_groups(docs).collect(), [r[:2] for r in rows])


def test_a_large_group_of_edits_of_one_text(spark):
    from lexmill.llm import near_dedup

    rng = random.Random(8)
    base = [f"b{k}" for k in range(90)]
    plain = []
    for i in range(220):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(90)] = f"y{rng.randint(0, 400)}"
        plain.append((1000 - i, " ".join(t)))
    df = spark.createDataFrame(plain, "doc_id long, text string")
    block = near_dedup.BLOCK_DOCS
    for near_dedup.BLOCK_DOCS in (block, 40):
        try:
            check_groups(near_dedup.near_duplicate_groups(df).collect(), plain)
        finally:
            near_dedup.BLOCK_DOCS = block


def test_cells_let_all_members_of_two_components_meet(spark):
    from lexmill.llm import near_dedup

    rng = random.Random(2)
    plain = [(cell, rep, 5, rng.choice([1, 1, 1, 1, 2, 3, rep])) for cell in range(8) for rep in rng.sample(range(10, 400), rng.choice([2, 5, 60, 150]))]
    block = near_dedup.BLOCK_DOCS
    near_dedup.BLOCK_DOCS = 20
    try:
        cells = near_dedup._cells(spark.createDataFrame(plain, "cell long, rep long, n long, c long")).collect()
    finally:
        near_dedup.BLOCK_DOCS = block
    inside = defaultdict(list)
    for r in cells:
        inside[r.cell, r.i, r.j].append((r.own, r.rep, r.c))
    met = {(k[0], *sorted((a[1], b[1]))) for k, rows in inside.items() for a in rows if a[0] == k[1] for b in rows if b[0] == k[2] and a[1] != b[1]}
    for cell in range(8):
        mine = [(rep, c) for x, rep, _, c in plain if x == cell]
        main = Counter(c for _, c in mine).most_common(1)[0][0]
        need = {(cell, *sorted((a, b))) for a, x in mine for b, y in mine if a < b and x != y}
        assert need <= met
        if len(mine) > 100:  # the main component doesn't meet itself, and travels once per block of the others
            others = -(-sum(c != main for _, c in mine) // 20)
            assert sum(len(rows) for k, rows in inside.items() if k[0] == cell) <= len(mine) * others + sum(c != main for _, c in mine) * -(-len(mine) // 20) + len(mine)


def test_near_groups_of_nothing(no_docs):
    from lexmill.llm.near_dedup import near_duplicate_groups

    assert near_duplicate_groups(no_docs).collect() == []


def test_sketch_fills_every_bin_and_estimates():
    from lexmill.llm.near_dedup import fast_sketch

    rng = np.random.default_rng(0)
    for size in (1, 3, 50, 2000):
        a = rng.integers(0, 1 << 54, size).astype(np.uint64)
        assert (fast_sketch(a, np.zeros(size, np.int64), 1, 224) != np.uint64(2**64 - 1)).all()
    a = rng.integers(0, 1 << 54, 1000).astype(np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 54, 200).astype(np.uint64)))
    both = np.concatenate((a, b)), np.repeat([0, 1], 1000)
    s = fast_sketch(*both, 2, 2000)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def test_components_of_a_path_and_a_star(spark):
    from lexmill.llm.cluster import components

    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1100)] + [(500, 501), (501, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{k: 1000 for k in range(1000, 1100)}, 500: 500, 501: 500}


# --- 10 pages ----------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var x = "</p>";</script></head><body><header><h2>Site</h2><a href=x>Home</a></header>
<div class="cookie-notice"><p>We use cookies to make this long site better for everyone who reads it.</p></div>
<div id="content"><h1>Big &amp; bold</h1><p>First   para with &lt;tags&gt; and&nbsp;spaces, quite long enough to be text.<p>Short.</p>
<div class="ad">Buy now! This is the best product that one may ever buy today.</div><p>Last para of this story is here, and it says more.</div>
<aside><p>Sidebar text that is rather long and looks like a real paragraph.</p></aside><section id="comments"><p>I liked this a lot and I write a long comment here.</p></section>
<form>Subscribe <input></form><!-- no --><footer>(c) 2020</footer>"""


def test_pages(spark):
    from lexmill.llm.html_extract import extract_main_text

    text = "Big & bold\nFirst para with <tags> and spaces, quite long enough to be text.\nShort.\nLast para of this story is here, and it says more."
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "", 1), (3, "w", "<nav><a href=x>all</a></nav>", 1), (4, "x", "<article><p>cut off in a ta<b", 1), (5, "y", "<article><!-- never closed", 1), (6, "z", "<article>" + "<div>" * 3000 + "<p>Deep text is still found here, as it should be.", 1)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    want = [text, text, "", "", "", "cut off in a ta", "", "Deep text is still found here, as it should be."]
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == sorted((str(a[0]), t, len(t)) for a, t in zip(rows, want))


def test_pages_that_only_look_silent(spark):
    from lexmill.llm.html_extract import extract_main_text

    one, two = "A first paragraph, long enough to be text.", "And a second one that says a little more."
    both = f"{one}\n{two}"
    pages = {
        f"<article><p>{one}</p><svg-icon name=x></svg-icon><p>{two}</p></article>": both,
        f"<article><template-card></template-card><p>{one}</p><title-bar>x</title-bar><p>{two}</p></article>": None,
        f"<article><p>{one}</p><svg class='a/b' viewBox=\"0 0 1 1\" /><p>{two}</p></article>": both,
        f"<article><p>{one}</p><svg/><p>{two}</p><svg><text>drawn</text></svg></article>": both,
        f"<article><p>{one}</p><svg href=a/><text>drawn</text></svg><p>{two}</p></article>": both,
        f"<article><p>{one}</p><svg><text>drawn</text></svg><script>x</script><p>{two}</p></article>": both,
        f"<head><title>t</title><meta charset=utf-8><bgsound src=x><article><p>{one}</p><p>{two}</p></article>": both,
        f"<html><head><title>t</title><link rel=x>\n<p>{one}</p>\n<p>{two}</p>": both,
        f"<head><title>t</title><style>s</style>\n{one}": one,
        f"<html><head><title>t</title></head><body><article><p>{one}</p><p>{two}</p></article>": both,
    }
    df = spark.createDataFrame([(k, "u", h) for k, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(df).collect()}
    for k, (page, want) in enumerate(pages.items()):
        if want is None:
            assert one in got[k] and two in got[k], page
        else:
            assert got[k] == want, page


def test_pages_of_many_templates():
    import page_templates

    from lexmill.llm.html_extract import main_text

    assert len(page_templates.TEMPLATES) >= 20
    for seed in (2, 3):
        for k, (page, want) in enumerate(page_templates.pages(seed, 5)):
            assert main_text(page) == want, page_templates.TEMPLATES[k // 5]


def test_weights_are_those_of_the_fit():
    import page_templates

    from lexmill.llm.html_extract import FEATURES, WEIGHTS, blocks_of, features, fit_weights

    blocks = [(features(b), b.text in want.split("\n")) for page, want in page_templates.pages(1) for b in blocks_of(page)]
    found = fit_weights([f for f, _ in blocks], [y for _, y in blocks])
    assert len(FEATURES) == len(WEIGHTS) and np.abs(np.array(found) - WEIGHTS).max() < 0.02


def test_the_table_of_pages():
    import html as entities
    import re

    import pyarrow.parquet as pq

    from lexmill.llm.html_extract import main_text

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        article = page[page.index("<article>") : page.index("</article>")]
        parts = re.split(r"</?(?:h1|p|div|article)[^>]*>", re.sub("</?b>", "", article.replace("<br>", " ")))
        assert main_text(page) == "\n".join(y for x in parts if (y := " ".join(entities.unescape(x).split())))


def test_cut_is_minimal():
    from lexmill.llm.html_extract import minimum_cut

    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i) if rng.random() < 0.4]

        def cost(labels):
            return sum(abs(s) for s, x in zip(scores, labels) if (s > 0) != x and s) + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(scores, edges)) == pytest.approx(best)


# --- the pipeline ------------------------------------------------------------------------------


def test_pipeline(spark, docs, rows, library):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    seen = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, "").cache()
        kept.append(seen.count())
        if name != "packing":
            assert seen.columns == corpus_pipeline.COLUMNS
    assert kept[0] < len(rows) and kept[1] < kept[0]
    check_packing(seen.collect(), [(r.doc_id, r.text) for r in before.collect()], library, 1024)


def test_pipeline_links_from_080_on(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    plain = []
    for k, n in enumerate((44, 45, 50, 60, 61, 62)):  # shingles; an edit in the middle changes five
        t = [f"d{k}w{i}" for i in range(n + 4)]
        plain += [(10 * k, " ".join(t)), (10 * k + 1, " ".join([*t[: n // 2], "edited", *t[n // 2 + 1 :]]))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in plain], "doc_id long, text string, lang string, source string, n_chars long")
    groups = brute.components({i: brute.shingles(t) for i, t in plain}, lambda a, b: brute.near(a, b, 80))
    left = sorted(i for i, g in groups.items() if i == g)
    assert left == [0, 1, 10, 20, 30, 40, 50]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == left


def test_pipeline_stages_before_packing(spark, docs):
    from lexmill.llm.quality import quality_cascade

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = corpus_pipeline.quality_rules(spark, docs, "").cache()
    judged = quality_cascade(docs, carry=("doc_id",), with_text=True).where("kept").collect()
    assert Counter((r.doc_id, r.text) for r in good.collect()) == Counter((r.doc_id, r.text) for r in judged)
    one = corpus_pipeline.near_dedup(spark, good, "").cache()
    sets = defaultdict(set)
    for r in good.collect():
        if r.doc_id is not None:
            sets[r.doc_id] |= brute.shingles(r.text)
    groups = brute.components(sets, lambda a, b: brute.near(a, b, 80))
    want = Counter((r.doc_id, r.text) for r in good.collect() if r.doc_id is None or groups[r.doc_id] == r.doc_id)
    assert Counter((r.doc_id, r.text) for r in one.collect()) == want
    plain = sorted(((r.doc_id, r.text) for r in one.collect()), key=str)
    kept = Counter((i, tuple(k)) for (i, _), k in zip(plain, brute.kept_words(plain)) if k)
    assert Counter((r.doc_id, tuple(brute.words(r.text))) for r in corpus_pipeline.substring_dedup(spark, one, "").collect()) == kept


def test_pipeline_of_nothing(spark, no_docs):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    seen = no_docs
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, "")
    assert seen.collect() == []
