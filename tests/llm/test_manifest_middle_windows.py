import hashlib
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
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- Merkle manifest ---------------------------------------------------------------------------


def plain_leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def plain_siblings(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        out += [d for k, d in enumerate(level[first : first + 8], first) if k != i]
        i //= 8
    return out


def plain_fold(levels, i, leaf):
    for level in levels[:-1]:
        run = list(level[i - i % 8 : i - i % 8 + 8])
        run[i % 8] = leaf
        leaf, i = sha(*run), i // 8
    return leaf


def plain_manifest(rows):
    """Sorted (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        other = r
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            other = (*r[:4], r[4].translate(brute.LOWER))
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r), plain_leaf(other), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort()
        trees[g] = plain_tree([x[2] for x in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for t, g in enumerate(names):
        for i, (_, _, leaf, other, doc) in enumerate(groups[g]):
            proof = plain_siblings(trees[g], i) + plain_siblings(top, t)
            folded = plain_fold(top, t, plain_fold(trees[g], i, other))
            out.append((doc, leaf, trees[g][-1][0], top[-1][0], sha(*proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_equals_the_plain_one(docs, rows):
    from lexmill.llm.merkle import manifest_table

    got = as_rows(manifest_table(docs))
    assert got == plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_hot_tiny_and_odd_groups(spark):
    from lexmill.llm.merkle import manifest_table

    rng = random.Random(3)
    rows = [(k, "s", "hot", 1, rng.choice(["Same", "x", None])) for k in range(700)] + [(5, "s", "hot", 1, "A repeated row")] * 300
    rows += [(k, None, lang, None, "Tail T") for k, lang in enumerate(["", None, "é", "z", "日", "a b", "ab", "A"] * 8 + ["lone", "two", "two"])]
    rows += [(None, None, None, None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = frame.select("*", *[F.lit("x").alias(c) for c in ("g", "part", "seq", "leaf", "claimed", "n", "i", "_copy")])
    assert as_rows(manifest_table(clash.repartition(7))) == plain_manifest(rows)
    one = spark.createDataFrame([(7, "s", "en", 1, "Lone")], frame.schema)
    assert as_rows(manifest_table(one)) == plain_manifest([(7, "s", "en", 1, "Lone")])
    assert manifest_table(frame.limit(0)).count() == 0


def test_proofs_are_returned_and_fold(spark):
    from lexmill.llm.merkle import fold, leaf_digest, merkle_manifest

    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, "a").otherwise("b").alias("lang"))
    leaves = docs.select("*", leaf_digest(F.col("doc_id"), F.col("lang")).alias("leaf"))
    got = merkle_manifest(leaves).collect()
    assert len({r["root"] for r in got}) == 1 and {(r["leaves"], r["trees"]) for r in got} == {(800, 2), (200, 2)}
    for r in got[::17]:
        places = [(r["index"], r["leaves"]), (r["tree_index"], r["trees"])]
        proof = "".join(r["proof"]).encode()
        assert fold(r["leaf"].encode(), proof, places).decode() == r["root"]
        assert fold(b"0" * 64, proof, places).decode() != r["root"]


def test_stretches_of_trees_meet_at_their_ragged_sides():
    from lexmill.llm.merkle import ragged, stretch_levels

    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 700)
        leaves = [str(k).encode() for k in range(n)]
        whole = stretch_levels(leaves, 0, n)
        cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 5)))})
        tops = [t for a, b in zip(cuts, cuts[1:]) for t in ragged(stretch_levels(leaves[a:b], a, n))]
        covered = Counter(j for k, i, _ in tops for j in range(i * 8**k, min((i + 1) * 8**k, n)))
        assert covered == Counter(range(n))
        assert all(whole[k][1][i] == d for k, i, d in tops)
        assert len(tops) <= 14 * 5 * len(cuts)


# --- fill in the middle ------------------------------------------------------------------------


def plain_middle(doc_id, text):
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'-' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(8)
    letters = "ab<>PSM é日ÿ😀́\n\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return texts + ["", None, "😀", "<", "<P", "S>", "a<S", "<<S>", "x<M>y", "😀" * 70_000, "é" * 9000, "z" * 3_000_000]


def test_middles_equal_plain_ones_and_come_back(spark, docs, rows):
    from lexmill.llm.fill_middle import fill_in_middle, fill_in_middle_table, restored

    own = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "null id"), (3, "again"), (3, "again")]
    frame = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    for df, source in ((docs, [(r[0], r[1]) for r in rows]), (frame, own)):
        got = fill_in_middle(df).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
        assert sorted((tuple(r[:6]) for r in got), key=repr) == sorted((plain_middle(i, t) for i, t in source), key=repr)
        assert Counter(r["back"] for r in got) == Counter(t or "" for _, t in source)
        table = fill_in_middle_table(df).collect()
        want = [(*p[:5], sha(p[5]), sha(t or "")) for (i, t) in source for p in [plain_middle(i, t)]]
        assert sorted(map(tuple, table), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_middles_of_an_empty_table(no_docs):
    from lexmill.llm.fill_middle import fill_in_middle_table

    assert fill_in_middle_table(no_docs).count() == 0


def test_other_marks_and_rates(spark):
    from lexmill.llm.fill_middle import fill_in_middle, restored

    marks = ("<|pre|>", "<|suffix|>", "<m>")
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é<P> "), (F.col("id") % 9).cast("int")).alias("text"))
    got = fill_in_middle(df, seed=4, percent=100, suffix_first=50, marks=marks).withColumn("back", restored(F.col("output"), F.col("form"), marks)).join(df, "doc_id").collect()
    assert all(r["back"] == r["text"] for r in got)
    forms = Counter(r["form"] for r in got)
    assert forms["plain"] == sum(not r["text"] for r in got) and abs(forms["psm"] - forms["spm"]) < 100


def test_rank_and_select_equal_counting():
    from lexmill.llm.fill_middle import CharacterStarts

    rng = random.Random(5)
    for size in (0, 1, 63, 64, 65, 511, 512, 513, 5000):
        text = "".join(rng.choice("aé日😀") for _ in range(size))
        data = np.frombuffer(text.encode(), np.uint8)
        starts = CharacterStarts(data)
        at = [len(text[:k].encode()) for k in range(size + 1)]
        assert starts.total == size
        assert starts.select(np.arange(size + 1)).tolist() == at
        inner = (data & 0xC0) != 0x80
        assert starts.rank(np.arange(len(data) + 1)).tolist() == [int(x) for x in np.concatenate(([0], np.cumsum(inner)))]


# --- best-fit decreasing -----------------------------------------------------------------------


def plain_windows(lengths, room):
    """Space left in each window, piece by piece."""
    left = []
    for v in sorted(lengths, reverse=True):
        fits = [s for s in left if s >= v]
        if fits:
            left[left.index(min(fits))] -= v
        else:
            left.append(room - v)
    return Counter(left)


def histogram(lengths, room):
    return np.bincount(lengths, minlength=room + 1)


def check_plan(plan, lengths, room):
    """Every token of every piece lies in one place; nothing overlaps."""
    used = defaultdict(list)
    for capacity, items, n in plan.windows():
        assert sum(x[3] for x in items) + capacity == room and n > 0
        for v, low, a, size in items:
            for j in range(low, low + n):
                used[v, j].append((a, size))
    want = {(v, j) for v, c in Counter(lengths).items() for j in range(c)}
    assert set(used) == want
    for (v, _), parts in used.items():
        at = 0
        for a, size in sorted(parts):
            assert a == at and size > 0
            at += size
        assert at == v


def test_plans_are_those_of_best_fit_decreasing():
    from lexmill.llm.windows import best_fit_decreasing

    rng = random.Random(9)
    for room in (1, 2, 7, 16, 64, 100):
        for _ in range(30):
            lengths = [rng.choice([rng.randint(1, room), 1 + rng.randrange(room) // 3]) for _ in range(rng.randint(1, 200))]
            plan = best_fit_decreasing(histogram(lengths, room), room)
            check_plan(plan, lengths, room)
            got = Counter()
            for c, _, n in plan.windows():
                got[c] += n
            assert got == plain_windows(lengths, room)


def test_the_segment_tree_finds_the_tightest_window():
    from lexmill.llm.windows import OpenWindows

    rng = random.Random(4)
    for room in (1, 5, 8, 31, 32):
        tree, have = OpenWindows(room), Counter()
        for _ in range(400):
            c = rng.randint(0, room)
            step = rng.choice([1, -1]) if have[c] else 1
            tree.add(c, step)
            have[c] += step
            live = [k for k in have if have[k]]
            for need in range(room + 1):
                assert tree.tightest(need) == min((k for k in live if k >= need), default=None)
            assert tree.widest() == max(live, default=None)


def test_gaps_are_filled_down_to_the_padding_asked_for():
    from lexmill.llm.windows import best_fit_decreasing, fill_gaps, padding

    rng = random.Random(2)
    for lengths in ([40] * 300, [33, 34, 35] * 50 + [1] * 3, [rng.randint(1, 64) for _ in range(500)], [64] * 5, [3]):
        plan = best_fit_decreasing(histogram(lengths, 64), 64)
        for most in (0, len(lengths), 10**9):
            out = fill_gaps(best_fit_decreasing(histogram(lengths, 64), 64), most)
            check_plan(out, lengths, 64)
            assert padding(out) <= max(most, 63) or padding(out) <= padding(plan) == 0
        assert fill_gaps(plan, 10**9) is plan
    tight = fill_gaps(best_fit_decreasing(histogram([40] * 300, 64), 64), 0)
    assert sum(n for _, _, n in tight.windows()) == -(-300 * 40 // 64)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_windows(got, source, room=2048):
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    want = Counter()
    ids_of = defaultdict(list)
    for i, t in source:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] += len(ids)
        ids_of[i].append(ids)
    have, windows = Counter(), defaultdict(list)
    for r in got:
        have[r["doc_id"]] += r["length"]
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        cuts = [x[r["start"] : r["start"] + r["length"]] for x in ids_of[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(crc(c) == r["ids_crc32"] and len(c) == r["length"] for c in cuts)
        if "ids" in r:
            assert list(r["ids"]) in cuts
    assert have == want
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return sum(room - sum(x[1] for x in p) for p in windows.values())


def test_documents_are_packed_whole(spark, docs, rows, no_docs):
    from lexmill.llm.windows import pack_windows

    source = [(r[0], r[1]) for r in rows]
    check_windows([r.asDict() for r in pack_windows(docs, TOKENIZER).collect()], source)
    check_windows([r.asDict() for r in pack_windows(docs, TOKENIZER, with_ids=True).collect()], source)
    loose = [r.asDict() for r in pack_windows(docs, TOKENIZER, most_padding=1).collect()]
    check_windows(loose, source)
    assert all(r["start"] % 2048 == 0 for r in loose)
    assert pack_windows(no_docs, TOKENIZER).count() == 0


def test_pieces_are_cut_when_padding_would_be_large(spark):
    from lexmill.llm.windows import pack_windows

    source = [(k, "one two three four five six " * 100) for k in range(40)] + [(None, None), (7, "x"), (7, "x")]
    frame = spark.createDataFrame(source, "doc_id long, text string").repartition(3)
    for with_ids in (False, True):
        got = [r.asDict() for r in pack_windows(frame, TOKENIZER, room=1024, most_padding=0, with_ids=with_ids).collect()]
        assert check_windows(got, source, 1024) < 1024
