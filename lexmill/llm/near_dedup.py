"""MinHash near-duplicate groups with fast similarity sketching.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in round i every shingle is hashed to one bin and
a value; a bin keeps the least (round, value). Rounds 0..t-1 choose the bin by the hash,
rounds t..2t-1 send everything to bin i-t, so every bin fills; work stops at the first
round after which all bins are full. Expected work is |shingles| + t log t instead of
|shingles| * t.

Plan: one Arrow pass makes a row per document (set size, 128-bit set fingerprint, band
keys). Documents with equal sets collapse to one class, so copies cost nothing further.
Per band bucket each class is paired with the smallest class only (a star: linear in the
bucket), and links are confirmed on the full shingle sets. Where a bucket still holds
several components after that, its members meet in cells of bounded size: the members of
its most common component and the others are cut into blocks, and every pair of blocks that
isn't of that component alone is a cell. In a cell all intersections across components are
counted exactly and at most one link per document comes out; so no link that can join
components is lost, and no pair rows are made. Buckets with the same members are compared
once. Texts travel once per bucket of up to 256 members; in a larger bucket those of its
most common component travel once per 256 of the others, and the others once per 256 members:
quadratic only in members that no star and no component joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm import wordhash as wh
from lexmill.llm.cluster import components, saved, scratch, small_batches, tasks_for, text_bytes

U64 = np.uint64
FULL = U64(0xFFFFFFFFFFFFFFFF)
PIECE = 1 << 20
BLOCK_DOCS, BLOCK_SHINGLES = 256, 300_000
#: pairs of one text that meet under one key
STAR_ROWS = 500


def fast_sketch(values: np.ndarray, doc: np.ndarray, n_docs: int, bins: int) -> np.ndarray:
    """[n_docs, bins] sketches of non-empty documents; documents without values keep all ones."""
    out = np.full(n_docs * bins, FULL, dtype=U64)
    seeds = wh.stream(77, 2 * bins)
    here, owner = values, doc
    for i in range(2 * bins):
        if not len(here):
            break
        h = wh.mix(here ^ seeds[i])
        at = ((h >> U64(32)) * U64(bins)) >> U64(32) if i < bins else np.full(len(h), i - bins, dtype=U64)
        np.minimum.at(out, owner * bins + at.astype(np.int64), (U64(i) << U64(32)) | (h & U64(0xFFFFFFFF)))
        open_docs = (out.reshape(n_docs, bins) == FULL).any(axis=1)
        if not open_docs[owner].all():
            left = open_docs[owner]
            here, owner = here[left], owner[left]
    return out.reshape(n_docs, bins)


def _band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.repeat(wh.stream(5, bands)[None, :], len(sketch), axis=0)
    for r in range(rows):
        key = wh.mix(key ^ cut[:, :, r])
    return key


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _sketches(bands: int, rows: int, key: int):
    def run(batches):
        for batch in batches:
            data, off = wh.utf8(batch.column(1))
            for a, b in wh.pieces(off, PIECE, wh.MOST_DOCS):
                n = b - a
                values, doc, first = wh.shingle_sets(data[off[a] : off[b]], off[a : b + 1] - off[a], key=key)
                keys = _band_keys(fast_sketch(values, doc, n, bands * rows), bands, rows)
                sums = [np.concatenate((np.zeros(1, U64), np.cumsum(wh.mix(values + U64(s)), dtype=U64))) for s in (1, 2)]
                prints = [(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums]
                size = np.diff(first)
                some = size > 0
                spans = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(spans), pa.array(keys[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n).cast(pa.int64()), pa.array(size.astype(np.int64)), *map(pa.array, prints), lists], schema=_SKETCHED)

    return run


def _overlapping(percent: int, key: int):
    """The pairs (a, b) of (a, b, ta, tb) whose texts' shingle sets overlap enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            left, right = wh.utf8(batch.column(2)), wh.utf8(batch.column(3))
            for a, b in wh.pieces(left[1] + right[1], PIECE, wh.MOST_DOCS):
                sets = [wh.shingle_sets(d[o[a] : o[b]], o[a : b + 1] - o[a], key=key) for d, o in (left, right)]
                both_keys = np.sort(np.concatenate([(doc.astype(U64) << U64(wh.SHINGLE_BITS)) | v for v, doc, _ in sets]))
                twice = both_keys[1:][both_keys[1:] == both_keys[:-1]] >> U64(wh.SHINGLE_BITS)
                both = np.bincount(twice.astype(np.int64), minlength=b - a)
                total = sum(np.diff(first) for _, _, first in sets)
                link = pa.array(100 * both >= percent * (total - both))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a).filter(link) for k in (0, 1)], schema=schema)

    return run


def _links_in(sets: list[np.ndarray], comp: np.ndarray, sides: tuple[np.ndarray, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of components with a link between some text of the one side and some of the other: a spanning forest of them.

    sets: ascending distinct shingles of each text; comp: its component; sides: positions of the texts.
    """
    size = np.array([len(x) for x in sets])
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), size)
    place = np.full((2, len(sets)), -1)
    for k in range(2):
        place[k, sides[k]] = np.arange(len(sides[k]))
    # intersections of all pairs at once: products of 0/1 columns, a slice of the shared shingles at a time
    order = np.argsort(values, kind="stable")
    values, doc = values[order], doc[order]
    column = np.cumsum(np.concatenate(([True], values[1:] != values[:-1]))) - 1
    shared = np.bincount(column)[column] > 1
    column, doc = np.unique(column[shared], return_inverse=True)[1], doc[shared]
    both = np.zeros((len(sides[0]), len(sides[1])), np.float32)
    width = min(2048, int(column.max(initial=-1)) + 1)
    for low in range(0, int(column.max(initial=-1)) + 1, width or 1):
        part = slice(*np.searchsorted(column, [low, low + width]))
        grids = []
        for k in range(2):
            at = place[k, doc[part]]
            grid = np.zeros((len(sides[k]), width), np.float32)
            grid[at[at >= 0], column[part][at >= 0] - low] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    total = size[sides[0]][:, None] + size[sides[1]][None, :]
    link = 100 * both.astype(np.int64) >= percent * (total - both.astype(np.int64))
    link &= comp[sides[0]][:, None] != comp[sides[1]][None, :]
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for a, b in zip(*np.nonzero(link), strict=True):
        x, y = int(comp[sides[0][a]]), int(comp[sides[1][b]])
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _bridges(percent: int, secret: int):
    """Links that join components, from a bundle of cells (cell, i, j, own, rep, c, text): in a cell texts of block i meet those of block j."""

    def run(table: pa.Table) -> pa.Table:
        data, off = wh.utf8(table.column("text"))
        cell, own, i, j, rep, comp = (np.asarray(table.column(c).combine_chunks()) for c in ("cell", "own", "i", "j", "rep", "c"))
        _, first, back = np.unique(rep, return_index=True, return_inverse=True)
        sets: list[np.ndarray] = []
        for k in first:  # each text once
            values, _, _ = wh.shingle_sets(data[off[k] : off[k + 1]], np.array([0, off[k + 1] - off[k]]), key=secret)
            sets.append(values)
        out = []
        for key in np.unique(np.stack((cell, i, j)), axis=1).T:
            mine = np.flatnonzero((cell == key[0]) & (i == key[1]) & (j == key[2]))
            sides = tuple(np.flatnonzero(own[mine] == x) for x in (key[1], key[2]))
            if len(sides[0]) and len(sides[1]):
                out += _links_in([sets[b] for b in back[mine]], comp[mine], sides, percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def _cells(mixed: DataFrame) -> DataFrame:
    """cell, i, j, own, rep, n, c: who meets whom in the buckets of mixed (cell, rep, n, c), in which several components are left."""
    counts = mixed.groupBy("cell", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    top = counts.groupBy("cell").agg(F.max(F.struct("m", F.col("c").alias("main"), F.col("s").alias("ms"))).alias("top"), F.sum("m").alias("all_m"), F.sum("s").alias("all_s"))
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK_DOCS), F.ceil(n / BLOCK_SHINGLES)).cast("int")
    many = blocks(F.col("all_m"), F.col("all_s")) > 1
    # all in block 0 if they fit; else blocks of the main component, then blocks of the others
    top = top.select("cell", "top.main", F.when(many, blocks(F.col("top.m"), F.col("top.ms"))).otherwise(0).alias("nm"), F.when(many, blocks(F.col("all_m") - F.col("top.m"), F.col("all_s") - F.col("top.ms"))).otherwise(1).alias("no"))
    placed = mixed.join(top, "cell")
    is_main = (F.col("nm") > 0) & (F.col("c") == F.col("main"))
    own = F.when(is_main, F.pmod(F.xxhash64("rep"), F.col("nm"))).otherwise(F.col("nm") + F.pmod(F.xxhash64("rep"), F.col("no"))).cast("int")
    others = F.when(is_main, F.sequence("nm", F.col("nm") + F.col("no") - 1)).otherwise(F.sequence(F.lit(0), F.col("nm") + F.col("no") - 1))
    met = placed.withColumn("own", own).withColumn("other", F.explode(others))
    return met.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "c")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, key: int) -> DataFrame:
    """The pairs (a, b, m) whose sets overlap enough, by the whole texts. A text that is paired with many, m at least, is dealt over several keys."""
    salts = lambda m: F.ceil(m / STAR_ROWS).cast("int")
    hubs = pairs.groupBy("a").agg(salts(F.max("m")).alias("salts"))
    hubs = hubs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    sides = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), salts(F.col("m"))).cast("int")).join(hubs, ["a", "salt"])
    sides = sides.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return sides.mapInArrow(_overlapping(percent, key), "a long, b long")


def near_duplicate_groups(docs: DataFrame, percent: int = 85, bands: int = 32, rows: int = 7) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of distinct
    5-word shingles (A-Z lower-cased; fewer words: the whole sequence). component_id is the
    smallest doc_id reachable, kept says that it is the document itself.

    With 32 bands of 7 coordinates a pair exactly at 0.85 escapes every band with
    probability (1 - 0.85**7)**32 = 5e-6; pairs further up less.

    Null or empty text, or text without words: no shingles, linked with nothing, kept.
    Null doc_id: linked with nothing, component_id null, kept. Rows that share a doc_id
    are one document for links. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = text_bytes(docs)[1]
    parts, secret = tasks_for(size, 16 << 20, spark), wh.fresh_key()
    sketched = docs.mapInArrow(_sketches(bands, rows, secret), "doc_id long, n_shingles long, fp1 long, fp2 long, keys array<long>")
    path = scratch(spark, "sketches")
    sketched.write.parquet(path)
    sketched = spark.read.parquet(path)

    same = ["n_shingles", "fp1", "fp2"]
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    one = sketched.join(classes.withColumnRenamed("rep", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates(["doc_id", *same])
    members = one.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.posexplode("keys").alias("band", "key"))
    low = members.groupBy("band", "key").agg(F.min(F.struct("rep", "n")).alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = saved(members.join(low, ["band", "key"]).select("band", "key", "rep", "n", "low", "m"))

    fits = f"100 * least(n, low.n) >= {percent} * greatest(n, low.n)"
    star = members.where("rep <> low.rep").where(fits).select(F.col("low.rep").alias("a"), F.col("rep").alias("b"), "m")
    star = saved(star.groupBy("a", "b").agg(F.max("m").alias("m")))
    texts = docs.where("doc_id is not null").repartition(parts, "doc_id")
    links = saved(_confirmed(star, texts, percent, secret))
    found = components(links)

    # Buckets that still hold several components: compare across components, cell by cell.
    tagged = members.join(found, members.rep == found.node, "left").select("band", "key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    prints = [F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("x2")]
    mixed = tagged.groupBy("band", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), *prints).where("lo <> hi")
    mixed = mixed.groupBy("m", "x1", "x2").agg(F.min(F.struct("band", "key")).alias("k")).select("k.band", "k.key", F.xxhash64("k.band", "k.key").alias("cell"))
    tagged = saved(tagged.join(mixed, ["band", "key"]).select("cell", "rep", "n", "c"))
    if not tagged.isEmpty():
        cells = saved(_cells(tagged))
        sums = cells.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).first()
        bundles = max(parts, -(-sums["m"] // BLOCK_DOCS), -(-sums["n"] // BLOCK_SHINGLES))
        bundle = F.pmod(F.xxhash64("cell", "i", "j"), F.lit(bundles)).cast("int")
        met = cells.drop("n").withColumn("bundle", bundle).join(texts.withColumnRenamed("doc_id", "rep"), "rep")
        more = saved(met.groupBy("bundle").applyInArrow(_bridges(percent, secret), "a long, b long"))
        found = components(more.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    by_class = classes.join(found, classes.rep == found.node, "left").select(*same, F.coalesce("component", "rep").alias("component"))
    out = sketched.select("doc_id", *same).join(by_class, same, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))
