"""A Merkle manifest: one digest per row, an 8-ary tree per group, one root over the groups, a proof per row.

H is the lower-case hex sha256 of its inputs, concatenated; digests enter as hex text. In a
tree every 8 consecutive nodes of a level (the last run may have fewer, even one) become
their H, until one node remains.

1. The digests, not the rows, are sorted by range over (group, order) and kept by a
   checkpoint, whose partitions stay as they are. A group may span many partitions.
2. Each partition counts its first and its last group, which alone may reach beyond it; the
   running totals say at which leaf of which tree it starts.
3. A partition builds all nodes whose leaves it has. What remains without a parent there,
   at most 14 nodes a level on its two ragged sides, is shuffled by coordinate (group, parent)
   and finished level by level; paths of siblings come back down the same way.
4. The roots of the groups are the leaves of one more tree, grown by the same steps.
5. Rows meet the paths of their own partition and complete their proofs there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.cluster import saved

ARITY = 8
#: leaves of a partition
PART_ROWS, PART_ROWS_WITH_PROOFS = 1 << 16, 1 << 14
_HEX = 64


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` if null, else its UTF-8 byte count, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def node_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def stretch_levels(leaves: list[bytes], low: int, total: int) -> list[tuple[int, list[bytes]]]:
    """By level (first index, nodes): all nodes of a tree of `total` leaves that leaves[low : low + len] suffice for."""
    out, nodes, n = [(low, leaves)], leaves, total
    while n > 1:
        high, n_up = low + len(nodes), -(-n // ARITY)
        first, last = -(-low // ARITY), n_up if low + len(nodes) == n else high // ARITY
        if first >= last:
            break
        nodes = [node_digest(nodes[ARITY * j - low : ARITY * j + ARITY - low]) for j in range(first, last)]
        low, n = first, n_up
        out.append((low, nodes))
    return out


def ragged(levels: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, bytes]]:
    """(level, index, digest) of the nodes whose parent isn't among the levels."""
    out = []
    for k, (low, nodes) in enumerate(levels):
        covered = range(0)
        if k + 1 < len(levels):
            up, above = levels[k + 1]
            covered = range(ARITY * up, ARITY * (up + len(above)))
        out += [(k, low + j, d) for j, d in enumerate(nodes) if low + j not in covered]
    return out


def fold(node: bytes, proof: bytes, places: list[tuple[int, int]]) -> bytes:
    """The root that a digest and its siblings give. places: (index, leaves) in each tree on the way, lowest first."""
    at = 0
    for i, n in places:
        while n > 1:
            first = i - i % ARITY
            size = _HEX * (min(ARITY, n - first) - 1)
            siblings, left = proof[at : at + size], _HEX * (i - first)
            node = hashlib.sha256(siblings[:left] + node + siblings[left:]).hexdigest().encode()
            at, i, n = at + size, i // ARITY, -(-n // ARITY)
    return node


def _bounds(table: pa.Table | pa.RecordBatch, column: str) -> list[int]:
    """Where runs of equal values of a sorted column begin, and its length."""
    values = table.column(column).to_pylist()
    return [k for k in range(len(values)) if not k or values[k] != values[k - 1]] + [len(values)]


_TOPS = "part int, g string, low long, n long, level int, i long, digest string"


def _local(places: np.ndarray):
    """Emits the ragged nodes of a partition. places[part]: leaves before its first group here, leaves of its first and last group in all."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tables = [pa.Table.from_batches([b.select(["g", "leaf"])]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        cuts = _bounds(table, "g")
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            low = int(places[part, 0]) if k == 0 else 0
            n = int(places[part, 2]) if k == len(cuts) - 2 else int(places[part, 1]) if k == 0 else b - a
            leaves = [x.encode() for x in table.column("leaf").slice(a, b - a).to_pylist()]
            tops = ragged(stretch_levels(leaves, low, n))
            g = table.column("g")[a].as_py()
            level, i, digest = zip(*tops, strict=True)
            m = len(tops)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * m, pa.int32()), "g": [g] * m, "low": pa.array([low] * m, pa.int64()), "n": pa.array([n] * m, pa.int64()), "level": pa.array(level, pa.int32()), "i": pa.array(i, pa.int64()), "digest": [d.decode() for d in digest]})

    return run


def _places(rows: DataFrame) -> np.ndarray:
    """[partitions, 3]: see _local; from the counts of the first and last group of each partition, which alone come to the driver."""
    counts = rows.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n"))
    ends = counts.groupBy("part").agg(F.min(F.struct("g", "n")).alias("a"), F.max(F.struct("g", "n")).alias("b"))
    found = sorted(ends.select("part", F.sha2("a.g", 256), "a.n", F.sha2("b.g", 256), "b.n").collect())
    size = max((r[0] for r in found), default=-1) + 1
    before, first, last, totals, open_g = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), [], None
    for part, g, n, last_g, last_n in found:  # totals: of the groups at the ends of partitions, in order
        if g != open_g:
            totals.append(0)
        before[part], first[part] = totals[-1], len(totals) - 1
        totals[-1] += n
        if last_g != g:
            totals.append(last_n)
        last[part], open_g = len(totals) - 1, last_g
    sums = np.array(totals or [0], np.int64)
    return np.stack([before, sums[first], sums[last]], axis=1)


def _finished(tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tops with the path of siblings of each up to its tree's root; g, n, digest of the roots)."""
    most = tops.agg(F.max("n")).first()[0] or 0
    height = 0
    while ARITY**height < most:
        height += 1
    made, runs, roots = None, [], []
    for k in range(height + 1):
        here = tops.where(F.col("level") == k).select("g", "n", "i", "digest")
        here = here if made is None else here.unionByName(made)
        roots.append(here.where(F.col("n") <= ARITY**k).select("g", "n", "digest"))
        if k == height:
            break
        run = here.where(F.col("n") > ARITY**k).groupBy("g", F.floor(F.col("i") / ARITY).alias("up")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("nodes"))  # at most 8 nodes
        runs.append(saved(run))
        made = runs[-1].select("g", "n", F.col("up").alias("i"), F.sha2(F.concat_ws("", "nodes.digest").cast("binary"), 256).alias("digest"))
    paths = [None] * (height + 1)  # by level: g, i, path of what has a parent
    for k in reversed(range(height)):
        members = runs[k].select("g", "up", F.explode("nodes.i").alias("i"), "nodes")
        own = members.select("g", "up", "i", F.expr("transform(filter(nodes, x -> x.i <> i), x -> x.digest)").alias("own"))
        if paths[k + 1] is None:
            paths[k] = own.select("g", "i", F.col("own").alias("path"))
        else:
            above = paths[k + 1].select("g", F.col("i").alias("up"), F.col("path").alias("rest"))
            paths[k] = own.join(above, ["g", "up"], "left").select("g", "i", F.concat("own", F.coalesce("rest", F.array().cast("array<string>"))).alias("path"))
        paths[k] = saved(paths[k]) if k else paths[k]
    found = [p.withColumn("level", F.lit(k)) for k, p in enumerate(paths) if p is not None]
    none = F.array().cast("array<string>")
    if not found:
        return tops.withColumn("path", none), roots[0]
    every = found[0]
    for p in found[1:]:
        every = every.unionByName(p)
    root = roots[0]
    for r in roots[1:]:
        root = root.unionByName(r)
    return tops.join(every, ["g", "level", "i"], "left").withColumn("path", F.coalesce("path", none)), root


def _grown(leaves: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: leaves (g, leaf, ...) with part and seq, in order; tops with paths; roots)."""
    dealt = leaves.withColumn("_copy", F.monotonically_increasing_id())  # so that repeated rows part
    keys = ["g", *order, "leaf", "_copy"]
    kept = saved(dealt.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_copy"))
    at = F.monotonically_increasing_id()
    rows = kept.withColumn("part", F.shiftright(at, 33).cast("int")).withColumn("seq", at.bitwiseAND(F.lit((1 << 33) - 1)))
    tops = saved(kept.mapInArrow(_local(_places(rows)), _TOPS))
    return (rows, *_finished(tops))


def _proven(claimed: bool, with_proofs: bool):
    """Completes the proofs of a partition's rows; checks a second digest by its proof if there is one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("seq")
        tops: dict[str, list[dict]] = {}
        for r in right.to_pylist():
            tops.setdefault(r["g"], []).append(r)
        cuts = _bounds(left, "g")
        out = {k: [] for k in ("index", "leaves", "tree_index", "trees", "subroot", "root", "proof_sha256", "proof", "folded_root")}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = tops[left.column("g")[a].as_py()]
            one = own[0]  # what concerns the whole stretch is the same in all
            leaves = [x.encode() for x in left.column("leaf").slice(a, b - a).to_pylist()]
            levels = stretch_levels(leaves, one["low"], one["n"])
            paths = [{} for _ in levels]
            for r in own:
                paths[r["level"]][r["i"]] = "".join(r["path"]).encode()
            for k in reversed(range(1, len(levels))):  # paths of inner nodes, of all but the leaves
                _down(levels, paths, k, range(levels[k][0], levels[k][0] + len(levels[k][1])))
            checks = left.column("claimed").slice(a, b - a).to_pylist() if claimed else []
            for j, leaf in enumerate(leaves):
                i = one["low"] + j
                proof = _down(levels, paths, 0, [i])
                del paths[0][i]
                out["index"].append(i)
                out["proof_sha256"].append(hashlib.sha256(proof).hexdigest())
                if with_proofs:
                    out["proof"].append([proof[x : x + _HEX].decode() for x in range(0, len(proof), _HEX)])
                if claimed:
                    out["folded_root"].append(fold(checks[j].encode() if checks[j] is not None else leaf, proof, [(i, one["n"]), (one["tree"], one["trees"])]).decode())
            for name, key in (("leaves", "n"), ("tree_index", "tree"), ("trees", "trees"), ("subroot", "subroot"), ("root", "root")):
                out[name] += [one[key]] * (b - a)
        kinds = {"index": pa.int64(), "leaves": pa.int64(), "tree_index": pa.int64(), "trees": pa.int64(), "proof": pa.list_(pa.string())}
        made = {"doc_id": left.column("doc_id"), "leaf": left.column("leaf")} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items() if (k != "proof" or with_proofs) and (k != "folded_root" or claimed)}
        return pa.table(made)

    return run


def _down(levels, paths, k: int, indices) -> bytes:
    """Notes the paths of nodes of level k: their siblings, then their parent's path; gives the last."""
    low, nodes = levels[k]
    path = b""
    for i in indices:
        path = paths[k].get(i)
        if path is None:
            first = i - i % ARITY
            run = nodes[max(first - low, 0) : first + ARITY - low]
            path = b"".join(run[: i - first] + run[i - first + 1 :]) + paths[k + 1][i // ARITY]
            paths[k][i] = path
    return path


def merkle_manifest(leaves: DataFrame, claimed: bool = False, with_proofs: bool = True) -> DataFrame:
    """Proofs of leaves (doc_id long, lang string, leaf string; with claimed also claimed string).

    Per row: doc_id, leaf, index (of the leaf in its language's tree), leaves (of that tree),
    tree_index, trees, subroot, root, proof_sha256 and, as asked for, proof (the siblings on
    the way to the root) and folded_root (what claimed, or the leaf where it is null, folds to).

    Leaves of a language ascend by doc_id, null first; rows of one doc_id by their digests.
    Languages ascend by UTF-8 bytes, null first and apart from the empty string. Repeated rows
    are leaves each. Other columns are ignored. An empty table gives no rows.
    """
    columns = ["doc_id", "leaf", *["claimed"] * claimed]
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    keyed = leaves.select(*columns, group.alias("g"))
    spark, total = leaves.sparkSession, leaves.count()
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-total // (PART_ROWS_WITH_PROOFS if with_proofs else PART_ROWS)))
    rows, tops, roots = _grown(keyed, ["doc_id"], parts)
    roots = saved(roots)

    upper = roots.select(F.lit("").alias("g"), F.col("g").alias("doc_id"), F.col("digest").alias("leaf"))
    few = max(1, -(-roots.count() // PART_ROWS_WITH_PROOFS))
    upper_rows, upper_tops, upper_root = _grown(upper, ["doc_id"], few)
    upper_tops = upper_tops.join(upper_root.select("g", F.col("digest").alias("root")), "g")
    upper_tops = upper_tops.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(0).cast("long").alias("tree"), F.lit(1).cast("long").alias("trees"))
    trees = saved(_attached(upper_rows, upper_tops, False, True, "string").select(F.col("doc_id").alias("g"), F.col("leaf").alias("subroot"), F.col("index").alias("tree"), F.col("leaves").alias("trees"), "root", F.col("proof").alias("rest")))

    tops = tops.join(trees, "g").withColumn("path", F.concat("path", "rest")).drop("rest")
    return _attached(rows, tops, claimed, with_proofs, "long")


def _attached(rows: DataFrame, tops: DataFrame, claimed: bool, with_proofs: bool, key: str) -> DataFrame:
    ddl = f"doc_id {key}, leaf string, index long, leaves long, tree_index long, trees long, subroot string, root string, proof_sha256 string" + ", proof array<string>" * with_proofs + ", folded_root string" * claimed
    tops = tops.select("part", "g", "low", "n", "level", "i", "path", "tree", "trees", "subroot", "root")
    return rows.groupBy("part").cogroup(tops.groupBy("part")).applyInArrow(_proven(claimed, with_proofs), ddl)


def manifest_table(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of docs (doc_id, source, lang, n_chars, text).

    Nulls are values of their own. folded_root: from a leaf whose text has A-Z lower-cased,
    where 3 divides the crc32 of doc_id, written as a decimal, and the siblings of the original; rows without
    doc_id aren't tampered with. Other columns are ignored.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    claimed = F.when(tampered, leaf_digest(*head, F.translate("text", upper, lower)))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_digest(*head, F.col("text")).alias("leaf"), claimed.alias("claimed"))
    out = merkle_manifest(leaves, claimed=True, with_proofs=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
