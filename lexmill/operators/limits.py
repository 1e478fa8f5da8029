"""Why a request has no route, and the route that the least rise of a limit gives it.

An edge carries a bit for each limit that it breaks; a path breaks the limits of all its
edges, and one more if it is too long. What stands between a request and a route are the
smallest sets of limits that some path breaks: an empty set is a route, {size} a route if
the size limit went. Searches go forward from all requested sources at once, a hop a round,
and keep the smallest sets per (source, node) alone, 2**(number of limits) at most; the last hop comes
from the requested targets, so the widest round never has to be made for targets nobody
asked for. The hop before it keeps the nodes alone from which a wanted target can be near: a
signature of 512 bits for each source says so before anything is exchanged, and the exact join
on the last hop settles the few that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.shared import saved


#: longs of a signature
WORDS = 8


def _bit(node: Column) -> tuple[Column, Column]:
    """(long, bit in it) of a node in a signature."""
    h = F.xxhash64(node)
    return F.pmod(F.shiftright(h, 6), F.lit(WORDS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))


def signature(node: Column) -> Column:
    """The signature of a group's nodes, an aggregate."""
    word, bit = _bit(node)
    return F.array(*[F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))) for k in range(WORDS)])


def may_hold(wanted: Column, node: Column) -> Column:
    """Whether the node can be one of a signature: never false for one that is."""
    word, bit = _bit(node)
    return F.get(wanted, word).bitwiseAND(bit) != 0


def _ahead(front: DataFrame, onward: DataFrame, wanted: DataFrame | None) -> DataFrame:
    """front (src, node, ..) one hop on along onward (node, to, ..); with wanted (src, wanted) only to nodes that may be wanted."""
    if wanted is None:
        return front.join(onward, "node")
    return front.join(wanted, "src").join(onward, "node").where(may_hold(F.col("wanted"), F.col("to"))).drop("wanted")


def minimal(masks: Column) -> Column:
    """Those of an array of bit sets that contain no other, ascending."""
    return F.array_sort(F.filter(masks, lambda m: ~F.exists(masks, lambda k: (k != m) & (k.bitwiseAND(m) == k))))


def _least_sets(paths: DataFrame, *by: str) -> DataFrame:
    """by, mask: the smallest bit sets of each group."""
    return paths.groupBy(*by).agg(minimal(F.collect_set("mask")).alias("masks")).select(*by, F.explode("masks").alias("mask"))


def limit_sets(edges: DataFrame, requests: DataFrame, max_hops: int, hop_bit: int, more_hops: int = 1) -> DataFrame:
    """req_id, masks: the smallest sets of limits on the way of each request (req_id, src, tgt).

    edges: src, tgt, mask (bits of the limits that an edge breaks, 0 for none). Paths of up to
    max_hops + more_hops edges are looked at; those longer than max_hops break hop_bit. masks: [0] if there is a
    route, empty if no path is, whatever is lifted. Edges or requests without an end have no
    path; of src = tgt only true rounds count. Repeated edges add nothing.
    """
    edges = saved(_least_sets(edges.where("src is not null and tgt is not null").select("src", "tgt", F.col("mask").cast("long").alias("mask")), "src", "tgt"))
    asked = saved(requests.select("req_id", "src", "tgt"))
    onward = edges.select(F.col("src").alias("node"), F.col("tgt").alias("to"), F.col("mask").alias("own"))
    inward = saved(asked.select("src", "tgt").distinct().join(edges.select(F.col("src").alias("node"), "tgt", F.col("mask").alias("own")), "tgt"))
    wanted = inward.groupBy("src").agg(signature(F.col("node")).alias("wanted"))
    seeds = asked.select("src").distinct()
    front = seeds.join(edges, "src").select("src", F.col("tgt").alias("node"), "mask")
    found = asked.select("src", "tgt").distinct().join(edges, ["src", "tgt"]).select("src", "tgt", "mask")
    for hops in range(2, max_hops + more_hops + 1):
        ends = front.join(inward, ["src", "node"]).select("src", "tgt", F.col("mask").bitwiseOR(F.col("own")).bitwiseOR(F.lit(hop_bit if hops > max_hops else 0)).alias("mask"))
        found = found.unionByName(_least_sets(ends, "src", "tgt"))
        if hops < max_hops + more_hops:
            front = saved(_least_sets(_ahead(front, onward, wanted if hops + 1 == max_hops + more_hops else None).select("src", F.col("to").alias("node"), F.col("mask").bitwiseOR(F.col("own")).alias("mask")), "src", "node"))
    sets = found.groupBy("src", "tgt").agg(minimal(F.collect_set("mask")).alias("masks"))
    return asked.join(sets, ["src", "tgt"], "left").select("req_id", F.coalesce("masks", F.array().cast("array<bigint>")).alias("masks"))


def named(masks: Column, names: dict[int, str]) -> Column:
    """Bit sets as text: names of a set joined by +, sets by |; nothing is on the way in the empty set."""
    one = lambda m: F.array_join(F.array_compact(F.array(*[F.when(m.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in sorted(names.items())])), "+")
    return F.array_join(F.transform(masks, one), "|")


def least_steps(edges: DataFrame, requests: DataFrame, max_hops: int | None) -> DataFrame:
    """req_id, step: the smallest size under which some path of edges (src, tgt, size) serves a request; no row where none does.

    max_hops None: paths of any length. Rounds go on until no (source, node) gets a smaller one.
    """
    asked = requests.select("req_id", "src", "tgt")
    least = saved(edges.where("src is not null and tgt is not null").groupBy("src", "tgt").agg(F.min("size").alias("size")))
    onward = least.select(F.col("src").alias("node"), F.col("tgt").alias("to"), F.col("size").alias("own"))
    every = saved(asked.select("src").distinct().join(least, "src").select("src", F.col("tgt").alias("node"), "size"))
    if max_hops is not None:  # the last hop comes from the targets
        pairs = asked.select("src", "tgt").distinct()
        inward = saved(pairs.join(least.select(F.col("src").alias("node"), "tgt", F.col("size").alias("own")), "tgt"))
        wanted = inward.groupBy("src").agg(signature(F.col("node")).alias("wanted"))
        found = pairs.join(least, ["src", "tgt"]).select("src", "tgt", "size")
    front, hops = every, 1
    while max_hops is None or hops < max_hops:
        if max_hops is not None:
            found = found.unionByName(front.join(inward, ["src", "node"]).select("src", "tgt", F.greatest("size", "own").alias("size")))
            if hops + 1 == max_hops:
                break
        last = max_hops is not None and hops + 2 == max_hops
        reached = _ahead(front, onward, wanted if last else None).select("src", F.col("to").alias("node"), F.greatest("size", "own").alias("size")).groupBy("src", "node").agg(F.min("size").alias("size"))
        if last:
            front, hops = reached, hops + 1
            continue
        better = saved(reached.join(every.withColumnRenamed("size", "had"), ["src", "node"], "left").where("had is null or size < had").drop("had"))
        if better.isEmpty():
            break
        every = saved(every.unionByName(better).groupBy("src", "node").agg(F.min("size").alias("size")))
        front, hops = better, hops + 1
    steps = every.withColumnRenamed("node", "tgt") if max_hops is None else found.groupBy("src", "tgt").agg(F.min("size").alias("size"))
    return asked.join(steps, ["src", "tgt"]).select("req_id", F.col("size").alias("step"))


def bottleneck_routes(edges: DataFrame, requests: DataFrame, max_hops: int | None = 3) -> DataFrame:
    """req_id, step, hops, nodes, models: the route of each request (req_id, src, tgt) whose largest model is smallest.

    edges: src, tgt, model, size. Of the routes under that size the shortest counts, of these the
    first by its nodes; on each edge the smallest model, the first by name. Requests that no
    path serves have nulls. src = tgt counts true rounds.
    """
    asked = saved(requests.select("req_id", "src", "tgt"))
    edges = saved(edges.where("src is not null and tgt is not null").groupBy("src", "tgt").agg(F.min(F.struct("size", "model")).alias("m")).select("src", "tgt", "m.size", "m.model"))
    steps = saved(least_steps(edges, asked, max_hops))
    open_ = saved(asked.join(steps, "req_id"))
    hop = edges.select(F.col("src").alias("node"), F.col("tgt").alias("to"), "size", "model")
    front = open_.select("req_id", F.col("tgt").alias("goal"), "step", F.col("src").alias("node"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("models"))
    wanted = open_.join(edges.select("src", "tgt", "size").withColumnRenamed("src", "node"), "tgt").where("size <= step").groupBy("req_id").agg(signature(F.col("node")).alias("wanted"))
    done, hops = None, 0
    while max_hops is None or hops < max_hops:
        hops += 1
        if hops == max_hops:  # nothing but the goals
            ahead = front.join(hop, (front["node"] == hop["node"]) & (front["goal"] == hop["to"])).drop(hop["node"])
        elif max_hops is not None and hops + 1 == max_hops:  # the goals, and where the last hop can start
            ahead = front.join(wanted, "req_id").join(hop, "node").where((F.col("to") == F.col("goal")) | may_hold(F.col("wanted"), F.col("to")))
        else:
            ahead = front.join(hop, "node")
        ahead = ahead.where("size <= step")
        ahead = ahead.select("req_id", "goal", "step", F.col("to").alias("node"), F.concat("nodes", F.array("to")).alias("nodes"), F.concat("models", F.array(F.col("model").cast("string"))).alias("models"))
        best = saved(ahead.groupBy("req_id", "goal", "step", "node").agg(F.min_by("models", "nodes").alias("models"), F.min("nodes").alias("nodes")))
        arrived = best.where("node = goal").select("req_id", F.lit(hops).alias("hops"), "nodes", "models")
        done = arrived if done is None else done.unionByName(arrived)
        if hops == max_hops or best.isEmpty():
            break
        front = saved(best.join(arrived.select("req_id"), "req_id", "left_anti").select("req_id", "goal", "step", "node", "nodes", "models"))
    empty = front.select("req_id", F.lit(0).alias("hops"), "nodes", "models").limit(0)
    return asked.select("req_id").join(steps, "req_id", "left").join(done if done is not None else empty, "req_id", "left")
