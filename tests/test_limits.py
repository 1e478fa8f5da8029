"""Limit sets and bottleneck routes against all paths of small graphs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import limits

HOP = 16


def walks(edges, src, tgt, most):
    """All walks of up to `most` edges."""
    front = [[e] for e in edges if e[0] == src]
    for _ in range(most):
        yield from (w for w in front if w[-1][1] == tgt)
        front = [w + [e] for w in front for e in edges if e[0] == w[-1][1]]


def graph(seed, nodes=6, n=14):
    rng = random.Random(seed)
    edges = [(rng.randrange(nodes), rng.randrange(nodes), f"m{rng.randrange(5)}", float(rng.randint(1, 6)), rng.choice([0, 0, 1, 2, 3, 4, 8, 9])) for _ in range(n)]
    return edges + edges[:2] + [(None, 1, "x", 1.0, 0), (1, None, "x", 1.0, 0)]


EDGES = "src long, tgt long, model string, size double, mask int"


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame([(6 * a + b, a, b) for a, b in itertools.product(range(6), repeat=2)] + [(99, None, 1), (98, 1, 77)], "req_id long, src long, tgt long")


@pytest.mark.parametrize("seed", range(3))
def test_limit_sets_are_the_smallest_of_all_paths(spark, requests, seed):
    edges = graph(seed)
    frame = spark.createDataFrame(edges, EDGES)
    for max_hops, more in ((1, 1), (2, 1), (2, 0)):
        got = {r.req_id: r.masks for r in limits.limit_sets(frame, requests, max_hops, HOP, more).collect()}
        assert got[99] == got[98] == []
        for a, b in itertools.product(range(6), repeat=2):
            sets = set()
            for w in walks([e for e in edges if None not in e], a, b, max_hops + more):
                mask = HOP if len(w) > max_hops else 0
                for e in w:
                    mask |= e[4]
                sets.add(mask)
            assert got[6 * a + b] == sorted(m for m in sets if not any(k != m and k & m == k for k in sets)), (a, b)


@pytest.mark.parametrize("seed", range(3))
def test_bottleneck_routes_have_the_smallest_largest_size(spark, requests, seed):
    edges = [e for e in graph(seed + 10, n=9) if None not in e]
    frame = spark.createDataFrame(edges, EDGES)
    for max_hops in (1, 3, None):
        got = {r.req_id: r for r in limits.bottleneck_routes(frame, requests, max_hops).collect()}
        assert len(got) == 38 and got[99].step is None and got[98].nodes is None
        for a, b in itertools.product(range(6), repeat=2):
            found = [(max(e[3] for e in w), len(w), [w[0][0]] + [e[1] for e in w]) for w in walks(edges, a, b, max_hops or 6)]
            r = got[6 * a + b]
            if not found:
                assert r.step is None and r.hops is None
                continue
            assert (r.step, r.hops, list(r.nodes)) == min(found)
            for x, y, m in zip(r.nodes, r.nodes[1:], r.models):
                assert m == min((e[3], e[2]) for e in edges if e[:2] == (x, y))[1]


def test_no_edges_no_requests(spark, requests):
    none = spark.createDataFrame([], EDGES)
    assert all(r.masks == [] for r in limits.limit_sets(none, requests, 2, HOP).collect())
    assert all(r.step is None for r in limits.bottleneck_routes(none, requests).collect())
    edges = spark.createDataFrame(graph(1), EDGES)
    assert limits.limit_sets(edges, requests.limit(0), 2, HOP).count() == limits.bottleneck_routes(edges, requests.limit(0)).count() == 0


def test_sets_are_named(spark):
    df = spark.createDataFrame([([],), ([0],), ([1, 6],)], "m array<long>")
    assert [r.t for r in df.select(limits.named(F.col("m"), {1: "size", 2: "absent", 4: "source"}).alias("t")).collect()] == ["", "", "size|absent+source"]


def test_a_signature_holds_its_nodes_and_few_others(spark):
    nodes = spark.range(4000)
    wanted = nodes.where("id % 200 = 0").agg(limits.signature(F.col("id")).alias("wanted"))
    held = {r.id for r in nodes.crossJoin(wanted).where(limits.may_hold(F.col("wanted"), F.col("id"))).collect()}
    assert held >= set(range(0, 4000, 200)) and len(held) < 800


def test_the_hop_before_the_last_is_made_for_wanted_targets_alone(spark, monkeypatch):
    """One request in a wide graph: 30 x 30 nodes are two hops away, one edge leads on to the target."""
    rows = [(0, 1 + a, "m", 1.0, 0) for a in range(30)] + [(1 + a, 100 + 30 * a + b, "m", 1.0, 0) for a in range(30) for b in range(30)] + [(100, 5000, "m", 2.0, 1)]
    edges, asked = spark.createDataFrame(rows, EDGES), spark.createDataFrame([(1, 0, 5000)], "req_id long, src long, tgt long")
    sizes, keep = [], limits.saved

    def counted(df):
        made = keep(df)
        sizes.append((tuple(made.columns), made.count()))
        return made

    monkeypatch.setattr(limits, "saved", counted)
    assert limits.limit_sets(edges, asked, 2, HOP).first().masks == [HOP + 1]
    assert max(n for c, n in sizes if c == ("src", "node", "mask")) < 60
    route = limits.bottleneck_routes(edges, asked, 3).first()
    assert (route.step, list(route.nodes)) == (2.0, [0, 1, 100, 5000])
    assert max(n for c, n in sizes if "nodes" in c) < 60
