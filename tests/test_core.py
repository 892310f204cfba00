import random

import pytest
from pyspark.sql import functions as F

from brute import as_core, pairs_df, peel, random_pairs
from tidecore.operators import core as C
from tidecore.operators import graph as G
from tidecore.plans.fixpoint import NotConverged

HAND = {
    "triangle_tail": ([(1, 2), (2, 3), (1, 3), (3, 4)], {1: 2, 2: 2, 3: 2, 4: 1}),
    "k5": ([(a, b) for a in range(1, 6) for b in range(a + 1, 6)], {i: 4 for i in range(1, 6)}),
    "path": ([(i, i + 1) for i in range(1, 6)], {i: 1 for i in range(1, 7)}),
    "star_rim": ([(0, i) for i in range(1, 6)] + [(1, 2)], {0: 2, 1: 2, 2: 2, 3: 1, 4: 1, 5: 1}),
}


def test_hand_graphs_in_one_table(spark):
    rows = [(name, u, v) for name, (pairs, _) in HAND.items() for u, v in pairs]
    pairs = spark.createDataFrame(rows, "g string, u long, v long")
    got = {(r["g"], r["u"]): r["core"] for r in C.core_numbers(pairs, keys=["g"]).collect()}
    assert got == {(n, u): c for n, (_, core) in HAND.items() for u, c in core.items()}


@pytest.mark.parametrize("seed", [2])
def test_random_graph_full_local_and_sliced(spark, seed):
    rng = random.Random(seed)
    pairs = random_pairs(rng, 60, 150) + [(100, i) for i in range(60)]
    want = peel(pairs)
    df = pairs_df(spark, pairs)
    assert as_core(C.core_numbers(df)) == want
    trace = []
    local = C.core_numbers(df, frontier_share=1.0, frontier_min_rows=0, trace=trace)
    assert as_core(local) == want
    assert any(kind == "local" for kind, _ in trace)
    assert as_core(C.core_numbers(df, hub_rows=7)) == want
    both = C.core_numbers(df, hub_rows=7, frontier_share=1.0, frontier_min_rows=0)
    assert as_core(both) == want


def test_empty_graph_and_round_limit(spark):
    assert C.core_numbers(pairs_df(spark, [(1, 2)]).filter("u > 5")).count() == 0
    with pytest.raises(NotConverged):
        C.core_numbers(pairs_df(spark, [(i, i + 1) for i in range(30)]), max_rounds=2)


def test_core_reports(spark):
    pairs, want = HAND["star_rim"]
    df = pairs_df(spark, pairs)
    core = C.core_numbers(df)
    assert {(r["u"], r["v"]) for r in C.k_core(df, 2, core).collect()} == {(0, 1), (0, 2), (1, 2)}
    assert {r["core"]: r["vertices"] for r in C.core_distribution(core).collect()} == {1: 3, 2: 3}
    stats = C.core_stats(core).first()
    assert (stats["max_core"], stats["vertices_in_max_core"], stats["distribution"]) == (2, 3, {1: 3, 2: 3})
    assert {r["u"] for r in C.max_core_members(core).collect()} == {0, 1, 2}
    levels = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, core int")
    shown = sorted(r["core"] for r in C.core_distribution_head_tail(levels).collect())
    assert shown == list(range(1, 11)) + list(range(16, 21))


def test_simple_graph_operators(spark):
    e = spark.createDataFrame([(2, 1, 5), (1, 2, 6), (3, 3, 7), (2, 3, 8)], "src long, dst long, ts long")
    assert {tuple(r) for r in G.simple_edges(e).collect()} == {(1, 2), (2, 3)}
    assert G.self_loop_count(e).first().asDict() == {"edges": 4, "self_loops": 1, "kept": 3}
    assert {tuple(r) for r in G.edge_multiplicity(e).collect()} == {(1, 2, 2), (2, 3, 1)}
    blocks = G.adjacency(pairs_df(spark, [(1, i) for i in range(2, 12)]), block=4)
    assert blocks.agg(F.max(F.size("neighbours"))).first()[0] <= 4
    assert blocks.filter("u = 1").agg(F.sum(F.size("neighbours"))).first()[0] == 10
    assert {tuple(r) for r in G.in_out_degrees(e).collect()} == {(1, 1, 1), (2, 2, 1), (3, 1, 2)}
