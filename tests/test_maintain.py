import random

import pytest
from pyspark.sql import functions as F

from brute import as_core, edges_df, pairs_df, peel, random_pairs
from tidecore.operators import bins as B
from tidecore.operators import core as C
from tidecore.operators import index as I
from tidecore.operators import maintain as M
from tidecore.operators import validate as V


def case(seed):
    rng = random.Random(seed)
    base = random_pairs(rng, 40, 70) + [(100 + i, i) for i in range(40)]
    removed = base[:: rng.randrange(4, 8)]
    added = [p for p in random_pairs(rng, 60, 25) if p not in set(base)]
    return base, removed, added


@pytest.mark.parametrize("options", [{}, {"frontier_share": 1.0, "frontier_min_rows": 0}])
def test_slide_equals_recomputation(spark, options):
    base, removed, added = case(3)
    pairs, core = pairs_df(spark, base), C.core_numbers(pairs_df(spark, base))
    left = [p for p in base if p not in set(removed)]
    gone, come = pairs_df(spark, removed), pairs_df(spark, added)
    assert as_core(M.core_after_slide(pairs, core, gone, come, **options)) == peel(left + added)
    assert as_core(M.core_after_removals(pairs, core, gone, **options)) == peel(left)
    # the caller's table is still there
    assert as_core(core) == peel(base)


def test_removals_near_changes_reach_the_neighbours_of_clipped_vertices(spark):
    k4 = [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]
    core = C.core_numbers(pairs_df(spark, k4))
    got = M.core_after_removals(pairs_df(spark, k4), core, pairs_df(spark, [(3, 4)]), frontier_min_rows=0)
    assert as_core(got) == {1: 2, 2: 2, 3: 2, 4: 2}


def test_random_removals_near_changes(spark):
    # fifty batches at once, as parts of one graph with ids of their own
    rng = random.Random(11)
    base, removed = [], []
    for k in range(50):
        own = [(1000 * k + a, 1000 * k + b) for a, b in random_pairs(rng, 24, 60)]
        base += own
        removed += rng.sample(own, rng.randrange(1, 20))
    pairs = pairs_df(spark, base)
    core = C.core_numbers(pairs)
    got = M.core_after_removals(pairs, core, pairs_df(spark, removed), frontier_share=1.0, frontier_min_rows=0)
    gone = set(removed)
    assert as_core(got) == peel([p for p in base if p not in gone])


def test_removals_near_most_vertices_take_rounds_over_all(spark):
    base, _, _ = case(6)
    removed = base[::3]
    pairs, trace = pairs_df(spark, base), []
    core = C.core_numbers(pairs)
    got = M.core_after_removals(pairs, core, pairs_df(spark, removed), frontier_min_rows=0, frontier_share=0.05, trace=trace)
    assert as_core(got) == peel([p for p in base if p not in set(removed)])
    assert trace[0][0] == "full"


def test_frontier_propagation_reads_the_pairs_once(spark):
    base, _, _ = case(7)
    core = C.core_numbers(pairs_df(spark, base)).persist()
    index = core.select("u", F.lit(0).alias("s"))
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    pairs = pairs_df(spark, base).mapInArrow(watched, "u long, v long")
    got = {r.u: r.s for r in M.frontier_propagation(pairs, core, index, core.select("u")).collect()}
    values = as_core(core)
    near = {u: [b if a == u else a for a, b in base if u in (a, b)] for u in values}
    able = {u for u in values if sum(values[v] > values[u] for v in near[u]) + len(near[u]) > values[u]}
    want = {u: sum(v in able and values[v] == values[u] for v in near[u]) for u in values}
    assert got == want
    assert read.value == len(base)


def test_pruned_rounds(spark):
    base, _, _ = case(4)
    chains = base + [(200 + i, 100 + i) for i in range(40)]
    trace = []
    got = C.core_numbers(pairs_df(spark, chains), prune_min_rows=0, hub_rows=5, trace=trace)
    assert as_core(got) == peel(chains)
    assert any(kind == "prune" for kind, _ in trace)


@pytest.mark.parametrize(
    "base, added, rising",
    [
        ([(1, 2), (2, 3), (3, 4)], [(1, 4)], {1, 2, 3, 4}),
        ([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4)], [(3, 4)], {1, 2, 3, 4}),
        ([(1, 2), (2, 3), (3, 4), (1, 4)], [(1, 3)], set()),
    ],
)
def test_promotable_set_is_what_rises(spark, base, added, rising):
    core = C.core_numbers(pairs_df(spark, base))
    plus = pairs_df(spark, base + added)
    assert {r["u"] for r in I.promotable_set(plus, core).collect()} == rising
    assert {r["u"] for r in M.promotion_eviction(plus, core, core).collect()} == rising


def test_repeated_pairs_leave_with_their_last_edge(spark):
    edges = edges_df(spark, [(1, 2, 0), (1, 2, 5), (2, 3, 5), (1, 3, 6)])
    binned = edges.withColumn("bin", F.col("ts").cast("int"))
    assert B.effective_delta(binned, 0, 7).count() == 0
    ((_, core),) = M.maintain_windows(binned.union(edges_df(spark, [(9, 9, 7)]).withColumn("bin", F.lit(7))), 0, 7, 1, 1)
    assert as_core(core) == {1: 2, 2: 2, 3: 2}


def test_support_indexes_and_violations(spark):
    base, _, _ = case(6)
    core = peel(base)
    pairs, exact = pairs_df(spark, base), spark.createDataFrame(list(core.items()), "u long, core int")
    adj = {}
    for u, v in base:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    r = {u: sum(core[w] > core[u] for w in ns) for u, ns in adj.items()}
    s = {u: sum(core[w] == core[u] for w in ns) for u, ns in adj.items()}
    got = {x["u"]: (x["r"], x["s"]) for x in I.s_index(pairs, exact, rounds=0).collect()}
    assert got == {u: (r[u], s[u]) for u in adj}
    assert all(r[u] <= core[u] for u in adj)
    # exact core numbers leave nothing to qualify at the fixpoint
    final = I.qualified_vertices(I.s_index(pairs, exact, rounds=None))
    assert final.count() == 0
    assert V.core_support_violations(pairs, exact).count() == 0
    assert V.cores_equal(exact, exact).first()["equal"]
    wrong = exact.withColumn("core", F.col("core") + (F.col("u") == 1).cast("int"))
    assert V.core_mismatches(exact, wrong).first()["mismatches"] == 1


def test_components_and_subcore(spark):
    pairs = pairs_df(spark, [(1, 2), (2, 3), (10, 11), (12, 11), (20, 21)])
    labels = {r["u"]: r["component"] for r in M.connected_labels(pairs).collect()}
    assert labels == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    core = spark.createDataFrame([(u, 1) for u in labels], "u long, core int")
    seeds = spark.createDataFrame([(3,)], "u long")
    assert {r["u"] for r in M.subcore(pairs, core, seeds).collect()} == {1, 2, 3}
