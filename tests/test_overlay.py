"""Graphs that change by batches against peeling, and spans of windows against windows formed one by one."""

import random

import pytest
from pyspark.sql import functions as F

from brute import as_core, edges_df, pairs_df, peel, random_pairs
from tidecore.operators import advise as A
from tidecore.operators import bins as B
from tidecore.operators import graph as G
from tidecore.operators import maintain as M
from tidecore.operators import overlay, slices
from tidecore.operators.core import core_numbers
from tidecore.operators.overlay import OverlaidGraph


def many_graphs(rng, graphs=8):
    """Random graphs with ids of their own, and batches that remove and add pairs at once."""
    base, batches = [], [([], [])]
    for k in range(graphs):
        n = rng.randrange(5, 26)
        own = random_pairs(rng, n, rng.randrange(3, min(60, n * (n - 1) // 2)))
        base += [(1000 * k + a, 1000 * k + b) for a, b in own]
        present = set(own)
        for out, into in batches:
            gone = set(rng.sample(sorted(present), rng.randrange(0, 1 + len(present) // 5)))
            new = {p for p in random_pairs(rng, n + 2, rng.choice([1, 2, 5])) if p not in present}
            present = (present - gone) | new
            out += [(1000 * k + a, 1000 * k + b) for a, b in sorted(gone)]
            into += [(1000 * k + a, 1000 * k + b) for a, b in sorted(new)]
    return base, batches


def indexes(pairs):
    core, adj = peel(pairs), {}
    for u, v in pairs:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    mcd = {u: sum(core[w] >= core[u] for w in ns) for u, ns in adj.items()}
    pcd = {u: sum(core[w] > core[u] or (core[w] == core[u] and mcd[w] > core[w]) for w in ns) for u, ns in adj.items()}
    return {u: (core[u], sum(core[w] > core[u] for w in ns), mcd[u], pcd[u]) for u, ns in adj.items()}


def test_batches_equal_peeling_and_recounted_indexes(spark, monkeypatch):
    # several parts, and overlays that are merged into their bases
    monkeypatch.setattr(overlay, "PART_ROWS", 300)
    monkeypatch.setattr(overlay, "MERGE_SHARE", 0.3)
    base, batches = many_graphs(random.Random(2))
    graph = OverlaidGraph(pairs_df(spark, base), indexes=True)
    now, core = set(base), peel(base)
    for out, into in batches:
        moved = graph.slide(pairs_df(spark, out), pairs_df(spark, into))
        now = (now - set(out)) | set(into)
        new = peel(now)
        assert as_core(graph.core()) == new
        assert {(r.u, r.old, r.core) for r in moved.collect()} == {(u, core.get(u, 0), new.get(u, 0)) for u in {*core, *new} if core.get(u, 0) != new.get(u, 0)}
        assert {r.u: (r.core, r.r, r.mcd, r.pcd) for r in graph.index().collect()} == indexes(now)
        assert {(r.u, r.v) for r in graph.pairs().collect()} == now
        core = new
    graph.close()


def test_neighbours_that_fall_in_one_round(spark):
    # twenty dense graphs that lose a third of their pairs: many vertices fall together, and then again
    rng = random.Random(12)
    base = [(1000 * k + a, 1000 * k + b) for k in range(20) for a, b in random_pairs(rng, 22, 150)]
    out = rng.sample(base, len(base) // 3)
    graph = OverlaidGraph(pairs_df(spark, base), place=False)
    graph.slide(pairs_df(spark, out), pairs_df(spark, out).limit(0))
    assert as_core(graph.core()) == peel(set(base) - set(out))


def test_several_levels_at_once_and_nothing_at_all(spark):
    path = [(i, i + 1) for i in range(4)]
    clique = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    graph = OverlaidGraph(pairs_df(spark, path), place=False)
    graph.slide(pairs_df(spark, path).limit(0), pairs_df(spark, [p for p in clique if p not in set(path)]))
    assert as_core(graph.core()) == dict.fromkeys(range(5), 4)
    assert graph.slide(pairs_df(spark, clique).limit(0), pairs_df(spark, clique).limit(0)).count() == 0
    graph.slide(pairs_df(spark, clique), pairs_df(spark, [(50, 51)]))
    assert as_core(graph.core()) == {50: 1, 51: 1}
    moved = graph.recompute(pairs_df(spark, [(50, 51)]), pairs_df(spark, [(1, 2), (2, 3), (1, 3)]))
    assert as_core(graph.core()) == {1: 2, 2: 2, 3: 2} and moved.count() == 5


def test_reads_stay_near_the_batch(spark):
    # a long chain of cliques: a batch in one of them must not read the others
    rng = random.Random(4)
    base = [(100 * k + a, 100 * k + b) for k in range(60) for a, b in random_pairs(rng, 12, 40)] + [(100 * k, 100 * k + 100) for k in range(59)]
    graph = OverlaidGraph(pairs_df(spark, base))
    near = [p for p in base if 3000 <= p[0] < 3012 and p[1] < 3012]
    graph.slide(pairs_df(spark, near[:2]), pairs_df(spark, [(3000, 9999), (3001, 9999)]))
    row = graph.impact().first()
    degree = {}
    for u, v in base:
        degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
    steps = {s["step"] for s in graph.steps}
    assert steps == {"lower", "raise"} and 0 < row.visited < 150 and row.traversed < 15 * max(degree.values()) * 12
    assert row.traversed < len(base) * 2 / 2
    now = [p for p in base if p not in set(near[:2])] + [(3000, 9999), (3001, 9999)]
    assert as_core(graph.core()) == peel(now)


@pytest.mark.parametrize("method", ["overlay", "rounds"])
def test_both_methods_of_a_slide(spark, method):
    rng = random.Random(8)
    base = random_pairs(rng, 40, 90)
    out, into = base[::7], [(0, 1), *[(50 + i, i) for i in range(9)]]
    pairs = pairs_df(spark, base)
    got = M.core_after_slide(pairs, core_numbers(pairs), pairs_df(spark, [*out, (900, 901)]), pairs_df(spark, [*into, base[1]]), method=method)
    assert as_core(got) == peel((set(base) - set(out)) | set(into) | {base[1]})


def temporal(seed, bins=24):
    rng = random.Random(seed)
    rows = [(rng.randrange(25), rng.randrange(25), rng.randrange(bins)) for _ in range(400)]
    return rows


def test_spans_hold_what_windows_hold(spark):
    rows = temporal(5)
    binned = edges_df(spark, rows).withColumn("bin", F.col("ts").cast("int"))
    for width in (1, 4, 30):
        spans = [tuple(r) for r in B.pair_spans(binned, width).collect()]
        ends = [tuple(r) for r in B.vertex_spans(binned, width).collect()]
        for s in range(-width, 25):
            inside = {(min(a, b), max(a, b)) for a, b, t in rows if a != b and s <= t < s + width}
            held = [(u, v) for u, v, e, x in spans if e <= s < x]
            assert sorted(held) == sorted(inside)
            assert sorted(u for u, e, x in ends if e <= s < x) == sorted({u for p in inside for u in p})


@pytest.mark.parametrize("step, strategy, slides", [(1, None, 3), (3, A.advise_ratio, 1), (7, None, 3)])
def test_maintained_windows_equal_peeling(spark, step, strategy, slides):
    rows = temporal(6)
    binned = edges_df(spark, rows).withColumn("bin", F.col("ts").cast("int"))
    results = M.maintain_windows(binned, 2, 5, step, slides, strategy)
    assert len(results) == min(slides, (23 - 7 + 1) // step)
    for i, core in results:
        s = 2 + i * step
        assert as_core(core) == peel({(min(a, b), max(a, b)) for a, b, t in rows if a != b and s <= t < s + 5})
    assert M.maintain_windows(binned.limit(0), 2, 5) == [] == M.maintain_windows(binned, 20, 5)


def test_slide_table(spark):
    rows = temporal(7)
    binned = edges_df(spark, rows).withColumn("bin", F.col("ts").cast("int"))
    window = lambda s: {(min(a, b), max(a, b)) for a, b, t in rows if a != b and s <= t < s + 6}
    want = {}
    for i in range(1, 5):
        old, new = window(1 + 2 * (i - 1)), window(1 + 2 * i)
        want[i] = (len({u for p in old for u in p}), len(old), len(old ^ new), len({u for p in old ^ new for u in p}))
    assert {r.slide: (r.n, r.m, r.batch, r.touched) for r in M.slide_table(binned, 1, 6, 2, 4).collect()} == want


def test_slide_impact(spark):
    rows = temporal(9)
    binned = edges_df(spark, rows).withColumn("bin", F.col("ts").cast("int"))
    cores = [peel({(min(a, b), max(a, b)) for a, b, t in rows if a != b and i <= t < i + 12}) for i in range(2)]
    (r,) = M.slide_impact(binned, 0, 12, 1, 1).collect()
    assert r.affected == sum(cores[0].get(u) != cores[1].get(u) for u in {*cores[0], *cores[1]}) and r.visited >= r.affected


def test_hubs_are_cut_into_slices(spark):
    # one vertex on a third of the edges: no task joins more than a few times the mean of its edges
    rng = random.Random(3)
    pairs = {(0, 10_000 + i) for i in range(4_000)} | {tuple(sorted(rng.sample(range(1, 3_000), 2))) for _ in range(8_000)}
    both = G.symmetrize(pairs_df(spark, sorted(pairs)))
    core = both.select("u").distinct().withColumn("core", F.lit(1))
    seen = core.select(F.col("u").alias("v"), F.col("core").alias("n_core"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = slices.join_by_vertex(both, seen, "v", slice_rows=200)
        loads = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(loads) == 2 * len(pairs) and max(loads) < 2.5 * sum(loads) / 16
        plain = [r["count"] for r in both.join(seen, "v").groupBy(F.spark_partition_id()).count().collect()]
        assert max(plain) > max(loads)
        kept = slices.join_by_vertex(both, seen.where("v < 100"), "v", "left_semi", slice_rows=200)
        assert kept.count() == both.where("v < 100").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_frontier_of_known_size_is_not_written_again(spark, monkeypatch):
    monkeypatch.setattr(overlay, "PART_ROWS", 4)
    pairs = random_pairs(random.Random(9), 12, 20)
    graph = OverlaidGraph(pairs_df(spark, pairs))
    assert graph.parts > 1
    frontier, _ = overlay.materialise(spark.createDataFrame([(pairs[0][0],), (pairs[-1][1],)], "u long").distinct())
    size = frontier.count()
    written, write = [], overlay.materialise
    monkeypatch.setattr(overlay, "materialise", lambda df, **m: (written.append(df.columns), write(df, **m))[1])
    known = graph._read("lower", frontier, size)
    assert written == [["u", "v"]]
    unknown = graph._read("lower", frontier)
    assert written[1:] == [["u"], ["u", "v"]]
    assert known[1] == unknown[1] == size
    assert sorted(map(str, known[0].collect())) == sorted(map(str, unknown[0].collect()))
    graph.close()
