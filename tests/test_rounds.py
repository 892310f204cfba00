"""What rounds send, keep and leave behind, against peeling."""

import random

from pyspark.sql import functions as F

from brute import as_core, edges_df, pairs_df, peel, random_pairs
from tidecore.checks.base import cp_core, customer_part_edges, slide_inputs
from tidecore.operators import core as C
from tidecore.operators import index as I
from tidecore.operators import maintain as M
from tidecore.operators import spans as S
from tidecore.plans import fixpoint


def test_rounds_broadcast_small_tables_only(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with fixpoint.loop_settings(spark, 10**9) as partitions:
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == fixpoint.LOOP_BROADCAST
        assert partitions >= 500
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == kept


def test_counts_are_kept_once_few_values_fall(spark):
    rng = random.Random(5)
    pairs = random_pairs(rng, 80, 240) + [(100 + i, 101 + i) for i in range(12)] + [(0, 100)]
    trace = []
    assert as_core(C.core_numbers(pairs_df(spark, pairs), trace=trace)) == peel(pairs)
    kinds = [kind for kind, _ in trace]
    assert kinds[0] == "full" and "counted" in kinds and trace[-1] == ("counted", 0)


def test_sparse_windows_leave_settled_pieces_behind(spark, monkeypatch):
    # many windows of trees, and a few with triangles and a chain that hangs on one
    rng = random.Random(6)
    pieces = [(w // 16, w, 1000 + i, 1001 + i, w, w + 1) for w in range(40) for i in range(0, 12, 2)]
    pieces += [(w // 16, w, a, b, w, w + 1) for w in (3, 17, 18) for a, b in random_pairs(rng, 9, 16)]
    pieces += [(1, 20, i, i + 1, 20, 21) for i in range(9)] + [(1, 20, 0, 2, 20, 21)]
    placed = []
    place = S.PlacedPieces.place
    monkeypatch.setattr(S.PlacedPieces, "place", lambda self, width: (placed.append(self.rows), place(self, width)))
    df = spark.createDataFrame([(b, u, v, x, y) for b, _, u, v, x, y in pieces], "block int, u long, v long, first int, end int")
    got = {}
    for r in S.span_core_numbers(df).collect():
        got.setdefault(r.window, {})[r.u] = r.core
    windows = {w for _, w, *_ in pieces}
    assert got == {w: peel([(u, v) for _, x, u, v, *_ in pieces if x == w]) for w in windows}
    assert max(placed) < len(pieces)


def test_slide_table_sizes_its_tasks(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(M, "loop_settings", lambda s, rows: (asked.append(rows), fixpoint.loop_settings(s, rows))[1])
    edges = edges_df(spark, [(i, i + 1, i % 5) for i in range(30)])
    M.slide_table(edges.withColumn("bin", F.col("ts").cast("int")), 0, 3, 1, 2)
    assert asked and asked[0] >= 30


def test_shared_inputs_are_read_from_written_tables(spark, sf_dir):
    pairs, core, delta = slide_inputs(spark, sf_dir)
    for table in (pairs, core, delta, *cp_core(spark, sf_dir)):
        files = table.inputFiles()
        assert files and all("/round-" in f for f in files)


def _few(monkeypatch, **shares):
    """Let every counted round look near changes; vertices written by each round."""
    settle, write, written = C.settle_counts, C.materialise, []

    def noted(df, **metrics):
        table, seen = write(df, **metrics)
        written.extend([seen["vertices"]] if "changed" in seen and "vertices" in seen else [])
        return table, seen

    for module in (C, S):
        monkeypatch.setattr(module, "settle_counts", lambda *a, **k: settle(*a, **k, **shares))
    monkeypatch.setattr(C, "materialise", noted)
    return written


def test_few_changes_rewrite_only_the_counts_beside_them(spark, monkeypatch):
    # a chain that comes loose from its end, a vertex a round, beside a graph that settles at once
    pairs = [(a, b) for a in range(12) for b in range(a)] + [(20 + i, 21 + i) for i in range(16)] + [(0, 20)]
    pairs += [(40 + a, 40 + b) for a in range(30) for b in range(a) if (a + b) % 3]
    written = _few(monkeypatch, few_share=1.0, later_share=0.5)
    trace = []
    assert as_core(C.core_numbers(pairs_df(spark, pairs), trace=trace)) == peel(pairs)
    vertices = len({x for p in pairs for x in p})
    assert any(kind == "few" for kind, _ in trace) and written[0] == vertices and min(written) < vertices / 2


def test_few_changes_go_back_to_all_counts_once_they_reach_many(spark, monkeypatch):
    rng = random.Random(8)
    graphs = {w: random_pairs(rng, 40, 90 + 20 * w) + [(100 + i, 101 + i) for i in range(9)] + [(0, 100)] for w in range(3)}
    rows = [(w, u, v) for w, pairs in graphs.items() for u, v in pairs]
    df = spark.createDataFrame(rows, "window_id int, u long, v long")
    for hub_rows in (C.HUB_ROWS, 4):
        with monkeypatch.context() as patch:
            written = _few(patch, few_share=1.0, later_share=0.05)
            trace = []
            got = {}
            for r in C.windowed_core_numbers(df, trace=trace, hub_rows=hub_rows).collect():
                got.setdefault(r.window_id, {})[r.u] = r.core
            assert got == {w: peel(pairs) for w, pairs in graphs.items()}
            assert sum(kind == "few" for kind, _ in trace) > 1 and min(written) < max(written)


def test_few_changes_in_windows_rewrite_only_the_counts_beside_them(spark, monkeypatch):
    rng = random.Random(9)
    graphs = {w: random_pairs(rng, 14, 50) + [(20 + i, 21 + i) for i in range(10)] + [(0, 20)] for w in (2, 15, 16)}
    pieces = [(w // 16, u, v, w, w + 1) for w, pairs in graphs.items() for u, v in pairs]
    written = _few(monkeypatch, few_share=1.0, later_share=0.5)
    df = spark.createDataFrame(pieces, "block int, u long, v long, first int, end int")
    got = {}
    for r in S.span_core_numbers(df).collect():
        got.setdefault(r.window, {})[r.u] = r.core
    assert got == {w: peel(pairs) for w, pairs in graphs.items()}
    assert min(written) < max(written)


def test_customer_part_edges_send_no_table_through_the_driver(spark, sf_dir):
    plan = customer_part_edges(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_indexes_join_vertex_tables_by_sorting(spark):
    pairs = random_pairs(random.Random(8), 20, 60)
    core, adj = peel(pairs), {}
    for u, v in pairs:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    graph = fixpoint.materialise(pairs_df(spark, pairs))[0]
    values = fixpoint.materialise(C.core_numbers(graph))[0]
    for table in (I.mcd_index(graph, values), I.pcd_index(graph, values), I.relaxed_s_index(graph, values), I.equal_core_links(graph, values)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        lines = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
        # only the few vertices that are cut into slices are sent to every task: they are joined by a left join
        assert "SortMergeJoin" in plan and all("LeftOuter" in line for line in lines), lines
    mcd = {r["u"]: r["mcd"] for r in I.mcd_index(graph, values).collect()}
    assert mcd == {u: sum(core[w] >= core[u] for w in ns) for u, ns in adj.items()}
