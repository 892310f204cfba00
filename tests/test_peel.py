"""Graphs that one task holds are worked on there, with the results of the rounds."""

import random
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from brute import as_core, pairs_df, peel, random_pairs
from tidecore.operators import core as C
from tidecore.operators import index as I
from tidecore.operators import maintain as M
from tidecore.operators import overlay
from tidecore.operators import peel as P
from tidecore.operators import spans as S
from tidecore.operators import validate as V


def _no_rounds(monkeypatch, module, name):
    def refuse(*args, **kwargs):
        raise AssertionError(f"{name} ran rounds")

    monkeypatch.setattr(module, name, refuse)


@pytest.mark.parametrize("seed, n, m", [(1, 60, 150), (2, 200, 900), (3, 9, 30)])
def test_peeled_core_numbers(spark, monkeypatch, seed, n, m):
    _no_rounds(monkeypatch, C, "lower_to_core")
    pairs = random_pairs(random.Random(seed), n, m)
    assert as_core(C.core_numbers(pairs_df(spark, pairs))) == peel(pairs)


def test_peeled_graphs_of_several_keys(spark, monkeypatch):
    _no_rounds(monkeypatch, C, "lower_to_core")
    graphs = {g: random_pairs(random.Random(g), 40, 30 + 25 * g) for g in range(5)}
    df = spark.createDataFrame([(g, u, v) for g, pairs in graphs.items() for u, v in pairs], "g int, u long, v long")
    got = {}
    for r in C.core_numbers(df, keys=["g"]).collect():
        got.setdefault(r["g"], {})[r["u"]] = r["core"]
    assert got == {g: peel(pairs) for g, pairs in graphs.items()}


def test_peeling_counts_repeats_and_loops_like_rounds(spark):
    pairs = [*random_pairs(random.Random(4), 20, 50), *random_pairs(random.Random(5), 20, 50), (3, 3), (40, 40)]
    df = pairs_df(spark, pairs)
    assert as_core(C.core_numbers(df, method="peel")) == as_core(C.core_numbers(df, method="rounds"))


def test_null_ids_go_to_the_rounds(spark, monkeypatch):
    used = []
    whole = C.lower_to_core
    monkeypatch.setattr(C, "lower_to_core", lambda *a, **k: (used.append(1), whole(*a, **k))[1])
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (None, 3)], "u long, v long")
    C.core_numbers(df).collect()
    assert used


def test_a_large_batch_on_a_graph_of_one_task_needs_no_rounds(spark, monkeypatch):
    rng = random.Random(7)
    base = random_pairs(rng, 50, 160)
    added = [p for p in random_pairs(rng, 55, 60) if p not in base]
    removed = base[::5]
    pairs = pairs_df(spark, base)
    core = C.core_numbers(pairs)
    _no_rounds(monkeypatch, M, "lower_to_core")
    got = M.core_after_slide(pairs, core, pairs_df(spark, removed), pairs_df(spark, added))
    assert as_core(got) == peel(sorted({*base, *added} - set(removed)))


def test_promotable_set_of_one_task(spark, monkeypatch):
    rng = random.Random(8)
    base = random_pairs(rng, 40, 120)
    plus = pairs_df(spark, sorted({*base, *random_pairs(rng, 44, 60)}))
    core = C.core_numbers(pairs_df(spark, base))
    want = {r["u"]: r["core"] for r in I.promotable(I.symmetrize(plus), core).collect()}
    assert want
    _no_rounds(monkeypatch, I, "shrink_to_support")
    assert {r["u"]: r["core"] for r in I.promotable_set(plus, core).collect()} == want


def _binned(spark, rng, n, m, bins):
    rows = [(rng.randrange(n), rng.randrange(n), rng.randrange(bins)) for _ in range(m)]
    return rows, spark.createDataFrame(rows, "src long, dst long, bin int")


def _window(rows, start, width):
    return peel(sorted({(min(u, v), max(u, v)) for u, v, b in rows if u != v and start <= b < start + width}))


def test_maintained_windows_of_one_task(spark, monkeypatch):
    _no_rounds(monkeypatch, M, "enclosed_core_numbers")
    rows, binned = _binned(spark, random.Random(9), 45, 400, 14)
    results = M.maintain_windows(binned, 0, 9, 1, 5)
    assert {i: as_core(core) for i, core in results} == {i: _window(rows, i, 9) for i in range(1, 6)}


def test_verification_report_of_one_task(spark, monkeypatch):
    _no_rounds(monkeypatch, S, "settle_counts")
    _no_rounds(monkeypatch, S, "clipped_levels")
    _, binned = _binned(spark, random.Random(10), 30, 200, 12)
    report = V.slide_verification_report(binned, 0, 8, 1, 4).collect()
    assert [r["passed"] for r in report] == [True] * 4 and {r["pass_rate"] for r in report} == {1.0}


def test_span_windows_are_peeled_block_by_block(spark, monkeypatch):
    _no_rounds(monkeypatch, S, "clipped_levels")
    rng = random.Random(11)
    spans = [(u, v, a, a + rng.randrange(1, 25)) for u, v in random_pairs(rng, 30, 200) for a in [rng.randrange(40)]]
    df = spark.createDataFrame(spans, "u long, v long, first int, end int")
    got = {}
    for r in S.block_core_numbers(S.cut_pieces(df)).collect():
        got.setdefault(r["window"], {})[r["u"]] = r["core"]
    windows = range(max(end for *_, end in spans))
    assert got == {w: found for w in windows if (found := peel([(u, v) for u, v, a, b in spans if a <= w < b]))}


@pytest.mark.parametrize("seed", [12, 13])
def test_a_batch_in_one_task_looks_at_what_the_rounds_read(spark, monkeypatch, seed):
    rng = random.Random(seed)
    base = random_pairs(rng, 40, 130)
    into = [p for p in random_pairs(rng, 46, 40) if p not in base]
    out = [*rng.sample(base, 15), *[p for p in base if 3 in p]]
    out = sorted(set(out))
    seen = []
    for rows in (overlay.TASK_ROWS, 0):
        monkeypatch.setattr(overlay, "TASK_ROWS", rows)
        if rows:
            _no_rounds(monkeypatch, overlay.OverlaidGraph, "_lower")
            _no_rounds(monkeypatch, overlay.OverlaidGraph, "_raise")
        else:
            monkeypatch.undo()
            monkeypatch.setattr(overlay, "TASK_ROWS", 0)
        graph = overlay.OverlaidGraph(pairs_df(spark, base), indexes=True)
        moved = {tuple(r) for r in graph.slide(pairs_df(spark, out), pairs_df(spark, into)).collect()}
        index = {tuple(r) for r in graph.index().collect()}
        seen.append((moved, index, as_core(graph.core()), [tuple(s.values()) for s in graph.steps]))
        graph.close()
    assert seen[0] == seen[1]
    assert seen[0][2] == peel((set(base) - set(out)) | set(into))


def test_workers_need_no_library_on_their_path(tmp_path):
    tasks = [P._numbered(["g"], 3, ()), P._listed(["g"], ()), P._per_graph(["g"], (), P._peeled(["g"], 3)), P._per_graph(["g"], (), P._peeled_windows(["g"], 3, 4, 9))]
    (tmp_path / "tasks").write_bytes(cloudpickle.dumps(tasks))
    code = "import pickle, sys; [list(t(iter(()))) for t in pickle.load(open('tasks', 'rb'))]; assert 'tidecore' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": ""})
