import random

from pyspark.sql import functions as F

from brute import edges_df
from tidecore.operators import bins as B
from tidecore.operators import profile as P
from tidecore.plans.ordering import with_position, with_previous
from tidecore.sources import edges as E
from tidecore.sources import sinks

DAY = 86_400


def test_single_timestamp_and_edges_of_bins(spark):
    same = edges_df(spark, [(1, 2, 7), (2, 3, 7)])
    for cut in (B.bin_equal_width, B.bin_timestamp_closed):
        assert {r["bin"] for r in cut(same, 10).collect()} == {0}
    # boundaries are whole seconds, so the bins before the last one end at 7
    assert {r["bin"] for r in B.bin_sorted_boundaries(same, 10).collect()} == {9}
    edges = edges_df(spark, [(1, 2, t) for t in range(100)])
    for cut in (B.bin_equal_width, B.bin_sorted_boundaries, B.bin_equal_count):
        got = {r["ts"]: r["bin"] for r in cut(edges, 10).collect()}
        assert got == {t: t // 10 for t in range(100)}, cut
    closed = {r["ts"]: r["bin"] for r in B.bin_timestamp_closed(edges, 9).collect()}
    assert closed[99] == 8 and closed[0] == 0 and closed[11] == 1
    assert B.bin_edges_of(B.bin_equal_width(edges, 10), 40).count() == 0


def test_positions_and_neighbours_with_many_equal_rows(spark):
    values = [5] * 300 + list(range(200))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(7)
    got = sorted((r["position"], r["x"]) for r in with_position(df, ["x"]).collect())
    assert [p for p, _ in got] == list(range(500))
    assert [x for _, x in got] == sorted(values)
    pairs = sorted(
        ((r["x"], r["prev"]) for r in with_previous(df, ["x"], {"prev": "x"}).collect()),
        key=lambda t: (t[0], -1 if t[1] is None else t[1]),
    )
    ordered = sorted(values)
    want = sorted(zip(ordered, [None, *ordered[:-1]]), key=lambda t: (t[0], -1 if t[1] is None else t[1]))
    assert pairs == want


def test_window_sequence_against_definition(spark):
    binned = spark.createDataFrame([(b, b) for b in range(23)], "src long, bin int")
    for start, width, step, count in ((2, 5, 1, None), (0, 4, 3, None), (3, 2, 4, 3)):
        got = {(r["bin"], r["window_id"]) for r in B.window_sequence(binned, start, width, step, count).collect()}
        want = set()
        for i in range(100 if count is None else count):
            begin = start + i * step
            if begin + width > 23:
                break
            want |= {(b, i) for b in range(begin, begin + width)}
        assert got == want


def test_calendar_windows_against_definition(spark):
    for total, slide in ((12, 1), (12, 2), (5, 1), (8, 1)):
        edges = edges_df(spark, [(d, d + 1, d * DAY) for d in range(total)])
        got = {(r["src"], r["day"]) for r in B.calendar_windows(edges, 7, slide).collect()}
        days = [6, *range(7, total - 1, slide)]
        want = {(d, day) for day in days for d in range(max(0, day - 6), day + 1) if d < total}
        assert got == want, (total, slide)


def test_first_n_by_position_equals_top_k(spark):
    edges = edges_df(spark, [(i % 7, i % 5, 100 - i) for i in range(60)])
    few = B.read_first_n(edges, 20).collect()
    placed = with_position(edges, ["ts", "src", "dst"], "p").filter(F.col("p") < 20).drop("p").collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, placed))
    # a third of the rows share one timestamp
    rows = [(i, 0, 500 if i % 3 == 0 else i) for i in range(9000)]
    many = {tuple(r) for r in B.read_first_n(edges_df(spark, rows), 3000).collect()}
    assert many == set(sorted(rows, key=lambda e: (e[2], e[0], e[1]))[:3000])


def test_gaps_with_repeats_and_far_timestamps(spark):
    times = [0, 0, 5, 1_000, 1_000, 1_003, 90_000]
    got = P.inter_event_gaps(edges_df(spark, [(1, 2, t) for t in times])).first()
    gaps = [b - a for a, b in zip(times, times[1:])]
    mean = sum(gaps) / len(gaps)
    std = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    assert (got["gaps"], got["min_gap"], got["max_gap"]) == (6, 0, max(gaps))
    assert abs(got["mean_gap"] - mean) < 1e-9 and abs(got["std_gap"] - std) < 1e-4


def test_bins_become_a_range_of_ts_in_the_scan(spark, tmp_path):
    rows = [(i, i + 1, 1000 + 37 * i) for i in range(500)]
    edges_df(spark, rows).write.parquet(str(tmp_path / "edges"))
    edges = E.read_edge_table(spark, str(tmp_path / "edges"))
    got = B.edges_of_bins(edges, 30, 7, 4)
    want = B.window_edges(B.bin_equal_width(edges, 30), 7, 4)
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    assert sorted(B.edges_of_bins(edges, 30, 28, 9).collect()) == sorted(B.window_edges(B.bin_equal_width(edges, 30), 28, 9).collect())
    assert B.edges_of_bins(edges, 30, 30, 2).collect() == [] and B.edges_of_bins(edges.limit(0), 30, 0, 2).collect() == []


def test_binned_table_is_read_by_bin(spark, tmp_path):
    binned = B.bin_equal_width(edges_df(spark, [(i, i + 1, i) for i in range(200)]), 10)
    sinks.write_binned_edges(binned, str(tmp_path / "binned"))
    table = E.read_binned_edges(spark, str(tmp_path / "binned"))
    got = B.window_edges(table, 3, 2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.window_edges(binned, 3, 2).select("src", "dst", "ts", "bin").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bin" in plan and ">= 3" in plan
