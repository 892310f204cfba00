from brute import as_core, edges_df, peel
from tidecore.streaming.coreness import CorenessStream, stream_coreness

DAY = 86_400


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    keeper = CorenessStream(spark, str(tmp_path / "state"), days=2)
    first = [(1, 2, 10), (2, 3, 20), (1, 3, 30), (4, 4, 40)]
    second = [(3, 4, DAY), (4, 5, DAY + 5), (3, 5, DAY + 9)]
    third = [(1, 9, 2 * DAY + 25)]
    keeper.process(edges_df(spark, first), 0)
    keeper.process(edges_df(spark, second), 1)
    want = peel([(u, v) for u, v, _ in first + second])
    assert as_core(keeper.latest_core()) == want
    keeper.process(edges_df(spark, second), 1)
    assert as_core(keeper.latest_core()) == want
    keeper.process(edges_df(spark, []), 2)
    keeper.process(edges_df(spark, third), 3)
    # the first two edges are older than two days by now
    live = [(u, v) for u, v, t in first + second + third if t > 25]
    assert as_core(keeper.latest_core()) == peel(live)
    rows = {r["batch"]: r["max_core"] for r in keeper.timeline().collect()}
    assert rows == {0: 2, 1: 2, 2: 2, 3: 2}
    assert keeper.alerts().count() == 0


def test_an_edge_from_the_future_does_not_expire_the_rest(spark, tmp_path):
    keeper = CorenessStream(spark, str(tmp_path / "state"), days=2)
    first = [(1, 2, 10), (2, 3, 20), (1, 3, 30)]
    keeper.process(edges_df(spark, first), 0)
    keeper.process(edges_df(spark, [(3, 4, 50), (7, 8, 10_000 * DAY)]), 1)
    assert as_core(keeper.latest_core()) == peel([(1, 2), (2, 3), (1, 3), (3, 4)])
    early = spark.read.parquet(str(tmp_path / "state" / "early"))
    assert [(r.u, r.v, r.ts, r.batch) for r in early.collect()] == [(7, 8, 10_000 * DAY, 1)]
    # a late edge inside the window still counts
    keeper.process(edges_df(spark, [(1, 4, 15)]), 2)
    assert as_core(keeper.latest_core()) == peel([(1, 2), (2, 3), (1, 3), (3, 4), (1, 4)])


def test_edges_put_aside_come_back_within_reach(spark, tmp_path):
    keeper = CorenessStream(spark, str(tmp_path / "state"), days=30)
    keeper.process(edges_df(spark, [(1, 2, 10), (2, 3, 20)]), 0)
    keeper.process(edges_df(spark, [(1, 3, 30), (3, 4, 400 * DAY), (9, 8, 10_000 * DAY)]), 1)
    assert as_core(keeper.latest_core()) == peel([(1, 2), (2, 3), (1, 3)])
    third = [(3, 5, 390 * DAY), (4, 5, 395 * DAY)]  # nothing for the window: a gap
    for _ in range(2):  # a batch may run again
        keeper.process(edges_df(spark, third), 2)
        assert as_core(keeper.latest_core()) == peel([(3, 4), (3, 5), (4, 5)])
    keeper.process(edges_df(spark, [(4, 6, 401 * DAY), (1, 5, 20)]), 3)
    assert as_core(keeper.latest_core()) == peel([(3, 4), (3, 5), (4, 5), (4, 6)])
    as_of = {r["batch"]: r["as_of"] for r in keeper.timeline().collect()}
    assert as_of == {0: 20, 1: 30, 2: 400 * DAY, 3: 401 * DAY}
    alerts = [(r["event"], r["batch"]) for r in keeper.alerts().collect()]
    assert alerts == [("SURGE", 1)]


def test_lead_days_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("src long, dst long, ts long").parquet(str(tmp_path / "in"))
    keeper, running = stream_coreness(stream, str(tmp_path / "state"), available_now=True, lead_days=3)
    running.awaitTermination(60)
    assert keeper.lead == 3 * DAY
