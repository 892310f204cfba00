import hashlib

from pyspark.sql import functions as F

from brute import edges_df, pairs_df
from tidecore.operators import bins as B
from tidecore.operators import sampling as X
from tidecore.sources import edges as E
from tidecore.sources import generate, sinks

DIRTY = "1 2 10\n# c\n% c\n\n  \na b c\n1 2\n7\t7   10\n 3 4 11 extra\n"


def test_text_readers_skip_what_is_no_edge(spark, tmp_path):
    (tmp_path / "one.txt").write_text(DIRTY)
    (tmp_path / "two.txt").write_text("5 6 12\n")
    (tmp_path / "notes.md").write_text("8 8 8\n")
    rows = {tuple(r) for r in E.read_temporal_edges(spark, str(tmp_path / "one.txt")).collect()}
    assert rows == {(1, 2, 10), (7, 7, 10), (3, 4, 11)}
    static = {tuple(r) for r in E.read_static_edges(spark, str(tmp_path / "one.txt")).collect()}
    assert static == {(1, 2), (7, 7), (3, 4)}
    named = {(r["dataset"], r["src"]) for r in E.read_dataset_dir(spark, str(tmp_path)).collect()}
    assert named == {("one", 1), ("one", 7), ("one", 3), ("two", 5)}
    counts = E.edge_line_counts(spark.read.text(str(tmp_path / "one.txt"))).first().asDict()
    assert counts == {"lines": 9, "comments": 2, "blank": 2, "data": 5}


def test_sinks_round_trip(spark, tmp_path):
    core = spark.createDataFrame([(2, 3), (1, 3), (5, 0)], "u long, core int")
    sinks.write_core_numbers(core, str(tmp_path / "core"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "core").glob("part-*")))
    assert text == "1 3\n2 3\n"
    binned = edges_df(spark, [(1, 2, 5), (2, 3, 6)]).withColumn("bin", F.col("ts").cast("int"))
    sinks.write_binned_edges(binned, str(tmp_path / "binned"))
    back = spark.read.parquet(str(tmp_path / "binned"))
    assert {tuple(r) for r in back.filter("bin = 6").select("src", "dst", "ts").collect()} == {(2, 3, 6)}


def test_generated_edges_and_backfill_repeat(spark):
    args = (spark, 3000, 50, 1, 80, True)
    a = generate.synthetic_temporal_edges(*args)
    rows = sorted(map(tuple, a.collect()))
    assert rows == sorted(map(tuple, generate.synthetic_temporal_edges(*args).collect()))
    span = 365 * 86_400
    assert all(u != v and 1_280_000_000 <= t <= 1_280_000_000 + span for u, v, t in rows)
    assert a.groupBy("src").count().agg(F.max("count")).first()[0] <= 72
    untimed = edges_df(spark, [(i, i + 1, 0) for i in range(50)]).select("src", "dst")
    timed = E.backfill_timestamps(untimed, 100, 110).collect()
    assert len(timed) == 50 and all(100 <= r["ts"] <= 110 for r in timed)
    assert [r["ts"] for r in timed] == sorted(r["ts"] for r in timed)


def test_samples(spark):
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12) if (i + j) % 3]
    df = pairs_df(spark, pairs)
    got = {tuple(r) for r in X.sample_existing_edges(df, 10).collect()}
    assert len(got) == 10 and got <= set(pairs)
    assert {tuple(r) for r in X.sample_existing_edges(df, 10).collect()} == got
    vertices = spark.range(12).select(F.col("id").alias("u"))
    absent = {tuple(r) for r in X.sample_non_edges(df, vertices, 8).collect()}
    assert len(absent) == 8 and not absent & set(pairs) and all(u < v for u, v in absent)
    assert X.sample_rows(edges_df(spark, [(1, 2, 3)] * 40), 15).count() == 15
    rows = edges_df(spark, [(i % 50, i, i % 7) for i in range(500)] * 2)
    one, two = (sorted(map(tuple, X.sample_rows(rows.repartition(k), 60).collect())) for k in (3, 5))
    assert one == two and len(one) == 60
    # a dense graph: all absent pairs come back, and no more
    dense = [(a, b) for b in range(12) for a in range(b) if (a, b) != (3, 7)]
    few = X.sample_non_edges(pairs_df(spark, dense), pairs_df(spark, dense).select("u").union(pairs_df(spark, dense).select("v")), 5)
    assert [tuple(r) for r in few.collect()] == [(3, 7)]


def test_samples_above_the_top_k(spark):
    n = 2500
    key = lambda *x: hashlib.md5(",".join(map(str, [*x, 42])).encode()).hexdigest()
    pairs = [(i, i + 1 + i % 7) for i in range(6000)]
    got = {tuple(r) for r in X.sample_existing_edges(pairs_df(spark, pairs), n).collect()}
    assert got == set(sorted(pairs, key=lambda p: key(*p))[:n])
    rows = [(i % 50, i, i % 7) for i in range(3000)]
    sample = sorted(tuple(r) for r in X.sample_rows(edges_df(spark, rows * 2), n).collect())
    copies = sorted(((*r, c) for r in rows for c in range(2)), key=lambda r: key(*r))
    assert sample == sorted(r[:3] for r in copies[:n])
