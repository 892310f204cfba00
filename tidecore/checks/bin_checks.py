"""Bins and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecore.checks.base import (
    BINNED,
    BINS,
    CP,
    DELTA,
    EV,
    START,
    WIDTH,
    binned_sql,
    check,
    cp_binned,
    customer_part_edges,
    event_edges,
    pairs_sql,
    query,
)
from tidecore.operators import bins as B

BOUNDS = "bounds AS (SELECT min(ts) AS lo, max(ts) AS hi FROM edges)"


@check("bin_equal_width", query(*BINNED, body="SELECT * FROM binned"))
def _(spark, sf):
    return cp_binned(spark, sf)


@check(
    "bin_timestamp_closed",
    query(
        CP,
        BOUNDS,
        body="""SELECT src, dst, ts,
  CAST(least(floor((ts - lo) / CAST(hi - lo AS DOUBLE) * 100), 99) AS INTEGER) AS bin FROM edges, bounds""",
    ),
)
def _(spark, sf):
    return B.bin_timestamp_closed(customer_part_edges(spark, sf), BINS)


@check(
    "bin_equal_count",
    query(
        CP,
        body="""SELECT src, dst, ts, CAST(least((rn - 1) // ((n + 99) // 100), 99) AS INTEGER) AS bin
FROM (SELECT *, row_number() OVER (ORDER BY ts, src, dst) AS rn, count(*) OVER () AS n FROM edges)""",
    ),
)
def _(spark, sf):
    return B.bin_equal_count(customer_part_edges(spark, sf), BINS)


@check(
    "bin_sorted_boundaries",
    query(
        CP,
        BOUNDS,
        """ends AS (SELECT b, trunc(lo + (b + 1) * (CAST(hi - lo + 1 AS DOUBLE) / 100)) AS stop
    FROM bounds, range(100) r(b))""",
        """per_ts AS (SELECT ts, coalesce(min(b), 99) AS bin FROM (SELECT DISTINCT ts FROM edges)
    LEFT JOIN ends ON ts < stop GROUP BY ts)""",
        body="SELECT src, dst, ts, CAST(bin AS INTEGER) AS bin FROM edges JOIN per_ts USING (ts)",
    ),
)
def _(spark, sf):
    return B.bin_sorted_boundaries(customer_part_edges(spark, sf), BINS)


@check(
    "bin_daily",
    query(
        EV,
        BOUNDS,
        body="""SELECT src, dst, ts, CAST((ts - lo) // 86400 AS INTEGER) AS bin,
  CAST((hi - lo) // 86400 + 1 AS INTEGER) AS total_days FROM edges, bounds""",
    ),
)
def _(spark, sf):
    return B.bin_daily(event_edges(spark, sf))


def _snapshot(unit: str) -> str:
    return f"strftime(date_trunc('{unit}', make_timestamp(ts * 1000000)), '%Y-%m-%d')"


@check(
    "discretize",
    query(
        CP,
        body=f"""SELECT src, dst, ts, {_snapshot('day')} AS snapshot, {_snapshot('week')} AS week,
  {_snapshot('month')} AS month FROM edges""",
    ),
)
def _(spark, sf):
    edges = customer_part_edges(spark, sf)
    weekly = B.discretize(edges, "weekly").withColumnRenamed("snapshot", "week")
    monthly = B.discretize(weekly, "monthly").withColumnRenamed("snapshot", "month")
    return B.discretize(monthly, "daily").select("src", "dst", "ts", "snapshot", "week", "month")


@check(
    "choose_time_scale",
    query(
        CP,
        body="""SELECT n, CASE WHEN n > 10000000 THEN 'monthly' WHEN n > 1000000 THEN 'weekly' ELSE 'daily' END
  AS scale, CASE WHEN n * 100 > 10000000 THEN 'monthly' WHEN n * 100 > 1000000 THEN 'weekly' ELSE 'daily' END
  AS scale_at_100 FROM (SELECT count(*) AS n FROM edges)""",
    ),
)
def _(spark, sf):
    n = F.col("n")
    return (
        customer_part_edges(spark, sf)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            n,
            B.choose_time_scale(n).alias("scale"),
            B.choose_time_scale(n * 100).alias("scale_at_100"),
        )
    )


@check(
    "bin_histogram", query(*BINNED, body="SELECT bin, count(*) AS edges FROM binned GROUP BY bin")
)
def _(spark, sf):
    return B.bin_histogram(cp_binned(spark, sf))


@check("window_edges", query(*BINNED, body="SELECT * FROM binned WHERE bin >= 40 AND bin < 50"))
def _(spark, sf):
    return B.window_edges(cp_binned(spark, sf), START, WIDTH)


@check("edges_of_bins", query(*BINNED, body="SELECT * FROM binned WHERE bin >= 40 AND bin < 50"))
def _(spark, sf):
    return B.edges_of_bins(customer_part_edges(spark, sf), BINS, START, WIDTH)


@check("bin_edges_of", query(*BINNED, body="SELECT * FROM binned WHERE bin = 99"))
def _(spark, sf):
    return B.bin_edges_of(cp_binned(spark, sf), BINS - 1)


@check("append_window", query(*BINNED, body="SELECT * FROM binned WHERE bin >= 40 AND bin <= 50"))
def _(spark, sf):
    return B.append_window(cp_binned(spark, sf), START, WIDTH)


@check(
    "start_bin",
    query(
        CP,
        """n AS (SELECT CAST((max(ts) - min(ts)) // 86400 + 1 AS INTEGER) AS bins FROM edges)""",
        """w AS (SELECT bins, width FROM n, (VALUES (100), (2000), (2390)) t(width))""",
        body="""SELECT bins, width,
  CAST(greatest(CASE WHEN 400 + width > bins THEN bins - width - 10 ELSE 400 END, 0) AS INTEGER) AS fixed,
  CAST(greatest(CASE WHEN 400 + width + 5 >= bins THEN bins - width - 15 ELSE 400 END, 0) AS INTEGER) AS fixed_step,
  CAST(greatest(floor((bins - width) / 2), 0) AS INTEGER) AS middle, 0 AS zero FROM w""",
    ),
)
def _(spark, sf):
    bins = B.bin_daily(customer_part_edges(spark, sf)).agg(F.max("total_days").alias("bins"))
    rows = None
    for width in (100, 2000, 2390):
        row = bins.select(
            "bins",
            F.lit(width).alias("width"),
            B.start_bin(F.col("bins"), width, 1, "fixed").alias("fixed"),
            B.start_bin(F.col("bins"), width, 5, "fixed_step").alias("fixed_step"),
            B.start_bin(F.col("bins"), width, 1, "middle").alias("middle"),
            B.start_bin(F.col("bins"), width, 1, "zero").alias("zero"),
        )
        rows = row if rows is None else rows.union(row)
    return rows


@check(
    "slide_delta",
    query(
        *BINNED,
        body="""SELECT *, 'remove' AS change FROM binned WHERE bin >= 40 AND bin < 43
UNION ALL SELECT *, 'add' FROM binned WHERE bin >= 50 AND bin < 53""",
    ),
)
def _(spark, sf):
    return B.slide_delta(cp_binned(spark, sf), START, WIDTH, 3)


@check(
    "slide_delta_of",
    query(
        *BINNED,
        body="""SELECT *, 'remove' AS change FROM binned WHERE bin >= 40 AND bin < 43
UNION ALL SELECT *, 'add' FROM binned WHERE bin >= 50 AND bin < 53""",
    ),
)
def _(spark, sf):
    return B.slide_delta_of(customer_part_edges(spark, sf), BINS, START, WIDTH, 3)


EV_BINNED = (EV, binned_sql(30))


@check(
    "effective_delta",
    query(
        *EV_BINNED,
        pairs_sql("pairs_b", "binned", "bin >= 5 AND bin < 12"),
        pairs_sql("pairs_a", "binned", "bin >= 7 AND bin < 14"),
        DELTA,
        body="SELECT u, v, change FROM delta",
    ),
)
def _(spark, sf):
    return B.effective_delta(B.bin_equal_width(event_edges(spark, sf), 30), 5, 7, 2)


@check(
    "window_sequence",
    query(
        *BINNED,
        body="""SELECT b.*, CAST(w AS INTEGER) AS window_id FROM binned b, range(5) r(w)
WHERE bin >= 40 + w * 4 AND bin < 40 + w * 4 + 10 AND 40 + w * 4 + 10 <= 100""",
    ),
)
def _(spark, sf):
    return B.window_sequence(cp_binned(spark, sf), START, WIDTH, 4, 5)


@check(
    "window_step_sweep",
    query(
        CP,
        binned_sql(1000),
        """grid AS (SELECT w.width, s.step,
    CASE WHEN 400 + w.width + s.step >= 1000 THEN 1000 - w.width - s.step - 10 ELSE 400 END AS st
  FROM (VALUES (10), (50), (100), (700)) w(width), (VALUES (1), (10), (50)) s(step) WHERE s.step <= w.width)""",
        body="""SELECT width, step, CAST(st AS INTEGER) AS start,
  count(*) FILTER (WHERE bin >= st AND bin < st + width) AS initial_edges,
  count(*) FILTER (WHERE bin >= st AND bin < st + step) AS removed_edges,
  count(*) FILTER (WHERE bin >= st + width AND bin < st + width + step) AS added_edges,
  count(*) FILTER (WHERE bin >= st AND bin < st + step)
    + count(*) FILTER (WHERE bin >= st + width AND bin < st + width + step) AS updates
FROM grid, binned GROUP BY width, step, st""",
    ),
)
def _(spark, sf):
    return B.window_step_sweep(cp_binned(spark, sf, 1000), 1000, [10, 50, 100, 700], [1, 10, 50])


@check(
    "batch_from_bins",
    query(
        *BINNED,
        body="""(SELECT *, 'remove' AS change FROM binned WHERE bin >= 40 ORDER BY bin, ts, src, dst LIMIT 1000)
UNION ALL (SELECT *, 'add' FROM binned WHERE bin >= 50 ORDER BY bin, ts, src, dst LIMIT 1000)""",
    ),
)
def _(spark, sf):
    return B.batch_from_bins(cp_binned(spark, sf), START, WIDTH, 1000)


CALENDAR = """daily AS (SELECT src, dst, ts, CAST((ts - lo) // 86400 AS INTEGER) AS d,
    CAST((hi - lo) // 86400 + 1 AS INTEGER) AS total FROM edges, bounds),
  windows AS (SELECT src, dst, ts, CAST(e.day AS INTEGER) AS day FROM daily,
    LATERAL (SELECT unnest(range(d, d + 7)) AS day) e
    WHERE e.day >= 6 AND (e.day = 6 OR e.day <= total - 2))"""


@check(
    "calendar_windows",
    query(CP, BOUNDS, CALENDAR, body="SELECT src, dst, ts, day FROM windows"),
)
def _(spark, sf):
    return B.calendar_windows(customer_part_edges(spark, sf))
