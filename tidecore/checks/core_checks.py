"""Core numbers, timeline and per-vertex indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecore.checks.base import (
    BINNED,
    CORE,
    CP,
    FROM,
    SLIDE,
    SPAN,
    STEP,
    WIDTH,
    check,
    core_sql,
    cp_binned,
    cp_core,
    cp_pairs,
    customer_part_edges,
    query,
    slide_inputs,
    sym_sql,
)
from tidecore.checks.bin_checks import BOUNDS, CALENDAR
from tidecore.operators import bins as B
from tidecore.operators import core as C
from tidecore.operators import index as I
from tidecore.operators import temporal as T
from tidecore.session import shared_path
from tidecore.sources import sinks


@check("core_numbers", query(*CORE, body="SELECT u, core FROM core"))
def _(spark, sf):
    return cp_core(spark, sf)[1]


@check("core_numbers_sliced_hubs", query(*CORE, body="SELECT u, core FROM core"))
def _(spark, sf):
    # the branches for large graphs, all at once: pruned, near changes only, hubs in slices
    return C.core_numbers(cp_pairs(spark, sf), prune_min_rows=0, hub_rows=16, frontier_share=1.0, frontier_min_rows=0)


@check(
    "k_core",
    query(
        *CORE,
        body="""SELECT p.u, p.v FROM pairs p JOIN core a ON a.u = p.u JOIN core b ON b.u = p.v
WHERE a.core >= 20 AND b.core >= 20""",
    ),
)
def _(spark, sf):
    pairs, core = cp_core(spark, sf)
    return C.k_core(pairs, 20, core)


LEVELS = "levels AS (SELECT core, count(*) AS vertices FROM core GROUP BY core)"


@check("core_distribution", query(*CORE, LEVELS, body="SELECT core, vertices FROM levels"))
def _(spark, sf):
    return C.core_distribution(cp_core(spark, sf)[1]).orderBy("core")


@check(
    "core_distribution_head_tail",
    query(
        *CORE,
        LEVELS,
        body="""SELECT core, vertices FROM (SELECT *, row_number() OVER (ORDER BY core) AS a,
  row_number() OVER (ORDER BY core DESC) AS b FROM levels) WHERE a <= 3 OR b <= 2""",
    ),
)
def _(spark, sf):
    return C.core_distribution_head_tail(cp_core(spark, sf)[1], 3, 2)


@check(
    "core_stats",
    query(
        *CORE,
        LEVELS,
        body="""SELECT max(core) AS max_core, arg_max(vertices, core) AS vertices_in_max_core,
  string_agg(core || ':' || vertices, ',' ORDER BY core) AS distribution FROM levels""",
    ),
)
def _(spark, sf):
    entries = F.transform(
        F.map_entries("distribution"), lambda e: F.concat_ws(":", e["key"], e["value"])
    )
    return C.core_stats(cp_core(spark, sf)[1]).withColumn("distribution", F.array_join(entries, ","))


@check(
    "windowed_core_numbers",
    query(
        *BINNED,
        """wpairs AS (SELECT DISTINCT CAST(w AS INTEGER) AS window_id, least(src, dst) AS u, greatest(src, dst) AS v
    FROM binned, range(10) r(w) WHERE src <> dst AND bin >= w * 10 AND bin < 10 + w * 10)""",
        sym_sql("wsym", "wpairs", "window_id"),
        core_sql("wcore", "wsym", 60, "window_id"),
        body="SELECT window_id, u, core FROM wcore",
    ),
)
def _(spark, sf):
    windows = B.window_sequence(cp_binned(spark, sf), 0, WIDTH, 10, 10)
    return C.windowed_core_numbers(B.window_pairs(windows))


@check(
    "max_core_members",
    query(*CORE, body="SELECT u, core FROM core WHERE core = (SELECT max(core) FROM core)"),
)
def _(spark, sf):
    return C.max_core_members(cp_core(spark, sf)[1])


TIMELINE = (
    CP,
    BOUNDS,
    CALENDAR,
    """wpairs AS (SELECT DISTINCT day, least(src, dst) AS u, greatest(src, dst) AS v
    FROM windows WHERE src <> dst)""",
    sym_sql("wsym", "wpairs", "day"),
    core_sql("wcore", "wsym", 60, "day"),
    """per_level AS (SELECT day, core, count(*) AS vertices FROM wcore GROUP BY day, core)""",
    """line AS (SELECT strftime(make_timestamp((any_value(lo) + day * 86400) * 1000000), '%Y-%m-%d') AS date,
    day, max(core) AS max_core, arg_max(vertices, core) AS vertices_in_max_core
  FROM per_level, bounds GROUP BY day)""",
)
ANOMALIES = (
    *TIMELINE,
    "lagged AS (SELECT *, lag(max_core) OVER (ORDER BY day) AS p FROM line)",
    """anomalies AS (SELECT date, day, CASE WHEN max_core < p THEN 'CRASH' ELSE 'SURGE' END AS event,
    p AS previous_max_core, max_core AS new_max_core, abs(max_core - p) / CAST(p AS DOUBLE) AS change_ratio,
    abs(max_core - p) / CAST(p AS DOUBLE) > 0.3 AS ratio_rule, p > 50 AND max_core < 30 AS collapse_rule
  FROM lagged WHERE day >= 7 AND p IS NOT NULL
    AND (abs(max_core - p) / CAST(p AS DOUBLE) > 0.3 OR (p > 50 AND max_core < 30)))""",
)


@check("core_timeline", query(*TIMELINE, body="SELECT * FROM line WHERE day >= 7"))
def _(spark, sf):
    return T.core_timeline(customer_part_edges(spark, sf))


def _timeline(spark, sf):
    return T.core_timeline(customer_part_edges(spark, sf), with_first=True)


@check("core_anomalies", query(*ANOMALIES, body="SELECT * FROM anomalies"))
def _(spark, sf):
    return T.core_anomalies(_timeline(spark, sf))


@check(
    "anomaly_event",
    query(
        *TIMELINE,
        body="""SELECT day, CASE WHEN max_core < 3 THEN 'CRASH' ELSE 'SURGE' END AS event FROM line""",
    ),
)
def _(spark, sf):
    return _timeline(spark, sf).select(
        "day", T.anomaly_event(F.col("max_core"), F.lit(3)).alias("event")
    )


@check(
    "timeline_for_plot",
    query(
        *ANOMALIES,
        body="""SELECT l.date, l.day, max_core, vertices_in_max_core, event FROM line l
LEFT JOIN anomalies a ON a.date = l.date WHERE l.day >= 7""",
    ),
)
def _(spark, sf):
    line = _timeline(spark, sf)
    return T.timeline_for_plot(line.filter("day >= 7"), T.core_anomalies(line))


@check(
    "write_timeline",
    query(
        *TIMELINE,
        body="""SELECT date AS "Date", day AS "Day", max_core AS "MaxCore",
  vertices_in_max_core AS "VerticesInMaxCore" FROM line WHERE day >= 7""",
    ),
)
def _(spark, sf):
    path = shared_path(spark, "timeline")
    sinks.write_timeline(T.core_timeline(customer_part_edges(spark, sf)), path)
    schema = "Date string, Day int, MaxCore int, VerticesInMaxCore long"
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


@check(
    "write_anomalies",
    query(
        *ANOMALIES,
        body="""SELECT date AS "Date", day AS "Day", event AS "Event", previous_max_core AS "PrevMaxCore",
  new_max_core AS "NewMaxCore", printf('%.3f', change_ratio) AS "ChangeRatio" FROM anomalies""",
    ),
)
def _(spark, sf):
    path = shared_path(spark, "anomalies")
    sinks.write_anomalies(T.core_anomalies(_timeline(spark, sf)), path)
    schema = "Date string, Day int, Event string, PrevMaxCore int, NewMaxCore int, ChangeRatio string"
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


@check(
    "core_changes",
    query(
        *SLIDE,
        body="""SELECT coalesce(b.u, a.u) AS u, b.core AS old_core, a.core AS new_core,
  CASE WHEN b.core IS NULL THEN 'appeared' WHEN a.core IS NULL THEN 'vanished'
    WHEN a.core > b.core THEN 'rose' ELSE 'fell' END AS change
FROM core_b b FULL JOIN core_a a ON a.u = b.u WHERE a.core IS DISTINCT FROM b.core""",
    ),
)
def _(spark, sf):
    binned = cp_binned(spark, sf)
    windows = B.window_sequence(binned, FROM, SPAN, STEP, 2)
    both = C.windowed_core_numbers(B.window_pairs(windows))
    before = both.filter("window_id = 0").select("u", "core")
    after = both.filter("window_id = 1").select("u", "core")
    return T.core_changes(before, after)


# --- indexes -----------------------------------------------------------------

NEIGHBOURS = """nb AS (SELECT s.u, a.core, s.v, b.core AS nc FROM sym s
    JOIN core a ON a.u = s.u JOIN core b ON b.u = s.v)"""
MCD = """mcd AS (SELECT u, any_value(core) AS core, count(*) FILTER (WHERE nc > core) AS r,
    count(*) FILTER (WHERE nc >= core) AS mcd, count(*) FILTER (WHERE nc = core) AS s0,
    count(*) AS degree FROM nb GROUP BY u)"""
PCD = """pcd AS (SELECT nb.u, any_value(nb.core) AS core,
    count(*) FILTER (WHERE nc > nb.core OR (nc = nb.core AND m.mcd > nb.core)) AS pcd,
    count(*) FILTER (WHERE nc = nb.core AND m.mcd > nb.core) AS s1,
    count(*) FILTER (WHERE nc = nb.core AND m.r + m.degree > nb.core) AS relaxed_s
  FROM nb JOIN mcd m ON m.u = nb.v GROUP BY nb.u)"""
INDEX = (*CORE, NEIGHBOURS, MCD, PCD)


@check("r_index", query(*INDEX, body="SELECT u, core, r FROM mcd"))
def _(spark, sf):
    return I.r_index(*cp_core(spark, sf))


@check(
    "s_index",
    query(
        *INDEX,
        body="SELECT u, p.core, r, s1 AS s FROM pcd p JOIN mcd USING (u)",
    ),
)
def _(spark, sf):
    return I.s_index(*cp_core(spark, sf), rounds=1)


@check(
    "qualified_vertices",
    query(*INDEX, body="SELECT u, core, r, s0 AS s FROM mcd WHERE mcd > core"),
)
def _(spark, sf):
    return I.qualified_vertices(I.s_index(*cp_core(spark, sf), rounds=0))


@check("mcd_index", query(*INDEX, body="SELECT u, core, mcd FROM mcd"))
def _(spark, sf):
    return I.mcd_index(*cp_core(spark, sf))


@check("pcd_index", query(*INDEX, body="SELECT u, core, pcd FROM pcd"))
def _(spark, sf):
    return I.pcd_index(*cp_core(spark, sf))


@check("relaxed_s_index", query(*INDEX, body="SELECT u, core, relaxed_s FROM pcd"))
def _(spark, sf):
    return I.relaxed_s_index(*cp_core(spark, sf))


@check(
    "core_levels",
    query(
        *CORE,
        body="""SELECT core, u // 4096 AS block, string_agg(CAST(u AS VARCHAR), ',' ORDER BY u) AS vertices,
  core = (SELECT max(core) FROM core) AS top FROM core GROUP BY core, u // 4096""",
    ),
)
def _(spark, sf):
    levels = I.core_levels(cp_core(spark, sf)[1])
    return levels.withColumn("vertices", F.array_join(F.col("vertices").cast("array<string>"), ","))


SIGNED = """ends AS (SELECT u, v, CASE WHEN change = 'add' THEN 1 ELSE -1 END AS sign FROM delta
    UNION ALL SELECT v, u, CASE WHEN change = 'add' THEN 1 ELSE -1 END FROM delta)"""


@check(
    "index_delta",
    query(
        *SLIDE,
        """mb AS (SELECT s.u, a.core, count(*) FILTER (WHERE b.core >= a.core) AS mcd FROM sym_b s
    JOIN core_b a ON a.u = s.u JOIN core_b b ON b.u = s.v GROUP BY s.u, a.core)""",
        SIGNED,
        body="""SELECT e.u, CAST(coalesce(sum(sign) FILTER (WHERE b.core > a.core), 0) AS BIGINT) AS r_delta,
  CAST(coalesce(sum(sign) FILTER (WHERE b.core = a.core AND m.mcd > m.core), 0) AS BIGINT) AS s_delta,
  CAST(coalesce(sum(sign) FILTER (WHERE b.core >= a.core), 0) AS BIGINT) AS mcd_delta,
  CAST(coalesce(sum(sign) FILTER (WHERE b.core > a.core OR (b.core = a.core AND m.mcd > m.core)), 0) AS BIGINT)
    AS pcd_delta
FROM ends e JOIN core_b a ON a.u = e.u JOIN core_b b ON b.u = e.v JOIN mb m ON m.u = e.v GROUP BY e.u""",
    ),
)
def _(spark, sf):
    pairs, core, delta = slide_inputs(spark, sf)
    able = I.mcd_index(pairs, core).select("u", (F.col("mcd") > F.col("core")).alias("able"))
    return I.index_delta(core, able, delta)


@check(
    "promotable_set",
    query(
        *SLIDE,
        # insertions at old core numbers: shrink from all vertices, 60 steps
        """plus AS (SELECT u, v FROM pairs_b UNION SELECT u, v FROM delta WHERE change = 'add')""",
        sym_sql("symp", "plus"),
        """seeded AS (SELECT u, core FROM core_b UNION ALL
    SELECT u, 1 FROM (SELECT DISTINCT u FROM symp EXCEPT SELECT u FROM core_b))""",
        """links AS (SELECT s.u, s.v, a.core, b.core AS nc FROM symp s
    JOIN seeded a ON a.u = s.u JOIN seeded b ON b.u = s.v WHERE b.core >= a.core)""",
        """q(i, u, core) AS (SELECT 0, u, core FROM seeded UNION ALL
    SELECT i, u, core FROM (SELECT q.i + 1 AS i, q.u, q.core, count(*) FILTER (WHERE l.nc > l.core OR o.u IS NOT NULL) AS n
      FROM q JOIN links l ON l.u = q.u LEFT JOIN q o ON o.u = l.v AND o.i = q.i WHERE q.i < 60
      GROUP BY q.i, q.u, q.core) WHERE n > core)""",
        body="SELECT u, CAST(core AS INTEGER) AS core FROM q WHERE i = 60",
    ),
)
def _(spark, sf):
    pairs, core, delta = slide_inputs(spark, sf)
    added = delta.filter("change = 'add'").select("u", "v")
    plus = pairs.union(added).distinct()
    fresh = (
        added.select(F.explode(F.array("u", "v")).alias("u"))
        .distinct()
        .join(core, "u", "left_anti")
        .select("u", F.lit(1).alias("core"))
    )
    return I.promotable_set(plus, core.union(fresh))
