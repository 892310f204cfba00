"""Dataset profiles, temporal quality and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecore.checks.base import (
    CP,
    GRAPH,
    EV,
    check,
    cp_pairs,
    customer_part_edges,
    event_edges,
    pairs_sql,
    query,
)
from tidecore.checks.bin_checks import BOUNDS, _snapshot
from tidecore.operators import profile as P
from tidecore.operators import sampling as X
from tidecore.session import shared_path
from tidecore.sources import sinks

OUT = "od AS (SELECT src AS u, count(*) AS d FROM edges GROUP BY src)"
IN = "ind AS (SELECT dst AS u, count(*) AS d FROM edges GROUP BY dst)"
RAW = """raw AS (SELECT u, count(*) AS d FROM (SELECT src AS u FROM edges UNION ALL SELECT dst FROM edges) GROUP BY u)"""
PROFILE = """prof AS (SELECT (SELECT count(*) FROM raw) AS num_nodes, count(*) AS num_edges,
    min(ts) AS min_timestamp, max(ts) AS max_timestamp,
    CAST((max(ts) - min(ts)) // 86400 AS INTEGER) AS time_span_days,
    round_even((max(ts) - min(ts)) / CAST(31536000 AS DOUBLE), 2) AS time_span_years,
    (SELECT max(d) FROM raw) AS max_degree,
    round_even(2.0::DOUBLE * count(*) / (SELECT count(*) FROM raw), 2) AS avg_degree,
    round_even(2.0::DOUBLE * count(*) / ((SELECT count(*) FROM raw) * ((SELECT count(*) FROM raw) - 1)), 8) AS density
  FROM edges)"""


@check("dataset_profile", query(CP, RAW, PROFILE, body="SELECT * FROM prof"))
def _(spark, sf):
    return P.dataset_profile(customer_part_edges(spark, sf))


@check("write_profile_csv", query(CP, RAW, PROFILE, body="SELECT * FROM prof"))
def _(spark, sf):
    profile = P.dataset_profile(customer_part_edges(spark, sf))
    path = shared_path(spark, "profile")
    sinks.write_profile_csv(profile, path)
    return spark.read.schema(profile.schema).csv(path, header=True)


def _report(name: str, kind: str) -> str:
    return f"""SELECT '{name}' AS dataset, format('{{:,}}', num_nodes) AS nodes, format('{{:,}}', num_edges) AS edges,
  CASE WHEN time_span_years >= 1 THEN printf('%.1f', time_span_years) || 'y' ELSE time_span_days || 'd' END AS time_span,
  CAST(max_degree AS VARCHAR) AS max_degree, printf('%.2e', density) AS density, '{kind}' AS type FROM prof"""


@check(
    "profile_report_rows",
    f"""SELECT * FROM ({query(CP, RAW, PROFILE, body=_report("orders", "Unknown"))})
UNION ALL SELECT * FROM ({query(EV, RAW, PROFILE, body=_report("sx-superuser", "Q&A"))})""",
)
def _(spark, sf):
    cp = P.dataset_profile(customer_part_edges(spark, sf)).withColumn("dataset", F.lit("orders"))
    ev = P.dataset_profile(event_edges(spark, sf)).withColumn("dataset", F.lit("sx-superuser"))
    return P.profile_report_rows(cp.unionByName(ev))


@check(
    "temporal_profile",
    query(
        CP,
        OUT,
        IN,
        RAW,
        body="""SELECT count(*) AS num_edges, min(ts) AS min_ts, max(ts) AS max_ts,
  count(DISTINCT ts) AS distinct_timestamps, (SELECT count(*) FROM raw) AS num_nodes,
  (SELECT avg(d) FROM od) AS mean_out_degree, (SELECT max(d) FROM od) AS max_out_degree,
  (SELECT min(d) FROM od) AS min_out_degree, (SELECT avg(d) FROM ind) AS mean_in_degree,
  (SELECT max(d) FROM ind) AS max_in_degree, (SELECT min(d) FROM ind) AS min_in_degree,
  max(ts) - min(ts) AS time_span FROM edges""",
    ),
)
def _(spark, sf):
    return P.temporal_profile(customer_part_edges(spark, sf))


@check(
    "degree_distribution",
    query(
        CP,
        OUT,
        IN,
        body="""SELECT 'out' AS direction, d AS degree, count(*) AS nodes FROM od GROUP BY d
UNION ALL SELECT 'in', d, count(*) FROM ind GROUP BY d""",
    ),
)
def _(spark, sf):
    edges = customer_part_edges(spark, sf)
    both = [P.degree_distribution(edges, d).withColumn("direction", F.lit(d)) for d in ("out", "in")]
    return both[0].union(both[1])


@check(
    "edges_per_timestamp", query(CP, body="SELECT ts, count(*) AS edges FROM edges GROUP BY ts")
)
def _(spark, sf):
    return P.edges_per_timestamp(customer_part_edges(spark, sf))


HOURS = """hours AS (SELECT unnest(range(lo - lo % 3600, hi - hi % 3600 + 1, 3600)) AS hour FROM bounds)"""


@check(
    "edges_per_hour",
    query(
        EV,
        BOUNDS,
        HOURS,
        body="""SELECT hour, count(src) AS edges FROM hours LEFT JOIN edges ON ts - ts % 3600 = hour GROUP BY hour""",
    ),
)
def _(spark, sf):
    return P.edges_per_hour(event_edges(spark, sf))


@check(
    "activity_series",
    query(
        EV,
        BOUNDS,
        HOURS,
        "per_ts AS (SELECT ts, count(*) AS edges FROM edges GROUP BY ts)",
        "per_hour AS (SELECT hour AS ts, count(src) AS edges FROM hours LEFT JOIN edges ON ts - ts % 3600 = hour GROUP BY hour)",
        body="""SELECT ts, edges FROM per_hour WHERE (SELECT count(*) FROM per_ts) > 1000
UNION ALL SELECT ts, edges FROM per_ts WHERE (SELECT count(*) FROM per_ts) <= 1000""",
    ),
)
def _(spark, sf):
    return P.activity_series(event_edges(spark, sf))


@check(
    "top_active_nodes",
    query(
        CP,
        OUT,
        IN,
        body="""(SELECT 'source' AS role, u AS node, d AS edges FROM od ORDER BY d DESC, u LIMIT 20)
UNION ALL (SELECT 'target', u, d FROM ind ORDER BY d DESC, u LIMIT 20)""",
    ),
)
def _(spark, sf):
    return P.top_active_nodes(customer_part_edges(spark, sf))


@check(
    "inter_event_gaps",
    query(
        EV,
        """gaps AS (SELECT ts - lag(ts) OVER (ORDER BY ts) AS gap FROM edges)""",
        body="""SELECT count(gap) AS gaps, min(gap) AS min_gap, max(gap) AS max_gap,
  CAST(sum(gap) AS DOUBLE) / count(gap) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap FROM gaps""",
    ),
)
def _(spark, sf):
    return P.inter_event_gaps(event_edges(spark, sf))


TD = """td AS (SELECT count(DISTINCT ts) AS distinct_timestamps, count(*) AS edges,
    count(DISTINCT ts) / CAST(count(*) AS DOUBLE) AS temporal_density,
    count(*) / CAST(count(DISTINCT ts) AS DOUBLE) AS edges_per_timestamp FROM edges)"""


@check(
    "temporal_density",
    query(
        EV,
        TD,
        body="""SELECT *, CASE WHEN temporal_density > 0.8 THEN 'very sparse' WHEN temporal_density > 0.5
  THEN 'sparse' ELSE 'dense' END AS density_class FROM td""",
    ),
)
def _(spark, sf):
    return P.temporal_density(event_edges(spark, sf))


@check(
    "degree_cv",
    query(
        CP,
        OUT,
        IN,
        body="""SELECT (SELECT round(stddev_pop(d) / avg(d), 9) FROM od) AS out_degree_cv,
  (SELECT round(stddev_pop(d) / avg(d), 9) FROM ind) AS in_degree_cv""",
    ),
)
def _(spark, sf):
    return P.degree_cv(customer_part_edges(spark, sf))


@check(
    "power_law_slope",
    query(
        CP,
        OUT,
        """levels AS (SELECT d, count(*) AS nodes FROM od GROUP BY d)""",
        """fit AS (SELECT count(*) AS levels, round(regr_slope(ln(CAST(nodes AS DOUBLE)), ln(CAST(d AS DOUBLE))), 6) AS slope
    FROM levels WHERE d > (SELECT min(d) FROM levels))""",
        body="SELECT levels, slope, abs(slope) > 1.5 AND abs(slope) < 3.5 AS plausible FROM fit",
    ),
)
def _(spark, sf):
    return P.power_law_slope(customer_part_edges(spark, sf))


SP = """sp AS (SELECT count(*) AS edges, (SELECT count(*) FROM raw) AS nodes,
    count(*) / CAST((SELECT count(*) FROM raw) * ((SELECT count(*) FROM raw) - 1) AS DOUBLE) AS sparsity FROM edges)"""


@check(
    "sparsity",
    query(
        CP,
        RAW,
        SP,
        body="""SELECT *, CASE WHEN sparsity < 0.001 THEN 'very sparse' WHEN sparsity < 0.01 THEN 'sparse'
  ELSE 'dense' END AS sparsity_class FROM sp""",
    ),
)
def _(spark, sf):
    return P.sparsity(customer_part_edges(spark, sf))


SPAN = """span AS (SELECT u, max(ts) - min(ts) AS span
    FROM (SELECT src AS u, ts FROM edges UNION ALL SELECT dst, ts FROM edges) GROUP BY u)"""


@check("node_activity_span", query(CP, SPAN, body="SELECT u, span FROM span"))
def _(spark, sf):
    return P.node_activity_span(customer_part_edges(spark, sf))


@check(
    "temporal_locality",
    query(
        EV,
        BOUNDS,
        SPAN,
        """mean AS (SELECT CAST(sum(span) AS DOUBLE) / count(*) AS mean_span, count(*) AS active_nodes
    FROM span WHERE span > 0)""",
        body="""SELECT mean_span, active_nodes, hi - lo AS total_span, mean_span / (hi - lo) AS relative_span,
  mean_span / (hi - lo) < 0.5 AS is_local FROM mean, bounds""",
    ),
)
def _(spark, sf):
    return P.temporal_locality(event_edges(spark, sf))


@check(
    "quality_score",
    query(
        EV,
        RAW,
        TD,
        SP,
        """pts AS (SELECT CASE WHEN temporal_density > 0.8 THEN 30 WHEN temporal_density > 0.5 THEN 20 ELSE 10 END AS temporal_points,
      CASE WHEN sparsity < 0.001 THEN 30 WHEN sparsity < 0.01 THEN 20 ELSE 10 END AS sparsity_points,
      CASE WHEN nodes > 500000 THEN 20 WHEN nodes > 100000 THEN 15 ELSE 10 END AS node_points,
      CASE WHEN sp.edges > 5000000 THEN 20 WHEN sp.edges > 1000000 THEN 15 ELSE 10 END AS edge_points FROM td, sp)""",
        """total AS (SELECT *, temporal_points + sparsity_points + node_points + edge_points AS score FROM pts)""",
        body="""SELECT *, CASE WHEN score >= 80 THEN 'very suitable' WHEN score >= 60 THEN 'suitable' ELSE 'limited' END
  AS verdict FROM total""",
    ),
)
def _(spark, sf):
    return P.quality_score(event_edges(spark, sf))


@check(
    "novelty_index",
    query(
        EV,
        f"""seen AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v, {_snapshot('day')} AS snapshot
    FROM edges WHERE src <> dst)""",
        """marked AS (SELECT a.snapshot, NOT EXISTS (SELECT 1 FROM seen b WHERE b.u = a.u AND b.v = a.v
      AND b.snapshot < a.snapshot) AS fresh FROM seen a)""",
        body="""SELECT count(*) AS snapshots, round(avg(share), 9) AS novelty FROM (
  SELECT snapshot, count(*) FILTER (WHERE fresh) / CAST(count(*) AS DOUBLE) AS share FROM marked GROUP BY snapshot)""",
    ),
)
def _(spark, sf):
    return P.novelty_index(event_edges(spark, sf))


SPLIT = (
    EV,
    BOUNDS,
    "cut AS (SELECT lo + CAST(floor((hi - lo) * 0.85::DOUBLE) AS BIGINT) AS cut_at FROM bounds)",
    pairs_sql("train", "edges, cut", "ts <= cut_at"),
    pairs_sql("test", "edges, cut", "ts > cut_at"),
)


@check(
    "surprise_index",
    query(
        *SPLIT,
        body="""SELECT count(*) AS test_pairs,
  count(*) FILTER (WHERE (u, v) NOT IN (SELECT (u, v) FROM train)) / CAST(count(*) AS DOUBLE) AS surprise FROM test""",
    ),
)
def _(spark, sf):
    return P.surprise_index(event_edges(spark, sf))


@check(
    "reoccurrence_index",
    query(
        *SPLIT,
        body="""SELECT count(*) AS train_pairs,
  count(*) FILTER (WHERE (u, v) IN (SELECT (u, v) FROM test)) / CAST(count(*) AS DOUBLE) AS reoccurrence FROM train""",
    ),
)
def _(spark, sf):
    return P.reoccurrence_index(event_edges(spark, sf))


@check(
    "active_snapshots",
    query(
        CP,
        BOUNDS,
        body="""SELECT (SELECT count(DISTINCT ts // 86400) FROM edges) AS active, hi // 86400 - lo // 86400 + 1 AS snapshots,
  (SELECT count(DISTINCT ts // 86400) FROM edges) / CAST(hi // 86400 - lo // 86400 + 1 AS DOUBLE) AS active_share
FROM bounds""",
    ),
)
def _(spark, sf):
    return P.active_snapshots(customer_part_edges(spark, sf))


@check(
    "sample_existing_edges",
    query(*GRAPH[:2], body="SELECT u, v FROM pairs ORDER BY md5(u || ',' || v || ',42'), u, v LIMIT 1000"),
)
def _(spark, sf):
    return X.sample_existing_edges(cp_pairs(spark, sf), 1000)


@check("sample_non_edges")
def _(spark, sf):
    pairs = cp_pairs(spark, sf)
    from tidecore.operators.maintain import endpoints

    return X.sample_non_edges(pairs, endpoints(pairs), 1000)


@check(
    "sample_rows",
    query(
        CP,
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY src, dst, ts) - 1 AS k FROM edges)",
        body="""SELECT src, dst, ts FROM numbered
ORDER BY md5(src || ',' || dst || ',' || ts || ',' || k || ',42'), src, dst, ts, k LIMIT 1000""",
    ),
)
def _(spark, sf):
    return X.sample_rows(customer_part_edges(spark, sf), 1000)
