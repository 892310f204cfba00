"""Sources, sinks and simple graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidecore.checks.base import (
    CORE,
    CP,
    EV,
    GRAPH,
    PS,
    check,
    cp_core,
    cp_pairs,
    customer_part_edges,
    event_edges,
    pairs_sql,
    part_supplier_edges,
    query,
    table,
)
from tidecore.operators import bins as B
from tidecore.operators import graph as G
from tidecore.session import shared_path
from tidecore.sources import edges as E
from tidecore.sources import sinks
from tidecore.plans.scalars import attach


def _as_text(spark, edges) -> str:
    """Edges written as ``src dst ts`` lines, each file with the noise a reader must skip."""
    path = shared_path(spark, "edges-text")
    line = F.concat_ws(" ", "src", "dst", "ts")
    noise = F.when(F.col("src") % 7 == 0, F.array(F.lit("# note"), F.lit(""), F.lit("% x"), F.lit("1 b 2")))
    lines = edges.select(line.alias("value")).union(
        edges.select(F.explode(noise).alias("value"))
    )
    lines.write.text(path)
    return path


@check("read_temporal_edges", query(CP, body="SELECT src, dst, ts FROM edges"))
def _(spark, sf):
    return E.read_temporal_edges(spark, _as_text(spark, customer_part_edges(spark, sf)))


@check("read_static_edges", query(PS, body="SELECT src, dst FROM edges"))
def _(spark, sf):
    edges = part_supplier_edges(spark, sf)
    path = shared_path(spark, "static-text")
    edges.select(F.concat_ws("\t", "src", "dst").alias("value")).write.text(path)
    return E.read_static_edges(spark, path)


@check("read_dataset_dir", query(CP, body="SELECT 'part' AS dataset, src, dst, ts FROM edges"))
def _(spark, sf):
    found = E.read_dataset_dir(spark, _as_text(spark, customer_part_edges(spark, sf)))
    return found.select(F.substring("dataset", 1, 4).alias("dataset"), "src", "dst", "ts")


@check(
    "clean_edge_lines",
    """WITH l AS (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
SELECT count(*) AS lines, count(*) FILTER (WHERE line LIKE '#%' OR line LIKE '!%%' ESCAPE '!') AS comments,
  count(*) FILTER (WHERE line = '') AS blank,
  count(*) FILTER (WHERE NOT (line LIKE '#%' OR line LIKE '!%%' ESCAPE '!' OR line = '')) AS data,
  count(*) FILTER (WHERE NOT (line LIKE '#%' OR line LIKE '!%%' ESCAPE '!' OR line = '')) AS kept
FROM l""",
)
def _(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    kept = E.clean_edge_lines(lines).agg(F.count(F.lit(1)).alias("kept"))
    return E.edge_line_counts(lines).transform(attach, kept)


@check("backfill_timestamps", query(PS, body="SELECT src, dst, true AS in_range FROM edges"))
def _(spark, sf):
    lo, hi = 1_200_000_000, 1_300_000_000
    timed = E.backfill_timestamps(part_supplier_edges(spark, sf).select("src", "dst"), lo, hi)
    return timed.select("src", "dst", F.col("ts").between(lo, hi).alias("in_range"))


@check("drop_self_loops", query(EV, body="SELECT src, dst, ts FROM edges WHERE src <> dst"))
def _(spark, sf):
    return G.drop_self_loops(event_edges(spark, sf))


@check(
    "self_loop_count",
    query(
        EV,
        body="""SELECT count(*) AS edges, count(*) FILTER (WHERE src = dst) AS self_loops,
  count(*) FILTER (WHERE src <> dst) AS kept FROM edges""",
    ),
)
def _(spark, sf):
    return G.self_loop_count(event_edges(spark, sf))


@check(
    "read_first_n",
    query(CP, body="SELECT src, dst, ts FROM edges ORDER BY ts, src, dst LIMIT 10000"),
)
def _(spark, sf):
    return B.read_first_n(customer_part_edges(spark, sf), 10_000)


@check(
    "time_range",
    query(CP, body="SELECT min(ts) AS min_ts, max(ts) AS max_ts, count(*) AS edges FROM edges"),
)
def _(spark, sf):
    return B.time_range(customer_part_edges(spark, sf))


@check(
    "edges_in_range",
    query(CP, body="SELECT * FROM edges WHERE ts >= 820454400 AND ts < 852076800"),
)
def _(spark, sf):
    return B.edges_in_range(customer_part_edges(spark, sf), 820_454_400, 852_076_800)


@check("write_core_numbers", query(*CORE, body="SELECT u, core FROM core"))
def _(spark, sf):
    path = shared_path(spark, "core-text")
    sinks.write_core_numbers(cp_core(spark, sf)[1], path)
    return spark.read.schema("u long, core int").csv(path, sep=" ")


@check("simple_edges", query(CP, pairs_sql(), body="SELECT u, v FROM pairs"))
def _(spark, sf):
    return cp_pairs(spark, sf)


@check("symmetrize", query(*GRAPH, body="SELECT u, v FROM sym"))
def _(spark, sf):
    return G.symmetrize(cp_pairs(spark, sf))


@check(
    "adjacency",
    query(
        *GRAPH,
        body="""SELECT u, v // 512 AS block, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS neighbours
FROM sym GROUP BY u, v // 512""",
    ),
)
def _(spark, sf):
    lists = G.adjacency(cp_pairs(spark, sf), block=512)
    return lists.withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


HALVES = (
    CP,
    pairs_sql("pairs", "edges", "ts < 900000000"),
    pairs_sql("batch", "edges", "ts >= 850000000"),
)


def _halves(spark, sf):
    edges = customer_part_edges(spark, sf)
    return (
        G.simple_edges(edges.filter("ts < 900000000")),
        G.simple_edges(edges.filter("ts >= 850000000")),
    )


@check("add_edges", query(*HALVES, body="SELECT * FROM pairs UNION SELECT * FROM batch"))
def _(spark, sf):
    return G.add_edges(*_halves(spark, sf))


@check("remove_edges", query(*HALVES, body="SELECT * FROM pairs EXCEPT SELECT * FROM batch"))
def _(spark, sf):
    return G.remove_edges(*_halves(spark, sf))


@check(
    "new_vertices",
    query(
        CP,
        pairs_sql("pairs", "edges", "ts < 800000000"),
        pairs_sql("batch", "edges", "ts >= 800000000"),
        body="""SELECT u FROM (SELECT u FROM batch UNION SELECT v FROM batch)
EXCEPT SELECT u FROM (SELECT u FROM pairs UNION SELECT v FROM pairs)""",
    ),
)
def _(spark, sf):
    edges = customer_part_edges(spark, sf)
    return G.new_vertices(
        G.simple_edges(edges.filter("ts < 800000000")),
        G.simple_edges(edges.filter("ts >= 800000000")),
    )


@check(
    "edge_multiplicity",
    query(
        EV,
        body="""SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS multiplicity
FROM edges WHERE src <> dst GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    return G.edge_multiplicity(event_edges(spark, sf))


@check(
    "graph_size",
    query(
        *GRAPH,
        body="""SELECT count(DISTINCT u) AS n, count(*) // 2 AS m,
  CAST(count(*) AS DOUBLE) / count(DISTINCT u) AS average_degree FROM sym""",
    ),
)
def _(spark, sf):
    return G.graph_size(cp_pairs(spark, sf))


@check("degrees", query(*GRAPH, body="SELECT u, count(*) AS degree FROM sym GROUP BY u"))
def _(spark, sf):
    return G.degrees(cp_pairs(spark, sf))


@check(
    "raw_degrees",
    query(
        EV,
        body="""SELECT u, count(*) AS raw_degree
FROM (SELECT src AS u FROM edges UNION ALL SELECT dst FROM edges) GROUP BY u""",
    ),
)
def _(spark, sf):
    return G.raw_degrees(event_edges(spark, sf))


@check(
    "in_out_degrees",
    query(
        CP,
        body="""SELECT coalesce(a.u, b.u) AS u, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree
FROM (SELECT src AS u, count(*) AS o FROM edges GROUP BY src) a
FULL JOIN (SELECT dst AS u, count(*) AS i FROM edges GROUP BY dst) b ON a.u = b.u""",
    ),
)
def _(spark, sf):
    return G.in_out_degrees(customer_part_edges(spark, sf))


@check("vertex_set", query(CP, body="SELECT src AS u FROM edges UNION SELECT dst FROM edges"))
def _(spark, sf):
    return G.vertex_set(customer_part_edges(spark, sf))
