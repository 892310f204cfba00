"""Edge tables over the driver's data, the registry of queries, and SQL building blocks.

The SQL is written from the definitions, not from the Spark code: core numbers
come from a recursive h-index over the whole graph, and maintained results are
compared with it on the new window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecore.functions.time import epoch_seconds
from tidecore.operators import bins as B
from tidecore.operators import core as C
from tidecore.operators import graph as G
from tidecore.plans.fixpoint import materialise
from tidecore.plans.ordering import with_previous

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PART_OFFSET = 1_000_000_000
BINS, START, WIDTH = 100, 40, 10
# The slide of the maintenance checks: its two windows cover all bins.
FROM, SPAN, STEP = 0, 90, 10


def check(name: str, sql: str | None = None):
    """Register a query under its operator's name, with its oracle where SQL can say it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- edge tables -----------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts they ordered.

    Compressed files look small enough to be sent to every task: the join is told to sort instead, so that no table passes
    through the driver.
    """
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("_k"), F.col("o_custkey").alias("src"), "o_orderdate"
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("_k"), (F.col("l_partkey") + PART_OFFSET).alias("dst")
    )
    return orders.hint("merge").join(lines, "_k").select(
        "src", "dst", epoch_seconds(F.col("o_orderdate")).alias("ts")
    )


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("src"),
        (F.col("l_suppkey") + PART_OFFSET).alias("dst"),
        epoch_seconds(F.col("l_shipdate")).alias("ts"),
    )


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events: has repeats and self-loops."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    return (
        with_previous(events, ["ts", "event_id"], {"src": "user_id"})
        .filter(F.col("src").isNotNull())
        .select("src", F.col("user_id").alias("dst"), epoch_seconds(F.col("ts")).alias("ts"))
    )


def cp_pairs(spark, sf_dir):
    return G.simple_edges(customer_part_edges(spark, sf_dir))


def cp_core(spark, sf_dir):
    """The graph, written because most users read it several times, and its core numbers."""
    pairs, _ = materialise(cp_pairs(spark, sf_dir))
    return pairs, C.core_numbers(pairs)


def cp_binned(spark, sf_dir, bins: int = BINS):
    return B.bin_equal_width(customer_part_edges(spark, sf_dir), bins)


def slide_inputs(spark, sf_dir):
    """Window graph, its core numbers, and the effective delta of one slide; written, as every user reads them several times."""
    binned, _ = materialise(cp_binned(spark, sf_dir).select("src", "dst", "bin"))
    pairs, _ = materialise(G.simple_edges(B.window_edges(binned, FROM, SPAN)))
    delta, _ = materialise(B.effective_delta(binned, FROM, SPAN, STEP))
    return pairs, C.core_numbers(pairs), delta


# --- SQL -------------------------------------------------------------------

CP = """edges AS (SELECT o_custkey AS src, 1000000000 + l_partkey AS dst,
    CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ts
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
PS = """edges AS (SELECT l_partkey AS src, 1000000000 + l_suppkey AS dst,
    CAST(floor(epoch(l_shipdate)) AS BIGINT) AS ts FROM lineitem)"""
EV = """edges AS (SELECT src, dst, ts FROM (SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS src,
    user_id AS dst, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events) WHERE src IS NOT NULL)"""


def pairs_sql(name: str = "pairs", source: str = "edges", where: str = "true") -> str:
    return (
        f"{name} AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v "
        f"FROM {source} WHERE src <> dst AND {where})"
    )


def sym_sql(name: str = "sym", pairs: str = "pairs", key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"{name} AS (SELECT {k}u, v FROM {pairs} UNION ALL SELECT {k}v, u FROM {pairs})"


def core_sql(name: str = "core", sym: str = "sym", depth: int = 40, key: str = "") -> str:
    """Recursive h-index; ``depth`` is beyond the rounds the data needs."""
    k, kt = (f"{key}, ", f"t.{key}, ") if key else ("", "")
    ks = f"s.{key}, " if key else ""
    on = f"AND t.{key} = s.{key}" if key else ""
    return f"""{name}_it(i, {k}v, c) AS (
    SELECT 0, {k}u, count(*) FROM {sym} GROUP BY {k}u
    UNION ALL
    SELECT i + 1, {k}u, max(least(c, rn)) FROM (
      SELECT t.i, {kt}s.u, t.c,
        row_number() OVER (PARTITION BY t.i, {ks}s.u ORDER BY t.c DESC) AS rn
      FROM {sym} s JOIN {name}_it t ON t.v = s.v {on} WHERE t.i < {depth})
    GROUP BY i, {k}u),
  {name} AS (SELECT {k}v AS u, CAST(c AS INTEGER) AS core FROM {name}_it WHERE i = {depth})"""


def binned_sql(bins: int = BINS) -> str:
    return f"""binned AS (SELECT src, dst, ts,
    CAST(least(floor((ts - lo) / (CAST(hi - lo + 1 AS DOUBLE) / {bins})), {bins - 1}) AS INTEGER) AS bin
  FROM edges, (SELECT min(ts) AS lo, max(ts) AS hi FROM edges))"""


def query(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n  ".join(ctes) + "\n" + body


GRAPH = (CP, pairs_sql(), sym_sql())
CORE = (*GRAPH, core_sql())
BINNED = (CP, binned_sql())


def window_sql(suffix: str, start: int, width: int) -> tuple[str, str, str]:
    """Pairs, both directions and core numbers of one bin window."""
    return (
        pairs_sql(f"pairs{suffix}", "binned", f"bin >= {start} AND bin < {start + width}"),
        sym_sql(f"sym{suffix}", f"pairs{suffix}"),
        core_sql(f"core{suffix}", f"sym{suffix}", 60),
    )


BEFORE = (*BINNED, *window_sql("_b", FROM, SPAN))
AFTER = window_sql("_a", FROM + STEP, SPAN)
DELTA = """delta AS (SELECT u, v, 'remove' AS change FROM (SELECT * FROM pairs_b EXCEPT SELECT * FROM pairs_a)
  UNION ALL SELECT u, v, 'add' FROM (SELECT * FROM pairs_a EXCEPT SELECT * FROM pairs_b))"""
SLIDE = (*BEFORE, *AFTER, DELTA)
