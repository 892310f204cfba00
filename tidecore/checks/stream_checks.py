"""Streams drained to the end, compared with SQL over the same events.

The event edges land in files slice by slice in time order, and the stream
reads a few files per trigger, so that state and watermarks matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidecore.checks.base import EV, binned_sql, check, core_sql, event_edges, query, sym_sql
from tidecore.operators import bins as B
from tidecore.session import shared_path
from tidecore.streaming import coreness as SC
from tidecore.streaming import edges as SE

SLICES = 4
DAYS = 7
TIMEOUT = 900


def landed(spark, sf) -> str:
    """The event edges, written slice after slice."""
    path = shared_path(spark, "landing")
    sliced = B.bin_equal_width(event_edges(spark, sf), SLICES).persist()
    for i in range(SLICES):
        part = sliced.filter(sliced["bin"] == i).select("src", "dst", "ts")
        part.coalesce(1).write.mode("append").parquet(path)
    sliced.unpersist()
    return path


def drained(result: DataFrame) -> DataFrame:
    """Run a stream over everything that is there and return what it wrote."""
    spark = result.sparkSession
    out = shared_path(spark, "stream-out")
    running = (
        result.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", shared_path(spark, "stream-progress"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    if not running.awaitTermination(TIMEOUT):
        running.stop()
        raise TimeoutError("stream did not finish")
    return spark.read.schema(result.schema).parquet(out)


def _stream(spark, sf) -> DataFrame:
    return SE.stream_edges(spark, landed(spark, sf), max_files_per_trigger=1)


@check("stream_edges", query(EV, body="SELECT src, dst, ts FROM edges"))
def _(spark, sf):
    return drained(_stream(spark, sf).select("src", "dst", "ts"))


MARK = "mark AS (SELECT max(ts) - 3600 AS passed FROM edges)"


@check(
    "stream_bin_counts",
    query(
        EV,
        MARK,
        """days AS (SELECT ts - ts % 86400 AS w, least(src, dst) AS u, greatest(src, dst) AS v
    FROM edges WHERE src <> dst)""",
        body="""SELECT w AS window_start, w + 86400 AS window_end, count(*) AS edges, count(DISTINCT (u, v)) AS pairs
FROM days, mark WHERE w + 86400 <= passed GROUP BY w""",
    ),
)
def _(spark, sf):
    return drained(SE.stream_bin_counts(_stream(spark, sf)))


@check(
    "stream_sliding_edge_counts",
    query(
        EV,
        MARK,
        """hit AS (SELECT ts - ts % 86400 - k * 86400 AS w FROM edges, range(7) r(k))""",
        body="""SELECT w AS window_start, w + 7 * 86400 AS window_end, count(*) AS edges FROM hit, mark
WHERE w + 7 * 86400 <= passed GROUP BY w""",
    ),
)
def _(spark, sf):
    return drained(SE.stream_sliding_edge_counts(_stream(spark, sf)))


@check(
    "stream_degree",
    query(
        EV,
        MARK,
        """weeks AS (SELECT DISTINCT ts - ts % (7 * 86400) AS w, least(src, dst) AS u, greatest(src, dst) AS v
    FROM edges WHERE src <> dst)""",
        "ends AS (SELECT w, u FROM weeks UNION ALL SELECT w, v FROM weeks)",
        body="""SELECT w AS window_start, w + 7 * 86400 AS window_end, u, count(*) AS degree FROM ends, mark
WHERE w + 7 * 86400 <= passed GROUP BY w, u""",
    ),
)
def _(spark, sf):
    return drained(SE.stream_degree(_stream(spark, sf)))


@check(
    "stream_novelty",
    query(
        EV,
        body="SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges WHERE src <> dst",
    ),
)
def _(spark, sf):
    return drained(SE.stream_novelty(_stream(spark, sf)))


LIFE = 86_400


@check(
    "stream_pair_expiry",
    query(
        EV,
        MARK,
        f"""seen AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, ts,
      lag(ts) OVER p AS before, lead(ts) OVER p AS later
    FROM edges WHERE src <> dst WINDOW p AS (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts))""",
        body=f"""SELECT u, v, 'enter' AS event, ts AS at FROM seen WHERE before IS NULL OR ts >= before + {LIFE}
UNION ALL SELECT u, v, 'leave', ts + {LIFE} FROM seen, mark
WHERE (later IS NOT NULL AND later >= ts + {LIFE}) OR (later IS NULL AND ts + {LIFE} <= passed)""",
    ),
)
def _(spark, sf):
    return drained(SE.stream_pair_expiry(_stream(spark, sf), LIFE))


BATCHES = (
    EV,
    binned_sql(SLICES),
    """snap AS (SELECT CAST(b AS BIGINT) AS batch, (SELECT max(ts) FROM binned WHERE bin <= b AND src <> dst) AS as_of
    FROM range(4) r(b))""",
    f"""wpairs AS (SELECT DISTINCT batch, least(src, dst) AS u, greatest(src, dst) AS v FROM binned, snap
    WHERE src <> dst AND bin <= batch AND ts > as_of - {DAYS * 86400})""",
    sym_sql("wsym", "wpairs", "batch"),
    core_sql("wcore", "wsym", 60, "batch"),
    "per_level AS (SELECT batch, core, count(*) AS vertices FROM wcore GROUP BY batch, core)",
    """line AS (SELECT as_of, max(core) AS max_core, arg_max(vertices, core) AS vertices_in_max_core, batch
    FROM per_level JOIN snap USING (batch) GROUP BY batch, as_of)""",
)


def _kept(spark, sf, days: int = DAYS) -> SC.CorenessStream:
    keeper, running = SC.stream_coreness(
        _stream(spark, sf), shared_path(spark, "coreness"), days, available_now=True
    )
    if not running.awaitTermination(TIMEOUT):
        running.stop()
        raise TimeoutError("stream did not finish")
    return keeper


@check(
    "stream_coreness",
    query(*BATCHES, body="SELECT u, core FROM wcore WHERE batch = 3"),
)
def _(spark, sf):
    return _kept(spark, sf).latest_core()


@check("stream_core_timeline", query(*BATCHES, body="SELECT * FROM line"))
def _(spark, sf):
    return _kept(spark, sf).timeline().drop("core_batch")


@check(
    "stream_core_anomalies",
    query(
        *BATCHES[:3],
        BATCHES[3].replace(f"as_of - {DAYS * 86400}", "as_of - 172800"),
        *BATCHES[4:],
        "lagged AS (SELECT *, lag(max_core) OVER (ORDER BY batch) AS p FROM line)",
        body="""SELECT as_of, CASE WHEN max_core < p THEN 'CRASH' ELSE 'SURGE' END AS event, p AS previous_max_core,
  max_core AS new_max_core, abs(max_core - p) / CAST(p AS DOUBLE) AS change_ratio, batch FROM lagged
WHERE abs(max_core - p) / CAST(p AS DOUBLE) > 0.05""",
    ),
)
def _(spark, sf):
    keeper = SC.CorenessStream(spark, shared_path(spark, "coreness"), 2, alert_ratio=0.05)
    running = keeper.start(_stream(spark, sf), available_now=True)
    if not running.awaitTermination(TIMEOUT):
        running.stop()
        raise TimeoutError("stream did not finish")
    return SC.stream_core_anomalies(keeper)
