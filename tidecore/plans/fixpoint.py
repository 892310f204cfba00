"""Helpers for jobs that repeat a DataFrame step until nothing changes.

Each round is one Spark job: the new table is written to the shared folder
(so the plan stays short, the next round sees exact sizes, and a lost executor
costs one round, not all of them), and the numbers that decide about the next
round are observed while that same job runs. A written table is used rather
than ``checkpoint()`` because the latter keeps the ordering and partitioning
expressions of its plan, which double with every self-join of a loop.
"""

from __future__ import annotations

import time
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from tidecore.session import shared_path

# Rows one task is meant to handle in a loop, for small and for large inputs.
SMALL_TASK_ROWS = 50_000
LARGE_TASK_ROWS = 2_000_000
MAX_LOOP_PARTITIONS = 50_000
# Below this many rows re-planning at stage borders costs more than it saves.
ADAPTIVE_MIN_ROWS = 5_000_000
# Tables that a task holds of its rows where they are sorted and grouped several times before they move again.
TASK_TABLES = 4
ROUND_LIMIT = 100_000
# Written size up to which a table may be sent to every task, over and over, from the driver.
LOOP_BROADCAST = "64KB"
# Shuffled bytes up to which tasks are joined into one.
LOOP_TASK_BYTES = "16MB"


class NotConverged(RuntimeError):
    """A fixpoint loop reached its round limit before it settled."""


# where each written table lives, as long as its DataFrame is in use
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def materialise(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` in one job; return the written table and the observed metrics.

    A plan that the optimizer reduces to an empty table reports no metrics;
    they are then counted on the (empty) result.
    """
    spark = df.sparkSession
    path = shared_path(spark, "round")
    named = [c.alias(k) for k, c in metrics.items()]
    watch = Observation()
    watched = df.observe(watch, *named) if named else df
    watched.write.parquet(path)
    saved = spark.read.schema(df.schema).parquet(path)
    _PATHS[saved] = path
    if not named:
        return saved, {}
    if _arrived(watch):
        return saved, watch.get
    return saved, saved.agg(*named).first().asDict()


def stands_for(view: DataFrame, table: DataFrame) -> DataFrame:
    """Let ``view`` be discarded in place of the written ``table`` that it reads."""
    path = _PATHS.pop(table, None)
    if path is not None:
        _PATHS[view] = path
    return view


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that no later step reads."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path is not None:
            sc = table.sparkSession.sparkContext
            target = sc._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def _arrived(watch: Observation, seconds: float = 1.0) -> bool:
    """Metrics come through the listener bus: wait for them a moment, never forever."""
    until = time.monotonic() + seconds
    while not watch._jo.future().isCompleted():
        if time.monotonic() > until:
            return False
        time.sleep(0.002)
    return True


def loop_partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for a loop over ``rows``: few when small, bounded task size when large."""
    cores = spark.sparkContext.defaultParallelism
    small = min(cores, -(-rows // SMALL_TASK_ROWS))
    large = -(-rows // LARGE_TASK_ROWS)
    return max(1, min(MAX_LOOP_PARTITIONS, max(small, large)))


@contextmanager
def loop_settings(spark: SparkSession, rows: int):
    """Shuffle width (and, for small inputs, no adaptive re-planning) inside a loop; rounds send small tables only through the driver."""
    wanted = {
        "spark.sql.shuffle.partitions": str(loop_partitions(spark, rows)),
        "spark.sql.autoBroadcastJoinThreshold": LOOP_BROADCAST,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": LOOP_TASK_BYTES,
    }
    if rows < ADAPTIVE_MIN_ROWS:
        wanted["spark.sql.adaptive.enabled"] = "false"
    with _set(spark, wanted):
        yield int(wanted["spark.sql.shuffle.partitions"])


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Rows that are sent to Python together."""
    with _set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)}):
        yield


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
