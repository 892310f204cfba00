"""Core numbers of a sliding window, kept up to date micro-batch by micro-batch.

Each batch adds its edges to a log, moves the window to the latest event time,
and updates the core numbers from the pairs that left and entered. Everything
a batch writes is named by its batch id and derived from what earlier batches
wrote, so a batch that is run again replaces its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidecore.functions.time import SECONDS_PER_DAY
from tidecore.operators.core import max_core_summary
from tidecore.operators.graph import as_pairs
from tidecore.operators.maintain import update_core
from tidecore.operators.temporal import anomaly_event

LOG_SCHEMA = "u long, v long, ts long, day long, batch long"
CORE_SCHEMA = "u long, core int"
TIMELINE_SCHEMA = (
    "as_of long, max_core int, vertices_in_max_core long, core_batch long, batch long"
)
ALERT_SCHEMA = (
    "as_of long, event string, previous_max_core int, new_max_core int, change_ratio double, batch long"
)


class CorenessStream:
    """State folder of one stream: edge log, core numbers, timeline and alerts.

    ``folder`` has to be reachable from every executor; ``days`` is the length
    of the window that ends at the latest event time. An edge dated more than
    ``lead_days`` after that time would expire everything else; it waits in the
    side table ``early`` until the window's end comes within ``lead_days`` of it, and
    does not move the window before (the first batch has nothing to compare with).
    A batch that has such edges but none for the window is taken as a gap in the
    stream: the window moves on to the first of them. ``None`` takes every date.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        days: int = 7,
        alert_ratio: float = 0.3,
        lead_days: int | None = 366,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.seconds = days * SECONDS_PER_DAY
        self.alert_ratio = alert_ratio
        self.lead = None if lead_days is None else lead_days * SECONDS_PER_DAY

    def _path(self, kind: str, batch: int | None = None) -> str:
        return f"{self.folder}/{kind}" + ("" if batch is None else f"/batch={batch}")

    def _files(self, spark: SparkSession, path: str):
        sc = spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(sc._jsc.hadoopConfiguration()), target

    def _exists(self, spark: SparkSession, path: str) -> bool:
        files, target = self._files(spark, path)
        return files.exists(target)

    def _row(self, spark: SparkSession, batch: int):
        """The timeline row of one batch, if it wrote any."""
        path = self._path("timeline", batch)
        if batch < 0 or not self._exists(spark, path):
            return None
        return spark.read.schema(TIMELINE_SCHEMA).parquet(path).first()

    def _log(self, spark: SparkSession, days: list[int]) -> DataFrame:
        """Logged pairs of some days; folders of other days are not even listed."""
        root = self._path("log")
        found = [p for p in (f"{root}/day={d}" for d in days) if self._exists(spark, p)]
        return spark.read.option("basePath", root).schema(LOG_SCHEMA).parquet(*found)

    def _waiting(self, spark: SparkSession, batch: int, as_of: int) -> DataFrame:
        """Edges that earlier batches put aside and that the window has not reached yet."""
        schema = "u long, v long, ts long, batch long"
        if not self._exists(spark, self._path("early")):
            return spark.createDataFrame([], schema).drop("batch")
        early = spark.read.schema(schema).parquet(self._path("early"))
        return early.filter((F.col("batch") < batch) & (F.col("ts") > as_of + self.lead)).drop("batch")

    def _reach(self, pairs: DataFrame, pool: DataFrame, as_of: int) -> int:
        """The latest event time that a batch takes: ``lead_days`` after the window's new end.

        ``pairs`` are the batch's own, ``pool`` has the waiting ones besides. The end moves
        on as long as it brings further edges within reach.
        """
        ts, now = F.col("ts"), as_of
        live = (ts > as_of - self.seconds) & (ts <= as_of + self.lead)
        own = pairs.agg(
            F.count(F.when(live, 1)).alias("live"), F.min(F.when(ts > as_of + self.lead, ts)).alias("ahead")
        ).first()
        if not own["live"] and own["ahead"] is not None:
            now = own["ahead"]
        while True:
            top = pool.filter(ts <= now + self.lead).agg(F.max("ts")).first()[0]
            if top is None or top <= now:
                return now + self.lead
            now = top

    def process(self, edges: DataFrame, batch: int) -> None:
        """One micro-batch; the function to hand to ``foreachBatch``."""
        spark = edges.sparkSession
        last = self._row(spark, batch - 1)
        day = F.floor(F.col("ts") / F.lit(SECONDS_PER_DAY))
        pairs = as_pairs(edges, ["ts"]).select("u", "v", "ts").persist()
        pool = pairs
        if last is not None and self.lead is not None:
            pool = pairs.union(self._waiting(spark, batch, last["as_of"])).persist()
        arrived = pool
        try:
            if pool is not pairs:
                limit = self._reach(pairs, pool, last["as_of"])
                early = pairs.filter(F.col("ts") > limit)
                early.write.mode("overwrite").parquet(self._path("early", batch))
                arrived = pool.filter(F.col("ts") <= limit)
            newest = arrived.agg(F.max("ts")).first()[0]
            if newest is None:
                self._carry(spark, batch, last)
                return
            (
                arrived.select("u", "v", "ts", day.alias("day"), F.lit(batch).cast("long").alias("batch"))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("day", "batch")
                .parquet(self._path("log"))
            )
        finally:
            pool.unpersist()
            pairs.unpersist()
        was = None if last is None else last["as_of"]
        now = newest if was is None else max(newest, was)
        oldest = (now if was is None else was) - self.seconds
        # after a gap, the days between the two windows hold nothing that counts
        ends = {(oldest, now if was is None else was), (max(oldest, now - self.seconds), now)}
        days = {d for a, b in ends for d in range(a // SECONDS_PER_DAY, b // SECONDS_PER_DAY + 1)}
        held = self._log(spark, sorted(days)).filter(F.col("batch") <= batch)
        before = F.lit(False)
        if was is not None:
            before = (F.col("batch") < batch) & (F.col("ts") > was - self.seconds)
        after = F.col("ts") > now - self.seconds
        state = (
            held.filter(before | after)
            .groupBy("u", "v")
            .agg(F.max(before).alias("before"), F.max(after).alias("after"))
        )
        known = self.core(spark, None if last is None else last["core_batch"])
        update_core(state, known).write.mode("overwrite").parquet(self._path("core", batch))
        self._write_row(
            max_core_summary(self.core(spark, batch)).select(
                F.lit(now).cast("long").alias("as_of"),
                "max_core",
                "vertices_in_max_core",
                F.lit(batch).cast("long").alias("core_batch"),
            ),
            batch,
        )
        self._alert(spark, batch, last)
        self._forget(spark, batch - 2, last)

    def _write_row(self, row: DataFrame, batch: int) -> None:
        row.coalesce(1).write.mode("overwrite").parquet(self._path("timeline", batch))

    def _carry(self, spark: SparkSession, batch: int, last) -> None:
        """A batch without edges repeats the row before it."""
        if last is not None:
            self._write_row(
                spark.createDataFrame([tuple(last)], TIMELINE_SCHEMA).drop("batch"), batch
            )

    def _forget(self, spark: SparkSession, batch: int, last) -> None:
        """Delete core numbers that no batch still to run (or to run again) can need."""
        old = self._row(spark, batch)
        if old is not None and old["core_batch"] != last["core_batch"]:
            files, target = self._files(spark, self._path("core", old["core_batch"]))
            files.delete(target, True)

    def _alert(self, spark: SparkSession, batch: int, last) -> None:
        """Compare the batch's largest core with the one before it."""
        if last is None or not last["max_core"]:
            return
        previous = F.lit(last["max_core"])
        current = spark.read.schema(TIMELINE_SCHEMA).parquet(self._path("timeline", batch))
        ratio = F.abs(F.col("max_core") - previous) / previous.cast("double")
        (
            current.filter(ratio > self.alert_ratio)
            .select(
                "as_of",
                anomaly_event(F.col("max_core"), previous).alias("event"),
                previous.alias("previous_max_core"),
                F.col("max_core").alias("new_max_core"),
                ratio.alias("change_ratio"),
            )
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(self._path("alerts", batch))
        )

    def core(self, spark: SparkSession | None = None, batch: int | None = None) -> DataFrame:
        """Core numbers as of ``batch`` (an empty table when there is none)."""
        spark = spark or self.spark
        if batch is None:
            return spark.createDataFrame([], CORE_SCHEMA)
        return spark.read.schema(CORE_SCHEMA).parquet(self._path("core", batch))

    def latest_core(self) -> DataFrame:
        row = self.timeline().orderBy(F.col("batch").desc()).first()
        return self.core(batch=None if row is None else row["core_batch"])

    def timeline(self) -> DataFrame:
        return self._table("timeline", TIMELINE_SCHEMA)

    def alerts(self) -> DataFrame:
        return self._table("alerts", ALERT_SCHEMA)

    def _table(self, kind: str, schema: str) -> DataFrame:
        if not self._exists(self.spark, self._path(kind)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(kind))

    def start(self, stream: DataFrame, available_now: bool = False) -> StreamingQuery:
        writer = (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", self._path("progress"))
        )
        if available_now:
            writer = writer.trigger(availableNow=True)
        return writer.start()


def stream_coreness(
    stream: DataFrame, folder: str, days: int = 7, available_now: bool = False, lead_days: int | None = 366
) -> tuple[CorenessStream, StreamingQuery]:
    """Start keeping the core numbers of the last ``days`` days of ``stream``.

    Edges over ``lead_days`` ahead wait, see ``CorenessStream``.
    """
    keeper = CorenessStream(stream.sparkSession, folder, days, lead_days=lead_days)
    return keeper, keeper.start(stream, available_now)


def stream_core_anomalies(keeper: CorenessStream) -> DataFrame:
    """Alerts raised so far: batches whose largest core jumped."""
    return keeper.alerts()
