"""Core timeline over sliding calendar windows, and its anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecore.functions.time import SECONDS_PER_DAY, date_text, epoch_date
from tidecore.operators.bins import pair_spans
from tidecore.operators.core import max_core_summary
from tidecore.operators.spans import GROUP_POINTS, block_core_numbers, block_groups, cut_pieces
from tidecore.plans.fixpoint import TASK_TABLES, discard, loop_settings, materialise


def core_timeline(
    edges: DataFrame, days: int = 7, slide: int = 1, with_first: bool = False, group_points: int = GROUP_POINTS
) -> DataFrame:
    """Largest core and its vertex count per sliding window, dated by its last day.

    A pair is stored once for every stretch of windows that hold it (``pair_spans``), cut at every ``BLOCK``
    windows (see :mod:`tidecore.operators.spans`), and never once per window: about two pieces per stretch and direction. Windows are swept in groups of at most
    ``group_points`` pairs times windows; those of a group share the rounds. ``with_first`` keeps
    the initial window, the predecessor of the first reported one. No edges, no rows.
    """
    spark = edges.sparkSession
    edges, size = materialise(edges.select("src", "dst", "ts"), lo=F.min("ts"), hi=F.max("ts"), n=F.count(F.lit(1)))
    lo, hi = size["lo"], size["hi"]
    found = spark.createDataFrame([], "day int, max_core int, vertices_in_max_core long")
    if lo is not None:
        last = (hi - lo) // SECONDS_PER_DAY - 1
        count = 1 + max(0, (last - days) // slide + 1)
        # window 0 ends with day days - 1, window k with day days + (k - 1) * slide
        at = lambda day: F.when(day <= days - 1, 0).otherwise(F.ceil((day - days) / F.lit(slide)) + 1).cast("int")
        daily = edges.select("src", "dst", F.floor((F.col("ts") - F.lit(lo)) / SECONDS_PER_DAY).cast("int").alias("bin"))
        spans = pair_spans(daily, days).select("u", "v", at(F.col("enter") + days - 1).alias("first"), F.least(at(F.col("leave") + days - 1), F.lit(count)).alias("end"))
        with loop_settings(spark, TASK_TABLES * size["n"]):
            spans, _ = materialise(spans.where("first < end"))
        for low, high in block_groups(spans, group_points):
            part = block_core_numbers(cut_pieces(spans, low, high))
            top, _ = materialise(max_core_summary(part, ["window"]))
            discard(part)
            day = F.when(F.col("window") == 0, days - 1).otherwise(F.lit(days) + (F.col("window") - 1) * slide).cast("int")
            found = found.union(top.select(day.alias("day"), "max_core", "vertices_in_max_core"))
        discard(spans)
    discard(edges)
    dated = found.select(
        date_text(epoch_date(F.lit(lo or 0) + F.col("day") * SECONDS_PER_DAY)).alias("date"), "day", "max_core", "vertices_in_max_core"
    )
    return dated if with_first else dated.filter(F.col("day") >= days)


def anomaly_event(current: Column, previous: Column) -> Column:
    return F.when(current < previous, "CRASH").otherwise("SURGE")


def core_anomalies(
    timeline: DataFrame, ratio: float = 0.3, high: int = 50, low: int = 30, days: int = 7
) -> DataFrame:
    """Days whose largest core jumps against the window before.

    ``timeline`` has to hold the initial window too (``with_first=True``). It
    has one row per day, so the ordering window stays small for any edge count.
    """
    by_day = Window.orderBy("day")
    current, previous = F.col("max_core"), F.col("previous_max_core")
    change = F.when(previous > 0, F.abs(current - previous) / previous.cast("double")).otherwise(0.0)
    return (
        timeline.withColumn("previous_max_core", F.lag("max_core").over(by_day))
        .filter((F.col("day") >= days) & previous.isNotNull())
        .withColumn("change_ratio", change)
        .withColumn("ratio_rule", F.col("change_ratio") > ratio)
        .withColumn("collapse_rule", (previous > high) & (current < low))
        .filter(F.col("ratio_rule") | F.col("collapse_rule"))
        .select(
            "date",
            "day",
            anomaly_event(current, previous).alias("event"),
            "previous_max_core",
            F.col("max_core").alias("new_max_core"),
            "change_ratio",
            "ratio_rule",
            "collapse_rule",
        )
    )


def core_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Vertices whose core number rose, fell, appeared or vanished."""
    old = before.select("u", F.col("core").alias("old_core"))
    new = after.select("u", F.col("core").alias("new_core"))
    kind = (
        F.when(F.col("old_core").isNull(), "appeared")
        .when(F.col("new_core").isNull(), "vanished")
        .when(F.col("new_core") > F.col("old_core"), "rose")
        .otherwise("fell")
    )
    return (
        old.join(new, "u", "full_outer")
        .filter(~F.col("old_core").eqNullSafe(F.col("new_core")))
        .withColumn("change", kind)
    )


def timeline_for_plot(timeline: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Timeline rows with the event of their day, where there is one."""
    events = anomalies.select("date", "event")
    return timeline.select("date", "day", "max_core", "vertices_in_max_core").join(
        events, "date", "left"
    )
