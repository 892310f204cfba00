"""Writing results: text in the documented layouts, Parquet for further use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_core_numbers(core: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``vertex core`` lines, range-sorted by vertex across the part files."""
    (
        core.filter(F.col("core") > 0)
        .select("u", "core")
        .orderBy("u")
        .write.mode(mode)
        .csv(path, sep=" ")
    )


def write_timeline(timeline: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated timeline with a header."""
    (
        timeline.orderBy("day")
        .select(
            F.col("date").alias("Date"),
            F.col("day").alias("Day"),
            F.col("max_core").alias("MaxCore"),
            F.col("vertices_in_max_core").alias("VerticesInMaxCore"),
        )
        .write.mode(mode)
        .csv(path, sep="\t", header=True)
    )


def write_anomalies(anomalies: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Tab-separated anomalies with a header; the ratio has three decimals."""
    (
        anomalies.orderBy("day")
        .select(
            F.col("date").alias("Date"),
            F.col("day").alias("Day"),
            F.col("event").alias("Event"),
            F.col("previous_max_core").alias("PrevMaxCore"),
            F.col("new_max_core").alias("NewMaxCore"),
            F.format_string("%.3f", "change_ratio").alias("ChangeRatio"),
        )
        .write.mode(mode)
        .csv(path, sep="\t", header=True)
    )


def write_profile_csv(profiles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Profiles or per-slide results, one row each, with a header."""
    profiles.write.mode(mode).csv(path, header=True)


def write_binned_edges(binned: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Edges as Parquet partitioned by bin, so a window reads only its bins.

    Rows are dealt out in ranges of bin and a hash of the edge, all of about the same size:
    a bin that holds much of the data is written by as many tasks as it needs.
    """
    (
        binned.repartitionByRange(F.col("bin"), F.xxhash64("src", "dst", "ts"))
        .write.mode(mode)
        .partitionBy("bin")
        .parquet(path)
    )
