"""Streaming edges and windowed counts over event time.

All aggregations run in append mode: a window is emitted once the watermark
has passed its end, and rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidecore.operators.graph import as_pairs, symmetrize
from tidecore.sources.edges import EDGE_SCHEMA, parse_temporal_edges


def stream_edges(
    spark: SparkSession, path: str, format: str = "parquet", max_files_per_trigger: int = 64
) -> DataFrame:
    """Edges as they arrive in a folder, with their event time."""
    reader = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
    if format == "text":
        edges = parse_temporal_edges(reader.text(path))
    else:
        edges = reader.schema(EDGE_SCHEMA).format(format).load(path)
    return edges.withColumn("event_time", F.timestamp_seconds("ts"))


def _seconds(column: str):
    return F.unix_seconds(F.col(column))


def _windowed_pairs(stream: DataFrame, delay: str, *window) -> DataFrame:
    """Distinct pairs per window with their number of edges."""
    late = stream.withWatermark("event_time", delay)
    pairs = as_pairs(late, ["event_time"])
    return pairs.groupBy(F.window("event_time", *window), "u", "v").agg(
        F.count(F.lit(1)).alias("n")
    )


def _bounds(counted: DataFrame, *columns: str) -> DataFrame:
    return counted.select(
        _seconds("window.start").alias("window_start"),
        _seconds("window.end").alias("window_end"),
        *columns,
    )


def stream_bin_counts(stream: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Edges (self-loops aside) and distinct pairs per tumbling bin."""
    counted = _windowed_pairs(stream, delay, width).groupBy("window").agg(
        F.sum("n").alias("edges"), F.count(F.lit(1)).alias("pairs")
    )
    return _bounds(counted, "edges", "pairs")


def stream_sliding_edge_counts(
    stream: DataFrame, delay: str = "1 hour", width: str = "7 days", slide: str = "1 day"
) -> DataFrame:
    """Edges per sliding window."""
    counted = (
        stream.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width, slide))
        .agg(F.count(F.lit(1)).alias("edges"))
    )
    return _bounds(counted, "edges")


def stream_degree(stream: DataFrame, delay: str = "1 hour", width: str = "7 days") -> DataFrame:
    """Simple-graph degree of every vertex per tumbling window."""
    ends = symmetrize(_windowed_pairs(stream, delay, width), ["window"])
    counted = ends.groupBy("window", "u").agg(F.count(F.lit(1)).alias("degree"))
    return _bounds(counted, "u", "degree")


def stream_novelty(stream: DataFrame, horizon: str | None = None) -> DataFrame:
    """Pairs seen for the first time.

    Without ``horizon`` every pair ever seen stays in the state store; with it,
    a pair is forgotten once the watermark is that far past it.
    """
    if horizon is None:
        return as_pairs(stream).dropDuplicates(["u", "v"])
    pairs = as_pairs(stream.withWatermark("event_time", horizon), ["event_time"])
    return pairs.dropDuplicatesWithinWatermark(["u", "v"]).select("u", "v")


EXPIRY_SCHEMA = "u long, v long, event string, at long"


def stream_pair_expiry(stream: DataFrame, lifetime: int, delay: str = "1 hour") -> DataFrame:
    """Enter and leave events of pairs that live ``lifetime`` seconds after each edge.

    A pair needs one number of state, the time of its latest edge: while it is
    renewed it stays, and the event-time timer at the end of its life emits
    ``leave``. Many edges of one pair within a micro-batch are merged in order.
    """
    pairs = as_pairs(stream.withWatermark("event_time", delay), ["event_time", "ts"])

    def step(
        key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        u, v = key
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"u": [u], "v": [v], "event": ["leave"], "at": [last + lifetime]})
            return
        # distinct times suffice, and they are few compared with the rows of a hot pair
        times: set[int] = set()
        for chunk in chunks:
            times.update(chunk["ts"].unique().tolist())
        events = []
        for t in sorted(times):
            if last is None:
                events.append(("enter", t))
            elif t >= last + lifetime:
                events += [("leave", last + lifetime), ("enter", t)]
            last = t if last is None else max(last, t)
        state.update((last,))
        # a pair that is already past its end when it arrives leaves at once
        end = (last + lifetime) * 1000
        if end <= state.getCurrentWatermarkMs():
            state.remove()
            events.append(("leave", last + lifetime))
        else:
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame(
            {
                "u": [u] * len(events),
                "v": [v] * len(events),
                "event": [e for e, _ in events],
                "at": [t for _, t in events],
            }
        )

    return pairs.groupBy("u", "v").applyInPandasWithState(
        step, EXPIRY_SCHEMA, "last long", "append", GroupStateTimeout.EventTimeTimeout
    )
