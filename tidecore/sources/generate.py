"""Synthetic temporal edges, drawn from hashes of a row counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecore.functions.time import DAYS_PER_YEAR, SECONDS_PER_DAY

# First timestamp and the three presets (edges, nodes, years, max_k, dense).
BASE_TIMESTAMP = 1_280_000_000
PRESETS = {
    "citation_network_10M": (10_000_000, 1_000_000, 1, 100, True),
    "social_media_100M": (100_000_000, 5_000_000, 5, 1000, True),
    "communication_1B": (1_000_000_000, 10_000_000, 10, 500, False),
}


def _draw(seed: int, what: str, below: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(what)), below)


def synthetic_temporal_edges(
    spark: SparkSession,
    n_edges: int,
    n_nodes: int,
    years: int,
    max_k: int,
    dense: bool,
    slices: int = 8,
    seed: int = 42,
) -> DataFrame:
    """About ``n_edges`` edges between uniform endpoints without self-loops.

    The time span is cut into ``slices`` equal parts; timestamps are uniform in
    a part or, when ``dense``, grow quadratically within it. An edge is left
    out when an endpoint already has ``0.9 * max_k`` edges of the same role.
    """
    span = years * DAYS_PER_YEAR * SECONDS_PER_DAY
    per_slice = -(-n_edges // slices)
    ids = spark.range(n_edges)
    part = F.pmod("id", F.lit(slices))
    begin = F.floor(F.lit(span) * part / slices)
    end = F.floor(F.lit(span) * (part + 1) / slices)
    progress = F.floor(F.col("id") / slices) / F.lit(float(per_slice))
    if dense:
        offset = F.floor(progress * progress * (end - begin))
    else:
        offset = _draw(seed, "ts", end - begin + 1)
    src = _draw(seed, "src", F.lit(n_nodes))
    # a non-zero step from src, so no self-loop can occur
    dst = F.pmod(src + 1 + _draw(seed, "dst", F.lit(n_nodes - 1)), F.lit(n_nodes))
    drawn = ids.select(
        "id", src.alias("src"), dst.alias("dst"), (F.lit(BASE_TIMESTAMP) + begin + offset).alias("ts")
    )
    cap = F.lit(int(max_k * 0.9))
    as_source = F.row_number().over(Window.partitionBy("src").orderBy("id"))
    as_target = F.row_number().over(Window.partitionBy("dst").orderBy("id"))
    return (
        drawn.withColumn("_s", as_source)
        .filter(F.col("_s") <= cap)
        .withColumn("_t", as_target)
        .filter(F.col("_t") <= cap)
        .select("src", "dst", "ts")
        .orderBy("ts", "src", "dst")
    )
