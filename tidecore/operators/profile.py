"""Dataset profiles and temporal quality measures, as aggregates over the edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecore.functions.time import (
    DAYS_PER_YEAR,
    SECONDS_PER_DAY,
    SECONDS_PER_HOUR,
    hour_start,
)
from tidecore.operators.bins import _SCALES, discretize
from tidecore.operators.graph import as_pairs, in_out_degrees, raw_degrees, vertex_set
from tidecore.plans.fixpoint import materialise
from tidecore.plans.scalars import attach


def dataset_profile(edges: DataFrame) -> DataFrame:
    """Nodes, edges, time span, raw degrees and density (one row)."""
    span = F.col("max_timestamp") - F.col("min_timestamp")
    totals = edges.agg(
        F.count(F.lit(1)).alias("num_edges"),
        F.min("ts").alias("min_timestamp"),
        F.max("ts").alias("max_timestamp"),
    )
    per_node = raw_degrees(edges).agg(
        F.count(F.lit(1)).alias("num_nodes"), F.max("raw_degree").alias("max_degree")
    )
    n, e = F.col("num_nodes"), F.col("num_edges")
    # ends are counted exactly, so the mean degree is 2E/n
    return totals.transform(attach, per_node).select(
        "num_nodes",
        "num_edges",
        "min_timestamp",
        "max_timestamp",
        F.floor(span / F.lit(SECONDS_PER_DAY)).cast("int").alias("time_span_days"),
        F.bround(span / F.lit(DAYS_PER_YEAR * SECONDS_PER_DAY), 2).alias("time_span_years"),
        "max_degree",
        F.bround(F.lit(2.0) * e / n, 2).alias("avg_degree"),
        F.when(n > 1, F.bround(F.lit(2.0) * e / (n * (n - 1)), 8)).otherwise(0.0).alias("density"),
    )


def temporal_profile(edges: DataFrame) -> DataFrame:
    """Nodes, edges, span, out/in degree statistics and distinct timestamps (one row)."""
    per_ts = edges_per_timestamp(edges).agg(
        F.sum("edges").alias("num_edges"),
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.count(F.lit(1)).alias("distinct_timestamps"),
    )

    def of(name: str) -> list[Column]:
        # vertices without such edges are not part of the statistics
        value = F.when(F.col(name) > 0, F.col(name))
        return [
            F.avg(value).alias(f"mean_{name}"),
            F.max(value).alias(f"max_{name}"),
            F.min(value).alias(f"min_{name}"),
        ]

    degrees = in_out_degrees(edges).agg(
        F.count(F.lit(1)).alias("num_nodes"), *of("out_degree"), *of("in_degree")
    )
    return per_ts.transform(attach, degrees).withColumn("time_span", F.col("max_ts") - F.col("min_ts"))


def degree_distribution(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Nodes per out- or in-degree."""
    end = "src" if direction == "out" else "dst"
    return (
        edges.groupBy(end)
        .agg(F.count(F.lit(1)).alias("degree"))
        .groupBy("degree")
        .agg(F.count(F.lit(1)).alias("nodes"))
    )


def edges_per_timestamp(edges: DataFrame) -> DataFrame:
    return edges.groupBy("ts").agg(F.count(F.lit(1)).alias("edges"))


def edges_per_hour(edges: DataFrame) -> DataFrame:
    """Edges per hour from the first to the last one, hours without edges as 0."""
    counted, ends = materialise(
        edges.groupBy(hour_start(F.col("ts")).alias("hour")).agg(F.count(F.lit(1)).alias("edges")),
        first=F.min("hour"),
        last=F.max("hour"),
    )
    if ends["first"] is None:
        return counted
    # the hours are dealt over tasks, so one timestamp far off is only more hours
    spine = edges.sparkSession.range(ends["first"], ends["last"] + 1, SECONDS_PER_HOUR).withColumnRenamed("id", "hour")
    return spine.join(counted, "hour", "left").select(
        "hour", F.coalesce("edges", F.lit(0)).alias("edges")
    )


def activity_series(edges: DataFrame, switch_at: int = 1000) -> DataFrame:
    """Counts per timestamp, or per hour once there are more than ``switch_at`` timestamps."""
    distinct = edges.select("ts").distinct().limit(switch_at + 1).count()
    if distinct > switch_at:
        return edges_per_hour(edges).select(F.col("hour").alias("ts"), "edges")
    return edges_per_timestamp(edges)


def top_active_nodes(edges: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent sources and targets; ties go to the smaller id."""

    def top(end: str, role: str) -> DataFrame:
        return (
            edges.groupBy(F.col(end).alias("node"))
            .agg(F.count(F.lit(1)).alias("edges"))
            .orderBy(F.col("edges").desc(), "node")
            .limit(n)
            .withColumn("role", F.lit(role))
        )

    return top("src", "source").union(top("dst", "target")).select("role", "node", "edges")


def inter_event_gaps(edges: DataFrame) -> DataFrame:
    """Min, max, mean and population deviation of the gaps between consecutive edges.

    Edges are first counted per timestamp. Distinct timestamps are compared
    inside time slices about sqrt(span) seconds wide, so a slice holds at most
    that many; the last one of each slice is handed to the next slice. Repeats
    of a timestamp are gaps of 0.
    """
    per_ts = edges_per_timestamp(edges)
    bounds = per_ts.agg(
        F.min("ts").alias("_lo"), F.max("ts").alias("_hi"), F.sum("edges").alias("_n")
    ).withColumn("_width", F.greatest(F.ceil(F.sqrt(F.col("_hi") - F.col("_lo"))), F.lit(1)))
    sliced = per_ts.transform(attach, bounds).withColumn(
        "_slice", F.floor((F.col("ts") - F.col("_lo")) / F.col("_width"))
    )
    inside = F.lag("ts").over(Window.partitionBy("_slice").orderBy("ts"))
    stitched = (
        sliced.groupBy("_slice")
        .agg(F.max("ts").alias("_last"))
        .withColumn("_before", F.lag("_last").over(Window.orderBy("_slice")))
        .select("_slice", "_before")
    )
    gap = F.col("ts") - F.coalesce("_inside", "_before")
    square = (gap.cast("decimal(19,0)") * gap.cast("decimal(19,0)")).cast("decimal(38,0)")
    n = F.col("_n") - 1
    mean = (F.col("_hi") - F.col("_lo")).cast("double") / n
    return (
        sliced.withColumn("_inside", inside)
        .join(stitched, "_slice")
        .groupBy("_lo", "_hi", "_n")
        .agg(
            F.min(gap).alias("_smallest"),
            F.max(gap).alias("_largest"),
            F.coalesce(F.sum(square), F.lit(0)).cast("double").alias("_squares"),
            F.bool_or(F.col("edges") > 1).alias("_repeats"),
        )
        .select(
            n.alias("gaps"),
            F.when(F.col("_repeats"), 0).otherwise(F.col("_smallest")).alias("min_gap"),
            F.coalesce("_largest", F.when(F.col("_repeats"), 0)).alias("max_gap"),
            F.when(n > 0, mean).alias("mean_gap"),
            F.when(n > 0, F.round(F.sqrt(F.greatest(F.col("_squares") / n - mean * mean, F.lit(0.0))), 6)).alias("std_gap"),
        )
    )


def temporal_density(edges: DataFrame) -> DataFrame:
    """Distinct timestamps per edge, and its class (one row)."""
    share = F.col("distinct_timestamps") / F.col("edges")
    return (
        edges_per_timestamp(edges)
        .agg(F.count(F.lit(1)).alias("distinct_timestamps"), F.sum("edges").alias("edges"))
        .withColumn("temporal_density", share)
        .withColumn("edges_per_timestamp", F.col("edges") / F.col("distinct_timestamps"))
        .withColumn(
            "density_class",
            F.when(share > 0.8, "very sparse").when(share > 0.5, "sparse").otherwise("dense"),
        )
    )


def degree_cv(edges: DataFrame) -> DataFrame:
    """Coefficient of variation of out- and in-degree, over vertices that have any."""

    def cv(name: str) -> Column:
        value = F.when(F.col(name) > 0, F.col(name))
        wide = value.cast("decimal(19,0)")
        count = F.count(value)
        mean = F.sum(value).cast("double") / count
        squares = F.sum((wide * wide).cast("decimal(38,0)")).cast("double")
        return F.round(F.sqrt(F.greatest(squares / count - mean * mean, F.lit(0.0))) / mean, 9)

    return in_out_degrees(edges).agg(
        cv("out_degree").alias("out_degree_cv"), cv("in_degree").alias("in_degree_cv")
    )


def power_law_slope(edges: DataFrame, drop_min_degree: bool = True) -> DataFrame:
    """Slope of ln(nodes) on ln(out-degree), without the smallest degree by default."""
    levels = degree_distribution(edges, "out")
    if drop_min_degree:
        smallest = levels.agg(F.min("degree").alias("_min"))
        levels = levels.transform(attach, smallest).filter(F.col("degree") > F.col("_min"))
    slope = F.regr_slope(F.ln(F.col("nodes").cast("double")), F.ln(F.col("degree").cast("double")))
    return levels.agg(F.count(F.lit(1)).alias("levels"), F.round(slope, 6).alias("slope")).withColumn(
        "plausible", (F.abs("slope") > 1.5) & (F.abs("slope") < 3.5)
    )


def _sparsity(n: Column, e: Column) -> Column:
    return e / (n * (n - 1)).cast("double")


def sparsity(edges: DataFrame) -> DataFrame:
    """E / (n (n - 1)) and its class (one row)."""
    value = F.col("sparsity")
    return (
        edges.agg(F.count(F.lit(1)).alias("edges"))
        .transform(attach, vertex_set(edges).agg(F.count(F.lit(1)).alias("nodes")))
        .withColumn("sparsity", _sparsity(F.col("nodes"), F.col("edges")))
        .withColumn(
            "sparsity_class",
            F.when(value < 0.001, "very sparse").when(value < 0.01, "sparse").otherwise("dense"),
        )
    )


def node_activity_span(edges: DataFrame) -> DataFrame:
    """Time between the first and the last edge of each node."""
    return (
        edges.select(F.explode(F.array("src", "dst")).alias("u"), "ts")
        .groupBy("u")
        .agg((F.max("ts") - F.min("ts")).alias("span"))
    )


def temporal_locality(edges: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Mean span of nodes active more than once, as a share of the data's span.

    ``sample`` (see ``sample_rows``) may stand in for the node part.
    """
    nodes = node_activity_span(edges if sample is None else sample).filter(F.col("span") > 0)
    mean = nodes.agg(
        (F.sum("span").cast("double") / F.count(F.lit(1))).alias("mean_span"),
        F.count(F.lit(1)).alias("active_nodes"),
    )
    whole = edges.agg((F.max("ts") - F.min("ts")).alias("total_span"))
    return (
        mean.transform(attach, whole)
        .withColumn("relative_span", F.col("mean_span") / F.col("total_span"))
        .withColumn("is_local", F.col("relative_span") < 0.5)
    )


def quality_score(edges: DataFrame) -> DataFrame:
    """Points for temporal density, sparsity, nodes and edges, and a verdict (one row)."""
    n, e = F.col("nodes"), F.col("edges")
    # one pass: distinct times (kind 0) and nodes (kind 1) with how often they occur
    seen = edges.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("long").alias("x")) for k, c in ((0, "ts"), (1, "src"), (1, "dst"))))).alias("_e"))
    counted = seen.groupBy("_e.kind", "_e.x").agg(F.count(F.lit(1)).alias("_n"))
    of = lambda kind, value: F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0))
    facts = counted.agg(of(0, 1).alias("times"), of(0, F.col("_n")).alias("edges"), of(1, 1).alias("nodes"))
    t, s = F.try_divide(F.col("times"), e), _sparsity(n, e)
    score = F.col("score")
    return (
        facts.select(
            F.when(t > 0.8, 30).when(t > 0.5, 20).otherwise(10).alias("temporal_points"),
            F.when(s < 0.001, 30).when(s < 0.01, 20).otherwise(10).alias("sparsity_points"),
            F.when(n > 500_000, 20).when(n > 100_000, 15).otherwise(10).alias("node_points"),
            F.when(e > 5_000_000, 20).when(e > 1_000_000, 15).otherwise(10).alias("edge_points"),
        )
        .withColumn(
            "score",
            F.col("temporal_points") + F.col("sparsity_points") + F.col("node_points") + F.col("edge_points"),
        )
        .withColumn(
            "verdict",
            F.when(score >= 80, "very suitable").when(score >= 60, "suitable").otherwise("limited"),
        )
    )


def novelty_index(edges: DataFrame, scale: str = "daily") -> DataFrame:
    """Mean over snapshots of the share of pairs never seen in an earlier snapshot.

    Snapshots without edges do not count.
    """
    seen = as_pairs(discretize(edges, scale), ["snapshot"]).distinct()
    # the window sees the snapshots of one pair
    first = F.min("snapshot").over(Window.partitionBy("u", "v")) == F.col("snapshot")
    counts = seen.withColumn("_new", first).groupBy("snapshot").agg(F.count(F.lit(1)).alias("pairs"), F.count_if("_new").alias("fresh"))
    share = F.col("fresh") / F.col("pairs")
    return counts.agg(
        F.count(F.lit(1)).alias("snapshots"), F.round(F.avg(share), 9).alias("novelty")
    )


def _split_pairs(edges: DataFrame, split: float) -> DataFrame:
    """Pairs with flags for the train and the test part of the time span."""
    bounds = edges.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    cut = F.col("_lo") + F.floor((F.col("_hi") - F.col("_lo")) * F.lit(split))
    return (
        as_pairs(
            edges.transform(attach, bounds).withColumn("train", F.col("ts") <= cut), ["train"]
        )
        .groupBy("u", "v")
        .agg(F.bool_or("train").alias("train"), F.bool_or(~F.col("train")).alias("test"))
    )


def surprise_index(edges: DataFrame, split: float = 0.85) -> DataFrame:
    """Share of test-period pairs that the train period does not have."""
    return _split_pairs(edges, split).agg(
        F.count_if("test").alias("test_pairs"),
        (F.count_if(F.col("test") & ~F.col("train")) / F.count_if("test")).alias("surprise"),
    )


def reoccurrence_index(edges: DataFrame, split: float = 0.85) -> DataFrame:
    """Share of train-period pairs that recur in the test period."""
    return _split_pairs(edges, split).agg(
        F.count_if("train").alias("train_pairs"),
        (F.count_if(F.col("test") & F.col("train")) / F.count_if("train")).alias("reoccurrence"),
    )


def active_snapshots(edges: DataFrame, scale: str = "daily") -> DataFrame:
    """Snapshots with at least one edge, out of those in the calendar span."""
    active = discretize(edges, scale).select("snapshot").distinct()
    days = active.agg(
        F.min(F.col("snapshot").cast("date")).alias("_a"),
        F.max(F.col("snapshot").cast("date")).alias("_b"),
        F.count(F.lit(1)).alias("active"),
    )
    # snapshots begin with their day, week or month
    apart = {"day": F.datediff("_b", "_a"), "week": F.datediff("_b", "_a") / 7, "month": F.months_between("_b", "_a")}
    total = F.round(apart[_SCALES[scale]]).cast("long") + 1
    return days.select(
        "active",
        total.cast("long").alias("snapshots"),
        (F.col("active") / total).alias("active_share"),
    )


# Kind of each dataset in the report.
DATASET_TYPES = {
    "bitcoin-temporal": "Transaction",
    "cit-Patents": "Citation",
    "soc-LiveJournal1": "Social",
    "sx-stackoverflow": "Q&A",
    "sx-superuser": "Q&A",
    "temporal-reddit-reply": "Social",
    "wiki-talk-temporal": "Communication",
    "citation_network_10M": "Synthetic (Dense)",
    "social_media_100M": "Synthetic (Dense)",
    "communication_1B": "Synthetic (Uniform)",
}


def profile_report_rows(profiles: DataFrame) -> DataFrame:
    """Profiles formatted for a report; ``profiles`` has a ``dataset`` column."""
    types = F.create_map(*[F.lit(x) for pair in DATASET_TYPES.items() for x in pair])
    years = F.concat(F.format_string("%.1f", "time_span_years"), F.lit("y"))
    days = F.concat(F.col("time_span_days").cast("string"), F.lit("d"))
    return profiles.select(
        "dataset",
        F.format_number("num_nodes", 0).alias("nodes"),
        F.format_number("num_edges", 0).alias("edges"),
        F.when(F.col("time_span_years") >= 1, years).otherwise(days).alias("time_span"),
        F.col("max_degree").cast("string").alias("max_degree"),
        F.format_string("%.2e", "density").alias("density"),
        F.coalesce(types[F.col("dataset")], F.lit("Unknown")).alias("type"),
    )
