"""Joins of edges with vertex values that a hub cannot hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Edges of one vertex that one task is meant to handle.
SLICE_ROWS = 1_000_000


def hub_slices(edges: DataFrame, end: str, slice_rows: int | None = None) -> DataFrame:
    """``(end, _slices)`` of the vertices with more than ``slice_rows`` edges; at most a row for every ``slice_rows`` edges."""
    limit = SLICE_ROWS if slice_rows is None else slice_rows
    slices = F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias("_slices")
    return edges.groupBy(end).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(end, slices)


def join_by_vertex(
    edges: DataFrame, values: DataFrame, end: str, how: str = "inner", slice_rows: int | None = None, hubs: DataFrame | None = None,
    sort: bool = False,
) -> DataFrame:
    """Join ``edges`` at their column ``end`` with vertex values ``(end, ...)``, one row per vertex.

    A vertex with more than ``slice_rows`` edges is cut into slices of about that many by a hash of the other end, and its
    value is repeated once per slice, so no task gets more of it. ``how`` is inner, left, left_semi or left_anti.
    The table of such vertices (``hub_slices``, which a loop makes once) is sent to every task; its size is bounded by
    the number of edges over ``slice_rows``. With ``sort`` the values are joined by sorting, whatever their written size, so
    that a table of all vertices never passes through the driver.
    """
    other = "v" if end == "u" else "u"
    hubs = F.broadcast(hub_slices(edges, end, slice_rows) if hubs is None else hubs)
    own = F.pmod(F.xxhash64(other), F.coalesce("_slices", F.lit(1)).cast("long")).cast("int")
    cut = edges.join(hubs, end, "left").withColumn("_slice", own).drop("_slices")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
    sent = values.join(hubs, end, "left").withColumn("_slice", copies).drop("_slices")
    return cut.join(sent.hint("merge") if sort else sent, [end, "_slice"], how).drop("_slice")


def at_ends(edges: DataFrame, vertices: DataFrame, end: str, how: str = "left_semi", hubs: DataFrame | None = None) -> DataFrame:
    """Edges whose ``end`` is (or with ``left_anti`` is not) one of the vertices ``u``."""
    members = vertices.select(F.col("u").alias(end)).distinct()
    return join_by_vertex(edges, members, end, how, hubs=hubs).select(*edges.columns)
