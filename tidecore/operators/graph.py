"""Simple graphs from temporal edges: pairs ``(u, v)`` with ``u < v``.

``keys`` names extra grouping columns (such as ``window_id``) that keep many
graphs apart in one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("src") != F.col("dst"))


def self_loop_count(edges: DataFrame) -> DataFrame:
    """Rows read, rows kept and self-loops dropped (one row)."""
    loops = F.count_if(F.col("src") == F.col("dst"))
    return edges.agg(
        F.count(F.lit(1)).alias("edges"),
        loops.alias("self_loops"),
        (F.count(F.lit(1)) - loops).alias("kept"),
    )


def as_pairs(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Undirected pairs, repeats kept."""
    return drop_self_loops(edges).select(
        *keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    )


def simple_edges(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Undirected pairs without repeats and self-loops."""
    return as_pairs(edges, keys).distinct()


def symmetrize(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both directions of every pair, from a single pass over the pairs."""
    there = F.struct(F.col("u"), F.col("v"))
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    return pairs.select(*keys, F.explode(F.array(there, back)).alias("_e")).select(
        *keys, "_e.u", "_e.v"
    )


def adjacency(pairs: DataFrame, block: int = 4096) -> DataFrame:
    """Sorted neighbour lists, cut into id blocks.

    A block covers ``block`` consecutive neighbour ids, so a list never holds
    more than that many entries, however large the hub.
    """
    return (
        symmetrize(pairs)
        .groupBy("u", F.floor(F.col("v") / F.lit(block)).alias("block"))
        .agg(F.sort_array(F.collect_set("v")).alias("neighbours"))
    )


def add_edges(pairs: DataFrame, batch: DataFrame) -> DataFrame:
    return pairs.select("u", "v").union(batch.select("u", "v")).distinct()


def remove_edges(pairs: DataFrame, batch: DataFrame) -> DataFrame:
    return pairs.join(batch.select("u", "v"), ["u", "v"], "left_anti")


def edge_multiplicity(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How often each pair occurs."""
    return as_pairs(edges, keys).groupBy(*keys, "u", "v").agg(
        F.count(F.lit(1)).alias("multiplicity")
    )


def degrees(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return symmetrize(pairs, keys).groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("degree"))


def graph_size(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Vertices, edges and average degree 2m/n."""
    ends = F.sum("degree")
    per_vertex = degrees(pairs, keys)
    grouped = per_vertex.groupBy(*keys) if keys else per_vertex.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce((ends / 2).cast("long"), F.lit(0)).alias("m"),
        (ends.cast("double") / F.count(F.lit(1))).alias("average_degree"),
    )


def _endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("u"))


def raw_degrees(edges: DataFrame) -> DataFrame:
    """Degree with repeats; both endpoints count, a self-loop counts twice."""
    return _endpoints(edges).groupBy("u").agg(F.count(F.lit(1)).alias("raw_degree"))


def in_out_degrees(edges: DataFrame) -> DataFrame:
    """Edges leaving and entering each vertex, counted in one aggregation."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("u"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("dst").alias("u"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        ).alias("_e")
    )
    return ends.groupBy("_e.u").agg(
        F.sum("_e.o").alias("out_degree"), F.sum("_e.i").alias("in_degree")
    )


def vertex_set(edges: DataFrame) -> DataFrame:
    return _endpoints(edges).distinct()


def new_vertices(pairs: DataFrame, batch: DataFrame) -> DataFrame:
    """Endpoints of ``batch`` that ``pairs`` does not hold yet."""
    seen = pairs.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    fresh = batch.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    return fresh.join(seen, "u", "left_anti")
