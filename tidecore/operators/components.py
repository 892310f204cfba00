"""Connected components by alternating stars; work follows the edges, never a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecore.plans.fixpoint import ROUND_LIMIT, NotConverged, discard, materialise


def components(edges: DataFrame) -> DataFrame:
    """Of edges ``(a, b)``: each vertex with the smallest one it is connected to, ``(node, label)``.

    Null ends and loops are ignored, repeated edges count once, and an empty
    table gives an empty one. A round maps every vertex to its smallest
    neighbour, first among all and then among smaller ones; minima are combined
    before the shuffle and the join back is one that adaptive execution can split,
    so a vertex with most of the edges does not end up in one task. Rounds are
    written to the shared folder; vertices are any orderable type.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    watch = {"n": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    old, seen = materialise(links.distinct(), **watch)
    for _ in range(ROUND_LIMIT):
        both = old.union(old.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        wide, _unused = materialise(large)
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        small = wide.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new, now = materialise(small.where("a <> b").distinct(), **watch)
        discard(old, wide)
        old = new
        if now == seen:
            ends = old.groupBy("a").agg(F.min("b").alias("label"))
            tops = old.select(F.col("b").alias("a")).distinct().select("a", F.col("a").alias("label"))
            return ends.union(tops).withColumnRenamed("a", "node")
        seen = now
    raise NotConverged("components")
