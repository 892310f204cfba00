"""Seeded samples; the same seed gives the same rows, also after a task retry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecore.operators.bins import read_first_n


def _key(columns: list[str], seed: int):
    """A random order of rows that any engine with MD5 can repeat."""
    return F.md5(F.concat_ws(",", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))).cast("binary"))


def _first_by_key(keyed: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` rows by ``_key``, then ``order``.

    The leading 60 bits of the key as a number come first, as quantiles need numbers; they
    sort as the key does.
    """
    lead = F.conv(F.substring("_key", 1, 15), 16, 10).cast("long")
    return read_first_n(keyed.withColumn("_lead", lead), n, ["_lead", "_key", *order])


def sample_existing_edges(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` random pairs of the graph (all of them when it has fewer)."""
    keyed = pairs.select("u", "v").withColumn("_key", _key(["u", "v"], seed))
    return _first_by_key(keyed, n, ["u", "v"]).select("u", "v")


def sample_non_edges(
    pairs: DataFrame, vertices: DataFrame, n: int, seed: int = 42
) -> DataFrame:
    """``n`` random absent pairs ``u < v`` of ``vertices``, or all of them when there are fewer.

    Draws vertex numbers from two hashes of a counter and looks the vertices up
    by number; more draws than needed are made only while some are missing. Once they
    would be as many as there are pairs, all pairs are tried instead.
    """
    from tidecore.plans.fixpoint import discard, materialise
    from tidecore.plans.ordering import with_position

    spark = pairs.sparkSession
    numbered, seen = materialise(
        with_position(vertices.select("u").distinct(), ["u"], "number"), n=F.count(F.lit(1))
    )
    size = seen["n"]
    if size < 2 or n == 0:
        return numbered.select("u", F.col("u").alias("v")).limit(0)
    draws = 2 * n
    while True:
        every = draws >= size * size
        a, b = F.xxhash64("id", F.lit(seed)), F.xxhash64("id", F.lit(seed + 1), F.lit("second"))
        if every:
            a, b = F.floor(F.col("id") / size), F.col("id")
        attempts = spark.range(min(draws, size * size)).select(
            "id", F.pmod(a, F.lit(size)).alias("_a"), F.pmod(b, F.lit(size)).alias("_b")
        )
        first = numbered.select(F.col("number").alias("_a"), F.col("u").alias("_u"))
        second = numbered.select(F.col("number").alias("_b"), F.col("u").alias("_v"))
        absent, got = materialise(
            attempts.filter(F.col("_a") != F.col("_b"))
            .join(first, "_a")
            .join(second, "_b")
            .groupBy(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v"))
            .agg(F.min("id").alias("id"))
            .join(pairs.select("u", "v"), ["u", "v"], "left_anti"),
            n=F.count(F.lit(1)),
        )
        if got["n"] >= n or every:
            order = absent.withColumn("_key", F.xxhash64("u", "v", F.lit(seed))) if every else absent
            return read_first_n(order, n, ["_key", "u", "v"] if every else ["id"]).select("u", "v")
        discard(absent)
        draws *= 4


def sample_rows(edges: DataFrame, n: int = 100_000, seed: int = 42) -> DataFrame:
    """``n`` uniformly chosen rows, repeats of a row included.

    Every copy of a row has a number of its own in the order of the sample, which
    therefore does not depend on how the rows are partitioned.
    """
    names = edges.columns
    counted = edges.groupBy(*names).agg(F.count(F.lit(1)).alias("_copies"))
    step = 1 << 16  # numbers in two steps, so that no row needs a long array
    blocks = counted.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / step))))
    first = F.col("_block") * step
    last = F.least(first + step, F.col("_copies")) - 1
    copies = blocks.withColumn("_copy", F.explode(F.sequence(first, last)))
    keyed = copies.withColumn("_key", _key([*names, "_copy"], seed))
    return _first_by_key(keyed, n, [*names, "_copy"]).select(*names)
