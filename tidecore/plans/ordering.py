"""Row numbers and neighbours in a total order, without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecore.plans.fixpoint import materialise

# monotonically_increasing_id() keeps the partition above this bit and the row below it
_ROW_BITS = 33


def _sorted_once(df: DataFrame, order: list[str]) -> DataFrame:
    """Range-partition and sort ``df``, then fix partition and row numbers.

    Equal rows get a tie-break, so even one value that fills a third of the
    table is spread over many ranges. The result is checkpointed because range
    bounds are sampled and must not differ between two uses.
    """
    keys = [*order, "_tie"]
    placed = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
        .drop("_tie")
        .withColumn("_part", F.shiftright("_slot", _ROW_BITS))
        .withColumn("_row", F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_slot")
    )
    return materialise(placed)[0]


def with_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Add the 0-based position of every row in the order of ``order``."""
    rows = _sorted_once(df, order)
    # one row per range partition: the only global window sees partition counts
    starts = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_part", "_start")
    )
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )


def with_previous(df: DataFrame, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add, for each ``new: old`` in ``values``, column ``old`` of the row before.

    Inside a range partition this is ``lag``; the first row of a partition gets
    the last row of the partition before it (one row per partition travels).
    """
    rows = _sorted_once(df, order)
    packed: Column = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    last = (
        rows.groupBy("_part")
        .agg(F.max_by(packed, F.col("_row")).alias("_last"))
        .withColumn("_before", F.lag("_last").over(Window.orderBy("_part")))
        .select("_part", "_before")
    )
    inside = F.lag(packed).over(Window.partitionBy("_part").orderBy("_row"))
    joined = rows.withColumn("_inside", inside).join(F.broadcast(last), "_part")
    picked = F.when(F.col("_row") == 0, F.col("_before")).otherwise(F.col("_inside"))
    return (
        joined.withColumn("_picked", picked)
        .select("*", *[F.col("_picked")[new].alias(new) for new in values])
        .drop("_part", "_row", "_inside", "_before", "_picked")
    )
