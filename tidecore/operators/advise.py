"""When to update incrementally and when to recompute: rules over slide counts.

Rules are columns over n (vertices), m (edges), batch (changed edges) and
touched (distinct batch endpoints); true means *update incrementally*. The
thresholds below are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIO = 0.05
DENSE_RATIO, DENSE_DEGREE = 0.02, 10
SPARSE_RATIO, SPARSE_DEGREE = 0.1, 5
LOCAL_VERTICES, LOCAL_EDGES = 0.1, 0.03
HISTORY_LENGTH, HISTORY_ACCURACY = 10, 0.6
TINY_BATCH, HUGE_RATIO = 10, 0.3
SCORE_RATIO, SCORE_DEGREE, SCORE_TOUCHED, SCORE_LIMIT = 0.1, 8, 0.2, 2


def _average_degree(n: Column, m: Column) -> Column:
    return m * F.lit(2.0) / n


def advise_ratio(n: Column, m: Column, batch: Column, touched: Column) -> Column:
    return batch < F.lit(RATIO) * m


def advise_density(n: Column, m: Column, batch: Column, touched: Column) -> Column:
    degree = _average_degree(n, m)
    share = (
        F.when(degree > DENSE_DEGREE, DENSE_RATIO)
        .when(degree < SPARSE_DEGREE, SPARSE_RATIO)
        .otherwise(RATIO)
    )
    return batch < share * m


def advise_locality(n: Column, m: Column, batch: Column, touched: Column) -> Column:
    return (touched < F.lit(LOCAL_VERTICES) * n) | (batch < F.lit(LOCAL_EDGES) * m)


def advise_composite(n: Column, m: Column, batch: Column, touched: Column) -> Column:
    score = (
        F.when(batch.cast("double") / m > SCORE_RATIO, 1).otherwise(0)
        + F.when(_average_degree(n, m) > SCORE_DEGREE, 1).otherwise(0)
        + F.when(touched.cast("double") / n > SCORE_TOUCHED, 1).otherwise(0)
    )
    return (
        F.when(batch < TINY_BATCH, True)
        .when(batch > F.lit(HUGE_RATIO) * m, False)
        .otherwise(score < SCORE_LIMIT)
    )


def advise_history(decisions: DataFrame, order: str = "decision") -> DataFrame:
    """The ratio rule, inverted while it was right in under 60 % of the last ten decisions.

    ``decisions`` has ``m, batch`` and the outcome of earlier decisions
    ``used_incremental, incremental_faster`` in ``order``; one row per
    decision, so the ordering window stays small.
    """
    recent = Window.orderBy(order).rowsBetween(-HISTORY_LENGTH, -1)
    right = (F.col("used_incremental") == F.col("incremental_faster")).cast("int")
    plain = F.col("batch") < F.lit(RATIO) * F.col("m")
    return decisions.withColumn("accuracy", F.avg(right).over(recent)).withColumn(
        "incremental",
        F.when(F.col("accuracy") < HISTORY_ACCURACY, ~plain).otherwise(plain),
    )


def advice_scorecard(outcomes: DataFrame, by: str = "rule") -> DataFrame:
    """Accuracy, cost of both ways, and time saved and wasted by the decisions.

    ``outcomes`` has ``incremental`` (the decision), ``incremental_cost`` and
    ``recompute_cost`` in whole units.
    """
    right = F.col("incremental") == (F.col("incremental_cost") < F.col("recompute_cost"))
    gap = F.abs(F.col("incremental_cost") - F.col("recompute_cost"))
    saved = F.coalesce(F.sum(F.when(right, gap)), F.lit(0))
    wasted = F.coalesce(F.sum(F.when(~right, gap)), F.lit(0))
    return outcomes.groupBy(by).agg(
        F.count(F.lit(1)).alias("decisions"),
        F.count_if(right).alias("correct"),
        (F.lit(100.0) * F.count_if(right) / F.count(F.lit(1))).alias("accuracy_percent"),
        F.sum("incremental_cost").alias("incremental_total"),
        F.sum("recompute_cost").alias("recompute_total"),
        saved.alias("saved"),
        wasted.alias("wasted"),
        (saved - wasted).alias("net"),
    )
