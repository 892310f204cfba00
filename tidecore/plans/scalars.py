"""One-row results as columns of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of the one-row table ``row`` to every row of ``df``.

    The row is a scalar subquery: it is computed once and used like a literal,
    without a join.
    """
    packed = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_row", packed).select(*df.columns, "_row.*")
