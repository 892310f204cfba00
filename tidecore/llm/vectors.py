"""What the vector operators share: which vectors count, and fits on bounded samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vectors on which rotations are fitted: those with the smallest hashes of their names.
FIT_SAMPLE = 8192


def usable(profile: str) -> Column:
    """Not null, nothing null or not finite in it, and not all zero."""
    inf = float("inf")
    x = F.col(profile)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < inf))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def proper(profiles: DataFrame) -> tuple[DataFrame, int]:
    """``(u, profile)`` as doubles, only usable ones of the most frequent length; that length."""
    ok = profiles.select("u", F.col("profile").cast("array<double>").alias("profile")).where(usable("profile"))
    top = ok.groupBy(F.size("profile").alias("d")).count().orderBy(F.desc("count"), "d").first()
    width = top["d"] if top else 0
    return ok.where(F.size("profile") == width), width


def sample(profiles: DataFrame, width: int, size: int = FIT_SAMPLE) -> np.ndarray:
    """At most ``size`` vectors, the same ones whatever the partitioning."""
    rows = profiles.orderBy(F.xxhash64("u", "profile"), "u").limit(size).select("profile").toArrow()
    return matrix(rows["profile"].combine_chunks(), width) if len(rows) else np.zeros((0, width))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def principal_axes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and axes by falling variance as the columns of an orthogonal matrix."""
    if not len(x):
        return np.zeros(x.shape[1]), np.eye(x.shape[1])
    mean = x.mean(0)
    _, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    return mean, np.ascontiguousarray(axes[:, ::-1])
