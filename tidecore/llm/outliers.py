"""Robust multivariate outliers: minimum covariance determinant per group, native.

Rows are vectors of measures of a vertex (edges, partners, active time, ...) in groups
such as its dataset. Measures are transformed by ``asinh`` and standardised by the group's median
and quartiles. From three deterministic starts (the standardised axes, the correlations of
``tanh`` scores, the spatial sign covariance) concentration steps look for the part of
the group whose covariance has the smallest determinant: distances are taken, the
closest rows kept, mean and covariance taken anew. Groups are never gathered: a step is a
histogram of distances and one sum per group, and the matrices are columns of the small
table of groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecore.plans.fixpoint import discard, materialise

# Share of a group's rows that the estimate is made of; the rest may be arbitrarily bad.
CORE_SHARE = 0.75
# Concentration steps from every start, and further ones from the best.
FIRST_STEPS, MORE_STEPS = 2, 2
# Histograms: bins of one transformed measure per unit, bins of a squared distance per doubling.
VALUE_BINS, DISTANCE_BINS = 256, 16
# A deviation this small in a transformed measure is no deviation: it is added to every variance.
NOISE = 0.05


def vertex_measures(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Activity of the sources of raw edges ``src, dst, ts``: ``u``, ``edges``, ``partners``, ``span`` and the columns ``by``."""
    return edges.groupBy(F.col("src").alias("u"), *by).agg(
        F.count(F.lit(1)).alias("edges"), F.count_distinct("dst").alias("partners"), (F.max("ts") - F.min("ts")).alias("span")
    )


def robust_outliers(vectors: DataFrame, measures: list[str], by: list[str], confidence: float = 0.9999, least_rows: int = 100) -> DataFrame:
    """Mark the rows whose vector of ``measures`` lies far from the bulk of their group.

    ``vectors``: the measures (numbers), the columns ``by`` that name a group, anything else. The result
    has every row with all its columns, ``distance`` (robust Mahalanobis distance) and ``outlier``
    (its square is over the chi-squared quantile ``confidence``); input columns of these names are refused.

    Groups with fewer than ``least_rows`` usable rows are pooled with the others like it that share
    all of ``by`` but its last column, then but the last two, and so on; what is still too small
    in the end has no distance and no outliers. Null is a group value like others. A row with a null or
    non-finite measure has a null distance, is no outlier and enters no estimate. Constant
    measures and groups of equal rows are harmless: ``NOISE`` is added to every deviation. Repeated rows count each.
    An empty table gives an empty result.

    The part that an estimate is made of is the smallest set of whole bins of distance that holds
    ``CORE_SHARE`` of the group. The input is read once and written to the shared folder.
    """
    taken = {"distance", "outlier"} & set(vectors.columns)
    if taken or not measures:
        raise ValueError(f"columns {sorted(taken)} are made here" if taken else "no measures")
    p = len(measures)
    x = F.array(*(F.asinh(F.col(c).cast("double")) for c in measures))
    fine = F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    flow = vectors.withColumn("_x", x).withColumn("_x", F.when(fine, F.col("_x")))
    own, _ = materialise(flow)  # whatever made the measures runs once
    rows, _ = materialise(_pooled(own, by, least_rows))
    used = rows.where("_key is not null and _x is not null").select("_key", "_x")
    centre, _ = materialise(_centres(used, p))
    scores, _ = materialise(used.join(centre, "_key").select("_key", _score("_x").alias("z")))
    fits, _ = materialise(_starts(scores, centre, p))
    for _ in range(FIRST_STEPS):
        fits = _concentrated(scores, centre, fits, p)
    fits, _ = materialise(fits.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("volume", "start"))).where("_r = 1").drop("_r"))
    for _ in range(MORE_STEPS):
        fits = _concentrated(scores, centre, fits, p)
    fits = _concentrated(scores, centre, fits, p, limit=chi2_quantile(0.975, p))  # all but the outlying rows sharpen the estimate
    final = _scaled(scores, fits, p)
    known = centre.join(final.select("_key", "mean", "inverse", "unit"), "_key")
    square = _square(_score("_x"), F.col("mean"), F.col("inverse"), p) / F.col("unit")
    done = rows.join(known, "_key", "left").select(*vectors.columns, F.sqrt(square).alias("distance"))
    discard(scores, own)
    return done.withColumn("outlier", F.coalesce(F.col("distance") * F.col("distance") > chi2_quantile(confidence, p), F.lit(False)))


def chi2_quantile(q: float, p: int) -> float:
    """The chi-squared quantile with ``p`` degrees of freedom, by bisection of its series."""

    def below(x: float) -> float:
        a, term, k = p / 2, 1.0, 0
        total = 1.0
        while term > 1e-17 * total:
            k += 1
            term *= x / 2 / (a + k)
            total += term
        return total * math.exp(a * math.log(x / 2) - x / 2 - math.lgamma(a + 1))

    lo, hi = 1e-9, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < q else (lo, mid)
    return lo


def _pooled(flow: DataFrame, by: list[str], least: int) -> DataFrame:
    """Add ``_key``, the name of the smallest enclosing group that has enough rows."""
    out = flow.withColumn("_key", F.lit(None).cast("string"))
    for depth in range(len(by), -1, -1):
        name = F.concat_ws(" ", F.lit(str(depth)), F.to_json(F.struct(*by[:depth])) if depth else F.lit(""))
        out = out.withColumn("_name", F.when(F.col("_key").isNull() & F.col("_x").isNotNull(), name))
        large = out.where("_name is not null").groupBy("_name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_name", F.col("_name").alias("_large"))
        out = out.join(large, "_name", "left").withColumn("_key", F.coalesce("_key", "_large")).drop("_name", "_large")
    return out


def _quantile_bins(counts: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """Of ``(keys, bin, n)``: the first bin at which each share of the rows is reached, ``q0, q1, ...``.

    Windows run over the bins of one group, whose number is bounded by the number of doubles' exponents.
    """
    upto = Window.partitionBy(*keys).orderBy("bin")
    run = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("upto") >= F.ceil(s * F.col("all")), F.col("bin"))).alias(f"q{i}") for i, s in enumerate(shares)))


def _centres(used: DataFrame, p: int) -> DataFrame:
    """``_key, centre, spread``: medians and quartile distances of every measure, as arrays."""
    one = used.select("_key", F.posexplode("_x").alias("i", "v"))
    counts = one.groupBy("_key", "i", F.floor(F.col("v") * VALUE_BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    q = _quantile_bins(counts, ["_key", "i"], [0.25, 0.5, 0.75])
    middle = (F.col("q1") + 0.5) / VALUE_BINS
    spread = F.greatest((F.col("q2") - F.col("q0")) / (VALUE_BINS * 1.349), F.lit(NOISE))
    packed = q.select("_key", F.struct("i", middle.alias("c"), spread.alias("s")).alias("m")).groupBy("_key").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return packed.select("_key", F.transform("m", lambda m: m["c"]).alias("centre"), F.transform("m", lambda m: m["s"]).alias("spread"))


def _score(x: str) -> Column:
    return F.transform(x, lambda v, i: (v - F.col("centre")[i]) / F.col("spread")[i])


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def _moments(z: list[Column], p: int) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.avg(z[i]).alias(f"m{i}") for i in range(p)), *(F.avg(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in _pairs(p))]


def _fit(sums: DataFrame, centre: DataFrame, keys: list[str], p: int, centred: bool = True) -> DataFrame:
    """Mean, inverse covariance (with the variance of ``NOISE`` added) and the determinant's logarithm from average products."""
    sums = sums.join(centre.select("_key", F.transform("spread", lambda s: (NOISE / s) * (NOISE / s)).alias("noise")), "_key")
    m = [F.col(f"m{i}") if centred else F.lit(0.0) for i in range(p)]
    entry = lambda i, j: F.col(f"s{max(i, j)}_{min(i, j)}") - m[i] * m[j] + (F.col("noise")[i] if i == j else F.lit(0.0))
    out = sums.select(*keys, F.array(*m).alias("mean"), F.array(*(F.array(*(entry(i, j) for j in range(p))) for i in range(p))).alias("a"), F.lit(0.0).alias("volume"))
    for k in range(p):  # sweep: the matrix becomes minus its inverse, the pivots' product its determinant
        out = out.withColumn("d", F.greatest(F.col("a")[k][k], F.lit(1e-12)))
        swept = F.transform(
            "a",
            lambda row, i: F.transform(  # noqa: B023
                row,
                lambda v, j: F.when((i == k) & (j == k), -1 / F.col("d"))  # noqa: B023
                .when(i == k, v / F.col("d"))  # noqa: B023
                .when(j == k, v / F.col("d"))  # noqa: B023
                .otherwise(v - row[k] * F.col("a")[k][j] / F.col("d")),  # noqa: B023
            ),
        )
        out = out.withColumn("volume", F.col("volume") + F.log("d")).withColumn("a", swept)
    return out.select(*keys, "mean", F.flatten(F.transform("a", lambda row: F.transform(row, lambda v: -v))).alias("inverse"), "volume")


def _square(z: Column, mean: Column, inverse: Column, p: int) -> Column:
    """Squared distance: z is centred, then weighed by the flat inverse matrix."""
    away = F.transform(z, lambda v, i: v - mean[i])
    weighed = F.transform(inverse, lambda w, k: w * away[F.floor(k / p).cast("int")] * away[k % p])
    return F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v)


def _squares(scores: DataFrame, fits: DataFrame, p: int) -> DataFrame:
    """``_key, start, z, square`` for every row and start."""
    both = scores.join(fits.select("_key", "start", "mean", "inverse"), "_key")
    away = both.select("_key", "start", "z", "inverse", F.transform("z", lambda v, i: v - F.col("mean")[i]).alias("away"))
    terms = [F.col("inverse")[i * p + j] * F.col("away")[i] * F.col("away")[j] * (1 if i == j else 2) for i, j in _pairs(p)]
    square = terms[0]
    for t in terms[1:]:
        square = square + t
    return away.select("_key", "start", "z", square.alias("square"))


def _distance_bin(square: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(square), F.lit(2.0**-20))) * DISTANCE_BINS)


def _distance_counts(squares: DataFrame) -> DataFrame:
    return squares.groupBy("_key", "start", _distance_bin("square").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _starts(scores: DataFrame, centre: DataFrame, p: int) -> DataFrame:
    """Three first estimates around the medians."""
    z = [F.col("z")[i] for i in range(p)]
    length = F.sqrt(F.greatest(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v), F.lit(1e-12)))
    rows = scores.withColumn("length", length)
    square = [F.tanh(c) for c in z]
    sign = [c / F.col("length") for c in z]
    fits = []
    for name, values in ((1, square), (2, sign)):
        sums = rows.groupBy("_key").agg(*_moments(values, p))
        fits.append(_fit(sums.withColumn("start", F.lit(name)), centre, ["_key", "start"], p, centred=False))
    plain = F.array(*(F.lit(1.0 if i == j else 0.0) for i in range(p) for j in range(p)))
    axes = scores.select("_key").distinct().select("_key", F.lit(0).alias("start"), F.array(*[F.lit(0.0)] * p).alias("mean"), plain.alias("inverse"), F.lit(0.0).alias("volume"))
    return axes.union(fits[0]).union(fits[1])


def _concentrated(scores: DataFrame, centre: DataFrame, fits: DataFrame, p: int, limit: float | None = None) -> DataFrame:
    """Estimates anew from the closest rows: ``CORE_SHARE`` of them, or those within ``limit`` of the scaled distance."""
    squares = _squares(scores, fits, p)
    q = _quantile_bins(_distance_counts(squares), ["_key", "start"], [CORE_SHARE])
    if limit is not None:
        q = q.withColumn("q0", F.floor(F.col("q0") + DISTANCE_BINS * math.log2(limit / chi2_quantile(CORE_SHARE, p))))
    edges, _ = materialise(q)
    near = squares.join(edges, ["_key", "start"]).where(_distance_bin("square") <= F.col("q0"))
    z = [F.col("z")[i] for i in range(p)]
    new, _ = materialise(_fit(near.groupBy("_key", "start").agg(*_moments(z, p)), centre, ["_key", "start"], p))
    discard(edges, fits)
    return new


def _scaled(scores: DataFrame, fits: DataFrame, p: int) -> DataFrame:
    """Add ``unit``: what a squared distance is divided by so that the core reaches no farther than the normal distribution's."""
    q = _quantile_bins(_distance_counts(_squares(scores, fits, p)), ["_key", "start"], [CORE_SHARE])
    reach = F.pow(F.lit(2.0), (F.col("q0") + 1) / DISTANCE_BINS)
    unit = F.greatest(F.lit(1.0), reach / chi2_quantile(CORE_SHARE, p)).alias("unit")
    out, _ = materialise(fits.join(q.select("_key", "start", unit), ["_key", "start"]))
    return out
