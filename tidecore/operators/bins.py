"""Cutting time into bins and sliding windows over the bins.

Every binning adds an integer column ``bin`` to an edge table; windows are
ranges of bins. The bounds of the time range travel as one broadcast row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecore.functions.time import SECONDS_PER_DAY, date_text, epoch_date
from tidecore.operators.graph import as_pairs
from tidecore.plans.fixpoint import materialise
from tidecore.plans.ordering import with_position
from tidecore.plans.scalars import attach


def time_range(edges: DataFrame) -> DataFrame:
    """Smallest and largest timestamp and the number of edges (one row)."""
    return edges.agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("edges")
    )


def edges_in_range(edges: DataFrame, t0: int, t1: int) -> DataFrame:
    """Edges with ``t0 <= ts < t1``; the filter reaches a Parquet scan."""
    return edges.filter((F.col("ts") >= t0) & (F.col("ts") < t1))


def _with_range(edges: DataFrame) -> DataFrame:
    lo_hi = edges.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    return edges.transform(attach, lo_hi)


def _clamped(value: Column, bins: int) -> Column:
    return F.least(F.floor(value).cast("int"), F.lit(bins - 1))


def bin_equal_width(edges: DataFrame, bins: int) -> DataFrame:
    """Bins of equal width over ``[min, max + 1)``."""
    width = (F.col("_hi") - F.col("_lo") + 1).cast("double") / F.lit(bins)
    return (
        _with_range(edges)
        .withColumn("bin", _clamped((F.col("ts") - F.col("_lo")) / width, bins))
        .drop("_lo", "_hi")
    )


def _edges_of_ranges(edges: DataFrame, bins: int, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """``bin_equal_width`` for some ranges ``(start, width)`` of bins; the time range is read once."""
    lo, hi = edges.agg(F.min("ts"), F.max("ts")).first()
    inside = [(max(start, 0), min(start + width, bins)) for start, width in ranges]
    inside = [(first, last) for first, last in inside if first < last]
    binned = edges.limit(0) if lo is None or not inside else edges
    lo, hi = lo or 0, hi or 0
    size = float(hi - lo + 1) / bins
    near, exact = F.lit(False), F.lit(False)
    for first, last in inside:
        # one second of slack at both ends: the bin decides
        near |= (F.col("ts") >= lo + int(first * size) - 1) & (F.col("ts") <= lo + int(last * size) + 1)
        exact |= (F.col("bin") >= first) & (F.col("bin") < last)
    return binned.filter(near).withColumn("bin", _clamped((F.col("ts") - F.lit(lo)) / F.lit(size), bins)).filter(exact)


def edges_of_bins(edges: DataFrame, bins: int, start: int, width: int) -> DataFrame:
    """``bin_equal_width`` for the bins ``[start, start + width)`` only.

    The bounds of the time range are read first (one row), so that the bins become a
    range of ``ts`` with constant ends, which reaches a Parquet scan. An empty table or
    range of bins gives no edges. With ``width + step`` bins it feeds ``effective_delta``, with one bin more than a window's
    ``append_window``, and with all bins from a start on ``batch_from_bins``.
    """
    return _edges_of_ranges(edges, bins, [(start, width)])


def bin_timestamp_closed(edges: DataFrame, bins: int) -> DataFrame:
    """Bins of equal width over ``[min, max]``; a single timestamp gives bin 0."""
    span = (F.col("_hi") - F.col("_lo")).cast("double")
    share = (F.col("ts") - F.col("_lo")) / F.nullif(span, F.lit(0.0)) * F.lit(bins)
    return (
        _with_range(edges)
        .withColumn("bin", _clamped(F.coalesce(share, F.lit(0.0)), bins))
        .drop("_lo", "_hi")
    )


def bin_equal_count(edges: DataFrame, bins: int) -> DataFrame:
    """Bins of ``ceil(E / bins)`` edges in ``(ts, src, dst)`` order."""
    placed = with_position(edges, ["ts", "src", "dst"], "_position")
    total = placed.agg(F.count(F.lit(1)).alias("_total"))
    size = F.ceil(F.col("_total") / F.lit(bins))
    return (
        placed.transform(attach, total)
        .withColumn("bin", _clamped(F.col("_position") / size, bins))
        .drop("_position", "_total")
    )


def bin_sorted_boundaries(edges: DataFrame, bins: int) -> DataFrame:
    """Bin ``b`` holds ``ts < trunc(min + (b + 1) * width)``.

    For whole seconds that is the first b with ``min + (b + 1) * width >= ts + 1``.
    Rounding may move the quotient by one bin, so it is compared with its two
    neighbours instead of joining a table of boundaries. Timestamps beyond the
    last boundary (rounding) stay in the last bin.
    """
    width = (F.col("_hi") - F.col("_lo") + 1).cast("double") / F.lit(bins)

    def below(b: Column) -> Column:
        return F.col("ts") < F.floor(F.col("_lo") + (b + 1) * width)

    guess = F.col("_guess")
    exact = (
        F.when(below(guess - 1) & (guess >= 1), guess - 1)
        .when(below(guess), guess)
        .otherwise(guess + 1)
    )
    return (
        _with_range(edges)
        .withColumn("_guess", (F.ceil((F.col("ts") + 1 - F.col("_lo")) / width) - 1).cast("int"))
        .withColumn("bin", F.least(exact, F.lit(bins - 1)))
        .drop("_lo", "_hi", "_guess")
    )


def bin_daily(edges: DataFrame) -> DataFrame:
    """24-hour bins counted from the first timestamp, and the number of such days."""
    day = F.lit(SECONDS_PER_DAY)
    return (
        _with_range(edges)
        .withColumn("bin", F.floor((F.col("ts") - F.col("_lo")) / day).cast("int"))
        .withColumn("total_days", (F.floor((F.col("_hi") - F.col("_lo")) / day) + 1).cast("int"))
        .drop("_lo", "_hi")
    )


_SCALES = {"daily": "day", "weekly": "week", "monthly": "month"}


def choose_time_scale(edge_count: Column) -> Column:
    """Coarser snapshots for larger tables."""
    return (
        F.when(edge_count > 10_000_000, "monthly")
        .when(edge_count > 1_000_000, "weekly")
        .otherwise("daily")
    )


def discretize(edges: DataFrame, scale: str) -> DataFrame:
    """Add ``snapshot``: first day of the calendar day, week or month of ``ts``."""
    date = epoch_date(F.col("ts"))
    if scale != "daily":
        date = F.trunc(date, _SCALES[scale])
    return edges.withColumn("snapshot", date_text(date))


def bin_histogram(binned: DataFrame) -> DataFrame:
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("edges"))


def window_edges(binned: DataFrame, start: int, width: int) -> DataFrame:
    """Edges of bins ``[start, start + width)``."""
    return binned.filter((F.col("bin") >= start) & (F.col("bin") < start + width))


def bin_edges_of(binned: DataFrame, b: int) -> DataFrame:
    return binned.filter(F.col("bin") == b)


def append_window(binned: DataFrame, start: int, width: int) -> DataFrame:
    """A window and the bin after it, nothing removed."""
    return window_edges(binned, start, width + 1)


def start_bin(bins: Column, width: int, step: int = 1, policy: str = "fixed") -> Column:
    """First bin of an experiment window, from the number of bins.

    ``fixed`` starts at 400 when that fits, ``fixed_step`` also leaves room for
    a step, ``middle`` centres the window, ``zero`` starts at the beginning.
    """
    if policy == "fixed":
        first = F.when(F.lit(400 + width) > bins, bins - width - 10).otherwise(400)
    elif policy == "fixed_step":
        first = F.when(F.lit(400 + width + step) >= bins, bins - width - step - 10).otherwise(400)
    elif policy == "middle":
        first = F.floor((bins - width) / 2).cast("int")
    elif policy == "zero":
        first = F.lit(0)
    else:
        raise ValueError(f"unknown start policy {policy!r}")
    return F.greatest(first.cast("int"), F.lit(0))


def slide_delta(binned: DataFrame, start: int, width: int, step: int = 1) -> DataFrame:
    """Edges that leave (``remove``) and enter (``add``) when the window moves by ``step``."""
    b = F.col("bin")
    leaving = (b >= start) & (b < start + min(step, width))
    entering = (b >= start + width) & (b < start + width + step)
    return binned.filter(leaving | entering).withColumn(
        "change", F.when(leaving, "remove").otherwise("add")
    )


def slide_delta_of(edges: DataFrame, bins: int, start: int, width: int, step: int = 1) -> DataFrame:
    """``slide_delta`` of ``bin_equal_width``; only the two time ranges that leave and enter reach the scan."""
    return slide_delta(_edges_of_ranges(edges, bins, [(start, min(step, width)), (start + width, step)]), start, width, step)


def slide_state(binned: DataFrame, start: int, width: int, step: int = 1) -> DataFrame:
    """Pairs of both windows with flags ``before`` and ``after`` the slide.

    A pair is in a window as long as at least one of its edges is, so repeats
    and pairs that leave and enter at once are no change of the graph.
    """
    b = F.col("bin")
    before = (b >= start) & (b < start + width)
    after = (b >= start + step) & (b < start + width + step)
    return (
        as_pairs(binned.filter(before | after), ["bin"])
        .groupBy("u", "v")
        .agg(F.max(before).alias("before"), F.max(after).alias("after"))
    )


def _spans(seen: DataFrame, names: Sequence[str], width: int) -> DataFrame:
    """``names, enter, leave`` from distinct ``names, bin``: the windows that start in ``[enter, leave)`` hold them.

    Occurrences at most ``width`` bins apart are one span. The ordering window sees the bins of one
    name, never its edges.
    """
    order = Window.partitionBy(*names).orderBy("bin")
    apart = F.coalesce((F.col("bin") - F.lag("bin").over(order) > width).cast("int"), F.lit(1))
    runs = seen.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(order))
    ends = runs.groupBy(*names, "_run").agg((F.min("bin") - width + 1).alias("enter"), (F.max("bin") + 1).alias("leave"))
    return ends.drop("_run")


def pair_spans(binned: DataFrame, width: int) -> DataFrame:
    """When each pair is in a sliding window of ``width`` bins: ``(u, v, enter, leave)``.

    The windows that start at the bins ``[enter, leave)`` hold the pair. A pair has one row for
    every stretch without a gap, whatever the number of its edges and of windows.
    """
    return _spans(as_pairs(binned, ["bin"]).distinct(), ["u", "v"], width)


def vertex_spans(binned: DataFrame, width: int) -> DataFrame:
    """``pair_spans`` of vertices with an edge to another one: ``(u, enter, leave)``."""
    ends = as_pairs(binned, ["bin"]).select("bin", F.explode(F.array("u", "v")).alias("u")).distinct()
    return _spans(ends, ["u"], width)


def span_events(spans: DataFrame, start: int, step: int, slides: int) -> DataFrame:
    """Slides at which spans begin and end: ``(slide, ..., change)`` with ``change`` 1 or -1.

    Slide i brings the window to ``start + i * step``; what the first window (slide 0) holds
    enters at slide 0. A span that ends where the next one of its name begins is no event.
    """
    names = [c for c in spans.columns if c not in ("enter", "leave")]
    at = lambda c: F.ceil((F.col(c) - F.lit(start)) / F.lit(step)).cast("int")
    placed = spans.select(*names, F.greatest(at("enter"), F.lit(0)).alias("_in"), at("leave").alias("_out")).where("_in < _out")
    event = F.explode(F.array(F.struct(F.col("_in").alias("slide"), F.lit(1).alias("n")), F.struct(F.col("_out").alias("slide"), F.lit(-1).alias("n"))))
    flat = placed.select(*names, event.alias("_e")).select("_e.slide", *names, "_e.n").where(F.col("slide") <= slides)
    return flat.groupBy("slide", *names).agg(F.sum("n").cast("int").alias("change")).where("change <> 0")


def effective_delta(binned: DataFrame, start: int, width: int, step: int = 1) -> DataFrame:
    """Pairs that really leave or enter the simple graph.

    The rest of the window is only asked for the pairs of the bins that leave and enter, and grouped for no other.
    """
    ends = as_pairs(slide_delta(binned, start, width, step), ["change"]).distinct()
    rest = as_pairs(window_edges(binned, start + step, max(0, width - step)))
    stays = rest.join(ends.select("u", "v").distinct(), ["u", "v"], "left_semi").select("u", "v", F.lit("stay").alias("change"))
    flags = ends.select("u", "v", "change").union(stays).groupBy("u", "v").agg(F.min("change").alias("_a"), F.max("change").alias("_b"))
    # a pair of both sides, or of the rest too, is no change
    return flags.filter((F.col("_a") == F.col("_b")) & (F.col("_a") != "stay")).select("u", "v", F.col("_a").alias("change"))


def window_sequence(
    binned: DataFrame, start: int, width: int, step: int = 1, count: int | None = None
) -> DataFrame:
    """One row per edge and window: window ``i`` holds bins ``start + i*step ...``.

    An edge belongs to at most ``ceil(width / step)`` windows. Windows end with
    the last bin; ``count`` limits how many are formed.
    """
    last = binned.agg(F.max("bin").alias("_last"))
    offset = F.col("bin") - F.lit(start)
    newest = F.floor(offset / F.lit(step))
    fits = F.floor((F.col("_last") + 1 - F.lit(start + width)) / F.lit(step))
    upper = F.least(newest, fits) if count is None else F.least(newest, fits, F.lit(count - 1))
    lower = F.greatest(F.floor((offset - F.lit(width)) / F.lit(step)) + 1, F.lit(0))
    return (
        binned.filter(F.col("bin") >= start)
        .transform(attach, last)
        .withColumn("_lower", lower)
        .withColumn("_upper", upper)
        .filter(F.col("_lower") <= F.col("_upper"))
        .withColumn("window_id", F.explode(F.sequence(F.col("_lower").cast("int"), F.col("_upper").cast("int"))))
        .drop("_last", "_lower", "_upper")
    )


def window_pairs(windowed: DataFrame, key: str = "window_id") -> DataFrame:
    """Simple graph of every window."""
    return as_pairs(windowed, [key]).distinct()


def window_step_sweep(
    binned: DataFrame, bins: int, widths: Sequence[int], steps: Sequence[int]
) -> DataFrame:
    """Edge counts for a grid of window widths and steps (``step <= width``).

    The edges are counted per bin once; the grid is joined to those counts.
    Configurations without enough bins are left out.
    """
    spark = binned.sparkSession
    grid = spark.createDataFrame(
        [(w, s) for w in widths for s in steps if s <= w], "width int, step int"
    )
    reach = F.col("width") + F.col("step")
    first = F.when(F.lit(400) + reach >= bins, F.lit(bins) - reach - 10).otherwise(400)
    grid = grid.withColumn("start", first.cast("int")).filter(F.col("start") >= 0)
    b = F.col("bin")
    end = F.col("start") + F.col("width")
    inside = (b >= F.col("start")) & (b < end)
    leaving = (b >= F.col("start")) & (b < F.col("start") + F.col("step"))
    entering = (b >= end) & (b < end + F.col("step"))

    def edges_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("edges"))), F.lit(0))

    # both sides are tables of parameters and bins, not of edges
    return (
        F.broadcast(grid)
        .join(bin_histogram(binned), (b >= F.col("start")) & (b < end + F.col("step")), "left")
        .groupBy("width", "step", "start")
        .agg(
            edges_where(inside).alias("initial_edges"),
            edges_where(leaving).alias("removed_edges"),
            edges_where(entering).alias("added_edges"),
        )
        .withColumn("updates", F.col("removed_edges") + F.col("added_edges"))
    )


# Quantiles of the first order column that are asked for, and the accuracy of their ranks (one in so many rows).
CUTS, ACCURACY = 200, 10_000


def read_first_n(edges: DataFrame, n: int, order: Sequence[str] = ("ts", "src", "dst")) -> DataFrame:
    """The first ``n`` edges in a total order; the first order column is a number.

    The source is read twice, whatever ``n``: once for the number of edges and quantiles of the first order column, and once
    for the edges up to the first quantile that surely has ``n`` below it. These are written and cut by
    position, so no task has to hold ``n`` rows.
    """
    if n <= 0:
        return edges.limit(0)
    placed = with_position(_at_least_first(edges, n, order[0]), list(order), "_position")
    return placed.filter(F.col("_position") < n).drop("_position")


def _at_least_first(edges: DataFrame, n: int, key: str) -> DataFrame:
    """A part of ``edges`` that surely holds the first ``n`` by ``key``, written."""
    shares = [(i + 1) / CUTS for i in range(CUTS)]
    quantiles = F.percentile_approx(key, F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias("cuts")
    seen = edges.agg(F.count(F.lit(1)).alias("n"), quantiles).first()
    cuts = seen["cuts"] or []
    enough = [c for c, share in zip(cuts, shares, strict=False) if (share - 2 / ACCURACY) * seen["n"] >= n]
    near = edges.filter(F.col(key).isNull() | (F.col(key) <= enough[0])) if enough else edges
    return materialise(near)[0]


def batch_from_bins(binned: DataFrame, start: int, width: int, n: int) -> DataFrame:
    """The first ``n`` edges from bin ``start`` on (``remove``) and from ``start + width`` on (``add``)."""
    order = ["bin", "ts", "src", "dst"]
    leaving = read_first_n(binned.filter(F.col("bin") >= start), n, order)
    entering = read_first_n(binned.filter(F.col("bin") >= start + width), n, order)
    return leaving.withColumn("change", F.lit("remove")).union(
        entering.withColumn("change", F.lit("add"))
    )


def calendar_windows(edges: DataFrame, days: int = 7, slide: int = 1) -> DataFrame:
    """Edges per sliding window of ``days`` days; ``day`` names the last one.

    Day 0 starts with the first timestamp. Window ``day`` holds days
    ``day - days + 1 .. day``; they start at ``days`` and the last day of the
    data never closes a window. The first full window (``days - 1``) is kept
    as the predecessor that change rules need.
    """
    daily = bin_daily(edges)
    day, every = F.col("bin"), F.lit(slide)
    later = F.greatest(day, F.lit(days)) - days
    first = (F.ceil(later / every) * every + days).cast("int")
    last = F.least(day + (days - 1), F.col("total_days") - 2)
    none = F.array().cast("array<int>")
    closing = F.concat(
        F.when(day < days, F.array(F.lit(days - 1))).otherwise(none),
        F.when(first <= last, F.sequence(first, last, every)).otherwise(none),
    )
    return daily.withColumn("day", F.explode(closing)).drop("bin", "total_days")
