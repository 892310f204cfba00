"""Exact core numbers by lowering an upper bound until it is consistent.

Start from the degree. A round sets every vertex to the h-index of its
neighbours' values; the values only fall and settle at the core number. No
neighbour list is built: a round counts neighbours per value, so map-side
combining absorbs hubs and a vertex never needs more rows than there are
distinct values. Once a round lowers few vertices the counts are kept, and only
what changed is sent to them. Graphs that one task can hold are peeled instead
(:mod:`tidecore.operators.peel`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecore.operators import peel
from tidecore.operators.graph import symmetrize
from tidecore.operators.slices import at_ends
from tidecore.plans.fixpoint import (
    ROUND_LIMIT,
    NotConverged,
    discard,
    loop_settings,
    materialise,
    stands_for,
)

# A vertex with more neighbours than this is stored in several slices.
HUB_ROWS = 2_000_000
# Re-evaluate only vertices near a change once a round lowers the values by
# less than this share of the vertices (and the graph is worth the extra joins).
FRONTIER_SHARE = 0.05
FRONTIER_MIN_ROWS = 20_000_000
# Keep the counts per level, and send changes only, once a round lowers the values by
# less than this share of the vertices.
COUNTED_SHARE = 0.5
# Once a round lowers at most this share of the vertices, only vertices beside a change are counted anew ...
FEW_SHARE = 0.005
# ... until they are more than this share.
LATER_SHARE = 0.25
# Leave settled vertices (core 1) behind once at most this share is still above 1.
PRUNE_SHARE = 0.5
PRUNE_MIN_ROWS = 1_000_000
# Hub tables up to this many rows are sent to every task; larger ones are joined by key.
BROADCAST_ROWS = 100_000


class NeighbourTable:
    """Both directions of a graph, placed and sorted by the neighbour column.

    It is built once and reused by every round, so a round moves vertex values
    to the edges and never the edges themselves. A hub's rows are cut into
    slices of about ``hub_rows``; vertex values are repeated once per slice.
    """

    def __init__(
        self,
        pairs: DataFrame,
        keys: Sequence[str] = (),
        hub_rows: int = HUB_ROWS,
    ):
        self.keys = list(keys)
        self.spark = pairs.sparkSession
        self.both = symmetrize(pairs, self.keys).persist()
        degree = self.both.groupBy(*self.keys, "u").agg(F.count(F.lit(1)).alias("n"))
        self._saved, seen = materialise(
            degree.select(*self.keys, "u", F.col("n").cast("int").alias("core"), "n"),
            vertices=F.count(F.lit(1)),
            rows=F.coalesce(F.sum("n"), F.lit(0)),
            largest=F.coalesce(F.max("n"), F.lit(0)),
            hubs=F.count_if(F.col("n") > hub_rows),
            unnamed=F.count_if(reduce(or_, (F.col(c).isNull() for c in [*self.keys, "u"]))),
        )
        self.unnamed = seen["unnamed"]
        self.vertices, self.rows = seen["vertices"], seen["rows"]
        self.slices = None
        if seen["largest"] > hub_rows:
            slices = self._saved.filter(F.col("n") > hub_rows).select(
                *self.keys,
                F.col("u").alias("v"),
                F.ceil(F.col("n") / F.lit(hub_rows)).cast("int").alias("_slices"),
            )
            self.slices = F.broadcast(slices) if seen["hubs"] <= BROADCAST_ROWS else slices
        self.degree = self._saved.drop("n")
        self._placed: DataFrame | None = None

    def can_be_peeled(self) -> bool:
        """Whether every graph is small enough for one task, has no hub that a packing task could not hold, and its ids are numbers."""
        if self.unnamed or self.slices is not None or not peel.fits(self.both, self.keys):
            return False
        if not self.keys or self.rows <= peel.PEEL_ROWS:
            return self.rows <= peel.PEEL_ROWS
        sizes = self._saved.groupBy(*self.keys).agg(F.sum("n").alias("n"))
        return sizes.agg(F.max("n")).first()[0] <= peel.PEEL_ROWS

    @property
    def on(self) -> list[str]:
        return [*self.keys, "v"] + (["_slice"] if self.slices is not None else [])

    def place(self, partitions: int) -> DataFrame:
        """The stored edges; placed on first use."""
        if self._placed is None:
            edges = self.both
            if self.slices is not None:
                edges = edges.join(self.slices, [*self.keys, "v"], "left").withColumn(
                    "_slice",
                    F.pmod(F.xxhash64("u"), F.coalesce("_slices", F.lit(1))).cast("int"),
                ).drop("_slices")
            self._placed = (
                edges.repartition(partitions, *self.on)
                .sortWithinPartitions(*self.on)
                .persist()
            )
        return self._placed

    def width(self, partitions: int) -> int | None:
        """Partitions for rows that are placed by vertex; none where a hub's rows have to be combined first."""
        return partitions if self.slices is None else None

    def send(self, values: DataFrame) -> DataFrame:
        """Vertex values renamed to the neighbour side, once per hub slice."""
        message = values.withColumnRenamed("u", "v")
        if self.slices is None:
            return message
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
        return (
            message.join(self.slices, [*self.keys, "v"], "left")
            .withColumn("_slice", copies)
            .drop("_slices")
        )

    def at_u(self, rows: DataFrame, values: DataFrame, other: str, how: str = "inner") -> DataFrame:
        """Join rows at their ``u`` with vertex values; a hub's rows are cut by a hash of the column ``other``."""
        ids = [*self.keys, "u"]
        if self.slices is None:
            return rows.join(values, ids, how)
        hubs = self.slices.withColumnRenamed("v", "u")
        own = F.pmod(F.xxhash64(other), F.coalesce("_slices", F.lit(1)).cast("long")).cast("int")
        cut = rows.join(hubs, ids, "left").withColumn("_cut", own).drop("_slices")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1))
        sent = values.join(hubs, ids, "left").withColumn("_cut", copies).drop("_slices")
        return cut.join(sent, [*ids, "_cut"], how).drop("_cut")

    def restrict(self, active: DataFrame, vertices: int, partitions: int) -> NeighbourTable:
        """The part of this table between ``active`` vertices."""
        part = object.__new__(NeighbourTable)
        part.__dict__.update(self.__dict__)
        part.vertices = vertices
        members = active.select(*self.keys, "u")
        inside = self.place(partitions).join(self.send(members), self.on, "left_semi")
        part._placed = (
            self.at_u(inside, members, "v", "left_semi")
            .repartition(partitions, *self.on)
            .sortWithinPartitions(*self.on)
            .persist()
        )
        return part

    def close(self) -> None:
        """Free the stored edges and degrees; results of the rounds do not read them."""
        self.both.unpersist()
        discard(self._saved)
        if self._placed is not None:
            self._placed.unpersist()


def h_index(counts: DataFrame, ids: Sequence[str], value: str = "core") -> DataFrame:
    """Largest h with at least h neighbours of value >= h, from counts per value."""
    downward = (
        Window.partitionBy(*ids)
        .orderBy(F.col(value).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    reached = F.least(F.col(value).cast("long"), F.sum("n").over(downward))
    return (
        counts.select(*ids, reached.alias("_h"))
        .groupBy(*ids)
        .agg(F.max("_h").cast("int").alias(value))
    )


def _levels(counts: DataFrame, ids: Sequence[str], *carried: str) -> DataFrame:
    """The outcome of a round: ``core``, and the neighbours per level up to it; those of higher levels are counted at ``core``.

    Exactly one row of a vertex has ``level = core``.
    """
    vertex = Window.partitionBy(*ids)
    downward = vertex.orderBy(F.col("level").desc())
    so_far = F.sum("n").over(downward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.select(*ids, *carried, "level", "n", so_far.alias("_sum"), F.lead("level").over(downward).alias("_next"))
    reached = F.max(F.least(F.col("level").cast("long"), "_sum")).over(vertex)
    valued = ranked.withColumn("core", reached.cast("int"))
    above = F.col("level") >= F.col("core")
    lowest = above & (F.col("_next").isNull() | (F.col("_next") < F.col("core")))
    return valued.filter(lowest | (~above & (F.col("n") != 0))).select(
        *ids, *carried, F.least("level", "core").alias("level"), F.when(above, F.col("_sum")).otherwise(F.col("n")).alias("n"), "core"
    )


def clipped_levels(rows: DataFrame, ids: Sequence[str], partitions: int | None) -> DataFrame:
    """``_levels`` of rows ``level, n, own``, where ``own`` (on some rows of each vertex) is its value before, which it keeps as ``old``."""
    counted = _counts(rows, ids, partitions, F.max("own").alias("own"))
    before = counted.withColumn("old", F.max("own").over(Window.partitionBy(*ids)))
    merged = before.groupBy(*ids, "old", F.least("level", "old").alias("level")).agg(F.sum("n").alias("n"))
    return _levels(merged, ids, "old")


def _counts(rows: DataFrame, ids: Sequence[str], partitions: int | None, *kept: Column) -> DataFrame:
    """Rows ``level, n`` summed per vertex and level.

    They are placed by vertex, so that counting and ranking share one shuffle; without ``partitions`` (where
    there are hubs) they are combined before they move instead.
    """
    placed = rows if partitions is None else rows.repartition(partitions, *ids)
    return placed.groupBy(*ids, "level").agg(F.sum("n").alias("n"), *kept)


def one_each(value: str = "core") -> list[Column]:
    """A neighbour's value as a contribution ``level, n, own`` to a round."""
    return [F.col(value).alias("level"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("int").alias("own")]


def marks(values: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Own values as rows ``level, n, own`` that add nothing."""
    return values.select(*ids, F.col("core").alias("level"), F.lit(0).cast("long").alias("n"), F.col("core").alias("own"))


def _moves(beside: DataFrame, ids: Sequence[str]) -> DataFrame:
    """What neighbours that fell from ``old`` to ``core`` add to the counts: rows ``level, n, own``."""
    gone = F.struct(F.col("old").alias("level"), F.lit(-1).cast("long").alias("n"))
    come = F.struct(F.col("core").alias("level"), F.lit(1).cast("long").alias("n"))
    moves = beside.select(*ids, F.explode(F.array(gone, come)).alias("_m"))
    return moves.select(*ids, "_m.level", "_m.n", F.lit(None).cast("int").alias("own"))


def moved_counts(beside: DataFrame, state: DataFrame, ids: Sequence[str], partitions: int | None) -> DataFrame:
    """The round after ``state`` from the edges ``beside`` neighbours that fell from ``old`` to ``core``."""
    moves = _moves(beside, ids)
    kept = state.select(*ids, "level", "n", F.col("core").alias("own"))
    return clipped_levels(kept.union(moves), ids, partitions)


def _fell() -> Column:
    return (F.col("level") == F.col("core")) & (F.col("core") < F.col("old"))


def settle_counts(
    state: DataFrame, changed: DataFrame, ids: Sequence[str], beside: Callable[[DataFrame], DataFrame],
    partitions: int | None, max_rounds: int = ROUND_LIMIT, trace: list | None = None,
    few_share: float = FEW_SHARE, later_share: float = LATER_SHARE,
) -> DataFrame:
    """Values at which nothing falls any more, from written counts per level and what ``changed``.

    A round sends what changed along the edges (``beside``) and rewrites the counts, not the edges; while it lowers few, it
    rewrites only those of vertices it reached (``_settle_few``). Both tables are deleted.
    """
    watch = {"changed": F.count_if(_fell()), "vertices": F.count_if(F.col("level") == F.col("core"))}
    trace = [] if trace is None else trace
    until = len(trace) + max_rounds
    while len(trace) < until:
        following, seen = materialise(moved_counts(beside(changed), state, ids, partitions), **watch)
        trace.append(("counted", seen["changed"]))
        discard(state, changed)
        state = following
        if seen["changed"] and seen["changed"] <= few_share * seen["vertices"]:
            most = later_share * seen["vertices"]
            state, seen = _settle_few(state, ids, beside, partitions, most, until, trace)
        if seen["changed"] == 0:
            return stands_for(values_of(state, ids), state)
        changed, _ = materialise(state.filter(_fell()).select(*ids, "old", "core"))
    raise NotConverged("core numbers still changed after the last round")


def _settle_few(
    state: DataFrame, ids: Sequence[str], beside: Callable[[DataFrame], DataFrame], partitions: int | None,
    most: float, until: int, trace: list,
) -> tuple[DataFrame, dict]:
    """Rounds that count anew only who was beside a change, until nothing falls or those are more than ``most``.

    The counts of the others stay where they are, placed by vertex; the vertices reached so far have theirs in a table
    of their own, which a round rewrites.
    """
    width = partitions or int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = state.repartition(width, *ids).sortWithinPartitions(*ids).persist()
    watch = {"changed": F.count_if(_fell()), "vertices": F.count_if(F.col("level") == F.col("core"))}
    # few rows: as many tasks as they need, unless a hub's have to be combined first
    spread = lambda rows: rows if partitions is None else rows.repartition(*ids)
    later, seen, fallen = state.limit(0), {"changed": None, "vertices": 0}, placed
    trace.append(("few", most))
    while seen["changed"] != 0 and seen["vertices"] <= most and len(trace) < until:
        changed = fallen.filter(_fell()).select(*ids, "old", "core")
        moves, _ = materialise(_counts(spread(_moves(beside(changed), ids)), ids, None, F.max("own").alias("own")))
        first = moves.select(*ids).distinct().join(later.select(*ids).distinct(), ids, "left_anti")
        reached = placed.join(first, ids, "left_semi").union(later)
        rows = reached.select(*ids, "level", "n", F.col("core").alias("own")).union(moves)
        following, seen = materialise(clipped_levels(spread(rows), ids, None), **watch)
        trace.append(("counted", seen["changed"]))
        discard(moves, later)
        later = fallen = following
    others = placed.join(later.select(*ids).distinct(), ids, "left_anti").withColumn("old", F.col("core"))
    whole, _ = materialise(others.select(*later.columns).union(later))
    placed.unpersist()
    discard(state, later)
    return whole, seen


def _full_round(
    table: NeighbourTable, edges: DataFrame, core: DataFrame, clip: bool, partitions: int, counted: bool
) -> DataFrame:
    """The h-index everywhere, as ``_levels`` where the counts are kept (``counted``), else with ``level = core`` only.

    ``clip`` keeps values from rising, which they cannot do when they started as degrees.
    """
    ids = [*table.keys, "u"]
    met = edges.join(table.send(core), table.on)
    width = table.width(partitions)
    if not counted:
        lowered = h_index(_one_counts(met, ids, width), ids)
        if clip:
            known = core.select(*ids, F.col("core").alias("_own"))
            lowered = lowered.join(known, ids).select(*ids, F.least("core", "_own").alias("core"))
        return lowered.withColumn("level", F.col("core"))
    rows = met.select(*ids, *one_each())
    if not clip:
        return _levels(_counts(rows, ids, width), ids)
    return clipped_levels(rows.union(marks(core, ids)), ids, width).drop("old")


def _one_counts(met: DataFrame, ids: Sequence[str], partitions: int | None) -> DataFrame:
    """Neighbours per vertex and value: only ids and values move."""
    rows = met.select(*ids, "core")
    placed = rows if partitions is None else rows.repartition(partitions, *ids)
    return placed.groupBy(*ids, "core").agg(F.count(F.lit(1)).alias("n"))


def values_of(state: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``(ids..., core)`` of a written outcome."""
    return state.filter(F.col("level") == F.col("core")).select(*ids, "core")


def _sum_where(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def _local_round(
    table: NeighbourTable, edges: DataFrame, core: DataFrame, dirty: DataFrame
) -> DataFrame:
    """All vertices as ``(u, core, old)`` after re-evaluating the ``dirty`` ones."""
    ids = [*table.keys, "u"]
    # rows whose neighbour side is dirty, read from the other end
    around = edges.join(table.send(dirty), table.on).select(
        *table.keys, F.col("v").alias("_centre"), "u"
    )
    counts = (
        table.at_u(around, core, "_centre")
        .groupBy(*table.keys, F.col("_centre").alias("u"), "core")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    lowered = dirty.join(h_index(counts, ids), ids, "left").select(
        *ids, F.coalesce("core", F.lit(0)).alias("_h")
    )
    return core.join(lowered, ids, "left").select(
        *ids, F.least("core", "_h").alias("core"), F.col("core").alias("old")
    )


def _weakened(
    table: NeighbourTable, edges: DataFrame, core: DataFrame, changed: DataFrame
) -> DataFrame:
    """Vertices that counted a changed neighbour before and do not any more."""
    ids = [*table.keys, "u"]
    news = changed.select(*ids, F.col("core").alias("_new"), F.col("old").alias("_old"))
    beside = edges.join(table.send(news), table.on).select(*ids, "v", "_new", "_old")
    return (
        table.at_u(beside, core, "v")
        .filter((F.col("core") <= F.col("_old")) & (F.col("core") > F.col("_new")))
        .select(*ids)
        .distinct()
    )


def lower_to_core(
    table: NeighbourTable,
    core: DataFrame,
    partitions: int,
    dirty: DataFrame | None = None,
    total: int | None = None,
    frontier_share: float = FRONTIER_SHARE,
    frontier_min_rows: int = FRONTIER_MIN_ROWS,
    max_rounds: int = ROUND_LIMIT,
    trace: list | None = None,
    clip: bool = True,
    prune_min_rows: int = PRUNE_MIN_ROWS,
) -> DataFrame:
    """Lower ``core`` (an upper bound per vertex) to the exact core numbers.

    Without ``dirty`` all vertices are re-evaluated each round; with it, only
    those vertices and then whoever a change reaches. ``trace`` collects
    ``(kind, size)`` per round. Vertices at 1 are final (everyone here has an
    edge) and hold nobody above 1; once they are the majority the rounds go on
    among the others only. ``prune_min_rows=None`` turns that off.
    """
    edges = table.place(partitions)
    ids = [*table.keys, "u"]
    written = None  # the caller's table is not ours to delete
    fallen = None
    own = F.col("level") == F.col("core")
    for done in range(1, max_rounds + 1):
        if dirty is None:
            counted = fallen is not None and fallen <= COUNTED_SHARE * table.vertices
            lowered, seen = materialise(
                _full_round(table, edges, core, clip, partitions, counted),
                total=_sum_where(own, "core"),
                above=F.count_if(own & (F.col("core") > 1)),
                above_total=_sum_where(own & (F.col("core") > 1), "core"),
            )
            fallen = None if total is None else total - seen["total"]
            if trace is not None:
                trace.append(("full", fallen))
            if fallen == 0:
                discard(written)
                return stands_for(values_of(lowered, ids), lowered)
            if (
                prune_min_rows is not None
                and table.rows >= prune_min_rows
                and seen["above"] <= PRUNE_SHARE * table.vertices
            ):
                discard(written)
                return _among_active(
                    table, lowered, partitions, seen, frontier_share, frontier_min_rows,
                    max_rounds, trace, clip,
                )
            # every vertex that changed fell by at least one
            few = (
                fallen is not None
                and table.rows >= frontier_min_rows
                and fallen <= frontier_share * table.vertices
            )
            now = values_of(lowered, ids)
            if few or counted:
                changed = (
                    now.join(core.withColumnRenamed("core", "old"), ids)
                    .filter(F.col("core") < F.col("old"))
                )
            if few:
                dirty, _ = materialise(_weakened(table, edges, now, changed))
            elif counted:
                changed, _ = materialise(changed)
                discard(written)
                beside = lambda fallen: edges.join(table.send(fallen), table.on)
                return settle_counts(lowered, changed, ids, beside, table.width(partitions), max_rounds - done, trace)
            discard(written)
            core, written, total = now, lowered, seen["total"]
            continue
        state, seen = materialise(
            _local_round(table, edges, core, dirty),
            changed=F.count_if(F.col("core") < F.col("old")),
        )
        if trace is not None:
            trace.append(("local", seen["changed"]))
        if seen["changed"] == 0:
            discard(dirty if written is not None else None, written)
            return state.select(*ids, "core")
        changed = state.filter(F.col("core") < F.col("old"))
        core = state.select(*ids, "core")
        reached, _ = materialise(_weakened(table, edges, core, changed))
        discard(dirty if written is not None else None, written)
        dirty, written = reached, state
    raise NotConverged(f"core numbers still changed after {max_rounds} rounds")


def _among_active(
    table, lowered, partitions, seen, frontier_share, frontier_min_rows, max_rounds, trace, clip
) -> DataFrame:
    """Finish among the vertices above 1; all others are 1."""
    ids = [*table.keys, "u"]
    whole = values_of(lowered, ids)
    active = whole.filter(F.col("core") > 1)
    part = table.restrict(active, seen["above"], partitions)
    if trace is not None:
        trace.append(("prune", seen["above"]))
    try:
        inner = lower_to_core(
            part,
            active,
            partitions,
            total=seen["above_total"],
            frontier_share=frontier_share,
            frontier_min_rows=frontier_min_rows,
            max_rounds=max_rounds,
            trace=trace,
            clip=clip,
            prune_min_rows=None,
        )
    finally:
        part._placed.unpersist()
    found = inner.withColumnRenamed("core", "_inner")
    finished, _ = materialise(
        whole.join(found, ids, "left").select(
            *ids, F.greatest(F.coalesce("_inner", F.lit(1)), F.lit(1)).cast("int").alias("core")
        )
    )
    discard(lowered, inner)
    return finished


def core_numbers(
    pairs: DataFrame,
    keys: Sequence[str] = (),
    hub_rows: int = HUB_ROWS,
    frontier_share: float = FRONTIER_SHARE,
    frontier_min_rows: int = FRONTIER_MIN_ROWS,
    max_rounds: int = ROUND_LIMIT,
    trace: list | None = None,
    prune_min_rows: int | None = PRUNE_MIN_ROWS,
    method: str | None = None,
) -> DataFrame:
    """Exact core number of every vertex: ``(keys..., u, core)``.

    ``method`` is ``peel`` (each graph in one task, which has to hold it) or ``rounds`` (which the other options steer);
    without it graphs of up to ``peel.PEEL_ROWS`` adjacency rows are peeled unless an option asks for rounds.
    """
    asked = (hub_rows, frontier_share, frontier_min_rows, max_rounds, trace, prune_min_rows)
    usual = (HUB_ROWS, FRONTIER_SHARE, FRONTIER_MIN_ROWS, ROUND_LIMIT, None, PRUNE_MIN_ROWS)
    table = NeighbourTable(pairs, keys, hub_rows)
    try:
        if method == "peel" or (method is None and asked == usual and table.can_be_peeled()):
            return peel.peeled_core_numbers(table.both, table.keys, table.rows)
        with loop_settings(pairs.sparkSession, table.rows) as partitions:
            return lower_to_core(
                table,
                table.degree,
                partitions,
                total=table.rows,
                frontier_share=frontier_share,
                frontier_min_rows=frontier_min_rows,
                max_rounds=max_rounds,
                trace=trace,
                clip=False,
                prune_min_rows=prune_min_rows,
            )
    finally:
        table.close()


def windowed_core_numbers(window_pairs: DataFrame, key: str = "window_id", **options) -> DataFrame:
    """Core numbers of many windows at once; all windows share the rounds."""
    return core_numbers(window_pairs, keys=[key], **options)


def k_core_vertices(core: DataFrame, k: int) -> DataFrame:
    return core.filter(F.col("core") >= k)


def k_core(pairs: DataFrame, k: int, core: DataFrame | None = None) -> DataFrame:
    """Pairs of the k-core: both endpoints have core number >= k."""
    core = core_numbers(pairs) if core is None else core
    inside = k_core_vertices(core, k)
    return at_ends(at_ends(pairs.select("u", "v"), inside, "u"), inside, "v")


def core_distribution(core: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Vertices per core number."""
    return (
        core.filter(F.col("core") > 0)
        .groupBy(*keys, "core")
        .agg(F.count(F.lit(1)).alias("vertices"))
    )


def core_distribution_head_tail(core: DataFrame, first: int = 10, last: int = 5) -> DataFrame:
    """The lowest ``first`` and highest ``last`` levels; all of them when they are few."""
    levels = core_distribution(core)
    low = levels.orderBy("core").limit(first)
    high = levels.orderBy(F.col("core").desc()).limit(last)
    return low.union(high).distinct()


def core_stats(core: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Largest core, vertices in it, and the distribution map (one row per key)."""
    levels = core_distribution(core, keys)
    grouped = levels.groupBy(*keys) if keys else levels.groupBy()
    return grouped.agg(
        F.max("core").alias("max_core"),
        F.max_by("vertices", "core").alias("vertices_in_max_core"),
        # one entry per distinct level, at most sqrt(2m) of them
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("core", "vertices")))
        ).alias("distribution"),
    )


def max_core_summary(core: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``core_stats`` without the map."""
    levels = core_distribution(core, keys)
    grouped = levels.groupBy(*keys) if keys else levels.groupBy()
    return grouped.agg(
        F.max("core").alias("max_core"),
        F.max_by("vertices", "core").alias("vertices_in_max_core"),
    )


def max_core_members(core: DataFrame) -> DataFrame:
    """Vertices of the innermost core."""
    top = core.agg(F.max("core").alias("core"))
    return core.join(F.broadcast(top), "core").select("u", "core")
