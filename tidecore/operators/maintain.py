"""Keeping core numbers up to date from the edges that leave and enter.

Core numbers after a batch are at most the old ones plus the largest number of
new edges at one vertex (take those edges away from a k-core and every member
still has k minus that many neighbours), and never more than the degree. That
upper bound is lowered to the exact values by the same rounds that compute core
numbers from scratch, starting much closer to the answer. A batch without
insertions is re-evaluated around the removed edges only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecore.operators import peel
from tidecore.operators.bins import pair_spans, span_events, vertex_spans, window_edges
from tidecore.operators.components import components
from tidecore.operators.core import (
    FRONTIER_MIN_ROWS,
    FRONTIER_SHARE,
    NeighbourTable,
    _weakened,
    core_numbers,
    lower_to_core,
)
from tidecore.operators.graph import symmetrize
from tidecore.operators.index import (
    core_ends,
    equal,
    equal_core_links,
    higher,
    index_delta,
    neighbour_index,
    pcd_of,
    s_index,
    shrink_to_support,
)
from tidecore.operators.overlay import OverlaidGraph
from tidecore.operators.slices import at_ends, hub_slices, join_by_vertex
from tidecore.operators.spans import enclosed_core_numbers
from tidecore.plans.fixpoint import (
    ROUND_LIMIT,
    TASK_TABLES,
    NotConverged,
    discard,
    loop_settings,
    materialise,
)
from tidecore.plans.scalars import attach
from tidecore.session import shared_path


def endpoints(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("u")).distinct()


def update_core(
    state: DataFrame,
    core: DataFrame,
    frontier_share: float = FRONTIER_SHARE,
    frontier_min_rows: int = FRONTIER_MIN_ROWS,
    trace: list | None = None,
    rounds: bool = False,
) -> DataFrame:
    """Core numbers after a slide, from pairs with flags ``before`` and ``after``.

    A graph that one task can hold is peeled, unless an option asks for rounds from the bound.
    """
    spark = state.sparkSession
    state, _ = materialise(state)
    leaving = state.filter(F.col("before") & ~F.col("after"))
    entering = state.filter(F.col("after") & ~F.col("before"))
    table = NeighbourTable(state.filter("after").select("u", "v"))
    bound = dirty = ends = None
    usual = (frontier_share, frontier_min_rows, trace, rounds) == (FRONTIER_SHARE, FRONTIER_MIN_ROWS, None, False)
    try:
        if usual and table.can_be_peeled():
            return peel.peeled_core_numbers(table.both, [], table.rows)
        with loop_settings(spark, table.rows) as partitions:
            most = (
                symmetrize(entering).groupBy("u").agg(F.count(F.lit(1)).alias("_n"))
                .agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_most"))
            )
            known = core.select("u", F.col("core").alias("_old"))
            highest = (F.coalesce("_old", F.lit(0)) + F.col("_most")).cast("int")
            bound, seen = materialise(
                table.degree.join(known, "u", "left")
                .transform(attach, most)
                .select("u", F.least("core", highest).alias("core"), "_most"),
                total=F.coalesce(F.sum("core"), F.lit(0)),
                most=F.coalesce(F.max("_most"), F.lit(0)),
            )
            if seen["most"] == 0 and table.rows >= frontier_min_rows:
                # where most vertices are near a change, rounds over all of them cost less than rounds that look for them
                few = frontier_share * table.vertices
                ends, near = materialise(endpoints(leaving).join(table.degree, "u", "left_semi"), n=F.count(F.lit(1)))
                if near["n"] <= few:
                    # a vertex whose new degree is below its old core falls before the first round:
                    # its neighbours have to be asked as well as the ends of what left
                    fell = bound.join(known, "u").where(F.col("core") < F.col("_old"))
                    fell = fell.select("u", "core", F.col("_old").alias("old"))
                    weak = _weakened(table, table.place(partitions), bound.select("u", "core"), fell)
                    dirty, near = materialise(ends.union(weak).distinct(), n=F.count(F.lit(1)))
                    if near["n"] > few:
                        discard(dirty)
                        dirty = None
            return lower_to_core(
                table,
                bound.select("u", "core"),
                partitions,
                dirty,
                total=seen["total"],
                frontier_share=frontier_share,
                frontier_min_rows=frontier_min_rows,
                trace=trace,
            ).select("u", "core")
    finally:
        table.close()
        discard(state, bound, dirty, ends)


def _flagged(pairs: DataFrame, before: bool, after: bool) -> DataFrame:
    return pairs.select("u", "v", F.lit(before).alias("before"), F.lit(after).alias("after"))


def _changes(pairs: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs with flags ``before`` and ``after`` that the batch names; added wins over removed."""
    batch = (
        removed.select("u", "v", F.lit(False).alias("_in"))
        .union(added.select("u", "v", F.lit(True)))
        .groupBy("u", "v")
        .agg(F.max("_in").alias("after"))
    )
    known = pairs.join(batch, ["u", "v"], "left_semi").select("u", "v").distinct().withColumn("before", F.lit(True))
    return batch.join(known, ["u", "v"], "left").select("u", "v", F.coalesce("before", F.lit(False)).alias("before"), "after")


# A batch of at least this share of the pairs is cheaper to work on all over (see ``advise_ratio``).
ROUNDS_SHARE = 0.05


def core_after_slide(
    pairs: DataFrame,
    core: DataFrame,
    removed: DataFrame,
    added: DataFrame,
    method: str | None = None,
    **options,
) -> DataFrame:
    """Core numbers of ``(pairs - removed) + added``, from those of ``pairs``.

    Absent removals and repeated additions are no changes. ``method`` is ``overlay`` (work spreads from the ends of the
    batch, see :class:`tidecore.operators.overlay.OverlaidGraph`) or ``rounds`` (an upper bound is lowered
    everywhere, which ``options`` steer); without it large batches are peeled where one task can hold the graph, and
    take the rounds where it cannot. All are exact.
    """
    state, seen = materialise(
        _changes(pairs, removed, added).where("before <> after"),
        out=F.count_if("before"),
        into=F.count_if("after"),
    )
    left, entered = state.where("before").select("u", "v"), state.where("after").select("u", "v")
    graph = None
    try:
        if method is None and not options:
            method = "overlay" if seen["out"] + seen["into"] < ROUNDS_SHARE * pairs.count() else None
        if method == "overlay":
            graph = OverlaidGraph(pairs, core, place=False)
            graph.slide(left, entered)
            return materialise(graph.core())[0]
        flagged = _flagged(pairs, True, True).join(left, ["u", "v"], "left_anti")
        state_of = flagged.union(_flagged(left, True, False)).union(_flagged(entered, False, True))
        return update_core(state_of, core, rounds=method == "rounds", **options)
    finally:
        if graph is not None:
            graph.close()
        discard(state)


def core_after_removals(
    pairs: DataFrame, core: DataFrame, removed: DataFrame, **options
) -> DataFrame:
    return core_after_slide(pairs, core, removed, removed.limit(0), **options)


def core_after_insertions(
    pairs: DataFrame, core: DataFrame, added: DataFrame, **options
) -> DataFrame:
    return core_after_slide(pairs, core, added.limit(0), added, **options)


def slide_counts(state: DataFrame) -> DataFrame:
    """What the refresh advice looks at: n, m, batch size and touched vertices (one row)."""
    changed = F.col("before") != F.col("after")
    ends = symmetrize(state, ["before", "after"])
    per_vertex = ends.groupBy("u").agg(
        F.count_if(F.col("before")).alias("_d"), F.max(changed).alias("_touched")
    )
    return per_vertex.agg(
        F.count_if(F.col("_d") > 0).alias("n"),
        (F.sum("_d") / 2).cast("long").alias("m"),
        F.count_if(F.col("_touched")).alias("touched"),
    ).transform(attach, state.agg(F.count_if(changed).alias("batch")))


def slide_table(binned: DataFrame, start: int, width: int, step: int = 1, slides: int = 10) -> DataFrame:
    """What refresh advice looks at, for every slide, from one pass over the edges.

    ``slide`` (from 1), ``n`` vertices and ``m`` pairs of the window before it, ``batch`` pairs that change and
    ``touched`` vertices at their ends. No window is formed: pairs and vertices enter and leave.
    """
    edges, size = materialise(window_edges(binned, start, width + slides * step).select("src", "dst", "bin"), n=F.count(F.lit(1)))
    # a task handles a part of bounded size, whatever the number of edges
    with loop_settings(binned.sparkSession, TASK_TABLES * size["n"]):
        pairs, _ = materialise(span_events(pair_spans(edges, width), start, step, slides))
        vertices = span_events(vertex_spans(edges, width), start, step, slides)
        ends = pairs.select("slide", F.explode(F.array("u", "v")).alias("u"))
        counts, _ = materialise(
            pairs.groupBy("slide").agg(F.sum("change").alias("m"), F.count(F.lit(1)).alias("batch"))
            .join(ends.groupBy("slide").agg(F.count_distinct("u").alias("touched")), "slide")
            .join(vertices.groupBy("slide").agg(F.sum("change").alias("n")), "slide", "left")
        )
    discard(edges, pairs)
    every = binned.sparkSession.range(slides + 1).select(F.col("id").cast("int").alias("slide"))
    # one row per slide
    sofar = Window.orderBy("slide").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))).over(sofar), F.lit(0)).cast("long").alias(c)
    whole = every.join(counts, "slide", "left").select("slide", total("n"), total("m"), F.coalesce("batch", F.lit(0)).alias("batch"), F.coalesce("touched", F.lit(0)).alias("touched"))
    return whole.where("slide > 0")


class MaintainedWindows:
    """Core numbers of consecutive windows: those of the first one and what every slide changed.

    Edges are read once: pairs become spans of windows, and a slide reads its own events. The graph of the present
    window is an :class:`tidecore.operators.overlay.OverlaidGraph`; ``strategy`` as in ``maintain_windows``.
    """

    def __init__(self, binned: DataFrame, start: int, width: int, step: int = 1, slides: int = 3, indexes: bool = False):
        spark = binned.sparkSession
        self.start, self.width, self.step = start, width, step
        last = binned.agg(F.max("bin")).first()[0]
        self.slides = 0 if last is None else max(0, min(slides, (last - (start + width) + 1) // step))
        spans = pair_spans(window_edges(binned, start, width + self.slides * step), width)
        path = shared_path(spark, "events")
        span_events(spans, start, step, self.slides).write.partitionBy("slide").parquet(path)
        self.events = spark.read.schema("u long, v long, change int, slide int").parquet(path)
        self.graph = OverlaidGraph(self._at(0, 1), indexes=indexes)
        self.first, seen = materialise(self.graph.core(), n=F.count(F.lit(1)))
        self.first_index = materialise(self.graph.index())[0] if indexes else None
        self.changes: list[DataFrame] = []

    def _at(self, slide: int, change: int) -> DataFrame:
        return self.events.where((F.col("slide") == slide) & (F.col("change") == change)).select("u", "v")

    def run(self, strategy: Callable | None = None, sizes: DataFrame | None = None) -> None:
        """All slides; ``sizes`` is the ``slide_table`` that ``strategy`` decides by."""
        update = {}
        if strategy is not None:
            rule = strategy(F.col("n"), F.col("m"), F.col("batch"), F.col("touched"))
            update = {r["slide"]: r["update"] for r in sizes.select("slide", rule.alias("update")).collect()}  # a row per slide
        for i in range(1, self.slides + 1):
            work = self.graph.slide if update.get(i, True) else self.graph.recompute
            self.changes.append(work(self._at(i, -1), self._at(i, 1)))

    def core(self, slide: int) -> DataFrame:
        """``(u, core)`` after a slide: the first window's, overlaid with the last change of each vertex."""
        if slide == 0 or not self.changes:
            return self.first
        numbered = [t.select("u", "core", F.lit(i).alias("_i")) for i, t in enumerate(self.changes[:slide])]
        whole = numbered[0]
        for t in numbered[1:]:
            whole = whole.union(t)
        latest = whole.groupBy("u").agg(F.max_by("core", "_i").alias("core"))
        return self.first.join(latest.select("u"), "u", "left_anti").union(latest.where("core > 0"))


# Windows whose core numbers are found together.
TOGETHER = 64


def maintain_windows(
    binned: DataFrame,
    start: int,
    width: int,
    step: int = 1,
    slides: int = 3,
    strategy: Callable | None = None,
) -> list[tuple[int, DataFrame]]:
    """Core numbers after each of ``slides`` consecutive slides.

    The slides of a table at rest are worked on together, ``TOGETHER`` at a time: the pairs that all their
    windows share and the pairs that any of them holds enclose the core numbers, and only vertices between the two bounds
    are looked at window by window (:func:`tidecore.operators.spans.enclosed_core_numbers`; where one task can hold the pairs,
    by peeling, :func:`tidecore.operators.peel.peeled_windows`). With ``strategy``, a
    column rule of :mod:`tidecore.operators.advise` (such as ``advise_ratio``), every slide starts
    from the result of the one before (:class:`MaintainedWindows`), and where the rule prefers recomputation the window
    is computed afresh. Slides end with the last bin.
    """
    if strategy is not None:
        windows = MaintainedWindows(binned, start, width, step, slides)
        windows.run(strategy, slide_table(binned, start, width, step, slides))
        windows.graph.close()
        return [(i, windows.core(i)) for i in range(1, windows.slides + 1)]
    edges, size = materialise(binned.select("src", "dst", "bin"), n=F.count(F.lit(1)), last=F.max("bin"))
    last = size["last"]
    fits = 0 if last is None else max(0, min(slides, (last - (start + width) + 1) // step))
    if not fits:
        discard(edges)
        return []
    with loop_settings(binned.sparkSession, TASK_TABLES * size["n"]):
        spans, _ = materialise(window_spans(edges, start + step, width, step, fits))
    discard(edges)
    results = []
    for low in range(0, fits, TOGETHER):
        count = min(TOGETHER, fits - low)
        near = spans.where((F.col("first") < low + count) & (F.col("end") > low))
        own = near.select("u", "v", F.greatest(F.col("first") - low, F.lit(0)).alias("first"), F.least(F.col("end") - low, F.lit(count)).alias("end"))
        both, size = materialise(symmetrize(own, ["first", "end"]), n=F.count(F.lit(1)))
        if size["n"] <= peel.WINDOW_ROWS and peel.fits(both, []) and peel.one_task_holds(both, size["n"]):
            # as below, in tasks that hold the graph
            share = -(-count // binned.sparkSession.sparkContext.defaultParallelism)
            found = peel.peeled_windows(both, [], size["n"], F.array(F.lit(0), F.lit(count - 1)), share, enclosed=count)
            discard(both)
            results += [(low + k + 1, found.where(F.col("window") == k).select("u", "core")) for k in range(count)]
            continue
        discard(both)
        settled, others, _ = enclosed_core_numbers(own, count)
        for k in range(count):
            results.append((low + k + 1, settled.union(others.where(F.col("window") == k).select("u", "core"))))
    discard(spans)
    return results


def window_spans(binned: DataFrame, start: int, width: int, step: int, windows: int) -> DataFrame:
    """Pairs of the windows that start at ``start + i * step``: ``(u, v, first, end)``, in the windows ``[first, end)``."""
    spans = pair_spans(window_edges(binned, start, width + (windows - 1) * step), width)
    at = lambda c: F.ceil((F.col(c) - F.lit(start)) / F.lit(step)).cast("int")
    placed = spans.select("u", "v", F.greatest(at("enter"), F.lit(0)).alias("first"), F.least(at("leave"), F.lit(windows)).alias("end"))
    return placed.where("first < end")


def maintain_indexes(binned: DataFrame, start: int, width: int, step: int = 1, slides: int = 3) -> DataFrame:
    """r, MCD and PCD of the last window, kept up to date along with the core numbers: ``(u, core, r, mcd, pcd)``."""
    windows = MaintainedWindows(binned, start, width, step, slides, indexes=True)
    windows.run()
    found = materialise(windows.graph.index())[0]
    windows.graph.close()
    return found


def slide_impact(binned: DataFrame, start: int, width: int, step: int = 1, slides: int = 3) -> DataFrame:
    """Per slide: core numbers ``affected``, vertices ``visited`` and adjacency rows ``traversed``, counted while maintaining."""
    windows = MaintainedWindows(binned, start, width, step, slides)
    windows.run()
    rows = None
    for i, moved in enumerate(windows.changes, 1):
        row = moved.agg(F.lit(i).alias("batch"), F.count(F.lit(1)).alias("affected"))
        rows = row if rows is None else rows.union(row)
    if rows is None:
        raise ValueError("no slide fits into the bins")
    found = rows.join(windows.graph.impact(), "batch").select(F.col("batch").alias("slide"), "affected", "visited", "traversed")
    windows.graph.close()
    return found


def slide_results(results: list[tuple[int, DataFrame]]) -> DataFrame:
    """The results of all slides as one table ``(slide, u, core)``."""
    tables = [core.select(F.lit(i).alias("slide"), "u", "core") for i, core in results]
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.union(table)
    return whole


def _batch_with_cores(batch: DataFrame, core: DataFrame) -> DataFrame:
    """Batch pairs with the core numbers ``cu`` and ``cv`` (0 when unknown)."""
    cu = core.select("u", F.col("core").alias("cu"))
    cv = core.select(F.col("u").alias("v"), F.col("core").alias("cv"))
    return (
        batch.select("u", "v")
        .join(cu, "u", "left")
        .join(cv, "v", "left")
        .select("u", "v", F.coalesce("cu", F.lit(0)).alias("cu"), F.coalesce("cv", F.lit(0)).alias("cv"))
    )


def _lower_ends(batch: DataFrame, core: DataFrame) -> DataFrame:
    """Endpoints on the lower-core side of each batch pair, both when tied."""
    cored = _batch_with_cores(batch, core)
    side = F.array_compact(
        F.array(
            F.when(F.col("cu") <= F.col("cv"), F.col("u")),
            F.when(F.col("cv") <= F.col("cu"), F.col("v")),
        )
    )
    return cored.select(F.explode(side).alias("u")).distinct()


def touched_vertices(delta: DataFrame, core: DataFrame | None = None) -> DataFrame:
    """Endpoints of a batch; with ``core`` only those on the lower-core side."""
    return endpoints(delta) if core is None else _lower_ends(delta, core)


def impact_neighborhood(
    pairs: DataFrame, vertices: DataFrame, core: DataFrame | None = None
) -> DataFrame:
    """``vertices`` and their neighbours; with ``core`` also one step further
    to the neighbours' neighbours of equal core number."""
    both = symmetrize(pairs)
    start = vertices.select("u")
    around = at_ends(both, start, "v").select("u").distinct()
    found = start.union(around)
    if core is not None:
        level = around.join(core, "u").select(F.col("u").alias("v"), F.col("core").alias("n_core"))
        further = join_by_vertex(join_by_vertex(both, level, "v"), core.select("u", "core"), "u").filter(equal()).select("u")
        found = found.union(further)
    return found.distinct()


def insertion_candidates(pairs: DataFrame, core: DataFrame, batch: DataFrame) -> DataFrame:
    """Lower-core endpoints of a batch that the new graph may lift: PCD > core.

    ``pairs`` already holds the batch, ``core`` is the one before it.
    """
    return pcd_of(pairs, core, _lower_ends(batch, core)).filter(F.col("pcd") > F.col("core"))


def removal_seeds_by_level(core: DataFrame, batch: DataFrame, block: int = 4096) -> DataFrame:
    """Endpoints of removed pairs per core level, in id blocks of bounded size."""
    seeds = endpoints(batch).join(core.filter(F.col("core") > 0), "u")
    return seeds.groupBy("core", F.floor(F.col("u") / F.lit(block)).alias("block")).agg(
        F.sort_array(F.collect_set("u")).alias("seeds")
    )


def removals_by_level(core: DataFrame, batch: DataFrame) -> DataFrame:
    """Removed pairs per level min(core(u), core(v))."""
    return (
        _batch_with_cores(batch, core)
        .groupBy(F.least("cu", "cv").alias("level"))
        .agg(F.count(F.lit(1)).alias("removed"))
    )


# Hops whose vertices are kept as tables of their own before they are merged into one.
MERGE_HOPS = 8


def subcore(pairs: DataFrame, core: DataFrame, seeds: DataFrame) -> DataFrame:
    """Vertices reachable from ``seeds`` through vertices of the seed's core number.

    A hop writes only the vertices it reaches first; those of earlier hops are left out by anti-joins
    and merged now and then, so a vertex is written a few times, whatever the number of hops.
    """
    spark = pairs.sparkSession
    links, sizes = materialise(equal_core_links(pairs, core), n=F.count(F.lit(1)))
    hubs, _ = materialise(hub_slices(links, "v"))
    with loop_settings(spark, sizes["n"]):
        edge, seen = materialise(core.join(seeds.select("u").distinct(), "u", "left_semi"), n=F.count(F.lit(1)))
        reached = [edge]
        while seen["n"]:
            near = at_ends(links, edge, "v", hubs=hubs).select("u").distinct()
            for table in reached:
                near = near.join(table.select("u"), "u", "left_anti")
            edge, seen = materialise(core.join(near, "u", "left_semi"), n=F.count(F.lit(1)))
            reached.append(edge)
            if len(reached) > MERGE_HOPS:
                merged, _ = materialise(_union(reached[:-1]))
                discard(*reached[:-1])
                reached = [merged, edge]
        whole, _ = materialise(_union(reached))
        discard(links, hubs, *reached)
        return whole


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.union(table)
    return whole


def effective_degree(pairs: DataFrame, core: DataFrame, members: DataFrame) -> DataFrame:
    """For ``members``: neighbours with at least the member's core number."""
    return neighbour_index(pairs, core, ["core"], members, effective_degree=higher() | equal())


def _level_support(pairs: DataFrame, core: DataFrame, members: DataFrame) -> tuple:
    """``(u, core, support)`` of members and the links among equal-core members.

    Equal-core neighbours outside ``members`` do not change and count as support.
    """
    inside = members.select("u").distinct().withColumn("member", F.lit(True))
    marked = core.join(inside, "u", "left").select(
        "u", "core", F.coalesce("member", F.lit(False)).alias("member")
    )
    firm = higher() | (equal() & ~F.col("n_member"))
    support = neighbour_index(pairs, marked, ["core", "member"], inside, support=firm)
    return support, equal_core_links(pairs, core.join(inside, "u", "left_semi"))


def demotion_cascade(pairs: DataFrame, core: DataFrame, members: DataFrame) -> DataFrame:
    """Members that fall: repeatedly drop those with fewer than core supporting neighbours."""
    support, links = _level_support(pairs, core, members)
    links, size = materialise(links, n=F.count(F.lit(1)))
    # keep when support + held >= core, that is > core - 1
    bound, seen = materialise(
        support.select("u", (F.col("core") - 1).alias("core"), "support"), n=F.count(F.lit(1))
    )
    with loop_settings(pairs.sparkSession, size["n"] + seen["n"]):
        staying = shrink_to_support(bound, links, seen["n"], size["n"])
        fallen, _ = materialise(
            core.join(members.select("u").distinct(), "u", "left_semi").join(
                staying, "u", "left_anti"
            )
        )
    discard(links, bound, staying)
    return fallen


def promotion_eviction(pairs: DataFrame, core: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that rise: repeatedly evict those with at most core candidate or higher neighbours."""
    inside = candidates.select("u").distinct()
    links, size = materialise(equal_core_links(pairs, core.join(inside, "u", "left_semi")), n=F.count(F.lit(1)))
    start, seen = materialise(neighbour_index(pairs, core, ["core"], inside, support=higher()), n=F.count(F.lit(1)))
    with loop_settings(pairs.sparkSession, size["n"] + seen["n"]):
        rising = shrink_to_support(start, links, seen["n"], size["n"])
    discard(links)
    return rising.select("u", "core")


def core1_to_2_candidates(pairs: DataFrame, core: DataFrame, candidates: DataFrame) -> DataFrame:
    """Core-1 candidates with at least two neighbours of core >= 1."""
    level = core.filter(F.col("core") == 1).join(candidates.select("u").distinct(), "u", "left_semi")
    found = neighbour_index(pairs, core, ["core"], level, neighbours=F.col("n_core") >= 1)
    return found.filter(F.col("neighbours") >= 2).select("u", "neighbours")


def frontier_propagation(
    pairs: DataFrame, core: DataFrame, index: DataFrame, seeds: DataFrame, rounds: int | None = None
) -> DataFrame:
    """Re-count s around ``seeds`` and spread to equal-core neighbours while it changes.

    ``index`` is ``(u, s)`` as known before; an equal-core neighbour w counts
    when r(w) + degree(w) > core. Those conditions are fixed, so a vertex is
    settled once visited. Returns all of ``core`` as ``(u, core, s)``. Without
    ``rounds`` it goes on until nothing changes.
    """
    # the pairs are read once, and one table of edges with the core numbers of both ends gives what all conditions need
    pairs, _ = materialise(pairs.select("u", "v"))
    met, size = materialise(core_ends(pairs, core), n=F.count(F.lit(1)))
    known = met.groupBy("u", "core").agg(F.count_if(higher()).alias("r"), F.count(F.lit(1)).alias("degree"))
    able, _ = materialise(known.select("u", "core", (F.col("r") + F.col("degree") > F.col("core")).alias("able")))
    links, _ = materialise(met.filter(equal()).select("u", "v"))
    # the hubs among them are found once for all rounds
    hubs, _ = materialise(hub_slices(links, "v"))
    counted = at_ends(links, able.where("able"), "v", hubs=hubs).groupBy("u").agg(F.count(F.lit(1)).alias("fresh"))
    with loop_settings(pairs.sparkSession, size["n"]):
        state, _ = materialise(
            core.join(index.select("u", "s"), "u", "left")
            .join(counted, "u", "left")
            .select("u", "core", F.coalesce("s", F.lit(0)).cast("long").alias("s"),
                    F.coalesce("fresh", F.lit(0)).cast("long").alias("fresh"))
        )
        changing, _ = materialise(state.where("s <> fresh").select("u"))
        moved: list[DataFrame] = []
        frontier = seeds.select("u").distinct()
        for _ in range(ROUND_LIMIT if rounds is None else rounds):
            # who moved is settled: each vertex is written once
            front = changing.join(frontier, "u", "left_semi")
            for table in moved:
                front = front.join(table, "u", "left_anti")
            moving, seen = materialise(front, n=F.count(F.lit(1)))
            moved.append(moving)
            if seen["n"] == 0:
                break
            if len(moved) > MERGE_HOPS:
                merged, _ = materialise(_union(moved[:-1]))
                discard(*moved[:-1])
                moved = [merged, moving]
            frontier = at_ends(links, moving, "v", hubs=hubs).select("u").distinct()
        settled = _union(moved).withColumn("_moved", F.lit(True)) if moved else changing.limit(0).withColumn("_moved", F.lit(True))
        found, _ = materialise(
            state.join(settled, "u", "left").select("u", "core", F.when(F.col("_moved"), F.col("fresh")).otherwise(F.col("s")).alias("s"))
        )
        discard(pairs, met, able, links, hubs, state, changing, *moved)
        return found


def connected_labels(pairs: DataFrame) -> DataFrame:
    """``(u, component)`` with the smallest vertex id of the component; see ``components``."""
    labels = components(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")))
    return labels.select(F.col("node").alias("u"), F.col("label").alias("component"))


def same_core_components(
    pairs: DataFrame, core: DataFrame, candidates: DataFrame, min_core: int = 2
) -> DataFrame:
    """Components among candidates of equal core number: ``(u, core, component)``.

    A candidate without such a neighbour is a component of its own.
    """
    inside = core.join(candidates.select("u").distinct(), "u", "left_semi").filter(
        F.col("core") >= min_core
    )
    linked = equal_core_links(pairs, inside).filter(F.col("u") < F.col("v"))
    labels = connected_labels(linked)
    return inside.join(labels, "u", "left").select(
        "u", "core", F.coalesce("component", "u").alias("component")
    )


def batch_components(batch: DataFrame) -> DataFrame:
    """Split a batch into sub-batches that share no vertex: ``(u, v, component)``."""
    pairs = batch.select("u", "v").distinct()
    return pairs.join(connected_labels(pairs), "u").select("u", "v", "component")


def one_round_core_estimate(pairs: DataFrame, core: DataFrame, delta: DataFrame) -> DataFrame:
    """APPROXIMATE core numbers after a batch: every vertex moves by at most one.

    Removed endpoints fall when too few neighbours of their level are left;
    then touched endpoints of additions rise when r + s > core, with s counting
    equal-core neighbours that have support beyond their own core. Use
    :func:`core_after_slide` for exact values.
    """
    removed = delta.filter(F.col("change") == "remove").select("u", "v")
    added = delta.filter(F.col("change") == "add").select("u", "v")
    index = s_index(pairs, core, rounds=0)
    always = core.select("u", F.lit(True).alias("able"))
    shift = index_delta(core, always, delta.filter(F.col("change") == "remove"))
    weak = (
        index.join(shift, "u")
        .filter(F.col("r") + F.col("s") + F.col("r_delta") + F.col("s_delta") < F.col("core"))
        .select("u", F.lit(-1).alias("_move"))
    )
    lowered = core.join(weak, "u", "left").select(
        "u", (F.col("core") + F.coalesce("_move", F.lit(0))).cast("int").alias("core")
    )
    after = pairs.join(removed, ["u", "v"], "left_anti").union(added).distinct()
    fresh = endpoints(added).join(lowered.filter(F.col("core") > 0), "u", "left_anti")
    seeded, _ = materialise(
        lowered.filter(F.col("core") > 0)
        .union(fresh.select("u", F.lit(1).cast("int").alias("core")))
        .join(endpoints(after), "u", "left_semi")
    )
    strong = pcd_of(after, seeded, endpoints(added)).filter(F.col("pcd") > F.col("core")).select("u", F.lit(1).alias("_move"))
    return seeded.join(strong, "u", "left").select(
        "u", (F.col("core") + F.coalesce("_move", F.lit(0))).cast("int").alias("core")
    )


def maintenance_impact(
    pairs: DataFrame, before: DataFrame, after: DataFrame, visited: DataFrame
) -> DataFrame:
    """Visited vertices, changed core numbers and edges looked at (one row)."""
    degree = symmetrize(pairs).groupBy("u").agg(F.count(F.lit(1)).alias("_d"))
    seen = (
        visited.select("u").distinct().join(degree, "u", "left")
        .agg(
            F.count(F.lit(1)).alias("visited"),
            F.coalesce(F.sum("_d"), F.lit(0)).alias("traversed"),
        )
    )
    old = before.select("u", F.col("core").alias("_old"))
    new = after.select("u", F.col("core").alias("_new"))
    changed = old.join(new, "u", "full_outer").agg(
        F.count_if(~F.col("_old").eqNullSafe(F.col("_new"))).alias("affected")
    )
    return seen.transform(attach, changed).select("visited", "affected", "traversed")


def impact_ratio(ours: DataFrame, other: DataFrame) -> DataFrame:
    """Visited and traversed of one method as a share of another's."""
    theirs = other.select(F.col("visited").alias("_v"), F.col("traversed").alias("_t"))
    return ours.transform(attach, theirs).select(
        F.when(F.col("_v") > 0, F.col("visited") / F.col("_v")).otherwise(1.0).alias("visited_ratio"),
        F.when(F.col("_t") > 0, F.col("traversed") / F.col("_t")).otherwise(1.0).alias("traversed_ratio"),
    )
