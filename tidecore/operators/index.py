"""Per-vertex support indexes at given core numbers.

Each index counts neighbours by a condition on both core numbers. Edges are
first counted per vertex and neighbour level, so a hub is combined before the
shuffle; the vertex's own core number joins that much smaller table. Tables of
all vertices are joined by sorting: compressed, they look small enough to be sent
to every task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecore.operators import peel
from tidecore.operators.graph import symmetrize
from tidecore.operators.slices import SLICE_ROWS, at_ends, hub_slices, join_by_vertex
from tidecore.plans.fixpoint import (
    ROUND_LIMIT,
    NotConverged,
    discard,
    loop_settings,
    materialise,
)
from tidecore.plans.scalars import attach


def neighbour_counts(
    pairs: DataFrame, vertices: DataFrame, by: Sequence[str] = ("core",), members: DataFrame | None = None
) -> DataFrame:
    """Neighbours per vertex and per value of ``by``: ``(u, n_<by>..., n)``; of ``members`` only, where given."""
    seen = vertices.select(F.col("u").alias("v"), *[F.col(c).alias(f"n_{c}") for c in by])
    both = symmetrize(pairs) if members is None else at_ends(symmetrize(pairs), members, "u")
    return (
        join_by_vertex(both, seen, "v", sort=True)
        .groupBy("u", *[f"n_{c}" for c in by])
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _count_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long")


def neighbour_index(
    pairs: DataFrame, vertices: DataFrame, by: Sequence[str], members: DataFrame | None = None, **conditions: Column
) -> DataFrame:
    """Columns counting neighbours by conditions over ``core`` and ``n_<by>``.

    With ``members`` only their edges are counted. Hubs are cut into slices on the neighbours' side and
    combined per level on the other.
    """
    counts = neighbour_counts(pairs, vertices, by, members)
    return (
        vertices.hint("merge").join(counts, "u")
        .groupBy("u", "core")
        .agg(*[_count_where(c).alias(name) for name, c in conditions.items()])
    )


def higher() -> Column:
    return F.col("n_core") > F.col("core")


def equal() -> Column:
    return F.col("n_core") == F.col("core")


def r_index(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Neighbours with a larger core number."""
    return neighbour_index(pairs, core, ["core"], r=higher())


def mcd_index(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Neighbours with at least the own core number."""
    return neighbour_index(pairs, core, ["core"], mcd=higher() | equal())


def pcd_index(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Neighbours that are higher, or equal with support beyond their own core number."""
    able = mcd_index(pairs, core).select("u", "core", (F.col("mcd") > F.col("core")).alias("able"))
    return neighbour_index(
        pairs, able, ["core", "able"], pcd=higher() | (equal() & F.col("n_able"))
    )


def pcd_of(pairs: DataFrame, core: DataFrame, members: DataFrame) -> DataFrame:
    """PCD of ``members`` only: ``(u, core, pcd)`` from their edges and those of their neighbours."""
    ends = members.select("u").distinct()
    near = at_ends(symmetrize(pairs), ends, "v").select("u").distinct()
    able = neighbour_index(pairs, core, ["core"], near, mcd=higher() | equal())
    able = able.select("u", "core", (F.col("mcd") > F.col("core")).alias("able"))
    mine = core.join(ends, "u", "left_semi").select("u", "core", F.lit(False).alias("able"))
    # a member counts its neighbours; its own flag matters only where it is a neighbour too
    seen = able.union(mine.join(able.select("u"), "u", "left_anti"))
    return neighbour_index(pairs, seen, ["core", "able"], ends, pcd=higher() | (equal() & F.col("n_able"))).join(ends, "u", "left_semi")


def core_ends(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Both directions of the edges with the core numbers of their ends: ``(u, v, core, n_core)``."""
    other = core.select(F.col("u").alias("v"), F.col("core").alias("n_core"))
    both = symmetrize(pairs)
    # the hubs are the same at both ends: looking for them again would join once more
    hubs = hub_slices(both, "v")
    level = join_by_vertex(both, other, "v", sort=True, hubs=hubs)
    own = join_by_vertex(level, core.select("u", "core"), "u", sort=True, hubs=hubs.withColumnRenamed("v", "u"))
    return own.select("u", "v", "core", "n_core")


def equal_core_links(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Both directions of the edges between vertices of equal core number."""
    return core_ends(pairs, core).filter(equal()).select("u", "v")


def s_index(pairs: DataFrame, core: DataFrame, rounds: int | None = 1) -> DataFrame:
    """Equal-core *qualified* neighbours, as a family of relaxations.

    ``rounds=0`` counts every equal-core neighbour; round i counts those with
    r + s > core by round i-1; ``None`` goes on until nothing changes. Returns
    ``(u, core, r, s)``.
    """
    base = neighbour_index(pairs, core, ["core"], r=higher(), s=equal())
    if rounds == 0:
        return base
    state, seen = materialise(base, total=F.coalesce(F.sum("s"), F.lit(0)))
    # only edges between equals are asked again, and they are found once
    links, size = materialise(equal_core_links(pairs, core), n=F.count(F.lit(1)))
    hubs, _ = materialise(hub_slices(links, "v"))
    step = 0
    with loop_settings(pairs.sparkSession, size["n"] + 1):
        while rounds is None or step < rounds:
            total = seen["total"]
            able = state.where(F.col("r") + F.col("s") > F.col("core"))
            counted = at_ends(links, able, "v", hubs=hubs).groupBy("u").agg(F.count(F.lit(1)).alias("_s"))
            following, seen = materialise(
                state.join(counted, "u", "left").select("u", "core", "r", F.coalesce("_s", F.lit(0)).cast("long").alias("s")),
                total=F.coalesce(F.sum("s"), F.lit(0)),
            )
            discard(state)
            state, step = following, step + 1
            # s only falls from round to round
            if seen["total"] == total:
                break
            if step > ROUND_LIMIT:
                raise NotConverged("s index still changed")
    discard(links, hubs)
    return state


def qualified_vertices(index: DataFrame) -> DataFrame:
    """Vertices with r + s > core."""
    return index.filter(F.col("r") + F.col("s") > F.col("core"))


def relaxed_s_index(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Equal-core neighbours w with r(w) + degree(w) > core."""
    known = neighbour_index(pairs, core, ["core"], r=higher(), degree=F.lit(True))
    able = known.select("u", "core", (F.col("r") + F.col("degree") > F.col("core")).alias("able"))
    return neighbour_index(
        pairs, able, ["core", "able"], relaxed_s=equal() & F.col("n_able")
    )


def index_delta(core: DataFrame, qualified: DataFrame, delta: DataFrame) -> DataFrame:
    """What a batch does to r, s, MCD and PCD at fixed core numbers.

    ``qualified`` is ``(u, able)``: whether an equal-core neighbour counts for
    s and PCD. ``delta`` is ``(u, v, change)`` with ``add`` / ``remove``.
    """
    signed = delta.select(
        "u", "v", F.when(F.col("change") == "add", 1).otherwise(-1).alias("sign")
    )
    there = F.struct(F.col("u"), F.col("v"), F.col("sign"))
    back = F.struct(F.col("v").alias("u"), F.col("u").alias("v"), F.col("sign"))
    ends = signed.select(F.explode(F.array(there, back)).alias("_e")).select("_e.*")
    other = core.join(qualified, "u", "left").select(
        F.col("u").alias("v"),
        F.col("core").alias("n_core"),
        F.coalesce("able", F.lit(False)).alias("n_able"),
    )

    def moved(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("sign"))), F.lit(0)).cast("long")

    return (
        ends.join(other, "v")
        .join(core, "u")
        .groupBy("u")
        .agg(
            moved(higher()).alias("r_delta"),
            moved(equal() & F.col("n_able")).alias("s_delta"),
            moved(higher() | equal()).alias("mcd_delta"),
            moved(higher() | (equal() & F.col("n_able"))).alias("pcd_delta"),
        )
    )


def core_levels(core: DataFrame, block: int = 4096) -> DataFrame:
    """Vertices of each core level, in id blocks of bounded size.

    ``top`` marks the largest level.
    """
    top = core.agg(F.max("core").alias("_top"))
    return (
        core.groupBy("core", F.floor(F.col("u") / F.lit(block)).alias("block"))
        .agg(F.sort_array(F.collect_set("u")).alias("vertices"))
        .transform(attach, top)
        .select("core", "block", "vertices", (F.col("core") == F.col("_top")).alias("top"))
    )


def shrink_to_support(candidates: DataFrame, links: DataFrame, size: int, link_rows: int | None = None) -> DataFrame:
    """Largest subset whose members keep ``support + linked members > core``.

    ``candidates`` is ``(u, core, support)`` with ``size`` rows, where
    ``support`` counts the neighbours that hold in any case; ``links`` holds
    both directions of the edges between candidates. Each round drops members
    that lost too much. Where there are ``link_rows`` links, too few for a hub, no slices are made.
    """
    alive = candidates
    if size == 0:
        return alive
    small = link_rows is not None and link_rows <= SLICE_ROWS
    hubs = None if small else materialise(hub_slices(links, "v"))[0]
    for i in range(ROUND_LIMIT):
        alive_ends = alive.select(F.col("u").alias("v"))
        held = (
            (links.join(alive_ends, "v", "left_semi") if small else at_ends(links, alive, "v", hubs=hubs))
            .groupBy("u")
            .agg(F.count(F.lit(1)).alias("_held"))
        )
        left, seen = materialise(
            alive.join(held, "u", "left")
            .filter(F.col("support") + F.coalesce("_held", F.lit(0)) > F.col("core"))
            .select("u", "core", "support"),
            n=F.count(F.lit(1)),
        )
        if i:
            discard(alive)
        alive = left
        if seen["n"] in (0, size):
            discard(hubs)
            return alive
        size = seen["n"]
    raise NotConverged("candidate set still shrank")


def promotable(edges: DataFrame, core: DataFrame) -> DataFrame:
    """``promotable_set`` from both directions of the edges.

    First the vertices with more than core neighbours of their level or higher;
    only the edges among those of equal core number take part in the rounds.
    """
    seen_from = core.select(F.col("u").alias("v"), F.col("core").alias("n_core"))
    counts = join_by_vertex(edges, seen_from, "v").groupBy("u", "n_core").agg(F.count(F.lit(1)).alias("n"))
    able, seen = materialise(
        core.join(counts, "u")
        .filter(F.col("n_core") >= F.col("core"))
        .groupBy("u", "core")
        .agg(_count_where(higher()).alias("support"), F.sum("n").alias("_mcd"))
        .filter(F.col("_mcd") > F.col("core"))
        .select("u", "core", "support"),
        n=F.count(F.lit(1)),
    )
    near = able.select(F.col("u").alias("v"), F.col("core").alias("n_core"))
    level = join_by_vertex(edges, near, "v")
    links, _ = materialise(join_by_vertex(level, able.select("u", "core"), "u").filter(equal()).select("u", "v"))
    rising = shrink_to_support(able, links, seen["n"])
    discard(links)
    return rising.select("u", "core")


def promotable_set(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """Vertices that can rise together by one.

    The greatest set Q in which every v keeps more than core(v) neighbours that
    are higher, or equal and in Q; empty when ``core`` is exact.
    """
    both = symmetrize(pairs).persist()
    try:
        rows = both.count()
        if peel.fits(both, []) and peel.one_task_holds(both, rows):
            return peel.supported_vertices(both, rows, core)
        with loop_settings(pairs.sparkSession, rows):
            return promotable(both, core)
    finally:
        both.unpersist()
