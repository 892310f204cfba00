"""A graph that changes by batches, its core numbers and indexes kept along.

The adjacency is written once and then overlaid with the pairs that left or entered; vertex
values are a written table overlaid with the values that changed. Both overlays are
merged into their base once they reach a share of it. A batch is worked on from its ends:

* lowering asks the ends of what left, and then whoever counted a vertex that fell;
* raising starts at the lower-core ends of what entered, follows neighbours of equal core number
  that have enough support to rise, evicts those that cannot, and lifts the rest by one; the
  next pass starts beside the lifted vertices.

Every step reads the adjacency of its own frontier only, and what it read is counted. A graph that one task
can hold is packed and the steps are made there (:mod:`tidecore.operators.peel`): they look at the same rows.

Why that is exact. Lowering ends at the largest consistent values below the old ones, so they are lower bounds of
the new core numbers. While one of them is too low, the vertices of some level that have more than
that many neighbours above or among themselves form a set that can rise. Each connected part of it
holds the lower end of an entered pair (otherwise it could have risen before) or, after a
pass, lies beside a lifted vertex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecore.operators import peel
from tidecore.operators.core import core_numbers, h_index
from tidecore.operators.graph import symmetrize
from tidecore.operators.index import higher, mcd_index, pcd_index, r_index, shrink_to_support
from tidecore.plans.fixpoint import (
    ADAPTIVE_MIN_ROWS,
    ROUND_LIMIT,
    NotConverged,
    discard,
    loop_partitions,
    loop_settings,
    materialise,
)
from tidecore.session import shared_path

# Rows of one part of the adjacency; a frontier smaller than the number of parts reads only its own parts.
PART_ROWS = 1_000_000
# Writing tasks that share a part, so that a hub's rows are not written by one task.
SPREAD = 16
# An overlay larger than this share of its base is merged into it.
MERGE_SHARE = 0.25
INDEXES = ("r", "mcd", "pcd")
# Adjacency rows of a graph whose batches are worked on in one task.
TASK_ROWS = peel.WINDOW_ROWS
# Rows that a changed pair may be expected to touch, to size the tasks of a small graph.
BATCH_REACH = 200


def _union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for table in tables[1:]:
        whole = whole.union(table)
    return whole


class Layered:
    """Rows by key ``u``: a written base and the rows that replace some of it; ``core`` 0 means gone."""

    def __init__(self, base: DataFrame, rows: int):
        self.base, self.rows = base, max(1, rows)
        self.over: DataFrame | None = None

    def now(self) -> DataFrame:
        if self.over is None:
            return self.base
        return self.base.join(self.over.select("u"), "u", "left_anti").select(*self.base.columns).union(self.over)

    def replace(self, rows: DataFrame) -> None:
        """Let ``rows`` stand for what was known of their keys."""
        new, _ = materialise(rows.select(*self.base.columns))
        old = self.over
        if old is not None:
            whole = old.join(new.select("u"), "u", "left_anti").select(*self.base.columns).union(new)
        else:
            whole = new
        self.over, seen = materialise(whole, n=F.count(F.lit(1)))
        discard(new, old)
        if seen["n"] > MERGE_SHARE * self.rows:
            merged, seen = materialise(self.now().where("core > 0"), n=F.count(F.lit(1)))
            discard(self.over, self.base)
            self.base, self.rows, self.over = merged, max(1, seen["n"]), None

    def close(self) -> None:
        discard(self.over, self.base)


class Changes:
    """Core numbers while a batch is worked on: those before it and layers of changed ones, the last counts."""

    MOST_LAYERS = 6

    def __init__(self, before: DataFrame):
        self.before = before.select("u", "core")
        self.layers: list[DataFrame] = []
        self.behind: list[DataFrame] = []  # written tables that layers are read from

    def add(self, rows: DataFrame) -> None:
        """Lay ``rows`` on top; they stay readable until the next call."""
        if len(self.layers) >= self.MOST_LAYERS:
            merged, _ = materialise(self.latest())
            self.close()
            self.layers = [merged]
        self.layers.append(rows)

    def close(self) -> None:
        discard(*self.layers, *self.behind)
        self.layers, self.behind = [], []

    def latest(self) -> DataFrame:
        if len(self.layers) == 1:
            return self.layers[0].select("u", "core")
        numbered = [t.select("u", "core", F.lit(i).alias("_i")) for i, t in enumerate(self.layers)]
        return _union(numbered).groupBy("u").agg(F.max_by("core", "_i").alias("core"))

    def now(self) -> DataFrame:
        if not self.layers:
            return self.before
        last = self.latest()
        return self.before.join(last.select("u"), "u", "left_anti").select("u", "core").union(last)

    def net(self) -> tuple[DataFrame | None, int]:
        """The vertices that differ in the end, ``(u, old, core)``, written, and their number."""
        if not self.layers:
            return None, 0
        last, _ = materialise(self.latest())
        known = self.before.join(last.select("u"), "u", "left_semi").withColumnRenamed("core", "old")
        both = last.join(known, "u", "left").select("u", F.coalesce("old", F.lit(0)).cast("int").alias("old"), "core")
        moved, seen = materialise(both.where("old <> core"), n=F.count(F.lit(1)))
        discard(last)
        return moved, seen["n"]


class OverlaidGraph:
    """Core numbers of a simple graph across batches of pairs that leave and enter.

    ``pairs`` is ``(u, v)`` with ``u < v`` and no repeats; ``core`` its core numbers when they are known. With ``indexes``
    r, MCD and PCD (see :mod:`tidecore.operators.index`) are kept up to date too. ``steps`` lists, for every
    batch and step, the vertices visited and the adjacency rows read for them. Without ``place`` the adjacency is
    not stored by vertex, which saves a shuffle where only one batch follows.

    A small frontier is sent to the stored adjacency and to the vertex table (Spark checks its written size); neither
    of them is shuffled or written again for a batch.
    """

    def __init__(self, pairs: DataFrame, core: DataFrame | None = None, indexes: bool = False, place: bool = True):
        self.spark = pairs.sparkSession
        self.indexes = indexes
        self.steps: list[dict] = []
        self.batches = 0
        self._own, seen = materialise(pairs.select("u", "v"), n=F.count(F.lit(1)))
        if place:
            self._store(symmetrize(self._own))
        else:  # for a single batch the pairs are read from both ends where they lie
            self.rows, self.parts, self.base = 2 * seen["n"], 1, symmetrize(self._own)
        self.delta: DataFrame | None = None
        found = core_numbers(self._own) if core is None else core
        self._keep(self._own, found)
        discard(found if core is None else None)

    def _keep(self, pairs: DataFrame, core: DataFrame) -> None:
        values, seen = materialise(self._with_indexes(pairs, core) if self.indexes else core.select("u", "core"), n=F.count(F.lit(1)))
        self.values = Layered(values, seen["n"])

    # --- adjacency ---------------------------------------------------------

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("u"), F.lit(self.parts).cast("long")).cast("int")

    def _store(self, both: DataFrame) -> None:
        """Write both directions in parts by ``u``, sorted inside; a hub's rows are written by many tasks."""
        rows, seen = materialise(both.select("u", "v"), n=F.count(F.lit(1)))
        self.rows = seen["n"]
        self.parts = max(1, -(-self.rows // PART_ROWS))
        path = shared_path(self.spark, "adjacency")
        width = max(self.parts, loop_partitions(self.spark, self.rows))
        placed = rows.select("u", "v", self._part().alias("part")).repartition(width, "part", F.pmod(F.hash("v"), F.lit(SPREAD)))
        placed.sortWithinPartitions("part", "u").write.partitionBy("part").parquet(path)
        self.base = self.spark.read.schema("u long, v long, part int").parquet(path)
        discard(rows)

    def adjacent(self, frontier: DataFrame, size: int | None = None) -> DataFrame:
        """Adjacency rows ``u, v`` of a frontier ``u``, as they are now; only its parts are read when it has few vertices."""
        base = self.base
        if size is not None and size < self.parts:
            near = [r[0] for r in frontier.select(self._part()).distinct().collect()]  # fewer than there are parts
            base = base.where(F.col("part").isin(near))
        rows = base.select("u", "v").join(frontier.select("u"), "u", "left_semi")
        if self.delta is None:
            return rows
        left = self.delta.where("not there").select("u", "v")
        entered = self.delta.where("there").select("u", "v").join(frontier.select("u"), "u", "left_semi")
        return rows.join(left, ["u", "v"], "left_anti").select("u", "v").union(entered.select("u", "v"))

    def pairs(self) -> DataFrame:
        """The graph as it is now, ``u < v``."""
        return self._everywhere().where("u < v")

    def _batch(self, leaving: DataFrame, entering: DataFrame) -> tuple[DataFrame, dict]:
        """Both directions of the changed pairs, flagged and written, and laid over the adjacency."""
        flagged = leaving.select("u", "v", F.lit(False).alias("there")).union(entering.select("u", "v", F.lit(True).alias("there")))
        batch, seen = materialise(symmetrize(flagged, ["there"]), out=F.count_if(~F.col("there")), into=F.count_if(F.col("there")))
        merged = batch.select("u", "v", "there")
        if self.delta is not None:  # a pair that changes back is no change
            both = self.delta.join(merged.withColumnRenamed("there", "_now"), ["u", "v"], "full_outer")
            merged = both.where("there is null or _now is null").select("u", "v", F.coalesce("there", "_now").alias("there"))
        old = self.delta
        self.delta, size = materialise(merged, n=F.count(F.lit(1)))
        discard(old)
        if size["n"] > MERGE_SHARE * self.rows:
            whole, last = symmetrize(self.pairs()), self.delta
            self._store(whole)
            self.delta = None
            discard(last)
        return batch, seen

    # --- batches -----------------------------------------------------------

    def core(self) -> DataFrame:
        """``(u, core)`` of all vertices with an edge; readable until the next batch."""
        return self.values.now().where("core > 0").select("u", "core")

    def index(self) -> DataFrame:
        """``(u, core, r, mcd, pcd)`` of all vertices with an edge; readable until the next batch."""
        return self.values.now().where("core > 0").select("u", "core", *INDEXES)

    def slide(self, leaving: DataFrame, entering: DataFrame) -> DataFrame:
        """Take pairs away and add others; returns what changed, ``(u, old, core)``, written; 0 stands for no edges.

        ``leaving`` are pairs of the graph, ``entering`` are not; neither has repeats.
        """
        self.batches += 1
        batch, seen = self._batch(leaving, entering)
        # few tasks for a small batch; large graphs leave it to adaptive execution
        work = self.rows if self.rows >= ADAPTIVE_MIN_ROWS else min(self.rows, BATCH_REACH * (seen["out"] + seen["into"]))
        with loop_settings(self.spark, work):
            before = self.values.now()
            if self._held_by_a_task():
                return self._slide_in_one_task(before, batch, seen)
            fresh = Changes(before)
            if seen["out"]:
                self._lower(fresh, batch.where("not there").select("u").distinct())
            if seen["into"]:
                self._raise(fresh, batch)
            moved, n = fresh.net()
            if self.indexes and seen["out"] + seen["into"]:
                self._reindex(before, moved, n, batch)
            elif n:
                self.values.replace(moved)
            discard(batch)
            fresh.close()
        return self._none() if moved is None else moved

    def _everywhere(self) -> DataFrame:
        """Both directions of the graph as it is now."""
        rows = self.base.select("u", "v")
        if self.delta is None:
            return rows
        return rows.join(self.delta.where("not there"), ["u", "v"], "left_anti").select("u", "v").union(self.delta.where("there").select("u", "v"))

    def _held_by_a_task(self) -> bool:
        rows = self._everywhere()
        return self.rows <= TASK_ROWS and peel.fits(rows, []) and peel.one_task_holds(rows, self.rows)

    def _slide_in_one_task(self, before: DataFrame, batch: DataFrame, seen: dict) -> DataFrame:
        """The steps of a slide on a graph that one task holds, in that task."""
        entered = batch.where("there").select("u", "v", F.lit(1).alias("_in"))
        both = self._everywhere().join(entered, ["u", "v"], "left").select("u", "v", F.coalesce("_in", F.lit(0)).alias("entered"))
        left = batch.where("not there").select("u").distinct().withColumn("_left", F.lit(1))
        values = before.select("u", "core").join(left, "u", "left").select("u", "core", F.coalesce("_left", F.lit(0)).alias("left"))
        found = peel.slide_in_one_task(both, self.rows + seen["into"], values, seen["out"] > 0, seen["into"] > 0)
        # a row per step
        for r in found.where("step is not null").orderBy("u").collect():
            self.steps.append({"batch": self.batches, "step": r["step"], "visited": r["old"], "traversed": r["core"]})
        moved, size = materialise(found.where("step is null").select("u", F.col("old").cast("int"), F.col("core").cast("int")), n=F.count(F.lit(1)))
        discard(found)
        if self.indexes and seen["out"] + seen["into"]:
            self._reindex(before, moved, size["n"], batch)
        elif size["n"]:
            self.values.replace(moved)
        discard(batch)
        return moved

    def recompute(self, leaving: DataFrame, entering: DataFrame) -> DataFrame:
        """As ``slide``, with the core numbers computed from scratch."""
        self.batches += 1
        batch, _ = self._batch(leaving, entering)
        now, _ = materialise(self.pairs())
        core = core_numbers(now)
        was, new = self.core().withColumnRenamed("core", "old"), core.select("u", "core")
        both = was.join(new, "u", "full_outer").select("u", F.coalesce("old", F.lit(0)).alias("old"), F.coalesce("core", F.lit(0)).alias("core"))
        moved, _ = materialise(both.where("old <> core"))
        self.values.close()
        self._keep(now, core)
        discard(batch, now, core)
        return moved

    def _none(self) -> DataFrame:
        return self.values.base.select("u", F.col("core").alias("old"), "core").limit(0)

    def impact(self) -> DataFrame:
        """``batch, visited, traversed``: vertices visited and adjacency rows read, counted in the steps themselves.

        A vertex visited in several steps counts in each. A recomputed batch has zeros.
        """
        totals: dict[int, list[int]] = {i + 1: [0, 0] for i in range(self.batches)}
        for step in self.steps:
            totals[step["batch"]][0] += step["visited"]
            totals[step["batch"]][1] += step["traversed"]
        return self.spark.createDataFrame([(i, *t) for i, t in totals.items()], "batch int, visited long, traversed long")

    def close(self) -> None:
        """Delete the written tables of this graph; tables it returned stay."""
        self.values.close()
        discard(self.delta, self._own)

    def _read(self, kind: str, frontier: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
        """The adjacency of a frontier as ``(u, v)``, written, and the frontier's size.

        Every vertex of the frontier has one more row with a null ``v``. A frontier of known ``size`` is read from a written
        table and not written again.
        """
        own = size is None and self.parts > 1
        if own:
            frontier, seen = materialise(frontier, n=F.count(F.lit(1)))
            size = seen["n"]
        marks = frontier.select("u", F.lit(None).cast("long").alias("v"))
        rows, seen = materialise(marks.union(self.adjacent(frontier, size if self.parts > 1 else None)), visited=F.count_if(F.col("v").isNull()), rows=F.count("v"))
        if own:
            discard(frontier)
        if seen["visited"]:
            self.steps.append({"batch": self.batches, "step": kind, "visited": seen["visited"], "traversed": seen["rows"]})
        return rows, seen["visited"]

    @staticmethod
    def _values(rows: DataFrame, fresh: Changes) -> DataFrame:
        """Core numbers of all vertices of written rows, written; the rows go to the vertex table, which stays where it is."""
        ends = rows.select("u").union(rows.select("v").where("v is not null"))
        return materialise(fresh.now().join(ends, "u", "left_semi"))[0]

    @staticmethod
    def _cored(rows: DataFrame, values: DataFrame) -> DataFrame:
        """``(u, core, v, n_core)`` of written rows; vertices not seen before have core number 0."""
        own = values.withColumnRenamed("core", "_own")
        other = values.select(F.col("u").alias("v"), F.col("core").alias("_other"))
        both = rows.where("v is not null").join(own, "u", "left").join(other, "v", "left")
        level = lambda c: F.coalesce(c, F.lit(0)).cast("int")
        return both.select("u", level("_own").alias("core"), "v", level("_other").alias("n_core"))

    def _lower(self, fresh: Changes, dirty: DataFrame) -> None:
        done: list[DataFrame] = []
        size = None
        for _ in range(ROUND_LIMIT):
            rows, visited = self._read("lower", dirty, size)
            discard(*done)
            if not visited:
                discard(rows)
                return
            values = self._values(rows, fresh)
            near = self._cored(rows, values)
            held = near.groupBy("u", F.least("core", "n_core").alias("core")).agg(F.count(F.lit(1)).alias("n"))
            reach = h_index(held, ["u"]).withColumnRenamed("core", "_h")
            own = values.join(rows.where("v is null").select("u"), "u", "left_semi").withColumnRenamed("core", "old")
            lowered = own.join(reach, "u", "left").select("u", "old", F.coalesce("_h", F.lit(0)).cast("int").alias("core"))
            fell = lowered.where("core < old")
            # whoever counted a vertex that fell, and may count it no more; both may have fallen in this round
            also = fell.select(F.col("u").alias("v"), F.col("core").alias("_now"))
            beside = near.join(fell.select("u", F.col("core").alias("_new")), "u").join(also, "v", "left").withColumn("_now", F.coalesce("_now", "n_core"))
            counted = beside.where("_now <= core and _now > _new")
            weak = counted.select(F.col("v").alias("u")).distinct()
            both, seen = materialise(
                fell.select("u", "old", "core").union(weak.select("u", F.lit(None).cast("int"), F.lit(None).cast("int"))),
                fell=F.count("core"), weak=F.count_if(F.col("core").isNull()),
            )
            fresh.add(both.where("core is not null").select("u", "core"))
            fresh.behind.append(both)
            done = [rows, values]
            if not seen["weak"]:
                discard(*done)
                return
            dirty, size = both.where("core is null").select("u"), seen["weak"]
        raise NotConverged("lowering")

    def _raise(self, fresh: Changes, batch: DataFrame) -> None:
        entered = batch.where("there").select("u", "v")
        values = self._values(entered, fresh)
        seeds, seen = materialise(self._cored(entered, values).where("core <= n_core").select("u").distinct(), n=F.count(F.lit(1)))
        discard(values)
        for _ in range(ROUND_LIMIT):
            near, read = self._able(fresh, seeds, seen["n"])
            if near is None:
                discard(seeds, *read)
                return
            start, size = materialise(near.where("able").groupBy("u", "core").agg(F.first("support").alias("support")), n=F.count(F.lit(1)))
            inside = start.select("u")
            equals = near.where("able and n_core = core").select("u", "v")
            links, held = materialise(equals.join(inside.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v"), n=F.count(F.lit(1)))
            rising = shrink_to_support(start, links, size["n"], held["n"])
            lifted = rising.select("u", (F.col("core") + 1).cast("int").alias("core"))
            fresh.add(lifted)
            fresh.behind.append(rising)
            # a lifted vertex is now above its old equals and level with those one above
            beside = near.where("n_core = core or n_core = core + 1").join(lifted.select("u"), "u", "left_semi").select(F.col("v").alias("u"))
            following, seen = materialise(lifted.select("u").union(beside).distinct(), n=F.count(F.lit(1)))
            discard(seeds, links, *read, *([start] if rising is not start else []))
            seeds = following
            if not seen["n"]:
                discard(seeds)
                return
        raise NotConverged("raising")

    def _able(self, fresh: Changes, seeds: DataFrame, size: int) -> tuple[DataFrame | None, list[DataFrame]]:
        """Who may rise, reached from ``seeds`` through equals that may.

        Returns the rows read, ``(u, core, v, n_core, support, able)``, where anyone may, and the tables behind them.
        """
        read, near, visited, ables = [], [], [], 0
        frontier = seeds
        for _ in range(ROUND_LIMIT):
            rows, n = self._read("raise", frontier, size)
            if not n:
                read.append(rows)
                break
            values = self._values(rows, fresh)
            cored = self._cored(rows, values)
            counts = cored.groupBy("u").agg(F.count_if(higher()).alias("support"), F.count_if(F.col("n_core") >= F.col("core")).alias("_mcd"))
            known = cored.join(counts, "u").withColumn("able", F.col("_mcd") > F.col("core")).select("u", "core", "v", "n_core", "support", "able")
            visited.append(rows.where("v is null").select("u"))
            further = known.where("able and n_core = core").select(F.col("v").alias("u")).distinct().join(_union(visited), "u", "left_anti")
            blank = [F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns[1:]]
            both, seen = materialise(known.union(further.select("u", *blank)), able=F.count_if("able"), further=F.count_if(F.col("v").isNull()))
            read += [rows, values, both]
            near.append(both.where("v is not null"))
            ables += seen["able"]
            if not seen["further"]:
                break
            frontier, size = both.where("v is null").select("u"), seen["further"]
        return (_union(near) if ables else None), read

    # --- indexes -----------------------------------------------------------

    @staticmethod
    def _with_indexes(pairs: DataFrame, core: DataFrame) -> DataFrame:
        found = core.select("u", "core")
        for name, index in (("r", r_index), ("mcd", mcd_index), ("pcd", pcd_index)):
            found = found.join(index(pairs, core).select("u", name), "u")
        return found

    def _reindex(self, before: DataFrame, moved: DataFrame | None, n: int, batch: DataFrame) -> None:
        """Carry r and MCD, and then PCD, over to the new graph and core numbers.

        A vertex whose core number changed is counted anew from its own adjacency. For the others, the terms of
        changed neighbours and of changed pairs are taken off as they were and put on as they are. PCD does the same one
        hop further: around the vertices whose core number or surplus (MCD > core) changed.
        """
        moved = self._none() if moved is None else moved
        surplus = (F.col("mcd") > F.col("core")).alias("able")
        old = before.select("u", "core", surplus)
        cores = before.join(moved.select("u"), "u", "left_anti").select("u", "core", F.lit(False).alias("able")).union(moved.select("u", "core", F.lit(False)))
        first = self._shifts(moved, moved, n, batch, old, cores, {"r": lambda own, c, able: c > own, "mcd": lambda own, c, able: c >= own})
        known, _ = materialise(before.join(first.select("u"), "u", "left_semi"))
        level = moved.select("u", F.col("core").alias("_core"))
        kept = lambda name: F.when(F.col("anew"), F.col(f"{name}_shift")).otherwise(F.coalesce(name, F.lit(0)) + F.col(f"{name}_shift")).cast("long").alias(name)
        changed, _ = materialise(
            first.join(known, "u", "left").join(level, "u", "left").select("u", F.coalesce("_core", "core").alias("core"), kept("r"), kept("mcd"), F.coalesce("pcd", F.lit(0)).cast("long").alias("pcd"))
        )
        was = known.select("u", F.col("core").alias("_core"), (F.col("mcd") > F.col("core")).alias("_able"))
        both = changed.select("u", "core", surplus).join(was, "u", "left")
        flipped, seen = materialise(both.where("not (core <=> _core) or not (able <=> _able)").select("u"), n=F.count(F.lit(1)))
        middle = before.join(changed.select("u"), "u", "left_anti").select("u", "core", *INDEXES).union(changed)
        second = self._shifts(flipped, moved, seen["n"], batch, old, middle.select("u", "core", surplus), {"pcd": lambda own, c, able: (c > own) | ((c == own) & able)})
        touched = changed.select("u").union(second.select("u")).distinct()
        final = middle.join(touched, "u", "left_semi").join(second.select("u", "anew", "pcd_shift"), "u", "left")
        pcd = F.when(F.coalesce("anew", F.lit(False)), F.col("pcd_shift")).otherwise(F.col("pcd") + F.coalesce("pcd_shift", F.lit(0)))
        self.values.replace(final.select("u", "core", "r", "mcd", pcd.cast("long").alias("pcd")))
        discard(first, second, known, changed, flipped)

    def _shifts(self, sources: DataFrame, anew: DataFrame, size: int, batch: DataFrame, old: DataFrame, new: DataFrame, conditions: dict[str, Callable]) -> DataFrame:
        """What changes in counts of neighbours when the vertices ``sources`` and the pairs of ``batch`` changed.

        ``anew`` is a part of ``sources``; ``old`` and ``new`` are ``(u, core, able)`` before and after; a condition takes
        the own core number and the neighbour's two values. Result, written: ``u``, ``anew`` and a shift per condition, the
        whole count where ``anew`` is true.
        """
        rows, seen = materialise(self.adjacent(sources, size if self.parts > 1 else None), n=F.count(F.lit(1)))
        self.steps.append({"batch": self.batches, "step": "index", "visited": size, "traversed": seen["n"]})
        entered, left = batch.where("there").select("u", "v"), batch.where("not there").select("u", "v")
        fresh = anew.select("u")
        # what x means to w: on with its new values (plus), off with its old ones (minus)
        mine = rows.join(fresh, "u", "left_semi").select(F.col("u").alias("w"), F.col("v").alias("x"), F.lit(1).alias("plus"), F.lit(0).alias("minus"), F.lit(True).alias("anew"))
        stayed = rows.join(entered, ["u", "v"], "left_anti").select(F.col("v").alias("w"), F.col("u").alias("x"), F.lit(1), F.lit(1))
        gained = entered.select("u", "v", F.lit(1), F.lit(0))
        lost = left.select("u", "v", F.lit(0), F.lit(1))
        others = stayed.union(gained).union(lost).join(fresh.withColumnRenamed("u", "w"), "w", "left_anti").withColumn("anew", F.lit(False))
        terms, _ = materialise(mine.union(others))
        ends = terms.select(F.col("w").alias("u")).union(terms.select("x")).distinct()
        now, _ = materialise(new.join(ends, "u", "left_semi"))
        past, _ = materialise(old.join(ends, "u", "left_semi"))
        named = lambda t, u, tag: t.select(F.col("u").alias(u), F.col("core").alias(f"{tag}_core"), F.col("able").alias(f"{tag}_able"))
        cored = terms.join(named(now, "w", "w"), "w", "left").join(named(now, "x", "new"), "x", "left").join(named(past, "x", "old"), "x", "left")
        own = F.coalesce("w_core", F.lit(0))

        def shift(condition: Callable) -> Column:
            holds = lambda tag: condition(own, F.coalesce(f"{tag}_core", F.lit(0)), F.coalesce(f"{tag}_able", F.lit(False))).cast("int")
            return F.sum(F.col("plus") * holds("new") - F.col("minus") * holds("old")).cast("long")

        counted = cored.groupBy(F.col("w").alias("u"), "anew").agg(*(shift(c).alias(f"{k}_shift") for k, c in conditions.items()))
        bare = fresh.join(mine.select(F.col("w").alias("u")), "u", "left_anti").select("u", F.lit(True), *(F.lit(0).cast("long") for _ in conditions))
        out, _ = materialise(counted.union(bare))
        discard(rows, terms, now, past)
        return out
