"""Core numbers of graphs that one task can hold, by peeling.

Rounds move every value over every edge until nothing falls, some dozens of times. A graph of bounded size needs none of
that: its vertices get dense numbers and its neighbour lists are packed into arrays, both by many tasks at once, and one
task takes vertices away from the lowest degree up, touching every edge once. Graphs that are kept apart by keys are
peeled side by side, each in a task of its own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.plans.fixpoint import arrow_batches, discard, loop_settings, materialise

# Workers get this module's functions with the task: queries on graphs do not ask for the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Adjacency rows (two for a pair) of a graph that one task peels; it holds four bytes for each.
PEEL_ROWS = 80_000_000
# The same for a graph with the windows of its rows, of which a task holds twelve bytes for each.
WINDOW_ROWS = PEEL_ROWS // 3
# Neighbours of one vertex that a packing task is meant to hold beside others; a graph of no more than HELD_ROWS cannot have too many.
HUB_ROWS = 2_000_000
HELD_ROWS = 4_000_000
# Neighbours looked at together, and entries of one packed list.
CHUNK = 1 << 20
# Packed lists that travel together.
LISTS = 16
# Tasks per core among which graphs are dealt, so that few large ones meet in a task.
SPREAD = 8


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``start .. start + count - 1`` of all entries, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def neighbours_of(rows: np.ndarray, indptr: np.ndarray, nbr: np.ndarray) -> Iterator[np.ndarray]:
    """The neighbours of the vertices ``rows``, in parts of about ``CHUNK``."""
    counts = indptr[rows + 1] - indptr[rows]
    groups = np.cumsum(counts) // CHUNK
    for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(groups)) + 1):
        if len(part):
            yield nbr[ranges(indptr[rows[part]], counts[part])]


def take_off(degree: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Lower ``degree`` by one for every entry of ``gone``; returns who is named there."""
    if len(gone) * 8 < len(degree):
        who, times = np.unique(gone, return_counts=True)
        degree[who] -= times
        return who
    times = np.bincount(gone, minlength=len(degree))
    degree -= times
    return np.flatnonzero(times)


def peel(indptr: np.ndarray, nbr: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Core number of every vertex of a graph given by neighbour lists.

    Where core numbers are ``known`` (-1: not), these vertices go at their level, whatever they have left by then.
    """
    n = len(indptr) - 1
    degree = np.diff(indptr)
    core = np.zeros(n, dtype=np.int32)
    alive = np.ones(n, dtype=bool)
    free = None
    if known is not None:
        free = known < 0
        degree = np.where(free, degree, known)
    left, k = np.arange(n), 0
    while len(left):
        level = degree[left]
        k = max(k, int(level.min()))
        front = left[level <= k]
        while len(front):
            core[front] = k
            alive[front] = False
            reached = []
            for near in neighbours_of(front, indptr, nbr):
                near = near[alive[near] if free is None else alive[near] & free[near]]
                if len(near):
                    who = take_off(degree, near)
                    reached.append(who[degree[who] <= k])
            front = np.unique(np.concatenate(reached)) if reached else front[:0]
        left = left[alive[left]]
    return core


def counts_where(indptr: np.ndarray, nbr: np.ndarray, condition) -> np.ndarray:
    """Per vertex the neighbours for which ``condition(owner, neighbour)`` holds, in bounded parts."""
    degree = np.diff(indptr)
    found = np.zeros(len(degree), dtype=np.int64)
    groups = indptr[:-1] // CHUNK
    for part in np.split(np.arange(len(degree)), np.flatnonzero(np.diff(groups)) + 1):
        if len(part):
            a, b = part[0], part[-1] + 1
            owner = np.repeat(part, degree[a:b])
            found[a:b] = np.bincount(owner[condition(owner, nbr[indptr[a] : indptr[b]])] - a, minlength=b - a)
    return found


def supported(indptr: np.ndarray, nbr: np.ndarray, core: np.ndarray) -> np.ndarray:
    """The largest set whose members have more than ``core`` neighbours that are higher, or equal and in the set.

    A core number of -1 stands for a vertex that is none of the graph's.
    """
    held = counts_where(indptr, nbr, lambda own, other: (core[other] >= core[own]) & (core[other] >= 0))
    inside = core >= 0
    front = np.flatnonzero(inside & (held <= core))
    while len(front):
        inside[front] = False
        reached = []
        for part in np.array_split(front, 1 + int((indptr[front + 1] - indptr[front]).sum()) // CHUNK):
            counts = indptr[part + 1] - indptr[part]
            near = nbr[ranges(indptr[part], counts)]
            near = near[inside[near] & (core[near] == np.repeat(core[part], counts))]
            if len(near):
                who = take_off(held, near)
                reached.append(who[held[who] <= core[who]])
        front = np.unique(np.concatenate(reached)) if reached else front[:0]
    return inside


# --- packing -------------------------------------------------------------------


def _ids(batch: pa.RecordBatch | pa.Table, names: Sequence[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in names]


def _ranked(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted order of rows, which of them begin a new combination, and the rank of each in that order."""
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order, fresh, np.cumsum(fresh) - 1


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows) if rows else None


def _key_starts(columns: list[np.ndarray], length: int) -> np.ndarray:
    """Which of sorted rows begin a new key."""
    begins = np.zeros(length, dtype=bool)
    begins[:1] = True
    for c in columns:
        begins[1:] |= c[1:] != c[:-1]
    return begins


def _numbered(keys: Sequence[str], parts: int, extra: Sequence[str]):
    """Rows ``keys, u, v`` placed by ``keys, v`` get the number of ``v``: its rank among those of its key there, and the part."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        columns = _ids(table, [*keys, "v"])
        order, _, rank = _ranked(columns)
        if keys:
            begins = _key_starts([c[order] for c in columns[:-1]], len(order))
            rank -= np.maximum.accumulate(np.where(begins, rank, 0))
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = rank * parts + table.column("_part")[0].as_py()
        if len(ids) and ids.max() > np.iinfo(np.int32).max:
            raise ValueError("too many vertices for one task")
        named = {c: table.column(c) for c in [*keys, "u", *extra]} | {"_id": pa.array(ids.astype(np.int32))}
        yield from pa.table(named).to_batches(max_chunksize=CHUNK)

    return number


def _listed(keys: Sequence[str], extra: Sequence[str]):
    """Rows ``keys, u, _id`` placed by ``keys, u`` become packed lists of vertices, their neighbours' numbers and what is ``extra`` to these."""
    packed = _packed(extra)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is None:
            return
        columns = _ids(table, [*keys, "u"])
        order, fresh, _ = _ranked(columns)
        beside = [table.column(c).to_numpy()[order].astype(np.int32) for c in ["_id", *extra]]
        part = table.column("_part")[0].as_py()
        starts = np.append(np.flatnonzero(fresh), len(order))
        own = [c[order[starts[:-1]]] for c in columns]
        # a list ends with its key, and where it is long enough
        begins = _key_starts(own[:-1], len(own[-1]))
        place = np.arange(len(begins))
        place -= np.maximum.accumulate(np.where(begins, place, 0))
        cut = begins.copy()
        cut[1:] |= np.diff(starts[:-1] // CHUNK) > 0
        edges = np.append(np.flatnonzero(cut), len(cut))
        found = {c: [] for c in [*keys, "_part", "_at", "ids", "degrees", *packed]}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for c, values in zip(keys, own, strict=False):
                found[c].append(values[a])
            found["_part"].append(part)
            found["_at"].append(place[a])
            found["ids"].append(own[-1][a:b].astype(np.int64).tobytes())
            found["degrees"].append(np.diff(starts[a : b + 1]).astype(np.int32).tobytes())
            for c, values in zip(packed, beside, strict=True):
                found[c].append(values[starts[a] : starts[b]].tobytes())
        kinds = {c: table.schema.field(c).type for c in keys} | {"_part": pa.int32(), "_at": pa.int32()}
        yield from pa.table({c: pa.array(v, kinds.get(c, pa.binary())) for c, v in found.items()}).to_batches(max_chunksize=LISTS)

    return pack


def _packed(extra: Sequence[str]) -> list[str]:
    return ["near", *(f"near_{c}" for c in extra)]


class _Lists:
    """Packed lists of one graph, gathered until it is whole."""

    def __init__(self):
        self.rows: list[tuple] = []

    def graph(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vertex ids, and the neighbour lists as positions among them."""
        ids = np.concatenate([np.frombuffer(r[2], dtype=np.int64) for r in self.rows])
        degrees = np.concatenate([np.frombuffer(r[3], dtype=np.int32) for r in self.rows])
        indptr = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(degrees, out=indptr[1:])
        # a part's numbers follow each other over its lists
        sizes = np.array([len(r[2]) // 8 for r in self.rows])
        offsets = np.cumsum(sizes) - sizes
        parts = 1 + max(r[0] for r in self.rows)
        base = np.zeros(parts, dtype=np.int64)
        for (part, first, *_), at in zip(self.rows, offsets, strict=True):
            base[part] = at - first
        return ids, indptr, base

    def near(self, indptr: np.ndarray, base: np.ndarray, parts: int) -> np.ndarray:
        nbr = np.empty(int(indptr[-1]), dtype=np.int32)
        at = 0
        for row in self.rows:
            numbers = np.frombuffer(row[4], dtype=np.int32)
            nbr[at : at + len(numbers)] = base[numbers % parts] + numbers // parts
            at += len(numbers)
        return nbr

    def extra(self, i: int) -> np.ndarray:
        return np.concatenate([np.frombuffer(r[5 + i], dtype=np.int32) for r in self.rows])


def _per_graph(keys: Sequence[str], extra: Sequence[str], solve):
    """Packed lists, sorted by key and place, become what ``solve(key, kinds, lists)`` yields; one graph is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, last, kinds = _Lists(), None, []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in keys]
            columns = [batch.column(c) for c in [*keys, "_part", "_at", "ids", "degrees", *_packed(extra)]]
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in columns]
                key = tuple(row[: len(keys)])
                if lists.rows and key != last:
                    yield from solve(last, kinds, lists)
                    lists = _Lists()
                last = key
                lists.rows.append(tuple(row[len(keys) :]))
        if lists.rows:
            yield from solve(last, kinds, lists)

    return run


def _peeled(keys: Sequence[str], parts: int):
    """``solve`` for ``_per_graph``: rows ``keys, u, core``."""

    def solve(key: tuple, kinds: list, lists: _Lists) -> Iterator[pa.RecordBatch]:
        ids, indptr, base = lists.graph()
        core = peel(indptr, lists.near(indptr, base, parts))
        columns = {c: pa.array(np.full(len(ids), k), t) for c, k, t in zip(keys, key, kinds, strict=True)}
        yield from batches_of(columns | {"u": pa.array(ids), "core": pa.array(core)})

    return solve


def _window(indptr: np.ndarray, nbr: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbour lists of the rows ``inside``."""
    before = np.zeros(len(nbr) + 1, dtype=np.int64)
    np.cumsum(inside, out=before[1:])
    return before[indptr], nbr[inside]


def _peeled_windows(keys: Sequence[str], parts: int, share: int, enclosed: int | None):
    """``solve`` for ``_per_graph`` whose last key says which ``share`` windows to do: rows ``window, u, core``.

    With ``enclosed`` (a number of windows, from 0) the pairs that all of them hold and the pairs of any are peeled first: where both agree
    on a vertex, it has that core number in every window.
    """

    def solve(key: tuple, kinds: list, lists: _Lists) -> Iterator[pa.RecordBatch]:
        ids, indptr, base = lists.graph()
        nbr, first, end = lists.near(indptr, base, parts), lists.extra(0), lists.extra(1)
        lists.rows = []
        low = key[-1] * share
        known = None
        if enclosed is not None:
            least = peel(*_window(indptr, nbr, (first <= 0) & (end >= enclosed)))
            known = np.where((least > 0) & (least == peel(indptr, nbr)), least, -1)
        for window in range(low, min(low + share, int(end.max()))):
            starts, near = _window(indptr, nbr, (first <= window) & (end > window))
            there = np.diff(starts) > 0
            if not there.any():
                continue
            core = peel(starts, near, known)
            yield from batches_of({"window": pa.array(np.full(int(there.sum()), window, dtype=np.int32)), "u": pa.array(ids[there]), "core": pa.array(core[there])})

    return solve


def fits(both: DataFrame, keys: Sequence[str]) -> bool:
    """Whether ids are numbers that arrays hold."""
    kinds = {f.name: f.dataType for f in both.schema.fields}
    return all(isinstance(kinds[c], T.LongType) for c in ("u", "v")) and all(isinstance(kinds[c], T.LongType | T.IntegerType) for c in keys)


def no_hub(both: DataFrame, keys: Sequence[str], rows: int) -> bool:
    """Whether a packing task can hold the neighbours of any vertex, in graphs of at most ``rows`` rows each."""
    if rows <= HELD_ROWS:
        return True
    return (both.groupBy(*keys, "u").count().agg(F.max("count")).first()[0] or 0) <= HUB_ROWS


def one_task_holds(both: DataFrame, rows: int) -> bool:
    """Whether a graph of ``rows`` adjacency rows is small enough, and has no hub that a packing task could not hold, nor null ids."""
    return rows <= PEEL_ROWS and not both.where("u is null").limit(1).count() and no_hub(both, [], rows)


def packed_lists(both: DataFrame, keys: Sequence[str], rows: int, extra: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """Both directions of graphs as packed lists, written, and the number of parts that number their vertices.

    ``extra`` are whole numbers of four bytes that belong to the rows.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType for f in both.schema.fields}
    with loop_settings(both.sparkSession, rows) as parts:
        head = [T.StructField(c, kinds[c]) for c in keys]
        also = [T.StructField(c, T.IntegerType()) for c in extra]
        numbered = T.StructType([*head, T.StructField("u", T.LongType()), *also, T.StructField("_id", T.IntegerType())])
        listed = T.StructType([
            *head, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.IntegerType()),
            *(T.StructField(c, T.BinaryType()) for c in ("ids", "degrees", *_packed(extra))),
        ])
        placed = both.select(*keys, "u", "v", *(F.col(c).cast("int").alias(c) for c in extra)).repartition(parts, *keys, "v").withColumn("_part", F.spark_partition_id())
        known = placed.mapInArrow(_numbered(keys, parts, extra), numbered)
        own = known.repartition(parts, *keys, "u").withColumn("_part", F.spark_partition_id())
        with arrow_batches(both.sparkSession, CHUNK // 8):
            lists, _ = materialise(own.mapInArrow(_listed(keys, extra), listed))
    return lists, parts


def peeled_core_numbers(both: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Core numbers ``(keys..., u, core)``, written, from both directions ``keys, u, v`` of graphs of at most ``PEEL_ROWS`` rows each."""
    keys = list(keys)
    spark = both.sparkSession
    kinds = {f.name: f.dataType for f in both.schema.fields}
    lists, parts = packed_lists(both, keys, rows)
    out = T.StructType([*(T.StructField(c, kinds[c]) for c in keys), T.StructField("u", T.LongType()), T.StructField("core", T.IntegerType())])
    tasks = SPREAD * spark.sparkContext.defaultParallelism if keys else 1
    with loop_settings(spark, rows), arrow_batches(spark, LISTS):
        placed = lists.repartition(tasks, *keys) if keys else lists.repartition(1)
        found, _ = materialise(placed.sortWithinPartitions(*keys, "_part", "_at").mapInArrow(_per_graph(keys, (), _peeled(keys, parts)), out))
    discard(lists)
    return found


def peeled_windows(both: DataFrame, keys: Sequence[str], rows: int, windows: Column, share: int, enclosed: int | None = None) -> DataFrame:
    """Core numbers of many windows, ``(window, u, core)``, written, from both directions ``keys, u, v, first, end``.

    A row is in the windows ``[first, end)``; those of a key are in the range ``windows``, an array of the first and the last one.
    A graph of at most ``WINDOW_ROWS`` rows is held whole and ``share`` of its windows are peeled from it, one after the other.
    """
    spark = both.sparkSession
    keys = list(keys)
    lists, parts = packed_lists(both, keys, rows, ("first", "end"))
    shares = (F.floor(windows[i] / F.lit(share)).cast("int") for i in (0, 1))
    dealt = lists.withColumn("_share", F.explode(F.sequence(*shares)))
    keys = [*keys, "_share"]
    tasks = SPREAD * spark.sparkContext.defaultParallelism
    solve = _peeled_windows(keys, parts, share, enclosed)
    with loop_settings(spark, rows), arrow_batches(spark, LISTS):
        placed = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys, "_part", "_at")
        found, _ = materialise(placed.mapInArrow(_per_graph(keys, ("first", "end"), solve), "window int, u long, core int"))
    discard(lists)
    return found


def _packed_values(names: Sequence[str]):
    """Rows ``u`` and whole numbers become packed columns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ["u", *names]]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in packed], names=["ids", *names])

    return pack


def in_one_task(both: DataFrame, rows: int, values: DataFrame, solve, out: T.StructType | str, extra: Sequence[str] = ()) -> DataFrame:
    """What ``solve(ids, indptr, nbr, values, apart, *extra)`` yields as record batches ``out`` for a whole graph in one task, written.

    ``values`` has a row ``u`` for vertices, with further whole numbers; ``solve`` gets them as arrays in the order of ``ids``, -1
    where a vertex has none, and those of vertices without an edge ``apart``, with their ``u``.
    """
    spark = both.sparkSession
    names = [c for c in values.columns if c != "u"]
    lists, parts = packed_lists(both, [], rows, extra)
    places = ["_part", "_at", "ids", "degrees", *_packed(extra)]
    kinds = [T.StructField(c, T.BinaryType()) for c in ["ids", *names]]
    with loop_settings(spark, rows), arrow_batches(spark, CHUNK // 8):
        packed, _ = materialise(values.mapInArrow(_packed_values(names), T.StructType(kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, known = _Lists(), []
        for batch in batches:
            for row in batch.to_pylist():
                if row["_part"] is None:
                    known.append([np.frombuffer(row[c], dtype=np.int64) for c in ["ids", *names]])
                else:
                    whole.rows.append(tuple(row[c] for c in places))
        ids, nbr, indptr, beside = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64), [np.empty(0, dtype=np.int32) for _ in extra]
        if whole.rows:
            whole.rows.sort(key=lambda r: r[:2])
            ids, indptr, base = whole.graph()
            nbr, beside = whole.near(indptr, base, parts), [whole.extra(i) for i in range(len(extra))]
            whole.rows = []
        found = {c: np.full(len(ids), -1, dtype=np.int64) for c in names}
        apart = {c: [np.empty(0, dtype=np.int64)] for c in ["u", *names]}
        order = np.argsort(ids)
        for given, *columns in known:
            at = np.minimum(np.searchsorted(ids, given, sorter=order), len(ids) - 1)
            place = order[at] if len(ids) else at
            match = ids[place] == given if len(ids) else np.zeros(len(given), dtype=bool)
            apart["u"].append(given[~match])
            for c, column in zip(names, columns, strict=True):
                found[c][place[match]] = column[match]
                apart[c].append(column[~match])
        yield from solve(ids, indptr, nbr, found, {c: np.concatenate(v) for c, v in apart.items()}, *beside)

    with arrow_batches(spark, LISTS):
        blank = [F.lit(None).cast("binary").alias(c) for c in names]
        no_list = [F.lit(None).cast("int" if c in ("_part", "_at") else "binary").alias(c) if c != "ids" else F.col(c) for c in places]
        rows_of = lists.select(*places, *blank)
        values_of = packed.select(*no_list, *names)
        result, _ = materialise(rows_of.union(values_of).repartition(1).mapInArrow(run, out))
    discard(lists, packed)
    return result


def batches_of(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=CHUNK)


def supported_vertices(both: DataFrame, rows: int, core: DataFrame) -> DataFrame:
    """``supported`` of a graph that one task holds: ``(u, core)``, written."""

    def solve(ids, indptr, nbr, values, apart):
        inside = supported(indptr, nbr, values["core"])
        yield from batches_of({"u": pa.array(ids[inside]), "core": pa.array(values["core"][inside].astype(np.int32))})

    out = T.StructType([T.StructField("u", T.LongType()), T.StructField("core", T.IntegerType())])
    return in_one_task(both, rows, core.select("u", "core"), solve, out)


# --- a batch worked on from its ends ------------------------------------------


def _met(rows: np.ndarray, indptr: np.ndarray, nbr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The adjacency rows of the vertices ``rows``: owners and neighbours."""
    counts = indptr[rows + 1] - indptr[rows]
    return np.repeat(rows, counts), nbr[ranges(indptr[rows], counts)]


def h_indexes(owner: np.ndarray, level: np.ndarray, n: int) -> np.ndarray:
    """Per vertex the largest h with at least h rows of ``level`` h or more."""
    order = np.lexsort((-level, owner))
    owner, level = owner[order], level[order]
    place = np.arange(len(owner))
    fresh = np.ones(len(owner), dtype=bool)
    fresh[1:] = owner[1:] != owner[:-1]
    place = place - np.maximum.accumulate(np.where(fresh, place, 0)) + 1
    h = np.zeros(n, dtype=np.int64)
    np.maximum.at(h, owner, np.minimum(level, place))
    return h


def lower_from(dirty: np.ndarray, core: np.ndarray, indptr: np.ndarray, nbr: np.ndarray, steps: list[tuple[str, int, int]]) -> None:
    """Lower ``core`` to values that hold, from the vertices ``dirty`` and then whoever counted one that fell."""
    while len(dirty):
        owner, near = _met(dirty, indptr, nbr)
        steps.append(("lower", len(dirty), len(near)))
        reach = h_indexes(owner, np.minimum(core[owner], core[near]), len(core))[dirty]
        fell = reach < core[dirty]
        gone, old = dirty[fell], core[dirty[fell]]
        core[gone] = reach[fell]
        counts = indptr[gone + 1] - indptr[gone]
        owner, near = _met(gone, indptr, nbr)
        dirty = np.unique(near[(core[near] <= np.repeat(old, counts)) & (core[near] > core[owner])])


def raise_from(seeds: np.ndarray, core: np.ndarray, indptr: np.ndarray, nbr: np.ndarray, steps: list[tuple[str, int, int]]) -> None:
    """Raise ``core`` by one level a pass: who may rise is reached from ``seeds`` through equals that may."""
    n = len(core)
    while len(seeds):
        support, able, visited = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        front = seeds
        while len(front):
            owner, near = _met(front, indptr, nbr)
            steps.append(("raise", len(front), len(near)))
            visited[front] = True
            support += np.bincount(owner[core[near] > core[owner]], minlength=n)
            held = np.bincount(owner[core[near] >= core[owner]], minlength=n)
            able[front] = held[front] > core[front]
            further = near[able[owner] & (core[near] == core[owner])]
            front = np.unique(further[~visited[further]])
        alive = np.flatnonzero(able)
        owner, near = _met(alive, indptr, nbr)
        equal = able[near] & (core[near] == core[owner])
        owner, near = owner[equal], near[equal]
        while len(alive):
            stays = able[near]
            held = np.bincount(owner[stays], minlength=n)
            keeps = support[alive] + held[alive] > core[alive]
            if keeps.all():
                break
            able[alive[~keeps]] = False
            alive = alive[keeps]
        if not len(alive):
            return
        owner, near = _met(alive, indptr, nbr)
        beside = near[(core[near] == core[owner]) | (core[near] == core[owner] + 1)]
        core[alive] += 1
        seeds = np.unique(np.concatenate([alive, beside]))


def slide_in_one_task(both: DataFrame, rows: int, values: DataFrame, out: bool, into: bool) -> DataFrame:
    """What a batch changes in the core numbers of a graph that one task holds, written: rows ``step, u, old, core``.

    ``both`` is the graph after the batch, ``u, v, entered``; ``values`` the core numbers before it, ``u, core, left``, where 1 marks
    the ends of what entered or left. Rows with a ``step`` have its place, the vertices visited and the adjacency rows looked at instead.
    """

    def solve(ids, indptr, nbr, values, apart, entered):
        before = np.maximum(values["core"], 0)
        core, steps = before.copy(), []
        if out:
            lower_from(np.flatnonzero(values["left"] == 1), core, indptr, nbr, steps)
            bare = int((apart["left"] == 1).sum())  # they have no edge any more
            if bare:
                steps[:1] = [("lower", bare + (steps[0][1] if steps else 0), steps[0][2] if steps else 0)]
        if into:
            new = np.flatnonzero(entered)
            owner = np.searchsorted(indptr, new, side="right") - 1
            raise_from(np.unique(owner[core[owner] <= core[nbr[new]]]), core, indptr, nbr, steps)
        moved = np.flatnonzero(core != before)
        lost = (apart["left"] == 1) & (apart["core"] > 0)
        if moved.size + lost.sum():
            yield from batches_of({
                "step": pa.nulls(int(moved.size + lost.sum()), pa.string()), "u": pa.array(np.concatenate([ids[moved], apart["u"][lost]])),
                "old": pa.array(np.concatenate([before[moved], apart["core"][lost]])), "core": pa.array(np.concatenate([core[moved], np.zeros(int(lost.sum()), dtype=np.int64)])),
            })
        if steps:
            kind, visited, traversed = zip(*steps, strict=True)
            yield from batches_of({
                "step": pa.array(kind), "u": pa.array(np.arange(len(steps))), "old": pa.array(visited, pa.int64()), "core": pa.array(traversed, pa.int64()),
            })

    return in_one_task(both, rows, values, solve, "step string, u long, old long, core long", ["entered"])
