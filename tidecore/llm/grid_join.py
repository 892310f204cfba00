"""Near-duplicate core profiles by an epsilon grid order join.

Profiles are scaled to length one, where a cosine of at least c is a distance
of at most eps = sqrt(2 - 2c). They are turned onto principal axes and sorted by the cells
of a grid of width eps on the leading axes. Intervals of that sequence, with the box
that holds their vectors, form a tree. Pairs of intervals are joined from the top
down, and a pair whose boxes lie further apart than eps is never opened. The
same goes on inside a pair of leaves, down to short intervals that are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecore.llm.vectors import matrix, principal_axes, proper, sample
from tidecore.operators.components import components
from tidecore.plans.fixpoint import discard, materialise

# Leading axes with a grid and a box; vectors of a leaf and of a shortest interval.
AXES, LEAF, SHORT = 8, 4096, 256
# Children of an interval: 2 ** FAN.
FAN = 3
# Slack of the single precision filter before the exact test.
SLACK = 1e-4


def near_profiles(profiles: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Group core profiles that point in nearly the same direction.

    ``profiles``: ``u`` (bigint) and ``profile`` (array of numbers), other columns
    are ignored. One row per input row: ``u``, ``n_links`` (other rows with a cosine
    of at least ``cosine``, in double precision), ``component`` (the smallest ``u`` reachable by
    links, its own included) and ``kept`` (``u`` is that component).

    Profiles that are null, all zero, hold null or non-finite numbers, or differ in
    length from most, link with nothing. Equal profiles link, whatever their ``u``;
    they are compared once. A null ``u`` takes part and never names a component
    that has another member. An empty table gives an empty result. The principal axes
    come from a bounded sample; they decide the order of the work, not the result.
    """
    ok, width = proper(profiles)
    prints = [F.xxhash64("profile").alias("p"), F.xxhash64(F.lit(1), "profile").alias("q")]
    named = ok.select("u", "profile", *prints)
    classes = named.groupBy("p", "q").agg(F.min("u").alias("u"), F.count(F.lit(1)).alias("copies"), F.min("profile").alias("profile"))
    mean, axes = principal_axes(_unit(sample(ok, width))) if width else (None, np.zeros((0, 0)))
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    leaves, _ = materialise(_leaves(classes, axes, eps, width, named.count()))
    pairs = _leaf_pairs(leaves, eps)
    found, _ = materialise(_join_leaves(leaves, pairs, axes, cosine, eps, width))
    labels = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    nodes = leaves.select(F.explode("members").alias("m")).select("m.*")
    labelled = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = labelled.groupBy("label").agg(F.min("u").alias("component"))
    by_class = (
        labelled.join(names, "label").join(counts, "node", "left")
        .select("p", "q", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    every = profiles.select("u", F.col("profile").cast("array<double>").alias("profile")).select("u", *prints)
    return every.join(by_class, ["p", "q"], "left").select(
        "u",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "u").alias("component"),
        (F.col("u") == F.coalesce("component", "u")).alias("kept"),
    )


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, initial=0)[:, None]  # first by the largest, so that no square overflows
    x = x / np.where(big > 0, big, 1)
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]


_BOX = ", ".join(f"lo{i} double, hi{i} double" for i in range(AXES))
_LEAF = f"seq long, members array<struct<node: long, p: long, q: long, u: long, copies: long>>, body binary, {_BOX}"


def _leaves(classes: DataFrame, axes: np.ndarray, eps: float, width: int, n: int) -> DataFrame:
    """The sequence in grid order, cut into leaves with their boxes."""
    lead = min(AXES, width)
    cell = eps or 1e-9
    full = -(-n // LEAF)
    serial_bits = full.bit_length()

    def place(batches):
        for batch in batches:
            z = _unit(matrix(batch["profile"], width)) @ axes[:, :lead]
            grid = np.floor(z / cell).astype(np.int64)
            # one sortable key: cells axis by axis, offset to be positive, 8 bits each
            key = np.zeros(len(z), np.int64)
            for i in range(min(lead, 7)):
                key = (key << 8) | np.clip(grid[:, i] + 128, 0, 255)
            yield pa.record_batch([batch[c] for c in ("p", "q", "u", "copies", "profile")] + [pa.array(key)], names=["p", "q", "u", "copies", "profile", "cell"])

    def cut(batches):
        from pyspark import TaskContext

        part, serial, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            i = 0
            while i < len(batch):
                take = min(len(batch) - i, LEAF - size)
                held.append(batch.slice(i, take))
                i, size = i + take, size + take
                if size == LEAF:
                    yield leaf(pa.Table.from_batches(held), (part << serial_bits) + serial)
                    held, size, serial = [], 0, serial + 1
        if held and size:
            yield leaf(pa.Table.from_batches(held), (part << serial_bits) + serial)

    def leaf(rows: pa.Table, seq: int) -> pa.RecordBatch:
        x = matrix(rows["profile"].combine_chunks(), width)
        z = _unit(x) @ axes[:, :lead]
        members = pa.StructArray.from_arrays(
            [pa.array(seq * LEAF + np.arange(len(rows))), *(rows[c].combine_chunks() for c in ("p", "q", "u", "copies"))],
            ["node", "p", "q", "u", "copies"],
        )
        box = []
        for i in range(AXES):
            box += [z[:, i].min() if i < lead else 0.0, z[:, i].max() if i < lead else 0.0]
        lists = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), members)
        names = ["seq", "members", "body"] + [f"{e}{i}" for i in range(AXES) for e in ("lo", "hi")]
        return pa.record_batch([pa.array([seq]), lists, pa.array([x.tobytes()], pa.binary()), *(pa.array([float(v)]) for v in box)], names=names)

    keyed = classes.select("p", "q", "u", "copies", "profile").mapInArrow(place, "p long, q long, u long, copies long, profile array<double>, cell long")
    ordered = keyed.repartitionByRange(max(1, full), "cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    return ordered.mapInArrow(cut, _LEAF)


def _leaf_pairs(leaves: DataFrame, eps: float) -> DataFrame:
    """Pairs of leaves whose boxes come within eps, found from the root of the tree down."""
    boxes = [f"{e}{i}" for i in range(AXES) for e in ("lo", "hi")]
    low = leaves.select("seq", *boxes)
    top = low.agg(F.max("seq")).first()[0]
    depth = 0 if top is None else -(-int(top).bit_length() // FAN)

    def level(k: int) -> DataFrame:
        at = F.shiftright("seq", FAN * k)
        return low.groupBy(at.alias("id")).agg(*(F.min(f"lo{i}").alias(f"lo{i}") for i in range(AXES)), *(F.max(f"hi{i}").alias(f"hi{i}") for i in range(AXES)))

    pairs = level(depth).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for k in range(depth - 1, -1, -1):
        own = level(k)
        a = own.select(*(F.col(c).alias(f"a_{c}") for c in own.columns)).withColumn("a", F.shiftright("a_id", FAN))
        b = own.select(*(F.col(c).alias(f"b_{c}") for c in own.columns)).withColumn("b", F.shiftright("b_id", FAN))
        gap = sum((F.pow(F.greatest(F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.lit(0.0)), 2) for i in range(AXES)), F.lit(0.0))
        grown = pairs.join(a, "a").join(b, "b").where("a_id <= b_id").where(gap <= eps * eps + 1e-9)
        pairs, _ = materialise(grown.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
    return pairs


def _join_leaves(leaves: DataFrame, pairs: DataFrame, axes: np.ndarray, cosine: float, eps: float, width: int) -> DataFrame:
    """Counts and spanning links of every pair of leaves; a task holds one leaf and streams its partners."""
    swap = (F.col("a") + F.col("b")) % 2 == 1  # spreads the pairs over both ends
    turned = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("hold"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("seq"))
    turned = turned.withColumn("lot", F.col("seq") % 8)
    data = leaves.select("seq", F.transform("members", lambda m: m["copies"]).alias("copies"), "body")
    guests = turned.join(data, "seq").select("hold", "lot", F.lit(1).alias("guest"), "seq", "copies", "body")
    hosts = turned.select("hold", "lot").distinct().join(data.withColumnRenamed("seq", "hold"), "hold").select("hold", "lot", F.lit(0).alias("guest"), F.col("hold").alias("seq"), "copies", "body")
    parts = max(1, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flow = hosts.union(guests).repartition(parts, "hold", "lot").sortWithinPartitions("hold", "lot", "guest", "seq")

    def run(batches):
        host = None
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                seq = row["seq"][0].as_py()
                x = np.frombuffer(row["body"][0].as_py(), np.float64).reshape(-1, width)
                copies = np.asarray(row["copies"].flatten(), np.int64)
                side = (seq, _unit(x), copies)
                if row["guest"][0].as_py() == 0:
                    host = side
                else:
                    yield from _compare(host, side, axes, cosine, eps)

    return flow.mapInArrow(run, "node long, other long, links long")


def _compare(one, two, axes, cosine: float, eps: float):
    same = one[0] == two[0]
    (s, x, cx), (t, y, cy) = one, two
    base_x, base_y = s * LEAF, t * LEAF
    lead = min(AXES, x.shape[1])
    zx, zy = x @ axes[:, :lead], y @ axes[:, :lead]
    fx, fy = x.astype(np.float32), y.astype(np.float32)
    left, right = [], []

    def box(z, a, b):
        return z[a:b].min(0), z[a:b].max(0)

    def join(a, b, c, d):
        """Pairs between x[a:b] and y[c:d], by halving the longer interval."""
        if same and c >= b or not same or a < d:
            (lo, hi), (lo2, hi2) = box(zx, a, b), box(zy, c, d)
            gap = np.maximum(np.maximum(lo - hi2, lo2 - hi), 0)
            if (gap * gap).sum() > eps * eps + 1e-9:
                return
        if b - a <= SHORT and d - c <= SHORT:
            i, j = np.nonzero(fx[a:b] @ fy[c:d].T >= cosine - SLACK)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                left.append(i), right.append(j)
            return
        if b - a >= d - c:
            m = (a + b) // 2
            halves = ((a, m, c, d), (m, b, c, d))
        else:
            m = (c + d) // 2
            halves = ((a, b, c, m), (a, b, m, d))
        for p, q, r, w in halves:
            if not same or p < w:
                join(p, q, r, w)

    join(0, len(x), 0, len(y))
    if not left:
        return
    i, j = np.concatenate(left), np.concatenate(right)
    exact = np.empty(len(i))
    for k in range(0, len(i), 1 << 15):
        exact[k : k + (1 << 15)] = np.einsum("ij,ij->i", x[i[k : k + (1 << 15)]], y[j[k : k + (1 << 15)]])
    ok = exact >= cosine
    i, j = i[ok], j[ok]
    if not len(i):
        return
    offset = 0 if same else len(x)
    count = np.bincount(i, cy[j], minlength=offset + len(y)) + np.bincount(j + offset, cx[i], minlength=offset + len(y))
    label = _labels(i, j + offset, offset + len(y))
    name = np.arange(len(label)) + (base_x if same else 0)
    if not same:
        name = np.concatenate([base_x + np.arange(len(x)), base_y + np.arange(len(y))])
    linked, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(label)))
    node = np.concatenate([name[linked], name[tied]])
    other = pa.array([None] * len(linked) + name[label[tied]].tolist(), pa.int64())
    links = np.concatenate([count[linked].astype(np.int64), np.zeros(len(tied), np.int64)])
    yield pa.record_batch([pa.array(node, pa.int64()), other, pa.array(links)], names=["node", "other", "links"])


def _labels(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex connected to each of ``n`` by the pairs ``(i, j)``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
