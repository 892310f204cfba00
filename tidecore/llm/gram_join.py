"""N-gram Jaccard join of contact histories, by set-relation skipping.

A history is the sequence of contacts of one vertex in time order. Its set
holds the hashes of its distinct n-grams, and two histories link when the
Jaccard similarity of their sets reaches a threshold.

The job, step by step:

1. Histories become gram sets in blocks of bounded size. Equal sets of a block
   are kept once, and a gram that repeats inside a block is sent once, so a hot
   history or gram costs one row per block.
2. Grams are counted in hash ranges. What returns to a block are only the grams
   that occur more than once, with a rarity class: grams in ordering (class,
   hash) start with those that nothing else has. A set that cannot reach the
   threshold with its repeated grams alone drops out here.
3. The prefix filter gives an index: gram -> (set, size, position). Sets that
   reach each other over the index are put into blocks of similar size; index
   lists are then joined block against block, and a pair of blocks is skipped
   when sizes or positions rule the threshold out.
4. Inside a pair of blocks, exact overlaps are counted over the index lists. The
   sets are visited so that similar ones follow each other, and the counts of a
   set are derived from those of its predecessor over the grams in which the two
   differ. Only a spanning forest of the links and their number per set leave a
   task, so a group of copies never becomes a table of pairs.
5. Connected components of the forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.llm import hashing as H
from tidecore.llm.memory import lean, lean_group
from tidecore.operators.components import components
from tidecore.plans.fixpoint import discard, materialise

# Words in one block of histories, and grams in one hash range (both only shape tasks).
BLOCK_WORDS = 400_000
RANGE_GRAMS = 1 << 19
# Sets in one block of the join.
JOIN_BLOCK = 256
# Rounds in which sets learn the anchor of the sets they share grams with.
ANCHOR_ROUNDS = 3
U = np.uint64


def contact_histories(edges: DataFrame) -> DataFrame:
    """``(src, dst, ts)`` to ``(u, contacts)``: the contacts of a vertex, ordered by ``(ts, dst)``."""
    return edges.groupBy(F.col("src").alias("u")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts", "dst"))), lambda c: c["dst"]).alias("contacts")
    )


def contact_gram_join(histories: DataFrame, n: int = 5, similarity: tuple[int, int] = (3, 4)) -> DataFrame:
    """Link contact histories with similar n-gram sets.

    ``histories``: ``u`` and ``contacts`` (array of strings or integers), one
    row per history; other columns are ignored whatever their names. The result
    has one row per input row: ``u``, ``n_grams`` (size of its set), ``component``
    (the smallest ``u`` reachable by links, its own included) and ``links`` (how
    many other histories link to it directly).

    Null and empty contacts are left out. Fewer than ``n`` contacts form one gram;
    a history without contacts, or null, has an empty set and links with nothing.
    Rows with the same ``u`` are histories of their own; a null ``u`` takes part
    but names a component only when no other member has a name. Equal sets always
    link. ``similarity`` is the threshold as a fraction. An empty table gives an
    empty result. Grams are compared by 64-bit hashes.
    """
    num, den = similarity
    if not 0 < num <= den:
        raise ValueError("similarity must lie in (0, 1]")
    sets = _gram_table(histories.select("u", "contacts"), n, num, den)
    nodes = (
        sets.where("node is not null")
        .groupBy("node")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("u").alias("u"),
            F.max("n_grams").alias("n"),
            F.max("grams").alias("grams"),
        )
    )
    nodes, _ = materialise(nodes)
    pairs = _block_pairs(nodes.where("grams is not null"), num, den)
    found, _ = materialise(_join_blocks(pairs, num, den))
    discard(pairs)
    labels = components(found.where("kind = 1").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.where("kind = 0").groupBy("node").agg(F.sum("links").alias("links"))
    labelled = nodes.select("node", "u", "copies").join(labels, "node", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "node"))
    names = labelled.groupBy("label").agg(F.min("u").alias("component"))
    by_node = (
        labelled.join(names, "label")
        .join(counts, "node", "left")
        .select(
            "node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")
        )
    )
    return sets.select("u", "n_grams", "node").join(by_node, "node", "left").select(
        "u", "n_grams", F.coalesce("component", "u").alias("component"), F.coalesce("links", F.lit(0)).alias("links")
    )


# --- sets ------------------------------------------------------------------

_SENT = "key long, block long, ids binary, body binary"


def _gram_table(histories: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """``u, n_grams, node, grams``: grams (bytes) only where a set may have a partner."""
    size = histories.agg(F.sum(F.size("contacts").cast("long"))).first()[0] or 0
    bits = max(5, (max(size, 1) // RANGE_GRAMS).bit_length())
    kind = histories.schema["u"].dataType
    sent = histories.mapInArrow(lean(lambda batches: _send(batches, n, bits)), _SENT)
    back = sent.groupBy("key").applyInArrow(lean_group(_count_range), _SENT)
    out = T.StructType(
        [
            T.StructField("u", kind),
            T.StructField("n_grams", T.LongType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("grams", T.BinaryType()),
        ]
    )
    sets, _ = materialise(back.groupBy("block").applyInArrow(lean_group(lambda t: _settle(t, num, den)), out))
    return sets


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays)] + [x.nbytes for x in arrays], np.int64)
    return b"".join([head.tobytes(), *(x.tobytes() for x in arrays)])


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    count = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, count, 8)
    ends = 8 * (1 + count) + np.cumsum(sizes)
    return [np.frombuffer(body, k, int(z) // np.dtype(k).itemsize, int(e - z)) for k, z, e in zip(kinds, sizes, ends, strict=True)]


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each value, byte planes one after the other."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).ravel()


def _values(planes: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(planes) // width, 8), np.uint8)
    out[:, :width] = planes.reshape(width, -1).T
    return out.view("<u8").ravel()


def _ipc(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("u", column.type)])) as writer:
        writer.write_batch(pa.record_batch([column], names=["u"]))
    return sink.getvalue().to_pybytes()


def _send(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, serial = TaskContext.get().partitionId(), 0
    for batch in batches:
        words = np.asarray(pc.list_value_length(batch["contacts"]).fill_null(0), np.int64)
        ends = np.cumsum(words)
        i = 0
        while i < len(words):
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_WORDS, "right"))
            j = min(max(i + 1, j), i + 65_535, len(words))
            yield from _send_block(batch.slice(i, j - i), (part << 31) + serial, n, bits)
            serial += 1
            i = j


def _send_block(batch: pa.RecordBatch, block: int, n: int, bits: int) -> Iterator[pa.RecordBatch]:
    """One row per hash range with the block's grams, one with what the block needs to go on."""
    h, _, counts = H.list_words(batch["contacts"])
    grams, sizes = H.gram_sets(h, counts, n)
    prints = H.set_prints(grams, sizes)
    _, first, of = np.unique(prints, axis=0, return_index=True, return_inverse=True) if len(prints) else (0, np.zeros(0, int), np.zeros(0, int))
    keep = np.zeros(len(sizes), bool)
    keep[first] = True
    owner = np.repeat(np.arange(len(sizes)), sizes)
    use = keep[owner]
    grams, owner = grams[use], owner[use]
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    head = np.ones(len(grams), bool)
    head[1:] = grams[1:] != grams[:-1]
    at = np.flatnonzero(head)
    times = np.diff(np.append(at, len(grams)))
    shift = U(64 - bits)
    many = at[times > 1]
    many_owner = owner[np.repeat(times > 1, times)]
    single, s_owner = grams[at[times == 1]], owner[at[times == 1]]
    s_cut = np.searchsorted(single >> shift, np.arange((1 << bits) + 1, dtype=U))
    m_cut = np.searchsorted(grams[many] >> shift, np.arange((1 << bits) + 1, dtype=U))
    m_times = times[times > 1]
    keys, bodies = [-1 - block], [_pack(sizes, prints.ravel(), of.astype(np.int64), first.astype(np.int64), grams[many], m_times, many_owner.astype(np.uint16))]
    for k in range(1 << bits):
        s, m = slice(*s_cut[k : k + 2]), slice(*m_cut[k : k + 2])
        if s.stop > s.start or m.stop > m.start:
            by = np.lexsort((single[s], s_owner[s]))
            step = np.diff(s_owner[s][by], prepend=0)
            keys.append(k)
            bodies.append(_pack(np.array([bits]), _planes(single[s][by], 8 - bits // 8), _planes(step, 2), _planes(grams[many[m]], 8 - bits // 8), np.minimum(m_times[m], 65_535).astype(np.uint16)))
    for i in range(0, len(keys), 64):
        part = keys[i : i + 64]
        ids = [_ipc(batch["u"]) if k < 0 else None for k in part]
        yield pa.record_batch([pa.array(part, pa.int64()), pa.array([block] * len(part), pa.int64()), pa.array(ids, pa.binary()), pa.array(bodies[i : i + 64], pa.binary())], names=["key", "block", "ids", "body"])


def _rarity(times: np.ndarray) -> np.ndarray:
    """A class per count: exact up to 16, then eight for each doubling."""
    fine = 16 + np.floor(8 * np.log2(np.maximum(times, 16) / 16))
    return np.where(times <= 16, times, np.minimum(fine, 255)).astype(np.uint8)


def _count_range(table: pa.Table) -> pa.Table:
    """Count the grams of one hash range; give each block back its repeated ones."""
    key = table["key"][0].as_py()
    if key < 0:
        return table
    top, per = None, []
    for body in table["body"]:
        bits, s, step, m, times = _unpack(body.as_py(), np.int64, np.uint8, np.uint8, np.uint8, np.uint16)
        bits = int(bits[0])
        width = 8 - bits // 8
        top = U(key) << U(64 - bits)
        mask = U((1 << (8 * width)) - 1)
        per.append([(_values(s, width) & mask) | top, np.cumsum(_values(step, 2)), (_values(m, width) & mask) | top, times])
    every = np.concatenate([x for p in per for x in (p[0], p[2])])
    weight = np.concatenate([x for p in per for x in (np.ones(len(p[0]), np.int64), p[3].astype(np.int64))])
    order = np.argsort(every)
    grams = every[order]
    head = np.ones(len(grams), bool)
    head[1:] = grams[1:] != grams[:-1]
    at = np.flatnonzero(head)
    total = np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)
    grade = np.empty(len(grams), np.uint8)
    grade[order] = np.repeat(_rarity(total), np.diff(np.append(at, len(grams))))
    bodies, i = [], 0
    for s, own, m, _ in per:
        g, mg = grade[i : i + len(s)], grade[i + len(s) : i + len(s) + len(m)]
        i += len(s) + len(m)
        rep = g > 1
        bodies.append(_pack(s[rep], own[rep].astype(np.uint16), g[rep], m, mg))
    return pa.table({"key": table["key"], "block": table["block"], "ids": table["ids"], "body": pa.array(bodies, pa.binary())})


def _settle(table: pa.Table, num: int, den: int) -> pa.Table:
    """Put a block's sets together again: repeated grams in (rarity, hash) order."""
    keys = np.asarray(table["key"])
    grams, owners, grades, shared, shared_grade = [], [], [], [], []
    for i in np.flatnonzero(keys >= 0):
        s, own, g, m, mg = _unpack(table["body"][int(i)].as_py(), U, np.uint16, np.uint8, U, np.uint8)
        grams.append(s), owners.append(own), grades.append(g), shared.append(m), shared_grade.append(mg)
    home = int(np.flatnonzero(keys < 0)[0])
    sizes, prints, of, first, many, m_times, m_owner = _unpack(table["body"][home].as_py(), np.int64, U, np.int64, np.int64, U, np.int64, np.uint16)
    prints = prints.reshape(-1, 2)
    if len(many):
        order = np.argsort(np.concatenate(shared))
        grade = np.concatenate(shared_grade)[order]  # `many` is sorted, so this aligns
        grams.append(np.repeat(many, m_times)), owners.append(m_owner), grades.append(np.repeat(grade, m_times))
    empty = np.zeros(0, U)
    g, own = np.concatenate(grams or [empty]), np.concatenate(owners or [empty]).astype(np.int64)
    grade = np.concatenate(grades or [empty]).astype(np.uint8)
    order = np.lexsort((g, grade, own))
    g, own = g[order], own[order]
    held = np.bincount(own, minlength=len(sizes))
    ends = np.cumsum(held)
    bodies = [None] * len(sizes)
    for i in first:
        if held[i] and held[i] * den >= num * sizes[i]:
            bodies[i] = g[ends[i] - held[i] : ends[i]].tobytes()
    node = [prints[i].tobytes() if sizes[i] else None for i in range(len(sizes))]
    with pa.ipc.open_stream(table["ids"][home].as_py()) as reader:
        ids = reader.read_all()["u"]
    return pa.table({"u": ids, "n_grams": pa.array(sizes, pa.int64()), "node": pa.array(node, pa.binary()), "grams": pa.array(bodies, pa.binary())})


# --- blocks ----------------------------------------------------------------


def _prefixes(num: int, den: int):
    """Index entries of each set: its repeated grams within the prefix, with positions."""

    def run(batches):
        for batch in batches:
            size = np.asarray(batch["n"], np.int64)
            gram, row, pos = [], [], []
            for i, body in enumerate(batch["grams"]):
                g = np.frombuffer(body.as_py(), np.int64)
                alone = size[i] - len(g)
                take = max(0, int(size[i] - -(-num * size[i] // den) + 1 - alone))
                gram.append(g[:take])
                row.append(np.full(len(gram[-1]), i))
                pos.append(alone + np.arange(len(gram[-1])))
            if gram:
                at = np.concatenate(row)
                yield pa.record_batch([pa.array(np.concatenate(gram)), batch["node"].take(pa.array(at)), pa.array(size[at]), pa.array(size[at] - np.concatenate(pos))], names=["gram", "node", "n", "rest"])

    return run


def _block_pairs(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The sets of every pair of blocks (x, y) to compare: ``x, y, side, inner, node, n, copies, grams``."""
    index = nodes.select("node", "n", "grams").mapInArrow(lean(_prefixes(num, den)), "gram long, node binary, n long, rest long")
    lists = index.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram")
    index, _ = materialise(index.join(lists, "gram"))
    # anchors: the smallest set reachable over a few index lists
    anchors = index.select("node", F.col("node").alias("anchor")).distinct()
    for _ in range(ANCHOR_ROUNDS):
        low = index.join(anchors, "node").groupBy("gram").agg(F.min("anchor").alias("anchor"))
        new, _ = materialise(index.select("gram", "node").join(low, "gram").groupBy("node").agg(F.min("anchor").alias("anchor")))
        discard(anchors)
        anchors = new
    # blocks: one anchor, one class of sizes, at most about JOIN_BLOCK sets
    sized = nodes.select("node", "n", "copies", "grams").join(anchors, "node").withColumn("span", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.2))))
    cuts = sized.groupBy("anchor", "span").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(JOIN_BLOCK))).alias("cuts"))
    placed = sized.join(cuts, ["anchor", "span"]).withColumn(
        "block", F.xxhash64("anchor", "span", F.pmod(F.xxhash64("node"), F.col("cuts")))
    )
    placed, _ = materialise(placed.select("node", "n", "copies", "grams", "block"))
    # index lists of blocks; lists over the same blocks with the same bounds are one list
    heads = (
        index.join(placed.select("node", "block"), "node")
        .groupBy("gram", "block")
        .agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"))
    )
    prints = heads.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("block", "low", "high", "rest").cast("decimal(38,0)")).alias("p"))
    one = prints.where("k > 1").groupBy("k", "p").agg(F.min("gram").alias("gram")).select("gram")
    heads, _ = materialise(heads.join(one, "gram"))
    a, b = heads.alias("a"), heads.alias("b")
    need = F.lit(float(num)) / F.lit(float(num + den)) * (F.col("a.low") + F.col("b.low"))
    cross = (
        a.join(b, F.col("a.gram") == F.col("b.gram"))
        .where("a.block < b.block")
        .where((F.col("a.high") * den >= F.col("b.low") * num) & (F.col("b.high") * den >= F.col("a.low") * num))
        .where(F.least("a.rest", "b.rest") >= need - 1e-6)
        .select(F.col("a.block").alias("x"), F.col("b.block").alias("y"))
        .distinct()
    )
    inner = placed.groupBy("block").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("block").alias("x"), F.col("block").alias("y"))
    pair = cross.union(inner)
    sides = pair.select("x", "y", F.col("x").alias("block"), F.lit(0).alias("side"), (F.col("x") == F.col("y")).alias("inner")).union(
        pair.where("x <> y").select("x", "y", F.col("y").alias("block"), F.lit(1).alias("side"), F.lit(False).alias("inner"))
    )
    out, _ = materialise(sides.join(placed, "block").select("x", "y", "side", "inner", "node", "n", "copies", "grams"))
    discard(index, anchors, placed, heads)
    return out


# --- join ------------------------------------------------------------------

_FOUND = "kind int, node binary, other binary, links long"


def _join_blocks(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Links inside each pair of blocks: a spanning forest (kind 1) and counts (kind 0)."""
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartition(width, "x", "y").sortWithinPartitions("x", "y")

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            x, y = np.asarray(rest["x"]), np.asarray(rest["y"])
            cuts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            if len(cuts):
                for s, e in zip(np.append(0, cuts[:-1]), cuts, strict=True):
                    yield from _join_pair(rest.slice(s, e - s), num, den)
                rest = rest.slice(cuts[-1])
        if rest is not None and len(rest):
            yield from _join_pair(rest, num, den)

    return ordered.mapInArrow(lean(run), _FOUND)


def _join_pair(table: pa.Table, num: int, den: int):
    node = table["node"].to_pylist()
    n, copies, side = (np.asarray(table[c], np.int64) for c in ("n", "copies", "side"))
    inner = table["inner"][0].as_py()
    grams = [np.frombuffer(x, np.int64) for x in table["grams"].to_pylist()]
    links, forest = _links(grams, n, copies, side, inner, num, den)
    a = [i for i in range(len(node)) if links[i]]
    if a:
        kind = [0] * len(a) + [1] * len(forest)
        first = [node[i] for i in a] + [node[i] for i, _ in forest]
        other = [None] * len(a) + [node[j] for _, j in forest]
        count = [int(links[i]) for i in a] + [0] * len(forest)
        yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(first, pa.binary()), pa.array(other, pa.binary()), pa.array(count, pa.int64())], names=["kind", "node", "other", "links"])


def _links(grams, n, copies, side, inner, num, den):
    """Exact links of the sets of two blocks (or of one with itself).

    ``near[i]`` counts the overlap of the visited set with set ``i``. Sets are
    visited in order of their rarest grams, so that copies follow each other, and
    ``near`` is carried over: only the index lists of grams that entered or left
    are added or taken away.
    """
    k = len(grams)
    _, ids = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(k), [len(g) for g in grams])
    order = np.argsort(ids, kind="stable")
    lists, ends = row[order], np.cumsum(np.bincount(ids))
    starts = ends - np.diff(np.append(0, ends))
    cut = np.cumsum([len(g) for g in grams])
    own = [ids[e - len(g) : e] for g, e in zip(grams, cut, strict=True)]
    keys = [tuple(x[:3]) for x in own]
    visit = sorted(range(k), key=lambda i: (keys[i], i))
    links, parent, forest = np.zeros(k, np.int64), list(range(k)), []
    near, last = np.zeros(k, np.int64), np.zeros(0, np.int64)

    def gather(which):
        size = ends[which] - starts[which]
        at = np.repeat(starts[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(lists[at], minlength=k)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    here = np.zeros(len(ends), bool)
    for i in visit:
        mine = own[i]
        here[last] = True
        same = int(here[mine].sum())
        if 2 * same > len(mine) + len(last) - len(mine) // 2:
            came = mine[~here[mine]]
            here[last] = False
            here[mine] = True
            left = last[~here[last]]
            here[mine] = False
            near = near + gather(came) - gather(left)
        else:
            here[last] = False
            near = gather(mine)
        last = mine
        ok = near * den >= num * (n[i] + n - near)
        ok[i] = False
        if not inner:
            ok &= side != side[i]
        others = np.flatnonzero(ok)
        links[i] = copies[others].sum()
        for j in others:
            a, b = root(i), root(int(j))
            if a != b:
                parent[a] = b
                forest.append((i, int(j)))
    return links, forest
