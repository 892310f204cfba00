"""Ranked search of contact histories by bit-sliced Bloom signatures.

A vertex's contact history is a document whose terms are its contacts; a query is a
list of contacts, and histories are ranked by how often they hold rare ones. Histories
of about the same size stand together in blocks. A block keeps one bitmap over its rows
for every bit of their Bloom signatures, so the rows that may hold a term are the
conjunction of a few bitmaps. A term enters once for every class of frequency it
reaches (twice or more, three times or more, ...), and a row's upper bound is the
weighted sum over the terms of the most that the highest class found can bring.
The histories with the largest bounds are scored first; their k-th score excludes every
row whose bound lies below it, and all others are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.llm.hashing import U, list_words, mix
from tidecore.llm.memory import lean
from tidecore.plans.fixpoint import discard, materialise
from tidecore.session import shared_path

# Smallest frequency of each class; a term of frequency f enters the signature for all classes up to f.
CLASSES = (1, 2, 3, 4, 6, 9, 13, 20, 40, 100)
# Bits of a signature per entry, and hashes per entry: about one entry in 150 is found by mistake.
BITS, HASHES = 12, 4
# Entries and rows of one block, words sorted at a time.
BLOCK_ENTRIES, BLOCK_ROWS, STEP_WORDS = 1 << 16, 1024, 1 << 18
# Bytes of Parquet row groups of the index: rows are long.
GROUP_BYTES = 8 << 20
# Terms of queries that travel to the tasks at a time, and terms looked up in a block at a time.
QUERY_TERMS, TERM_STEP = 1 << 18, 2048
# Weights of the ranking formula, fixed values.
LENGTH_SHARE, SCALE, TF_FACTOR, M_FACTOR = 75, 1_000_000_000, 1000, 8


def rank_histories(histories: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best contact histories of every query.

    ``histories``: ``u`` (bigint) and ``contacts`` (array of strings or integers); ``queries``: ``query``
    (bigint) and ``contacts`` of the same type; other columns are ignored. A contact's weight is
    ``floor(1000 ln((2N + 2) / (2df + 1)))`` over N histories that are not empty, of which df hold it; a
    history of n entries (of L in all) that holds it tf times gains the weight times
    ``10^9 tf div (1000 tf + 8m)`` with ``m = 25 + 75 n N div L``, for every time the query names it.

    Result: ``query``, ``rank`` (from 1), ``u``, ``score``; best first, equal scores by smaller ``u``, only
    scores above 0. Null or empty contacts and lists count nowhere; rows with a null ``u`` or
    ``query`` take no part. Several rows with one ``u`` are histories of their own, several rows with one
    ``query`` are one query. Empty tables give an empty result. Exact up to collisions of 64-bit
    hashes. Query terms are worked on ``QUERY_TERMS`` at a time; the histories are
    indexed once and never shuffled.
    """
    known = histories.where("u is not null").select(F.col("u").cast("long").alias("u"), "contacts")
    asked, total = materialise(_asked(queries), n=F.count(F.lit(1)))
    index = signature_index(known)
    counts = index.agg(F.sum(F.size("u")).alias("docs"), F.sum("words").alias("words")).first()
    spark = histories.sparkSession
    results = []
    batches = max(1, -(-total["n"] // QUERY_TERMS))
    for b in range(batches):
        own = asked.where(F.pmod(F.xxhash64("query"), F.lit(batches).cast("long")) == b).orderBy("query", "term").toArrow()
        if not len(own) or not counts["docs"]:
            continue
        batch = QueryBatch(own, frequencies(known, own["term"].to_numpy()), counts["docs"], counts["words"])
        results.append(_searched(known, index, batch, k))
    if not results:
        return spark.createDataFrame([], "query long, rank int, u long, score long")
    out = results[0]
    for other in results[1:]:
        out = out.union(other)
    discard(asked)
    return out


def _asked(queries: DataFrame) -> DataFrame:
    """``query, term, times``: hashed terms of each query."""

    def run(batches):
        for batch in batches:
            h, rows, _ = list_words(batch["contacts"])
            yield pa.record_batch([batch["query"].take(pa.array(rows)), pa.array(h.view(np.int64))], names=["query", "term"])

    flow = queries.where("query is not null").select(F.col("query").cast("long").alias("query"), "contacts")
    return flow.mapInArrow(lean(run), "query long, term long").groupBy("query", "term").agg(F.count(F.lit(1)).alias("times"))


class QueryBatch:
    """Hashed terms of some queries with their weights, as arrays that travel to the tasks."""

    def __init__(self, asked: pa.Table, df: dict[int, int], docs: int, words: int):
        self.docs, self.words = docs, words
        names = asked["query"].to_numpy()
        term = asked["term"].to_numpy()
        self.names, first = np.unique(names, return_index=True)
        self.first = np.append(first, len(names))
        self.terms, self.at = np.unique(term.view(U), return_inverse=True)
        weight = [math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(int(t), 0) + 1))) for t in self.terms]
        self.gain = asked["times"].to_numpy() * np.array(weight, np.int64)[self.at]

    def query(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the terms of a query among ``terms``, and weight times repeats."""
        own = slice(self.first[q], self.first[q + 1])
        return self.at[own], self.gain[own]

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * x * self.docs // self.words for x in n.tolist()], np.int64)

    def groups(self) -> Iterator[tuple[int, int]]:
        """Ranges of queries with about ``TERM_STEP`` terms together, one query at least."""
        lo = 0
        while lo < len(self.names):
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + TERM_STEP, "right")) - 1)
            yield lo, hi
            lo = hi


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (TF_FACTOR * tf + M_FACTOR * m)


def term_counts(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and frequency of every different word of every row, in that order; ``rows`` ascend."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return rows[first], h[first], np.diff(np.append(first, len(h)))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with few words each: their positions, words per row, and ``term_counts``."""
    size = np.asarray(batch["contacts"].value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(size)
    lo = 0
    while lo < len(size):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + STEP_WORDS, "right")))
        h, rows, counts = list_words(batch["contacts"].slice(lo, hi - lo))
        yield np.arange(lo, hi), counts, *term_counts(h, rows)
        lo = hi


def frequencies(histories: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many histories each of some hashed terms stands."""
    wanted = np.unique(terms.view(U))

    def run(batches):
        found = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for _, _, _, h, _ in _parts(batch):
                at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                found += np.bincount(at[wanted[at] == h], minlength=len(wanted))
        some = np.flatnonzero(found)
        yield pa.record_batch([pa.array(wanted[some].view(np.int64)), pa.array(found[some])], names=["term", "df"])

    if not len(wanted):
        return {}
    df = histories.select("contacts").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    return dict(zip(df["term"].to_numpy().view(U).tolist(), df["df"].to_pylist(), strict=True))


INDEX = "u array<long>, n array<long>, words long, width long, slices binary"


def signature_index(histories: DataFrame) -> DataFrame:
    """Blocks of histories of like size, written to the shared folder: ids, lengths and bit slices.

    A slice is a bitmap over the rows of the block; slice ``b`` tells whose signature has
    bit ``b``. Blocks are made inside the reading tasks. Empty histories have no row.
    """

    def run(batches):
        pending: dict[int, Block] = {}
        for batch in batches:
            ids = np.asarray(batch["u"], np.int64)
            for at, n, rows, h, tf in _parts(batch):
                keys, owner = _entries(h, tf, rows)
                order = np.argsort(owner, kind="stable")
                keys, entries = keys[order], np.bincount(owner, minlength=len(at))
                ends = np.cumsum(entries)
                for size in np.unique(_class(entries[entries > 0])).tolist():
                    block = pending.setdefault(size, Block())
                    for i in np.flatnonzero((entries > 0) & (_class(np.maximum(entries, 1)) == size)).tolist():
                        block.add(int(ids[at[i]]), int(n[i]), keys[ends[i] - entries[i] : ends[i]])
                        if block.full():
                            yield block.row()
                            block = pending[size] = Block()
        for block in pending.values():
            if block.ids:
                yield block.row()

    path = shared_path(histories.sparkSession, "signatures")
    blocks = histories.select("u", "contacts").mapInArrow(lean(run), INDEX)
    blocks.write.option("parquet.block.size", str(GROUP_BYTES)).parquet(path)
    return histories.sparkSession.read.schema(INDEX).parquet(path)


def _class(entries: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(entries)).astype(np.int64)


def _entry(h: np.ndarray, level: int) -> np.ndarray:
    return mix(h + U(level), 1)


def _entries(h: np.ndarray, tf: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature entries of words with their frequencies, and the rows they belong to."""
    keys, owner = [], []
    for level, low in enumerate(CLASSES):
        own = tf >= low
        if level and not own.any():
            break
        keys.append(_entry(h[own], level))
        owner.append(rows[own])
    return np.concatenate(keys), np.concatenate(owner)


def _places(keys: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The bits of entries in a signature of ``width`` bits, one array per hash."""
    a, b = keys >> U(32), (keys & U(0xFFFFFFFF)) | U(1)
    for j in range(HASHES):
        yield ((a + U(j) * b) % U(width)).astype(np.int64)


class Block:
    """Rows of like size on their way into bit slices."""

    def __init__(self):
        self.ids, self.n, self.keys, self.entries = [], [], [], 0

    def add(self, u: int, n: int, keys: np.ndarray) -> None:
        self.ids.append(u)
        self.n.append(n)
        self.keys.append(keys)
        self.entries += len(keys)

    def full(self) -> bool:
        return self.entries >= BLOCK_ENTRIES or len(self.ids) >= BLOCK_ROWS

    def row(self) -> pa.RecordBatch:
        width = BITS * max(map(len, self.keys))
        bits = np.zeros((width, len(self.ids)), bool)
        owner = np.repeat(np.arange(len(self.ids)), [len(x) for x in self.keys])
        for place in _places(np.concatenate(self.keys), width):
            bits[place, owner] = True
        slices = np.packbits(bits, axis=1, bitorder="little").tobytes()
        columns = [[self.ids], [self.n], [sum(self.n)], [width], [slices]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["u", "n", "words", "width", "slices"])


def bounds(ids: np.ndarray, n: np.ndarray, width: int, slices: np.ndarray, batch: QueryBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of queries with the upper bounds of all rows of a block, ``(queries, rows)``."""
    bitmap = slices.reshape(width, -1)
    m = batch.lengths(n)
    most = [impact(np.minimum(n, high - 1), m) for high in CLASSES[1:]] + [impact(n, m)]
    steps = np.diff(np.array(most), axis=0, prepend=0).astype(np.float64)
    for lo, hi in batch.groups():
        out = np.zeros((hi - lo, len(ids)))
        used = np.unique(batch.at[batch.first[lo] : batch.first[hi]])
        for i in range(0, len(used), TERM_STEP):
            part = used[i : i + TERM_STEP]
            gains = _gains(bitmap, batch.terms[part], width, steps)
            for q in range(lo, hi):
                at, gain = batch.query(q)
                here = np.searchsorted(part, at)
                ok = (here < len(part)) & (part[np.minimum(here, len(part) - 1)] == at)
                if ok.any():
                    out[q - lo] += gain[ok].astype(np.float64) @ gains[here[ok]]
        if out.max(initial=0) >= 1 << 52:  # beyond exact doubles a bound stays one
            out *= 1 + 1e-9
        yield lo, hi, out


def _gains(bitmap: np.ndarray, terms: np.ndarray, width: int, steps: np.ndarray) -> np.ndarray:
    """The most that each term can bring each row: the highest class of frequency whose bits are all set."""
    rows = steps.shape[1]
    gains = np.zeros((len(terms), rows))
    alive = np.arange(len(terms))
    held = np.full((len(terms), bitmap.shape[1]), 255, np.uint8)
    for level in range(len(CLASSES)):
        places = _places(_entry(terms[alive], level), width)
        for place in places:
            held &= bitmap[place]
        some = held.any(axis=1)
        alive, held = alive[some], held[some]
        if not len(alive):
            break
        gains[alive] += np.unpackbits(held, axis=1, count=rows, bitorder="little") * steps[level]
    return gains


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    for rows in batches:
        for i in range(len(rows)):
            row = rows.slice(i, 1)
            yield (
                np.asarray(row["u"].flatten(), np.int64),
                np.asarray(row["n"].flatten(), np.int64),
                row["width"][0].as_py(),
                np.frombuffer(row["slices"][0].as_buffer(), np.uint8),
            )


CANDIDATE = "q int, u long, bound double"


def _candidates(q: np.ndarray, u: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(q.astype(np.int32)), pa.array(u), pa.array(bound)], names=["q", "u", "bound"])


def _largest(batch: QueryBatch, k: int):
    """Of the blocks of a task: for each query the ``k`` rows with the largest bounds."""

    def run(batches):
        best = np.zeros((len(batch.names), k))
        who = np.zeros((len(batch.names), k), np.int64)
        for ids, n, width, slices in _blocks(batches):
            for lo, hi, bound in bounds(ids, n, width, slices, batch):
                both = np.concatenate([best[lo:hi], bound], axis=1)
                names = np.concatenate([who[lo:hi], np.broadcast_to(ids, bound.shape)], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best[lo:hi], who[lo:hi] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        q, at = np.nonzero(best)
        yield _candidates(q, who[q, at], best[q, at])

    return run


def _not_excluded(batch: QueryBatch, least: np.ndarray, last: np.ndarray):
    """All rows whose bound reaches the score of a query's k-th row; at an equal score a larger ``u`` is behind."""

    def run(batches):
        for ids, n, width, slices in _blocks(batches):
            for lo, hi, bound in bounds(ids, n, width, slices, batch):
                limit = least[lo:hi, None]
                q, at = np.nonzero((bound > limit) | ((bound == limit) & (bound > 0) & (ids <= last[lo:hi, None])))
                if len(q):
                    yield _candidates(q + lo, ids[at], bound[q, at])

    return run


def rescored(histories: DataFrame, candidates: DataFrame, batch: QueryBatch) -> DataFrame:
    """Exact scores above 0 of candidates ``q, u``; every history named ``u`` is read whole."""
    asks = candidates.groupBy("u").agg(F.collect_set("q").alias("asks"))

    def run(batches):
        for rows in batches:
            ids, asks = np.asarray(rows["u"], np.int64), rows["asks"].to_pylist()
            q_out, u_out, s_out = [], [], []
            for at, n, row, h, tf in _parts(rows):
                place = np.minimum(np.searchsorted(batch.terms, h), len(batch.terms) - 1)
                ok = batch.terms[place] == h
                row, place, tf = row[ok], place[ok], tf[ok]
                ends = np.searchsorted(row, np.arange(len(at) + 1))
                m = batch.lengths(n)
                for i, pos in enumerate(at.tolist()):
                    mine = slice(ends[i], ends[i + 1])
                    held, value = place[mine], impact(tf[mine], m[i])
                    if not len(held):
                        continue
                    for q in asks[pos]:
                        terms, gain = batch.query(q)
                        j = np.minimum(np.searchsorted(held, terms), len(held) - 1)
                        score = int((gain * value[j] * (held[j] == terms)).sum())
                        if score > 0:
                            q_out.append(q)
                            u_out.append(ids[pos])
                            s_out.append(score)
            yield pa.record_batch([pa.array(q_out, pa.int32()), pa.array(u_out, pa.int64()), pa.array(s_out, pa.int64())], names=["q", "u", "score"])

    return histories.join(asks, "u").select("u", "contacts", "asks").mapInArrow(lean(run), "q int, u long, score long")


def _first(rows: DataFrame, k: int, order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order)).cast(T.IntegerType())).where(F.col("rank") <= k)


def _searched(histories: DataFrame, index: DataFrame, batch: QueryBatch, k: int) -> DataFrame:
    order = (F.desc("score"), F.col("u"))
    tops, _ = materialise(_first(index.mapInArrow(lean(_largest(batch, k)), CANDIDATE), k, (F.desc("bound"), F.col("u"))).select("q", "u"))
    ends = _first(rescored(histories, tops, batch), k, order).where(F.col("rank") == k).toArrow()
    least, last = np.zeros(len(batch.names)), np.full(len(batch.names), np.iinfo(np.int64).max)
    at = ends["q"].to_numpy()
    least[at], last[at] = ends["score"].to_numpy(), ends["u"].to_numpy()
    left, _ = materialise(index.mapInArrow(lean(_not_excluded(batch, least, last)), CANDIDATE).select("q", "u"))
    names = histories.sparkSession.createDataFrame(pa.table({"q": pa.array(np.arange(len(batch.names)), pa.int32()), "query": pa.array(batch.names, pa.int64())}))
    found = _first(rescored(histories, left, batch), k, order)
    return found.join(names, "q").select("query", "rank", "u", "score")
