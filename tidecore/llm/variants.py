"""Spelling variants of names by one-edit neighbourhoods over a reduced alphabet.

A vertex name is an id as it stands in a raw edge file, and ``n`` the raw edges that
carry it; a name seen rarely beside one seen often that differs by one character is
likely a slip of the keyboard. The characters of a name are hashed to a few symbols
(the code point modulo ``symbols``), which makes a shorter list of reduced names. The
full one-edit neighbourhood of every reduced name is generated and joined with the
list. Names of neighbouring reduced names are then verified on the original
strings: the characters left of and right of the edited place must be equal, which is
an equality join on what the edit leaves and never a comparison of all names that
share a reduced form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecore.llm.hashing import BASE, U, _INVERSE, _powers, mix
from tidecore.llm.memory import lean
from tidecore.plans.fixpoint import ROUND_LIMIT, NotConverged, discard, materialise

# Symbols of the reduced alphabet: few enough that reduced names repeat, so few neighbourhoods are generated.
SYMBOLS = 4
# Places of names worked on at a time, and rows in one batch sent back.
STEP = 1 << 17
# Keeps hashes of different lengths apart.
LENGTH = 0x9E3779B97F4A7C15


def written_names(edges: DataFrame) -> DataFrame:
    """Vertex names of raw edges ``src, dst``: ``name``, ``n``; an edge counts at both ends, a null end nowhere."""
    ends = F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string")))
    return edges.select(ends.alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def name_variants(names: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """Group names that differ by one inserted, deleted or replaced character.

    ``names``: ``name`` (string) and ``n`` (how often it occurs); other columns are ignored,
    rows of one name are added up, a null name takes no part and a null ``n`` adds nothing.
    Names with fewer than ``least_length`` code points or ``least_count`` occurrences take no part.

    Result, one row per name that takes part: ``name``, ``n``, ``n_near`` (names at exactly one
    edit, 0 if none), ``form`` (its near name of largest ``n``, the smallest in code-point order
    among equals, if that ``n`` is at least ``ratio`` times its own, else null), ``form_n`` and
    ``root`` (the end of the chain of forms, the name itself where there is none). With
    ``ratio`` at least 2 a chain has at most log2 of the largest ``n`` steps; a ratio below 2 is refused.

    Work is linear in the characters of the names times ``symbols``, however long a name is and
    however many names share a reduced form. An empty table gives an empty result.
    """
    if ratio < 2 or symbols < 1:
        raise ValueError("ratio is at least 2, symbols at least 1")
    counted = names.where("name is not null").groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    words, _ = materialise(
        counted.where((F.col("n") >= least_count) & (F.char_length("name") >= least_length)).withColumn("id", F.monotonically_increasing_id())
    )
    cuts, _ = materialise(words.select("id", "name").mapInArrow(lean(_cuts(symbols)), "id long, code long, cut int, rest long, last boolean"))
    reduced = words.select("name").mapInArrow(lean(_reduced(symbols)), "code long, reduced string").distinct()
    codes, _ = materialise(reduced)
    near_codes = codes.select("reduced").mapInArrow(lean(_neighbourhoods(symbols)), "code long, cut int, near long, near_cut int")
    related = near_codes.join(codes.select(F.col("code").alias("near")), "near", "left_semi")
    # a name stands at every place that may be edited, and looks for names that are equal elsewhere; a letter
    # missing from a run of equal ones is missing at the run's end, so a pair is found once
    reached = cuts.join(related, ["code", "cut"]).where("near_cut >= 0 or last").select(
        F.col("id").alias("a"), "cut", "near", "near_cut", "rest", (F.col("code") == F.col("near")).alias("same")
    )
    there = cuts.select(F.col("id").alias("b"), F.col("code").alias("near"), F.col("cut").alias("near_cut"), "rest", F.col("last").alias("near_last"))
    # names of one reduced form meet from both sides, others from one
    met = reached.join(there, ["near", "near_cut", "rest"]).where("(a < b or not same) and (cut >= 0 or near_last)")
    found, _ = materialise(met.select("a", "cut", "b", "near_cut"))
    discard(cuts, codes)
    of = lambda k: words.select(F.col("id").alias(k), F.col("name").alias(f"name_{k}"), F.col("n").alias(f"n_{k}"))
    pairs = found.join(of("a"), "a").join(of("b"), "b").where(_without("name_a", "cut") == _without("name_b", "near_cut"))
    side = lambda a, b: F.struct(F.col(f"name_{a}").alias("name"), (-F.col(f"n_{b}")).alias("less"), F.col(f"name_{b}").alias("near"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("name").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    rows = words.join(best, "name", "left")
    form = F.when(-F.col("best.less") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    shaped, _ = materialise(rows.select("name", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f")).select("name", "n", "n_near", "f.form", "f.form_n"))
    discard(found)
    return shaped.join(_roots(shaped), "name").select("name", "n", "n_near", "form", "form_n", "root")


def _without(name: str, cut: str) -> Column:
    """The name without its character at a place; the whole name at place -1."""
    left = F.substring(F.col(name), F.lit(1), F.col(cut))
    return F.when(F.col(cut) < 0, F.col(name)).otherwise(F.concat(left, F.substring(F.col(name), F.col(cut) + 2, F.char_length(name))))


def _roots(shaped: DataFrame) -> DataFrame:
    """The end of each name's chain of forms, by doubling the steps each round."""
    ends = shaped.select("name", F.coalesce("form", "name").alias("root"))
    for _ in range(ROUND_LIMIT):
        further = ends.select(F.col("name").alias("root"), F.col("root").alias("next"))
        new, seen = materialise(ends.join(further, "root").select("name", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), moved=F.count_if("moved"))
        ends = new.select("name", "root")
        if not seen["moved"]:
            return ends
    raise NotConverged("roots")


def _blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of equal length together: their positions and a matrix of code points."""
    strings = texts.to_pylist()
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    first = np.cumsum(size) - size
    for length in np.unique(size):
        rows = np.flatnonzero(size == length)
        step = max(1, STEP // max(1, int(length)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield part, points[first[part][:, None] + np.arange(length)]


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all beginnings of each row, the empty one first, and the powers."""
    n, length = values.shape
    power = _powers(BASE, length + 1)
    out = np.zeros((n, length + 1), U)
    np.cumsum(values.astype(U) * power[:length], axis=1, dtype=U, out=out[:, 1:])
    return out, power


def _named(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h + U(length * LENGTH % (1 << 64))).view(np.int64)


def _codes(sums: np.ndarray) -> np.ndarray:
    return _named(sums[:, -1], sums.shape[1] - 1)


def _symbols(points: np.ndarray, symbols: int) -> np.ndarray:
    return points % np.uint32(symbols) + np.uint32(1)


def _cuts(symbols: int):
    """``id, name`` to one row per place that an edit may touch, and one (place -1) for the whole name."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch["id"], np.int64)
            for rows, points in _blocks(batch["name"]):
                n, length = points.shape
                code = _codes(_sums(_symbols(points, symbols))[0])
                sums, _ = _sums(points)
                rest = np.empty((n, length + 1), np.int64)
                rest[:, 0] = _named(sums[:, -1], length)
                rest[:, 1:] = _named(sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * _INVERSE, length - 1)
                across = lambda x: pa.array(np.repeat(x, length + 1))
                cut = np.tile(np.arange(-1, length, dtype=np.int32), n)
                last = np.ones((n, length + 1), bool)  # of a run of equal characters
                last[:, 1:-1] = points[:, 1:] != points[:, :-1]
                yield pa.record_batch([across(ids[rows]), across(code), pa.array(cut), pa.array(rest.ravel()), pa.array(last.ravel())], names=["id", "code", "cut", "rest", "last"])

    return run


def _reduced(symbols: int):
    """``name`` to its reduced form and that form's hash."""

    def run(batches):
        for batch in batches:
            for _, points in _blocks(batch["name"]):
                reduced = _symbols(points, symbols)
                strings = [bytes(r).decode("utf-32-le") for r in np.ascontiguousarray(reduced + np.uint32(47)).view(np.uint8).reshape(len(points), -1)]
                yield pa.record_batch([pa.array(_codes(_sums(reduced)[0])), pa.array(strings, pa.string())], names=["code", "reduced"])

    return run


def _neighbourhoods(symbols: int):
    """All reduced forms at one edit or equal, with the place edited on either side (-1: none there).

    A pair of forms is met from both sides; the one with the larger hash is the neighbour.
    """

    def run(batches):
        for batch in batches:
            for _, points in _blocks(batch["reduced"]):
                values = (points - np.uint32(47)).astype(U)
                step = max(1, len(values) // (2 * symbols + 1) or 1)
                for i in range(0, len(values), step):
                    yield _near(values[i : i + step], symbols)

    return run


def _near(values: np.ndarray, symbols: int) -> pa.RecordBatch:
    n, length = values.shape
    sums, power = _sums(values)
    whole = sums[:, -1:]
    code = _codes(sums)
    alphabet = np.arange(1, symbols + 1, dtype=U)
    place = np.arange(length, dtype=np.int32)
    # replaced by every symbol, its own included: different letters may share it
    changed = _named(whole[:, :, None] + (alphabet - values[:, :, None]) * power[:length][:, None], length)
    own = alphabet == values[:, :, None]
    shorter = _named(sums[:, :-1] + (whole - sums[:, 1:]) * _INVERSE, length - 1)
    longer = _named((sums + (whole - sums) * BASE)[:, :, None] + alphabet * power[:, None], length + 1)
    parts = []
    for near, at, theirs in (
        (changed, place, place),
        (shorter, place, np.full(length, -1, np.int32)),
        (longer, np.full(length + 1, -1, np.int32), np.arange(length + 1, dtype=np.int32)),
    ):
        shape = near.shape
        wide = lambda x: np.broadcast_to(x[:, None] if near.ndim == 3 else x, shape)  # noqa: B023, E731
        keep = near > code.reshape(-1, *[1] * (near.ndim - 1))
        if near is changed:
            keep |= own
        parts.append((np.broadcast_to(code.reshape(-1, *[1] * (near.ndim - 1)), shape)[keep], wide(at)[keep], near[keep], wide(theirs)[keep]))
    return pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["code", "cut", "near", "near_cut"])
