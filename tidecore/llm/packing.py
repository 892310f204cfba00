"""Best-fit packing of neighbour lists into fixed-size blocks, by bin completion.

Adjacency lists (or any integer lists) are laid out in blocks of at most
``capacity`` entries. Lists arrive in groups of bounded size; a group is packed
inside the task that reads it, so entries never move. Blocks that a group
could not fill go on to the next round, where the groups are that much fewer,
until one group is left: the whole table ends with at most one badly filled
block, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.llm.memory import lean
from tidecore.plans.fixpoint import discard, materialise

# Entries packed together in one task; with four bytes each, 32 MB.
GROUP_ENTRIES = 8_000_000
# A block that lacks at least this share of its capacity is packed again first.
REPACK_SHARE = 16
# Search steps of one group before the best packing so far is taken.
SEARCH_NODES = 20_000


def pack_lists(lists: DataFrame, capacity: int) -> DataFrame:
    """Lay out neighbour lists in as few blocks of at most ``capacity`` entries as it can.

    ``lists``: ``u`` and ``neighbours`` (array of int), one row per list; other
    columns are ignored. A list longer than ``capacity`` is cut into full pieces,
    the first one shorter where it does not divide; no other list is cut. The
    result has one row per piece: ``u``, ``piece`` (from 0), ``start`` (the entries
    of its list before it), ``length``, ``entries`` (packed little-endian unsigned
    32-bit), ``block`` (any numbers) and ``offset`` (place in the block, gapless from 0).

    A null or empty list has no pieces. Equal rows and rows with the same ``u``
    are lists of their own; a null ``u`` is kept. An empty table gives an empty
    result. The number of blocks is that of bin completion: where it does not
    reach the lower bound ``sum / capacity`` within its steps, it is the best found.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = T.StructType(
        [
            T.StructField("u", lists.schema["u"].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("entries", T.BinaryType()),
            T.StructField("block", T.LongType()),
            T.StructField("offset", T.LongType()),
            T.StructField("room", T.LongType()),
        ]
    )
    cut = lists.select("u", "neighbours")
    packed, _ = materialise(cut.mapInArrow(lean(lambda b: _pack_stream(_cut(b, capacity), capacity, 0, False)), kind))
    parts, level, failed = [packed], 1, None
    # badly filled blocks first; all that are short of full only where these did not suffice
    for share in (REPACK_SHARE, capacity):
        short = F.col("room") * share >= capacity
        while True:
            table = parts[0]
            for more in parts[1:]:
                table = table.union(more)
            seen = table.agg(*(c.alias(k) for k, c in _sums(capacity, short).items())).first()
            least = max(-(-seen["total"] // capacity), seen["large"])
            if seen["blocks"] <= least or seen["open"] < 2 or seen["open"] == failed:
                break
            groups = -(-seen["entries"] // GROUP_ENTRIES)
            last = groups == 1
            rest = table.where(short)
            if not last:
                # rounding up keeps every task at about one group
                spread = rest.repartition(int(groups), F.xxhash64("block"))
            else:
                spread = rest.coalesce(1)
            flow = spread.select("u", "piece", "start", "length", "entries")
            again, now = materialise(flow.mapInArrow(_again(capacity, level, last), kind), blocks=F.count(F.when(F.col("offset") == 0, 1)))
            if now["blocks"] >= seen["open"]:
                # these pieces do not fit any better: the blocks stay as they were
                discard(again)
                failed = seen["open"]
                break
            parts, level = [table.where(~short), again], level + 1
            if last:
                break
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out.drop("room")


def _sums(capacity: int, short) -> dict:
    """Entries, blocks and pieces over half a block; blocks to pack again and their entries. A block starts at offset 0."""
    first = F.col("offset") == 0
    return {
        "total": F.coalesce(F.sum("length"), F.lit(0)),
        "blocks": F.count(F.when(first, 1)),
        "large": F.count(F.when(F.col("length") * 2 > capacity, 1)),
        "open": F.count(F.when(first & short, 1)),
        "entries": F.coalesce(F.sum(F.when(short, F.col("length"))), F.lit(0)),
    }


_NAMES = ["u", "piece", "start", "length", "entries"]


def _columns(batches):
    for batch in batches:
        yield [batch[c] for c in _NAMES]


def _again(capacity: int, level: int, last: bool):
    return lean(lambda batches: _pack_stream(_columns(batches), capacity, level, last))


def _cut(batches: Iterator[pa.RecordBatch], capacity: int):
    """Pieces of each list, as columns."""
    for batch in batches:
        column = batch["neighbours"]
        size = np.diff(np.asarray(column.offsets, np.int64)) * np.asarray(column.is_valid())
        begin = np.asarray(column.offsets, np.int64)[:-1]
        entries = np.asarray(column.values.fill_null(0)).astype("<u4")
        pieces = -(-size // capacity)
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        short = (size - (pieces - 1) * capacity)[row]
        start = np.where(piece > 0, short + (piece - 1) * capacity, 0)
        length = np.where(piece > 0, capacity, short)
        at = begin[row] + start
        body = [entries[a : a + n].tobytes() for a, n in zip(at, length, strict=True)]
        yield [batch["u"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(body, pa.binary())]


def _pack_stream(parts, capacity: int, level: int, last: bool):
    """Pack groups as they fill up; blocks are numbered by round, partition and order."""
    from pyspark import TaskContext

    number = (level << 52) + (TaskContext.get().partitionId() << 32)
    held, size = [], 0

    def flush():
        nonlocal number
        columns = [pa.concat_arrays([p[i] for p in held]) for i in range(5)]
        length = np.asarray(columns[3], np.int64)
        block, offset, fill = assign(length, capacity)
        room_left = (capacity - fill)[block]
        order = np.lexsort((offset, block))
        for i in range(0, len(order), 4096):
            at = pa.array(order[i : i + 4096])
            pick = order[i : i + 4096]
            yield pa.record_batch([c.take(at) for c in columns] + [pa.array(number + block[pick], pa.int64()), pa.array(offset[pick], pa.int64()), pa.array(room_left[pick], pa.int64())], names=[*_NAMES, "block", "offset", "room"])
        number += len(fill)

    for part in parts:
        i, length = 0, np.asarray(part[3], np.int64)
        ends = np.cumsum(length)
        while i < len(length):
            room = GROUP_ENTRIES - size + (ends[i - 1] if i else 0)
            j = len(length) if last else max(int(np.searchsorted(ends, room, "right")), i)
            if j == i and not held:
                j = i + 1
            if j > i:
                held.append([c.slice(i, j - i) for c in part])
                size += int(length[i:j].sum())
            if j < len(length):
                yield from flush()
                held, size = [], 0
            i = j
    if held:
        yield from flush()


def assign(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block and offset of each piece, and the fill of each block."""
    block, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    ends = np.cumsum(np.bincount(length, minlength=capacity + 1))
    taken = ends - np.bincount(length, minlength=capacity + 1)
    fill = []
    for pattern, times in complete_bins(np.bincount(length, minlength=capacity + 1), capacity):
        for _ in range(times):
            at = 0
            for n in pattern:
                i = order[taken[n]]
                taken[n] += 1
                block[i], offset[i] = len(fill), at
                at += n
            fill.append(at)
    return block, offset, np.array(fill, np.int64)


# --- bin completion --------------------------------------------------------


def complete_bins(counts: np.ndarray, capacity: int, nodes: int = SEARCH_NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, for ``counts[n]`` pieces of length n.

    Branch and bound: the largest piece left is put into a block, the undominated
    ways to fill that block are tried with the fullest first, each as often as the
    counts allow, and a branch ends when its blocks plus the ones the rest needs
    at least are no fewer than the best packing so far. Best-fit decreasing gives the first.
    """
    counts = [int(c) for c in counts]
    total = sum(n * c for n, c in enumerate(counts))
    if not total:
        return []
    best = best_fit(counts, capacity)
    least = max(-(-total // capacity), sum(counts[capacity // 2 + 1 :]))
    fewest = sum(t for _, t in best)
    if fewest == least:
        return best
    left, used, rest, steps = list(counts), 0, total, 0
    here = np.array(counts) > 0
    top = max(n for n, c in enumerate(counts) if c)
    frames: list[list] = []
    down = True
    while steps < nodes and fewest > least:
        if down:
            steps += 1
            if rest == 0:
                if used < fewest:
                    best, fewest = [(f[0], f[1]) for f in frames], used
                down = False
                continue
            if used + -(-rest // capacity) >= fewest:
                down = False
                continue
            while not left[top]:
                top -= 1
            frames.append([None, 0, _fillings(here, left, top, capacity), top])
        elif not frames:
            break
        frame = frames[-1]
        if frame[1]:  # take the last choice back
            for n in frame[0]:
                left[n] += frame[1]
                here[n] = True
            used, rest = used - frame[1], rest + frame[1] * sum(frame[0])
        top = frame[3]
        pattern = next(frame[2], None)
        if pattern is None:
            frames.pop()
            down = False
            continue
        if not pattern:  # looked at and dominated
            frame[1], down = 0, False
            steps += 1
            continue
        times = min(left[n] // pattern.count(n) for n in set(pattern))
        for n in pattern:
            left[n] -= times
        for n in pattern:
            here[n] = left[n] > 0
        frame[0], frame[1] = pattern, times
        used, rest, down = used + times, rest - times * sum(pattern), True
    return best


def _fillings(here: np.ndarray, left: list[int], top: int, capacity: int) -> Iterator[tuple[int, ...]]:
    """Ways to fill a block around one piece of length ``top``, the fullest first; an empty one is no way.

    A single piece that fills the room exactly dominates every other way. Then come
    pairs and triples that fill it exactly and are quickly found, largest member first, and
    at last all undominated ways. Counts are read when the next way is asked for, which
    has to be in the same state of the search.
    """
    room = capacity - top
    if room == 0:
        yield (top,)
        return
    have = lambda n: left[n] - (n == top)
    if have(room) > 0:
        yield (top, room)
        return
    fits = np.flatnonzero(here[: room + 1])[::-1]
    fits = fits[[have(n) > 0 for n in fits.tolist()]] if top <= room else fits
    if not len(fits):
        yield (top,)
        return
    seen = set()
    for a in fits[:24].tolist():
        if top <= room:
            left[top] -= 1
            own, here[top] = here[top], left[top] > 0
        exact = _pair(here, left, room - a, a)
        if top <= room:
            left[top] += 1
            here[top] = own
        if exact is not None and (x := tuple(sorted((a, *exact), reverse=True))) not in seen:
            seen.add(x)
            yield (top, *x)
    for x in _undominated([(n, min(have(n), room // n)) for n in fits.tolist()], {n: have(n) for n in fits.tolist()}, room):
        if x not in seen:
            yield (top, *x) if x else ()


def _undominated(sizes: list[tuple[int, int]], have: dict[int, int], room: int) -> Iterator[tuple[int, ...]]:
    """Multisets of ``sizes`` (length and most copies, descending) by falling sum; empty for a dominated one."""
    full = (1 << (room + 1)) - 1
    reach = [1]  # sums that the lengths from each place on can make, as bit sets
    for n, most in reversed(sizes):
        sums, step = reach[-1], 1
        while most:
            k = min(step, most)
            sums |= (sums << (n * k)) & full
            most, step = most - k, 2 * step
        reach.append(sums)
    reach.reverse()

    def ways(i: int, rest: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        for j in range(i, len(sizes)):
            if not reach[j] >> rest & 1:
                return
            n, most = sizes[j]
            for k in range(min(most, rest // n), 0, -1):
                if reach[j + 1] >> (rest - n * k) & 1:
                    for more in ways(j + 1, rest - n * k):
                        yield (n,) * k + more

    every = sum(1 << n for n in have)
    for total in range(room, 0, -1):
        if reach[0] >> total & 1:
            for x in ways(0, total):
                yield () if _dominated(x, have, every, room - total) else x


def _dominated(x: tuple[int, ...], have: dict[int, int], outside: int, slack: int) -> bool:
    """Whether a piece left outside could take the place of some (or none) of ``x`` at no loss."""
    several = 0  # sums of two pieces or more
    made, ones = 1, 0
    for n in x:
        several |= (several << n) | (ones << n)
        ones |= 1 << n
        made |= made << n
    for n in set(x):
        if have[n] == x.count(n):
            outside ^= 1 << n
    larger = 0
    if slack:  # every sum (of no piece as well) and 1 to ``slack`` more
        up, width = made << 1, 1
        while width < slack:
            step = min(width, slack - width)
            up |= up << step
            width += step
        larger = up & outside
    return bool(several & outside or larger)


def _pair(here: np.ndarray, left: list[int], room: int, used: int) -> tuple[int, ...] | None:
    """One or two lengths that fill ``room`` exactly beside a piece of length ``used``."""
    ok = lambda n, k=1: here[n] and left[n] >= k + (n == used)
    if room == 0:
        return ()
    if ok(room):
        return (room,)
    both = np.flatnonzero(here[1:room] & here[room - 1 : 0 : -1]) + 1
    for a in both[::-1][:8]:
        a, b = int(a), room - int(a)
        if (a != b and ok(a) and ok(b)) or (a == b and ok(a, 2)):
            return (a, b)
    return None


def best_fit(counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing; open blocks are found by their room, in a bit set."""
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    mask, out = 0, []
    for n in range(len(counts) - 1, 0, -1):
        for _ in range(counts[n]):
            found = mask >> n
            if found:
                room = n + (found & -found).bit_length() - 1
                pieces = rooms[room].pop()
                if not rooms[room]:
                    mask &= ~(1 << room)
            else:
                pieces, room = [], capacity
                out.append(pieces)
            pieces.append(n)
            if room > n:
                rooms[room - n].append(pieces)
                mask |= 1 << (room - n)
    merged: dict[tuple[int, ...], int] = {}
    for pieces in out:
        merged[tuple(pieces)] = merged.get(tuple(pieces), 0) + 1
    return list(merged.items())
