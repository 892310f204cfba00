"""Hashes of many words and word sequences at once, on the buffers of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
# Fixed odd multipliers of the hash functions.
BASE = U(0x100000001B3)
MIX = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93))
# Bytes hashed at a time: bounds the memory of the intermediate arrays.
SLICE_BYTES = 1 << 19


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    """Scramble 64-bit values; one to one."""
    x = (x ^ (x >> U(29))) * MIX[k & 3]
    x = (x ^ (x >> U(32))) * MIX[(k + 1) & 3]
    return x ^ (x >> U(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = U(1)
    return np.cumprod(out, dtype=U)


_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_TABLES = [_powers(BASE, 1 << 16), _powers(_INVERSE, 1 << 16)]


def _tables(n: int) -> list[np.ndarray]:
    if len(_TABLES[0]) < n:
        size = 1 << int(n).bit_length()
        _TABLES[:] = [_powers(BASE, size), _powers(_INVERSE, size)]
    return _TABLES


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are ascending, disjoint and not empty.

    Bytes between spans are ignored, so any delimiter may lie there.
    """
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE_BYTES, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, inverse = _tables(hi - lo + 1)
        v = (data[lo:hi].astype(U) + U(1)) * power[: hi - lo]
        s, e = starts[i:j] - lo, ends[i:j] - lo
        if len(s) > 1 or e[-1] < hi - lo:
            cuts = np.empty(2 * len(s), np.int64)
            cuts[0::2], cuts[1::2] = s, e
            h = np.add.reduceat(np.append(v, U(0)), cuts)[0::2]
            # reduceat gives the element itself for an empty gap, never for a span
        else:
            h = v.sum(dtype=U)[None]
        out[i:j] = mix(h * inverse[s] + (e - s).astype(U) * MIX[3])
        i = j
    return out


def list_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list<string or int> column: word hashes, row of each word, words per row.

    Null and empty words do not count; a null list has none.
    """
    n = len(column)
    flat, rows = column.flatten(), np.asarray(pc.list_parent_indices(column), np.int64)
    if pa.types.is_integer(flat.type):
        ok = np.asarray(flat.is_valid())
        h = mix(np.asarray(flat.fill_null(0), np.int64).view(U) + MIX[2])
    else:
        flat = flat.cast(pa.large_string())
        size = np.asarray(pc.binary_length(flat).fill_null(0), np.int64)
        offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
        ok = size > 0
        h = hash_spans(data, offsets[:-1][ok], offsets[:-1][ok] + size[ok])
        return h, rows[ok], np.bincount(rows[ok], minlength=n)
    return h[ok], rows[ok], np.bincount(rows[ok], minlength=n)


def gram_sets(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row as sorted hashes, and their number per row.

    A row with fewer than ``n`` words has its whole sequence as one gram; a
    row without words has none.
    """
    factors = mix(np.arange(1, n + 1, dtype=U) * MIX[0]) | U(1)
    first = np.cumsum(counts) - counts
    grams = np.maximum(counts - n + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams) + first[row]
    g = np.zeros(len(row), U)
    span = np.minimum(counts, n)[row]
    for j in range(n):
        ok = j < span
        if ok.all():
            g += words[at + j] * factors[j]
        else:
            g[ok] += words[at[ok] + j] * factors[j]
    g = mix(g + span.astype(U) * MIX[1], 2)
    ends = np.cumsum(grams)
    for s, e in zip(ends - grams, ends, strict=True):
        if e - s > 1:
            g[s:e].sort()
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[new], np.bincount(row[new], minlength=len(counts))


def set_prints(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit print of each set, equal for equal sets; zero for empty ones."""
    out = np.zeros((len(sizes), 2), U)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in (0, 1):
            out[full, k] = np.add.reduceat(mix(grams, k + 1), starts) + sizes[full].astype(U)
    return out
