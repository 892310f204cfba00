"""Runs of letters, digits and symbols of many texts at once, as hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tidecore.llm.hashing import U, hash_spans, mix

# Texts worked on at a time: bounds the memory of the intermediate arrays.
SLICE_BYTES = 1 << 19
SPACE, LETTER, DIGIT = 0, 1, 2


def _classes() -> np.ndarray:
    """Class of each byte: space, letter (or part of a longer character), digit, else one per symbol."""
    kind = np.arange(256) + 3
    kind[:33] = SPACE
    kind[127] = SPACE
    for low, high in ((65, 90), (97, 122), (128, 255)):
        kind[low : high + 1] = LETTER
    kind[48:58] = DIGIT
    return kind.astype(np.int16)


CLASS = _classes()


class Runs:
    """Runs of one slice of texts: ``row`` (text), ``hash``, ``kind``, ``caps``, ``again``, ``sentence``.

    ``caps``: two or more letters, all of A-Z. ``again``: the same run as the one
    before. ``sentence``: number of the sentence in the slice; one ends at ``. ! ?`` and
    at a line break. Letters count in lower case (A-Z and Latin-1).
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        n = len(ends)
        kind = CLASS[data]
        start = np.ones(len(data), bool)
        start[1:] = kind[1:] != kind[:-1]
        begins = np.concatenate([[0], ends[:-1]])
        start[begins[begins < len(data)]] = True
        at = np.flatnonzero(start)
        stop = np.append(at[1:], len(data))
        keep = kind[at] != SPACE if len(at) else np.zeros(0, bool)
        upper = (data >= 65) & (data <= 90)
        low = data + (upper * np.uint8(32))
        wide = (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        wide[1:] &= data[:-1] == 0xC3
        wide[:1] = False
        low = low + wide * np.uint8(32)
        self.texts = n
        self.begin, self.end = at[keep], stop[keep]
        self.row = np.searchsorted(ends, self.begin, "right")
        self.kind = kind[self.begin] if len(at) else np.zeros(0, np.int16)
        self.hash = hash_spans(low, self.begin, self.end)
        self.low = low
        size = self.end - self.begin
        capitals = np.concatenate([[0], np.cumsum(upper)])
        self.caps = (size > 1) & (capitals[self.end] - capitals[self.begin] == size)
        self.again = np.zeros(len(self.row), bool)
        if len(self.row):
            self.again[1:] = (self.hash[1:] == self.hash[:-1]) & (self.row[1:] == self.row[:-1])
        breaks = np.isin(data, np.frombuffer(b".!?\n", np.uint8))
        passed = np.concatenate([[0], np.cumsum(breaks)])
        own = passed[self.begin] + self.row  # a new text also starts a new sentence
        self.sentence = np.cumsum(np.concatenate([[0], np.diff(own) != 0]))[: len(own)] if len(own) else own

    def prefixes(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Letter runs of more than ``size`` bytes, and a hash of their first ones."""
        at = np.flatnonzero((self.kind == LETTER) & (self.end - self.begin > size))
        begin = self.begin[at]
        return at, mix(hash_spans(self.low, begin, begin + size) + U(size), 1)

    def per_text(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.texts)


def slices(column: pa.Array) -> Iterator[Runs]:
    """The texts of a string column in slices of whole texts; null is empty."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    valid = np.asarray(column.is_valid())
    size = np.diff(offsets) * valid
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, "right")) - 1)
        own = size[i:j]
        if valid[i:j].all():
            part = data[offsets[i] : offsets[j]]
        else:
            part = np.concatenate([data[a : a + n] for a, n in zip(offsets[i:j], own, strict=True)] + [np.zeros(0, np.uint8)])
        yield Runs(part, np.cumsum(own))
        i = j


def slot(runs: Runs, bits: int, shapes: int = 0) -> np.ndarray:
    """A table row for every run. With ``shapes`` reserved rows at the start of the table,
    capitals and numbers by length have rows of their own."""
    at = (runs.hash >> U(64 - bits)).astype(np.int64)
    if shapes:
        at = np.maximum(at, shapes)
        at[runs.caps] = 0
        digits = runs.kind == DIGIT
        at[digits] = 1 + np.minimum(runs.end[digits] - runs.begin[digits], shapes - 2)
    return at


def signs(seed: int, rows: int, width: int, nonzero: int) -> np.ndarray:
    """Sparse random index vectors of -1, 0 and 1, the same ones everywhere."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, width), np.float32)
    place = np.argsort(rng.random((rows, width), np.float32), axis=1)[:, :nonzero]
    np.put_along_axis(out, place, rng.choice(np.float32([-1, 1]), (rows, nonzero)), axis=1)
    return out

