"""Personal data: exact base patterns, and a character BiLSTM-CRF that adds to them.

The base patterns name the spans the network is trained on. The network reads
characters in overlapping windows; every character takes its label from the
window in which it stands furthest from an edge, and spans are read from the labels
of the whole text. A span it adds must not touch a base span.

A window is only read where a digit or ``@`` stands in it: every kind needs one,
so elsewhere there is nothing to label.

The project has no records with personal data, so this operator is general.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.llm import bilstm, crf
from tidecore.llm.labelled import different_texts
from tidecore.llm.memory import give_back, lean

KINDS = ("email", "ip", "card", "phone")
# Texts the network is trained on, at most, and their longest; windows from them, at most.
TRAIN_TEXTS, TRAIN_CHARS, TRAIN_WINDOWS = 3000, 50_000, 6000
WINDOW, STRIDE = 64, 32
EMBED, HIDDEN, STEPS, BATCH, RATE = 12, 20, 500, 48, 1e-2
# Windows decoded at a time, and mean probability an added span needs.
DECODE, SURE = 512, 0.9

# The base patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the base patterns, by kind, then start; code points."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((0, start, last))
        at = text.find("@", max(at + 1, last))
    if not _TRIGGER.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = [int(c) for c in m[0] if "0" <= c <= "9"] if m.end() - m.start() <= 40 else []
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def _luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


# --- windows and labels ----------------------------------------------------

# Character ids: 0 outside, ASCII by code, one for other letters and one for the rest.
CHARS = 131
LABELS = 1 + 2 * len(KINDS)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(codes < 128, codes + 1, np.where(codes < 0x2000, 129, 130))


def windows(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a digit or ``@``; they overlap by half."""
    hot = np.flatnonzero(((codes >= 49) & (codes <= 58)) | (codes == 65))
    if not len(hot):
        return hot
    last = max(0, -(-(len(codes) - WINDOW) // STRIDE))
    k = np.unique(np.concatenate([hot // STRIDE, hot // STRIDE - 1]))
    return k[(k >= 0) & (k <= last)] * STRIDE


def label_text(size: int, spans) -> np.ndarray:
    """B and I labels of each character; earlier kinds win where spans overlap."""
    out = np.zeros(size, np.int64)
    for kind, s, e in sorted(spans, reverse=True):
        out[s:e] = 2 + 2 * kind
        out[s] = 1 + 2 * kind
    return out


@dataclass
class SpanModel:
    """Weights of the network and of the CRF; ``find`` gives the spans of texts."""

    weights: dict[str, np.ndarray]

    def scores(self, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
        w = self.weights
        table_f, table_r = w["emb"] @ w["fx"] + w["fb"], w["emb"] @ w["rx"] + w["rb"]
        return bilstm.scores(w, table_f[codes], table_r[codes], mask, keep)

    def find(self, texts: list[str], found: list[list]) -> list[list[tuple[int, int, int]]]:
        """What the network adds to the spans ``found`` in each text."""
        parts, owner, start = [], [], []
        encoded = {}
        for i, text in enumerate(texts):
            if _TRIGGER.search(text):
                encoded[i] = codes = encode(text)
                for s in windows(codes):
                    parts.append(codes[s : s + WINDOW])
                    owner.append(i), start.append(int(s))
        labels: dict[int, dict[int, tuple[int, int, float]]] = {}
        for k in range(0, len(parts), DECODE):
            batch = parts[k : k + DECODE]
            codes = np.zeros((WINDOW, len(batch)), np.int64)
            mask = np.zeros((WINDOW, len(batch)), np.float32)
            for b, p in enumerate(batch):
                codes[: len(p), b], mask[: len(p), b] = p, 1
            out = self.scores(codes, mask)[0]
            path = crf.best_paths(out, self.weights["moves"], mask)
            chance = np.exp(out - out.max(2, keepdims=True))
            chance = np.take_along_axis(chance, path[:, :, None], 2)[:, :, 0] / chance.sum(2)
            for b in np.flatnonzero((path > 0).any(0)):
                i, s, size = owner[k + b], start[k + b], len(batch[b])
                own = labels.setdefault(i, {})
                end = s + size == len(encoded[i])
                for t in range(size):
                    depth = min(t if s else WINDOW, WINDOW if end else size - 1 - t)
                    if own.get(s + t, (0, -1, 0))[1] < depth:
                        own[s + t] = (int(path[t, b]), depth, float(chance[t, b]))
        return [_added(labels.get(i, {}), found[i], text) for i, text in enumerate(texts)]


def _added(labels: dict, found: list, text: str) -> list[tuple[int, int, int]]:
    """Spans in the reconciled labels that touch no base span and are certain enough."""
    out, run = [], []

    def close():
        if run:
            kind, s, e = (labels[run[0]][0] - 1) // 2, run[0], run[-1] + 1
            sure = np.mean([labels[p][2] for p in run])
            if sure >= SURE and e - s >= 6 and _TRIGGER.search(text, s, e) and all(e <= a or s >= b for _, a, b in found) and _whole(text, s, e):
                out.append((kind, s, e))
        run.clear()

    for p in sorted(labels):
        label = labels[p][0]
        kind = (label - 1) // 2
        if run and (p != run[-1] + 1 or not label or label % 2 or (labels[run[0]][0] - 1) // 2 != kind):
            close()
        if label and (run or label % 2):
            run.append(p)
    close()
    return out


def _whole(text: str, s: int, e: int) -> bool:
    """The span is not a part of a longer word or number."""
    return not (s and text[s - 1].isalnum() and text[s].isalnum()) and not (e < len(text) and text[e].isalnum() and text[e - 1].isalnum())


def fit(texts: list[str]) -> SpanModel | None:
    """Train on the base spans of ``texts``; windows without spans are examples too."""
    rng = np.random.default_rng(3)
    with_span, without = [], []
    for text in texts:
        codes, spans = encode(text), base_spans(text)
        labels = label_text(len(codes), spans)
        for s in windows(codes):
            own = labels[s : s + WINDOW]
            (with_span if own.any() else without).append((codes[s : s + WINDOW], own))
    if not with_span:
        return None
    half = TRAIN_WINDOWS // 2
    pick = lambda x: [x[i] for i in rng.permutation(len(x))[:half]]
    data = pick(with_span) + pick(without)
    w = bilstm.init(rng, EMBED, HIDDEN, LABELS)
    w["emb"] = (rng.normal(size=(CHARS, EMBED)) * 0.5).astype(np.float32)
    w["moves"] = np.zeros((LABELS, LABELS), np.float32)
    model, adam = SpanModel(w), bilstm.Adam(w, RATE)
    for step in range(STEPS):
        adam.rate = RATE * (1 - 0.9 * step / STEPS)
        batch = [data[i] for i in rng.integers(0, len(data), BATCH)]
        codes = np.zeros((WINDOW, BATCH), np.int64)
        labels, mask = codes.copy(), np.zeros((WINDOW, BATCH), np.float32)
        for b, (c, y) in enumerate(batch):
            codes[: len(c), b], labels[: len(c), b], mask[: len(c), b] = c, y, 1
        out, memory = model.scores(codes, mask, keep=True)
        _, d_scores, d_moves = crf.loss_slopes(out, w["moves"], labels, mask)
        g, gates_f, gates_r = bilstm.slopes(w, d_scores.astype(np.float32), memory)
        emb = w["emb"][codes].reshape(-1, EMBED)
        for d, gates in (("f", gates_f), ("r", gates_r)):
            flat = gates.reshape(-1, gates.shape[2])
            g[f"{d}x"], g[f"{d}b"] = emb.T @ flat, flat.sum(0)
        d_emb = np.zeros_like(w["emb"])
        np.add.at(d_emb, codes.ravel(), gates_f.reshape(-1, 4 * HIDDEN) @ w["fx"].T + gates_r.reshape(-1, 4 * HIDDEN) @ w["rx"].T)
        g["emb"], g["moves"] = d_emb, d_moves
        adam.update(w, g)
    return model


# --- Spark -----------------------------------------------------------------

_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]
    )
)


def redact(text: str, spans) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping ones count as the first."""
    out, at = [], 0
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], "[", KINDS[kind].upper(), "]"]
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def personal_spans(texts: DataFrame, carry: tuple[str, ...] = (), redacted: bool = False) -> DataFrame:
    """Personal data in every text of ``(u, text)``: ``(u, spans)``, one row per row.

    ``spans`` is an array of ``kind`` (email, ip, card, phone), ``start``, ``end`` (code
    points, end exclusive) and ``base`` (found by a base pattern), by kind in that order, then
    by start. Null and empty texts have none; equal texts have equal spans; other columns
    are ignored. Whole texts are read. The network is trained on at most ``TRAIN_TEXTS``
    of the texts, taken by hash among those with a digit or ``@``; without base spans in
    them, or with an empty table, only the base patterns are used. The columns ``carry``
    come along unchanged; ``redacted`` adds ``clean``, the text with its spans replaced
    (null stays null).
    """
    pool = texts.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= TRAIN_CHARS))
    model = fit(different_texts(pool, "text", TRAIN_TEXTS))
    give_back()  # the driver trains more than one model
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                own = [t or "" for t in part["text"].to_pylist()]
                base = [base_spans(t) for t in own]
                more = model.find(own, base) if model else [[] for _ in own]
                every = [sorted([(*x, True) for x in b] + [(*x, False) for x in m]) for b, m in zip(base, more, strict=True)]
                rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": known} for k, s, e, known in x] for x in every]
                columns = [part["u"], pa.array(rows, kind), *(part[c] for c in carry)]
                if redacted:
                    valid = part["text"].is_valid().to_pylist()
                    columns.append(pa.array([redact(t, x) if v else None for t, x, v in zip(own, every, valid, strict=True)], pa.string()))
                yield pa.record_batch(columns, names=["u", "spans", *carry, *(["clean"] if redacted else [])])

    flow = texts.select(*dict.fromkeys(["u", "text", *carry]))
    fields = [T.StructField("u", flow.schema["u"].dataType), T.StructField("spans", _SPANS), *(flow.schema[c] for c in carry)]
    return flow.mapInArrow(lean(run), T.StructType(fields + [T.StructField("clean", T.StringType())] * redacted))
