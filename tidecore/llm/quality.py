"""Quality classifier: random-indexing word vectors, pooled, and a small calibrated network.

The project has no records of texts with quality labels, so this operator is
general: it works on any table of texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tidecore.llm.labelled import sample_texts, score_texts
from tidecore.llm.memory import give_back
from tidecore.llm.runs import Runs, signs, slices, slot

# Labelled texts the classifier is fitted on, at most.
TRAIN_TEXTS = 4000
# Word rows (2 ** ROW_BITS, the first SHAPES reserved), numbers per word, words of context on each side.
ROW_BITS, SHAPES, WIDTH, NONZERO, CONTEXT = 15, 16, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 3e-3, 1e-4
AGAIN_ROW = SHAPES - 1


@dataclass
class QualityModel:
    """Word vectors, the two layers, the scaling of their inputs, and the temperature."""

    words: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text; null and empty texts are scored as empty ones."""
        parts = [self.logits(pool(r, self.words)) / self.temperature for r in slices(texts)]
        z = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward((x - self.centre) / self.spread, self.layers)[1]


def score_quality(texts: DataFrame, labels: DataFrame, learnable: Column, carry: tuple[str, ...] = ()) -> DataFrame:
    """Score every text of ``(u, text)`` for quality: ``(u, score)``, one row per row.

    ``labels``: ``(u, label)`` with label 0 or 1; only rows of ``texts`` for which
    ``learnable`` holds are learned from, ``TRAIN_TEXTS`` of them at most. A score is
    between 0 and 1, higher where label 1 is likelier, and depends on the text alone.
    The columns ``carry`` come along unchanged. Null and empty texts get the score of an empty text; equal texts equal scores; other
    columns are ignored. Without usable labels every score is 0.5. Whole texts are read.
    """
    sample, label = sample_texts(texts, labels, learnable, TRAIN_TEXTS)
    model = fit(sample, np.array(label, np.float64))
    del sample
    give_back()  # the driver trains more than one model
    return score_texts(texts, model.score if model else lambda t: np.full(len(t), 0.5), carry)


def pool(runs: Runs, words: np.ndarray) -> np.ndarray:
    """Mean word vector of each text, with how often a word follows itself and the length."""
    at = slot(runs, ROW_BITS, SHAPES)
    at[runs.again & (runs.kind == 1)] = AGAIN_ROW
    count = runs.per_text()
    out = np.zeros((runs.texts, WIDTH + 3), np.float32)
    full = count > 0
    if full.any():
        starts = (np.cumsum(count) - count)[full]
        out[full, :WIDTH] = np.add.reduceat(words[at], starts, axis=0) / count[full][:, None]
    again = np.bincount(runs.row, runs.again, minlength=runs.texts)
    caps = np.bincount(runs.row, runs.caps, minlength=runs.texts)
    out[:, WIDTH] = again / np.maximum(count, 1)
    out[:, WIDTH + 1] = caps / np.maximum(count, 1)
    out[:, WIDTH + 2] = np.log1p(count)
    return out


def word_vectors(texts: pa.Array) -> np.ndarray:
    """Random indexing: a word is its index vector plus the direction of those around it."""
    index = signs(11, 1 << ROW_BITS, WIDTH, NONZERO)
    around = np.zeros_like(index)
    for runs in slices(texts):
        at = slot(runs, ROW_BITS, SHAPES)
        for step in range(1, CONTEXT + 1):
            a, b = at[:-step], at[step:]
            same = runs.row[:-step] == runs.row[step:]
            a, b = a[same], b[same]
            for i, j in ((a, b), (b, a)):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                if len(first):
                    around[i[first]] += np.add.reduceat(index[j], first, axis=0)
    size = np.sqrt((around**2).sum(1, keepdims=True))
    return index + around / np.maximum(size, 1e-6)


def fit(texts: pa.Array, label: np.ndarray) -> QualityModel | None:
    """Fit on labelled texts; every fifth only sets the temperature."""
    label = (label >= 0.5).astype(np.float64)
    if not len(label) or label.min() == label.max():
        return None
    words = word_vectors(texts)
    x = np.concatenate([pool(r, words) for r in slices(texts)]).astype(np.float64)
    held = np.arange(len(x)) % 5 == 0
    if label[~held].min() == label[~held].max():
        held[:] = False
    centre, spread = x[~held].mean(0), x[~held].std(0) + 1e-3
    z = (x - centre) / spread
    layers = _train(z[~held], label[~held])
    check = z[held] if held.any() else z
    goal = label[held] if held.any() else label
    logit = _forward(check, layers)[1]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [_cross_entropy(logit / t, goal) for t in grid]
    return QualityModel(words, centre, spread, layers, float(grid[int(np.argmin(loss))]))


def _cross_entropy(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.maximum(x @ w1 + b1, 0)
    return hidden, hidden @ w2 + b2[0]


def _train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the cross entropy."""
    rng = np.random.default_rng(5)
    layers = [rng.normal(size=(x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) * 0.1, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step = 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // BATCH)):
            hidden, z = _forward(x[at], layers)
            d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[at]) / len(at)
            back = np.outer(d, layers[2]) * (hidden > 0)
            slopes = [x[at].T @ back + DECAY * layers[0], back.sum(0), hidden.T @ d + DECAY * layers[2], d.sum(keepdims=True)]
            step += 1
            for w, g, m, v in zip(layers, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return layers
