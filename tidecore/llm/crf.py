"""A linear-chain CRF over label scores: loss, gradients and best paths, for batches."""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def loss_slopes(scores: np.ndarray, moves: np.ndarray, labels: np.ndarray, mask: np.ndarray):
    """Mean negative log likelihood, and its gradients for ``scores`` and ``moves``.

    ``scores`` (time, batch, labels), ``labels`` and ``mask`` (time, batch); masked steps
    stand at the end and pass on the state.
    """
    steps, batch, k = scores.shape
    ahead, behind = np.empty_like(scores), np.zeros_like(scores)
    ahead[0] = scores[0]
    for t in range(1, steps):
        new = _lse(ahead[t - 1][:, :, None] + moves[None], 1) + scores[t]
        ahead[t] = np.where(mask[t][:, None] > 0, new, ahead[t - 1])
    total = _lse(ahead[-1], 1)
    for t in range(steps - 2, -1, -1):
        new = _lse(moves[None] + (scores[t + 1] + behind[t + 1])[:, None, :], 2)
        behind[t] = np.where(mask[t + 1][:, None] > 0, new, behind[t + 1])
    share = np.exp(ahead + behind - total[None, :, None]) * mask[:, :, None]
    d_scores = share / batch
    d_moves = np.zeros_like(moves)
    path = np.take_along_axis(scores, labels[:, :, None], 2)[:, :, 0] * mask
    gold = path.sum(0)
    for t in range(1, steps):
        live = mask[t] > 0
        if live.any():
            pair = ahead[t - 1][live][:, :, None] + moves[None] + (scores[t] + behind[t])[live][:, None, :] - total[live][:, None, None]
            d_moves += np.exp(pair).sum(0)
            a, b = labels[t - 1][live], labels[t][live]
            np.add.at(d_moves, (a, b), -1)
            gold[live] += moves[a, b]
    t, b = np.nonzero(mask > 0)
    d_scores[t, b, labels[t, b]] -= 1 / batch
    return float((total - gold).mean()), d_scores, d_moves / batch


def best_paths(scores: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Viterbi labels (time, batch); 0 where masked."""
    steps, batch, k = scores.shape
    best, came = scores[0], np.zeros((steps, batch, k), np.int8)
    for t in range(1, steps):
        options = best[:, :, None] + moves[None]
        came[t] = options.argmax(1)
        new = options.max(1) + scores[t]
        live = mask[t][:, None] > 0
        best = np.where(live, new, best)
        came[t] = np.where(live, came[t], np.arange(k, dtype=np.int8)[None])
    out = np.empty((steps, batch), np.int64)
    out[-1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = came[t][np.arange(batch), out[t]]
    return np.where(mask > 0, out, 0)
