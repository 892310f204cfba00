"""A bidirectional LSTM in numpy, with its gradients and an Adam step."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def init(rng: np.random.Generator, inputs: int, hidden: int, outputs: int) -> dict[str, np.ndarray]:
    """Weights of both directions (``f`` and ``r``) and of the output layer."""
    w = {}
    for d in "fr":
        w[f"{d}x"] = rng.normal(size=(inputs, 4 * hidden)) / np.sqrt(inputs)
        w[f"{d}h"] = rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)
        w[f"{d}b"] = np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])  # open forget gates
    w["ow"] = rng.normal(size=(2 * hidden, outputs)) * 0.3
    w["ob"] = np.zeros(outputs)
    return {k: v.astype(np.float32) for k, v in w.items()}


def run(gates: np.ndarray, wh: np.ndarray, mask: np.ndarray, keep: bool = False):
    """One direction over ``gates`` (time, batch, 4 hidden) = inputs @ wx + b.

    Where ``mask`` (time, batch) is 0 the state passes on unchanged. Returns the
    hidden states and, with ``keep``, what the gradient needs.
    """
    steps, batch, four = gates.shape
    n = four // 4
    h, c = np.zeros((batch, n), gates.dtype), np.zeros((batch, n), gates.dtype)
    out, memory = np.empty((steps, batch, n), gates.dtype), []
    for t in range(steps):
        g = gates[t] + h @ wh
        s = sigmoid(g[:, : 3 * n])
        f, i, o, u = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(g[:, 3 * n :])
        m = mask[t][:, None]
        new = f * c + i * u
        tan = np.tanh(new)
        if keep:
            memory.append((h, c, f, i, o, u, tan, m))
        c = m * new + (1 - m) * c
        h = m * (o * tan) + (1 - m) * h
        out[t] = h
    return out, memory


def back(d_out: np.ndarray, wh: np.ndarray, memory) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``run`` for its gates and for ``wh``."""
    steps, batch, n = d_out.shape
    d_gates, d_wh = np.empty((steps, batch, 4 * n), d_out.dtype), np.zeros_like(wh)
    dh, dc = np.zeros((batch, n), d_out.dtype), np.zeros((batch, n), d_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, c, f, i, o, u, tan, m = memory[t]
        dh = dh + d_out[t]
        live = dh * m
        dn = dc * m + live * o * (1 - tan * tan)
        g = np.concatenate([dn * c * f * (1 - f), dn * u * i * (1 - i), live * tan * o * (1 - o), dn * i * (1 - u * u)], axis=1)
        d_gates[t] = g
        d_wh += h.T @ g
        dh = dh * (1 - m) + g @ wh.T
        dc = dc * (1 - m) + dn * f
    return d_gates, d_wh


def scores(w: dict, gates_f: np.ndarray, gates_r: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Output scores (time, batch, outputs) from the gates of both directions, in reading order."""
    hf, mf = run(gates_f, w["fh"], mask, keep)
    hr, mr = run(gates_r[::-1], w["rh"], mask[::-1], keep)
    both = np.concatenate([hf, hr[::-1]], axis=2)
    return both @ w["ow"] + w["ob"], (both, mf, mr)


def slopes(w: dict, d_scores: np.ndarray, memory) -> tuple[dict, np.ndarray, np.ndarray]:
    """Gradients of the weights behind the gates, and of the gates of both directions."""
    both, mf, mr = memory
    n = both.shape[2] // 2
    flat = d_scores.reshape(-1, d_scores.shape[2])
    g = {"ow": both.reshape(-1, 2 * n).T @ flat, "ob": flat.sum(0)}
    d_both = d_scores @ w["ow"].T
    gates_f, g["fh"] = back(d_both[:, :, :n], w["fh"], mf)
    gates_r, g["rh"] = back(d_both[::-1, :, n:], w["rh"], mr)
    return g, gates_f, gates_r[::-1]


class Adam:
    """Adam with the gradient clipped by its norm."""

    def __init__(self, w: dict, rate: float, clip: float = 5.0):
        self.rate, self.clip, self.step = rate, clip, 0
        self.first = {k: np.zeros_like(v) for k, v in w.items()}
        self.second = {k: np.zeros_like(v) for k, v in w.items()}

    def update(self, w: dict, g: dict) -> None:
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, self.clip / max(size, 1e-12))
        self.step += 1
        for k, slope in g.items():
            slope = (slope * scale).astype(w[k].dtype)
            self.first[k] += 0.1 * (slope - self.first[k])
            self.second[k] += 0.001 * (slope * slope - self.second[k])
            w[k] -= self.rate * (self.first[k] / (1 - 0.9**self.step)) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)
