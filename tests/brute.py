"""Plain Python answers for small graphs, written independently of the library."""

from __future__ import annotations

import random


def peel(pairs):
    """Core numbers by repeatedly removing a vertex of smallest degree."""
    adj = {}
    for u, v in pairs:
        if u == v:
            continue
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    core, k = {}, 0
    left = {u: set(ns) for u, ns in adj.items()}
    while left:
        u = min(left, key=lambda x: (len(left[x]), x))
        k = max(k, len(left[u]))
        core[u] = k
        for w in left.pop(u):
            left[w].discard(u)
    return core


def random_pairs(rng: random.Random, n: int, m: int):
    out = set()
    while len(out) < m:
        u, v = rng.randrange(n), rng.randrange(n)
        if u != v:
            out.add((min(u, v), max(u, v)))
    return sorted(out)


def pairs_df(spark, pairs):
    return spark.createDataFrame(list(pairs), "u long, v long")


def edges_df(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long, ts long")


def as_core(df):
    return {r["u"]: r["core"] for r in df.collect()}
