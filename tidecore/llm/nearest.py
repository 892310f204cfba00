"""Nearest core profiles by multi-index hashing.

A core profile is a vector of numbers per vertex, such as its core numbers in
consecutive windows. Profiles are turned by a learned rotation (principal axes,
then iterative quantisation) and the signs are a binary code. A code is split
into substrings of at most 16 bits, each with an index of its own. Two codes
within Hamming radius r agree up to ``r // substrings`` bits in at least one
substring, so probing every index that far finds all of them; what is found is
ranked by the exact distance of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.llm.vectors import matrix, principal_axes, proper, sample

BITS, SUBSTRING = 64, 16
ITQ_ROUNDS = 30
# The radius is the smallest that finds this share of true neighbours in the sample.
SAMPLE_RECALL, SAMPLE_QUERIES = 0.97, 256
# Profiles in one shard of the index, and queries in one block against it.
SHARD, QUERY_BLOCK = 8192, 1024


def nearest_profiles(profiles: DataFrame, is_query, k: int = 10) -> DataFrame:
    """The ``k`` nearest other profiles of every profile for which ``is_query`` (a column) holds.

    ``profiles``: ``u`` (bigint) and ``profile`` (array of numbers); other columns
    may be used in ``is_query`` only. Result: ``query``, ``rank`` (from 1), ``u`` and
    ``distance`` (Euclidean, double precision, on the original vectors), nearest
    first, equal distances by smaller ``u``. Fewer than ``k`` rows come back where
    there are fewer other profiles.

    Profiles that are null, all zero, hold null or non-finite numbers, or differ in
    length from most take no part, nor do rows without ``u``. A row is never its own
    neighbour; rows with an equal ``u`` are the same vertex and one of them, the one
    with the smallest profile, is used. An empty table gives an empty result.
    Approximate: the rotation and the radius are fitted on at most ``FIT_SAMPLE``
    profiles so that ``SAMPLE_RECALL`` of their neighbours are found; every profile
    is indexed. A query for which the radius finds fewer than ``k`` is probed without limit.
    """
    named = profiles.where("u is not null").withColumn("wanted", F.coalesce(is_query, F.lit(False)))
    ok, width = proper(named)
    rows = ok.groupBy("u").agg(F.min("profile").alias("profile"))
    wanted = named.groupBy("u").agg(F.max("wanted").alias("wanted")).where("wanted").select("u")
    fit = sample(rows, width)
    mean, turn, radius = learn(fit, k)
    n = rows.count()
    shards = max(1, -(-n // SHARD))
    asked = rows.join(wanted, "u", "left_semi")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    left = rows.select(F.pmod(F.xxhash64("u"), F.lit(shards).cast("long")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), F.lit(0).alias("asks"), "u", "profile")
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64(F.lit(1), "u"), F.lit(blocks)).cast("int").alias("part"), F.lit(1).alias("asks"), "u", "profile")

    def run(table: pa.Table) -> pa.Table:
        asks = np.asarray(table["asks"], np.int64) == 1
        ids = np.asarray(table["u"], np.int64)
        x = matrix(table["profile"].combine_chunks(), width)
        query, found, dist = search(ids[~asks], x[~asks], ids[asks], x[asks], mean, turn, radius, k)
        return pa.table({"query": pa.array(query, pa.int64()), "u": pa.array(found, pa.int64()), "distance": pa.array(dist, pa.float64())})

    near = left.union(right).groupBy("shard", "part").applyInArrow(run, "query long, u long, distance double")
    order = Window.partitionBy("query").orderBy("distance", "u")
    return (
        near.withColumn("rank", F.row_number().over(order).cast(T.IntegerType()))
        .where(F.col("rank") <= k)
        .select("query", "rank", "u", "distance")
    )


def learn(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, rotation to code dimensions, and the Hamming radius to probe."""
    mean, axes = principal_axes(x)
    axes = axes[:, :BITS]
    d = axes.shape[1]
    if not len(x) or not d:
        return mean, axes, BITS
    z = (x - mean) @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(d, d)))[0]
    for _ in range(ITQ_ROUNDS):
        u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
        turn = (u @ vt).T
    rotation = axes @ turn
    code = codes((x - mean) @ rotation)
    needed = []
    for i in range(min(len(x), SAMPLE_QUERIES)):
        dist = ((x - x[i]) ** 2).sum(1)
        dist[i] = np.inf
        near = np.argsort(dist, kind="stable")[: min(k, len(x) - 1)]
        needed.append(np.bitwise_count(code[near] ^ code[i]))
    every = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    radius = int(every[int(np.ceil(SAMPLE_RECALL * len(every))) - 1]) if len(every) else BITS
    return mean, rotation, radius


def codes(z: np.ndarray) -> np.ndarray:
    """Signs as 64-bit codes."""
    bits = np.zeros((len(z), BITS), np.uint8)
    bits[:, : z.shape[1]] = z > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def search(ids, x, query_ids, queries, mean, rotation, radius, k):
    """Of one shard: for each query the ``k`` nearest among the codes within the radius."""
    code, asked = codes((x - mean) @ rotation), codes((queries - mean) @ rotation)
    parts = -(-min(BITS, rotation.shape[1]) // SUBSTRING) or 1
    index = []
    for j in range(parts):
        value = (code >> np.uint64(j * SUBSTRING)) & np.uint64((1 << SUBSTRING) - 1)
        order = np.argsort(value, kind="stable")
        keys, first = np.unique(value[order], return_index=True)
        index.append((keys, first, np.append(first[1:], len(order)), order))
    out_q, out_u, out_d = [], [], []
    for i in range(len(asked)):
        for reach in (radius, BITS):
            hit = np.zeros(len(code), bool)
            for j, (keys, first, last, order) in enumerate(index):
                own = (asked[i] >> np.uint64(j * SUBSTRING)) & np.uint64((1 << SUBSTRING) - 1)
                near = np.flatnonzero(np.bitwise_count(keys ^ own) <= reach // parts)
                size = last[near] - first[near]
                at = np.repeat(first[near] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                hit[order[at]] = True
            hit &= ids != query_ids[i]
            at = np.flatnonzero(hit)
            at = at[np.bitwise_count(code[at] ^ asked[i]) <= reach]
            if len(at) >= k:
                break
        dist = np.sqrt(((x[at] - queries[i]) ** 2).sum(1))
        best = np.lexsort((ids[at], dist))[:k]
        out_q.append(np.full(len(best), query_ids[i]))
        out_u.append(ids[at][best])
        out_d.append(dist[best])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_u), np.concatenate(out_d)
