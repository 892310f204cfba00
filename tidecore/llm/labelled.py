"""Bounded samples of labelled texts for the classifiers, and scoring of whole tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecore.llm.memory import lean

# A sampled text has at most this many characters; longer ones are scored, not learned from.
SAMPLE_CHARS = 100_000
# Texts scored at a time.
STEP = 1024


def sample_texts(texts: DataFrame, labels: DataFrame, learnable: Column, size: int) -> tuple[pa.Array, list[float]]:
    """At most ``size`` labelled texts, those whose names have the smallest hashes, each different text once.

    ``texts``: ``u, text``; ``labels``: ``u, label``, rows with a null label are ignored;
    several labels of one ``u`` are averaged.
    """
    known = labels.where("u is not null and label is not null").groupBy("u").agg(F.avg(F.col("label").cast("double")).alias("label"))
    names = texts.where(learnable).where(F.length("text") <= SAMPLE_CHARS).select("u").distinct()
    chosen = names.join(known, "u").orderBy(F.xxhash64("u"), "u").limit(size)  # names alone: texts don't move
    rows = (
        texts.where(F.length("text") <= SAMPLE_CHARS)
        .join(F.broadcast(chosen), "u")
        .groupBy(F.xxhash64("text").alias("key"))
        .agg(F.min("text").alias("text"), F.avg("label").alias("label"))
        .orderBy("key")
        .select("text", "label")
        .toArrow()
    )
    return rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string()), rows["label"].to_pylist()


def different_texts(texts: DataFrame, column: str, size: int) -> list[str]:
    """At most ``size`` different texts of ``column``, those with the smallest hashes; only hashes are sorted."""
    keyed = texts.where(F.col(column).isNotNull()).withColumn("key", F.xxhash64(column))
    keys = keyed.select("key").distinct().orderBy("key").limit(size)
    rows = keyed.join(F.broadcast(keys), "key").groupBy("key").agg(F.min(column).alias(column)).orderBy("key")
    return rows.select(column).toArrow()[column].to_pylist()


def score_texts(texts: DataFrame, score, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(u, text)`` to ``(u, score)`` and the columns ``carry``; ``score`` maps a string column to numbers."""

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), STEP):  # small batches back: carried texts stand in memory twice
                part = batch.slice(i, STEP)
                own = [part[c] for c in carry]
                yield pa.record_batch([part["u"], pa.array(score(part["text"]), pa.float64()), *own], names=["u", "score", *carry])

    flow = texts.select(*dict.fromkeys(["u", "text", *carry]))
    kept = [flow.schema[c] for c in carry]
    return flow.mapInArrow(lean(run), T.StructType([T.StructField("u", flow.schema["u"].dataType), T.StructField("score", T.DoubleType()), *kept]))
