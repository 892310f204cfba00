"""Preference formatting: a shared prompt once, and two masked completions.

The project has no records of conversations, so this operator is general.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns in one output row: longer conversations go on in further rows.
PART_TURNS = 256


def format_preferences(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Split pairs of conversations into their longest common turn prefix and what differs.

    ``turns``: ``pair``, ``side`` (``chosen`` or ``rejected``), ``turn``, ``role``, ``text``; other columns
    are ignored. Turns are compared by number, role and text, and the prefix ends before the
    first turn that differs or that one side lacks. Each turn is rendered as
    ``<|role|>``, a line break, the text, ``<|end|>`` and a line break.

    Result: one row per pair and part of ``part_turns`` turn numbers: ``pair``, ``part`` (from 0),
    ``prompt`` (rendered once), ``chosen`` and ``rejected`` (the rest of each side),
    ``chosen_mask`` and ``rejected_mask`` (arrays of ``start, end``: where in that string stand the texts of
    the assistant, which are learned from; all else is masked), and ``prompt_turns``,
    ``chosen_turns``, ``rejected_turns``. The parts of a pair in order make the whole.

    Rows with a null pair or turn or another side take no part; null roles and texts are
    empty. Equal rows count once; several rows of one turn are one turn, in order of
    role and text. A pair with one side only has an empty prompt and an empty other
    completion; equal sides have empty completions. An empty table gives an empty result.
    """
    known = turns.where("pair is not null and turn is not null and side in ('chosen', 'rejected')")
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    of = lambda side: F.array_sort(F.collect_set(F.when(F.col("side") == side, said)))
    both = known.groupBy("pair", "turn").agg(of("chosen").alias("c"), of("rejected").alias("r"))
    first = both.where(F.col("c") != F.col("r")).groupBy("pair").agg(F.min("turn").alias("fork"))
    split = both.join(first, "pair", "left")
    shared = F.col("fork").isNull() | (F.col("turn") < F.col("fork"))
    start = known.groupBy("pair").agg(F.min("turn").alias("low"))
    placed = split.join(start, "pair").select(
        "pair",
        F.floor((F.col("turn") - F.col("low")) / part_turns).cast("long").alias("part"),
        F.struct(
            "turn",
            F.when(shared, F.col("c")).alias("p"),
            F.when(~shared & (F.size("c") > 0), F.col("c")).alias("c"),
            F.when(~shared & (F.size("r") > 0), F.col("r")).alias("r"),
        ).alias("t"),
    )
    rows = placed.groupBy("pair", "part").agg(F.array_sort(F.collect_list("t")).alias("t"))
    # a first pass gives flat lists of rendered turns, so that offsets are sums over them
    rows = rows.select("pair", "part", *(F.filter(F.col("t")[k], lambda x: x.isNotNull()).alias(k) for k in "pcr"))
    rows = rows.select("pair", "part", *(F.size(k).cast("long").alias(f"n_{k}") for k in "pcr"), *(F.flatten(k).alias(k) for k in "pcr"))
    rows = rows.select("pair", "part", "n_p", "n_c", "n_r", *(F.transform(k, _render).alias(k) for k in "pcr"))
    whole = lambda k: F.array_join(F.transform(k, lambda x: x["all"]), "")
    return rows.select(
        "pair",
        "part",
        whole("p").alias("prompt"),
        whole("c").alias("chosen"),
        whole("r").alias("rejected"),
        _mask("c").alias("chosen_mask"),
        _mask("r").alias("rejected_mask"),
        F.col("n_p").alias("prompt_turns"),
        F.col("n_c").alias("chosen_turns"),
        F.col("n_r").alias("rejected_turns"),
    )


def _render(x: Column) -> Column:
    head = F.concat(F.lit("<|"), x["role"], F.lit("|>\n"))
    return F.struct(
        F.concat(head, x["text"], F.lit("<|end|>\n")).alias("all"),
        F.length(head).alias("head"),
        F.length(x["text"]).alias("text"),
        (x["role"] == "assistant").alias("learned"),
    )


def _mask(side: str) -> Column:
    """Spans of the assistant's texts; a part has at most ``part_turns`` turns, so sums over what precedes are cheap."""
    spans = F.transform(
        side,
        lambda x, i: F.when(
            x["learned"],
            F.struct(
                (F.aggregate(F.slice(side, F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y["all"])) + x["head"]).alias("start"),
                (F.aggregate(F.slice(side, F.lit(1), i), F.lit(0), lambda s, y: s + F.length(y["all"])) + x["head"] + x["text"]).alias("end"),
            ),
        ),
    )
    return F.filter(spans, lambda x: x.isNotNull())
