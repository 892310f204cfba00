"""Counts of words, symbols and repeats in texts, by DataFrame functions only.

The project has no records with texts, so this is general.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Words of a window that may be found again.
WINDOW = 8


def text_measures(texts: DataFrame) -> DataFrame:
    """Add counts to every row that has a ``text``; all other columns stay, ``text`` goes.

    ``n_words`` and ``word_chars`` (words stand between ASCII white space; code points),
    ``n_symbols`` (characters of ``SYMBOLS``), ``n_lines`` (lines with a word), ``n_dup_lines`` (those equal to an earlier
    one) and ``n_repeat_words`` (words that lie in a window of ``WINDOW`` words found twice or more in the text), all
    bigint. A null text counts as empty, and an empty one has zeros. Windows are compared by 64-bit hashes.
    A text is worked on in one row, in memory that follows its length.
    Input columns with the names of the counts are refused.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    taken = set(made) & set(texts.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are made here")
    kept = [c for c in texts.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    own = texts.select(*kept, text.alias("_text"), F.btrim(text, F.lit(SPACE)).alias("_trim"))
    words = F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    n_symbols = F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))
    split = own.select(*kept, n_symbols.cast("long").alias("n_symbols"), words.alias("_words"), lines.alias("_lines"))
    hashed = split.select(
        *kept,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    n = F.size("_hashes") - (WINDOW - 1)
    # single elements: slice() copies its whole array every time
    window = lambda i: F.xxhash64(*(F.get("_hashes", i + j) for j in range(WINDOW)))
    windows = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), window))
    placed = hashed.withColumn("_windows", windows).drop("_hashes")
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = placed.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    met = lambda x, j: (x["h"] == F.get("_sorted", j - 1)["h"]) | (x["h"] == F.get("_sorted", j + 1)["h"])
    twice = F.transform(F.filter("_sorted", met), lambda x: x["i"])
    placed = placed.withColumn("_at", F.sort_array(twice)).drop("_windows", "_sorted")
    return placed.select(*kept, *made[:-1], F.coalesce(_covered("_at"), F.lit(0)).cast("long").alias(made[-1]))


def _covered(starts: str) -> Column:
    """Words covered by windows that begin at the ascending places ``starts``."""
    own = F.transform(starts, lambda a, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - a, F.lit(WINDOW))))
    return F.aggregate(own, F.lit(0), lambda total, k: total + k)
