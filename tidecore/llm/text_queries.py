"""Thin queries of the operators on texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecore.llm.pages import main_texts
from tidecore.llm.personal import KINDS, personal_spans
from tidecore.llm.pieces import encode_pieces
from tidecore.llm.preferences import format_preferences
from tidecore.llm.quality import score_quality
from tidecore.llm.registry import query, table
from tidecore.llm.toxicity import score_toxicity

THRESHOLD = 0.3


def texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("u"), "text")


def labels(spark, sf_dir, name: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("u"), F.col(name).alias("label"))


def fold(folds: int) -> Column:
    return F.crc32(F.col("u").cast("string").cast("binary")) % folds


def _scored(scores: DataFrame, held_out: Column) -> DataFrame:
    return scores.select(
        F.col("u").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def quality_scores(spark, docs: DataFrame, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return score_quality(docs, labels(spark, sf_dir, "quality"), fold(5) != 0, carry)


def toxicity_scores(spark, docs: DataFrame, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return score_toxicity(docs, labels(spark, sf_dir, "toxic"), fold(4) != 2, carry)


@query("op8_quality_classifier")
def op8(spark, sf_dir) -> DataFrame:
    return _scored(quality_scores(spark, texts(table(spark, sf_dir, "documents")), sf_dir), fold(5) == 0)


@query("op10_toxicity")
def op10(spark, sf_dir) -> DataFrame:
    return _scored(toxicity_scores(spark, texts(table(spark, sf_dir, "documents")), sf_dir), fold(4) == 2)


@query("op9_pii")
def op9(spark, sf_dir) -> DataFrame:
    found = personal_spans(texts(table(spark, sf_dir, "documents")))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col("u").alias("doc_id"),
        *(of(k) for k in KINDS),
        F.sha2(line(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


@query("op7_html_extraction")
def op7(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("u"), "html")
    return main_texts(pages).select("u.page_id", "u.url", "text", F.length("text").cast("long").alias("n_chars"))


@query("pipeline")
def pipeline(spark, sf_dir) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP4_SQL = """
WITH last AS (
  SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1
), answer AS (
  SELECT c.conv_id, c.turn, max(c.text) AS text FROM conversations c JOIN last USING (conv_id, turn) WHERE c.role = 'assistant' GROUP BY 1, 2
), sides AS (
  SELECT DISTINCT conv_id, 'chosen' AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION
  SELECT c.conv_id, 'rejected', c.turn, coalesce(c.role, ''),
         CASE WHEN c.role = 'assistant' AND a.turn IS NOT NULL THEN coalesce(o.text, '') ELSE coalesce(c.text, '') END
  FROM conversations c LEFT JOIN answer a ON a.conv_id = c.conv_id AND a.turn = c.turn LEFT JOIN answer o ON o.conv_id = c.conv_id + 1
), lists AS (
  SELECT conv_id, turn, list_sort(coalesce(list([role, text]) FILTER (side = 'chosen'), [])) AS c,
         list_sort(coalesce(list([role, text]) FILTER (side = 'rejected'), [])) AS r
  FROM sides GROUP BY 1, 2
), forks AS (SELECT conv_id, min(turn) AS fork FROM lists WHERE c <> r GROUP BY 1
), low AS (SELECT conv_id, min(turn) AS low FROM lists GROUP BY 1
), items AS (
  SELECT conv_id, (turn - low) // 256 AS part, turn, 'p' AS k, c AS x FROM lists JOIN low USING (conv_id) LEFT JOIN forks USING (conv_id) WHERE fork IS NULL OR turn < fork
  UNION ALL
  SELECT conv_id, (turn - low) // 256, turn, 'c', c FROM lists JOIN low USING (conv_id) JOIN forks USING (conv_id) WHERE turn >= fork AND len(c) > 0
  UNION ALL
  SELECT conv_id, (turn - low) // 256, turn, 'r', r FROM lists JOIN low USING (conv_id) JOIN forks USING (conv_id) WHERE turn >= fork AND len(r) > 0
), flat AS (
  SELECT conv_id, part, turn, k, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM items
), rendered AS (
  SELECT *, '<|' || x[1] || '|>' || chr(10) || x[2] || '<|end|>' || chr(10) AS a, length(x[1]) + 5 AS head FROM flat
), placed AS (
  SELECT *, CAST(coalesce(sum(length(a)) OVER (PARTITION BY conv_id, part, k ORDER BY turn, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + head AS s FROM rendered
), done AS (
  SELECT conv_id, part, k, string_agg(a, '' ORDER BY turn, i) AS body, count(DISTINCT turn) AS n,
         coalesce(string_agg(s || ':' || (s + length(x[2])), ',' ORDER BY turn, i) FILTER (x[1] = 'assistant'), '') AS mask
  FROM placed GROUP BY 1, 2, 3
)
SELECT conv_id, CAST(part AS BIGINT) AS part, coalesce(max(body) FILTER (k = 'p'), '') AS prompt, coalesce(max(body) FILTER (k = 'c'), '') AS chosen,
       coalesce(max(body) FILTER (k = 'r'), '') AS rejected, coalesce(max(mask) FILTER (k = 'c'), '') AS chosen_mask,
       coalesce(max(mask) FILTER (k = 'r'), '') AS rejected_mask, CAST(coalesce(max(n) FILTER (k = 'p'), 0) AS BIGINT) AS prompt_turns
FROM done GROUP BY 1, 2
"""


@query("op4_chat_formatting", OP4_SQL)
def op4(spark, sf_dir) -> DataFrame:
    """Chosen: a conversation. Rejected: the same, its last answer being that of the next conversation."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("a")).select("conv_id", "a.turn", "a.text")
    last = answers.select("conv_id", F.col("turn").alias("last_turn"))
    other = answers.select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("other"))
    wrong = turns.join(last, "conv_id", "left").join(other, "conv_id", "left")
    swapped = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    rejected = wrong.select("conv_id", F.lit("rejected").alias("side"), "turn", "role", F.when(swapped, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text"))
    sides = turns.select("conv_id", F.lit("chosen").alias("side"), "turn", "role", "text").union(rejected)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return format_preferences(sides.withColumnRenamed("conv_id", "pair")).select(
        F.col("pair").alias("conv_id"), "part", "prompt", "chosen", "rejected", line(F.col("chosen_mask")).alias("chosen_mask"), line(F.col("rejected_mask")).alias("rejected_mask"), "prompt_turns"
    )


@query("op6_sentencepiece")
def op6(spark, sf_dir) -> DataFrame:
    """Ids of every document, and whether decoding gives the document back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode_pieces(texts(table(spark, sf_dir, "documents")), path, carry=("text",), decoded=True)
    return encoded.select(
        F.col("u").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_digest"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    )
