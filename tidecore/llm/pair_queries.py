"""Thin queries of the operators on pairs, packings and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecore.llm.gram_join import contact_gram_join
from tidecore.llm.grid_join import near_profiles
from tidecore.llm.nearest import nearest_profiles
from tidecore.llm.packing import pack_lists
from tidecore.llm.registry import query, table
from tidecore.llm.tokens import token_lists, with_crc


def words(text: str):
    """Words between ASCII white space, A-Z in lower case; empty strings may be among them."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(low, "[\\x20\\x09-\\x0D]+")


def histories(docs: DataFrame) -> DataFrame:
    """Documents as histories of words."""
    return docs.select(F.col("doc_id").alias("u"), words("text").alias("contacts"))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1
), common AS (SELECT s FROM g GROUP BY 1 HAVING count(*) > 1
), r AS (SELECT doc_id, s FROM g JOIN common USING (s)
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM r a JOIN r b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)
), both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), c(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT c.x, e.y FROM c JOIN both_ways e ON e.x = c.y
), m AS (SELECT x, min(y) AS component_id FROM c GROUP BY 1
), d AS (SELECT x, count(*) AS k FROM both_ways GROUP BY 1)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, CAST(coalesce(d.k, 0) AS BIGINT) AS n_links
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.x = documents.doc_id LEFT JOIN d ON d.x = documents.doc_id
"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return contact_gram_join(histories(docs), n=5, similarity=(3, 4)).select(
        F.col("u").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links")
    )


@query("op2_best_fit_packing")
def op2(spark, sf_dir) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed into sequences of at most 2048 tokens."""
    lists = token_lists(docs.select(F.col("doc_id").alias("u"), "text"))
    return with_crc(pack_lists(lists, capacity=2048)).select(
        F.col("u").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("block").alias("sequence_id"), "offset"
    )


def _profiles(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("u"), F.col("embedding").alias("profile"))


@query("op3_approximate_nearest_neighbours")
def op3(spark, sf_dir) -> DataFrame:
    return nearest_profiles(_profiles(spark, sf_dir), F.col("u") % 100 == 0, k=10).select(
        F.col("query").alias("query_id"), "rank", F.col("u").alias("vec_id"), F.col("distance").alias("score")
    )


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), c(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y
), m AS (SELECT x, min(y) AS component_id FROM c GROUP BY 1
), d AS (SELECT x, count(*) AS k FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(d.k, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.x = vec_id LEFT JOIN d ON d.x = vec_id
"""


@query("op5_embedding_near_dedup", OP5_SQL)
def op5(spark, sf_dir) -> DataFrame:
    return near_profiles(_profiles(spark, sf_dir), cosine=0.9).select(
        F.col("u").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept"
    )
