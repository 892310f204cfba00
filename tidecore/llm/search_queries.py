"""Thin queries of the operators on names, ranked search and statistics of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecore.llm.outliers import robust_outliers
from tidecore.llm.ranked import rank_histories
from tidecore.llm.registry import query, table
from tidecore.llm.text_measures import text_measures
from tidecore.llm.variants import name_variants

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str) -> Column:
    """A-Z alone in lower case."""
    return F.translate(F.col(text), UPPER, LOWER)


def terms(text: str) -> Column:
    """Runs of letters, digits and characters beyond ASCII; empty strings may be among them."""
    return F.split(lowered(text), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


OP11_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents
), docs AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0
), size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs
), occurs AS (
  SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM occurs, size GROUP BY term, docs
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN occurs USING (term) JOIN weights USING (term), size GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0
)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""


@query("op11_ranked_lexical_search", OP11_SQL)
def op11(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("u"), terms("text").alias("contacts"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), terms("text").alias("contacts"))
    return rank_histories(docs, items, k=10).select(F.col("query").alias("item_id"), "rank", F.col("u").alias("doc_id"), "score")


def runs(docs: DataFrame) -> DataFrame:
    """Every run of letters of the documents, some of them with a letter left out, as the contract says."""
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lowered("text"), F.lit("[A-Za-z\u00C0-\u00FF]+"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    return run.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, less).otherwise(F.col("run")).alias("name"), F.lit(1).alias("n"))


OP13_SQL = """
WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
         lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
), occurs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
  ) GROUP BY 1, 2
), bytes AS (
  SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM occurs
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, length(x), 2),
      lambda i: CAST((strpos('0123456789ABCDEF', x[i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 2]) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, crc[CAST(xor(c & 255, b) AS INTEGER) + 1]))) AS h
  FROM bytes, t
), noisy AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS w, n FROM hashed
), words AS (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM noisy GROUP BY 1 HAVING sum(n) >= 3 AND length(w) >= 5
), cuts AS (
  SELECT w, n, p, left(w, p) || substr(w, p + 2) AS rest FROM (SELECT w, n, unnest(range(0, length(w))) AS p FROM words)
), links AS (
  SELECT a.w AS x, b.w AS y, b.n FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.w <> b.w
  UNION SELECT a.w, b.w, b.n FROM cuts a JOIN words b ON a.rest = b.w
  UNION SELECT b.w, a.w, a.n FROM cuts a JOIN words b ON a.rest = b.w
), best AS (
  SELECT x, count(*) AS n_near, max(n) AS top FROM links GROUP BY 1
), first AS (
  SELECT links.x, min(links.y) AS y FROM links JOIN best ON best.x = links.x AND best.top = links.n GROUP BY 1
), shaped AS (
  SELECT w AS word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * words.n THEN y END AS form, CASE WHEN top >= 2 * words.n THEN top END AS form_n
  FROM words LEFT JOIN best ON best.x = w LEFT JOIN first ON first.x = w
), chain(word, root) AS (
  SELECT word, word FROM shaped UNION ALL SELECT c.word, s.form FROM chain c JOIN shaped s ON s.word = c.root WHERE s.form IS NOT NULL
), roots AS (
  SELECT chain.word, chain.root FROM chain JOIN shaped ON shaped.word = chain.root WHERE shaped.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM shaped JOIN roots USING (word)
"""


@query("op13_spelling_variant_grouping", OP13_SQL)
def op13(spark, sf_dir) -> DataFrame:
    return name_variants(runs(table(spark, sf_dir, "documents"))).select(F.col("name").alias("word"), "form", "root", "n", "n_near", "form_n")


def rated(docs: DataFrame) -> DataFrame:
    """Counts of every document, whether they fail outright, and, of the others, rates per word and line."""
    counts = text_measures(docs.select(F.struct("doc_id").alias("doc"), "lang", "source", "text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rate = lambda part, whole, name: F.when(~F.col("base_failed"), F.col(part) / F.greatest(F.col(whole), F.lit(1))).alias(name)
    return counts.withColumn("base_failed", failed).select(
        "*",
        rate("word_chars", "n_words", "word_length"),
        rate("n_symbols", "n_words", "symbol_rate"),
        rate("n_dup_lines", "n_lines", "line_repeats"),
        rate("n_repeat_words", "n_words", "word_repeats"),
    )


@query("op12_quality_rules")
def op12(spark, sf_dir) -> DataFrame:
    rows = rated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    judged = robust_outliers(rows, ["word_length", "symbol_rate", "line_repeats", "word_repeats"], ["lang", "source"])
    kept = ~F.col("base_failed") & ~F.col("outlier")
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
