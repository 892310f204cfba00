"""The corpus pipeline: documents are filtered, deduplicated, cleaned of personal data and packed.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecore.llm import pair_queries, text_queries
from tidecore.llm.gram_join import contact_gram_join
from tidecore.llm.personal import personal_spans
from tidecore.llm.registry import long_rows
from tidecore.session import shared_path

# SQL cannot express the classifiers; the tests compare the stages with brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame) -> DataFrame:
    """Documents as texts with the rest of the row beside them."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").alias("u"), "text", F.struct(*rest).alias("rest"))


def _restored(flow: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    return flow.select(*(F.col(text).alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts."""
    long_rows(spark)
    scored = text_queries.quality_scores(spark, _carried(docs), sf_dir, carry=("text", "rest"))
    return _restored(scored.where(F.col("score") >= text_queries.THRESHOLD), docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the toxicity classifier does not reject."""
    long_rows(spark)
    scored = text_queries.toxicity_scores(spark, _carried(docs), sf_dir, carry=("text", "rest"))
    return _restored(scored.where(F.col("score") < text_queries.THRESHOLD), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id."""
    long_rows(spark)
    linked = contact_gram_join(pair_queries.histories(docs), n=5, similarity=(3, 4))
    away = linked.where("component <> u").select(F.col("u").alias("doc_id"))
    # rows that carry the same id and stand for one group are told apart only here
    same = linked.where("component = u and links > 0").groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    repeated = same.where("k > 1").select(F.col("u").alias("doc_id"))
    kept = docs.join(away.union(repeated), "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.union(once)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    long_rows(spark)
    clean = personal_spans(_carried(docs), carry=("rest",), redacted=True)
    out = _restored(clean, docs, "clean")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens."""
    long_rows(spark)
    return pair_queries.packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxicity),
    ("n-gram jaccard join", near_duplicates),
    ("pii", personal),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = shared_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
