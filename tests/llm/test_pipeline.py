"""The pipeline's stages against brute force on the smallest table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_brute import groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_document_of_each_group_stays(spark):
    rng_words = [f"w{i}" for i in range(40)]
    base = " ".join(rng_words)
    texts = [base, base + " x", base, "alone " * 3, None, "", "  ", "alone alone alone", "one two three four five six"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(1, texts[1], "en", "s", 1), (8, texts[8], "en", "s", 1), (None, "no name", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(0, base), (3, texts[3]), (4, None), (5, ""), (6, "  "), (8, texts[8]), (None, "no name")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_filters_keep_whole_rows(spark, sf_dir, docs):
    good = corpus_pipeline.quality(spark, docs, sf_dir)
    assert good.columns == docs.columns and good.schema == docs.schema
    kept = {r.doc_id for r in good.collect()}
    marked = docs.where(F.col("text").rlike("%%%|&&&|!!.*!!.*!!")).select("doc_id").collect()
    assert len(kept) > 0.6 * docs.count()
    assert sum(r.doc_id in kept for r in marked) <= 0.1 * max(1, len(marked))
    clean = corpus_pipeline.toxicity(spark, docs, sf_dir)
    assert clean.schema == docs.schema and clean.count() > 0.6 * docs.count()
    assert clean.join(docs, docs.columns, "left_anti").count() == 0


def test_groups_of_the_table(spark, docs):
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert kept == sorted({min(g) for g in groups(rows)})


def test_personal_data_goes(spark, docs):
    out = corpus_pipeline.personal(spark, docs, "")
    assert out.columns == docs.columns
    pattern = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"
    assert docs.where(F.col("text").rlike(pattern)).count() > 0
    assert out.where(F.col("text").rlike(pattern)).count() == 0
    assert out.where(F.col("n_chars") != F.length("text")).count() == 0
