"""Reading edge tables: text files of ``src dst ts`` lines, static and untimed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SCHEMA = "src long, dst long, ts long"


def _is_data(line: Column) -> Column:
    return (line != "") & ~line.startswith("#") & ~line.startswith("%")


def _fields(lines: DataFrame) -> DataFrame:
    line = F.trim(F.regexp_replace("value", r"\s+", " "))
    return (
        lines.withColumn("_line", line)
        .filter(_is_data(F.col("_line")))
        .withColumn("_f", F.split("_line", " "))
    )


def _number(position: int) -> Column:
    return F.get("_f", F.lit(position)).try_cast("long")


def parse_temporal_edges(lines: DataFrame) -> DataFrame:
    """Edges from text lines; blank, comment and malformed lines are dropped."""
    return (
        _fields(lines)
        .select(
            *[c for c in lines.columns if c != "value"],
            _number(0).alias("src"),
            _number(1).alias("dst"),
            _number(2).alias("ts"),
        )
        .dropna(subset=["src", "dst", "ts"])
    )


def read_temporal_edges(spark: SparkSession, path: str) -> DataFrame:
    """Headerless whitespace-separated ``src dst ts`` lines."""
    return parse_temporal_edges(spark.read.text(path))


def read_static_edges(spark: SparkSession, path: str) -> DataFrame:
    """The first two fields of each line; whatever follows is ignored."""
    return (
        _fields(spark.read.text(path))
        .select(_number(0).alias("src"), _number(1).alias("dst"))
        .dropna()
    )


def read_binned_edges(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_binned_edges``; a filter on ``bin`` reads only those bins' files."""
    return spark.read.parquet(path).select("src", "dst", "ts", "bin")


def read_edge_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet edge table written by this library (only the edge columns are read)."""
    return spark.read.parquet(path).select("src", "dst", "ts")


def read_dataset_dir(spark: SparkSession, path: str) -> DataFrame:
    """All ``.txt`` files of a folder as one table, named by file stem."""
    lines = spark.read.option("pathGlobFilter", "*.txt").text(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    return parse_temporal_edges(lines.select("value", stem.alias("dataset")))


def _trimmed(column: str):
    """Without white space of any kind at both ends, as the readers see a line."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def clean_edge_lines(lines: DataFrame) -> DataFrame:
    """Data lines only, trimmed; see ``edge_line_counts`` for what was dropped."""
    line = _trimmed("value")
    return lines.filter(_is_data(line)).select(line.alias("value"))


def edge_line_counts(lines: DataFrame) -> DataFrame:
    """Lines read, comments, blank lines and data lines (one row)."""
    line = _trimmed("value")
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(line.startswith("#") | line.startswith("%")).alias("comments"),
        F.count_if(line == "").alias("blank"),
        F.count_if(_is_data(line)).alias("data"),
    )


def backfill_timestamps(
    edges: DataFrame, lo: int = 1_000_000_000, hi: int = 1_157_760_000, seed: int = 42
) -> DataFrame:
    """Give untimed edges a timestamp in ``[lo, hi]``, sorted by it.

    The value is a hash of the edge, so a retried task gives the same one.
    Repeats of an edge get the same timestamp.
    """
    ts = F.lit(lo) + F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(hi - lo + 1))
    return edges.select("src", "dst", ts.alias("ts")).orderBy("ts", "src", "dst")
