"""Parquet scans with column aliases and the tables of the project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettiver.functions.shared import spread

TEXT_ALIASES = ("text", "chunk_text", "content")
QUERY_ALIASES = ("query", "translated_query", "target_query", "Query")
QUERY_ID_ALIASES = ("query_id", "id")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def resolve_column(df: DataFrame, aliases: Sequence[str]) -> str:
    """The first of ``aliases`` that ``df`` has; ``ValueError`` if it has none."""
    for alias in aliases:
        if alias in df.columns:
            return alias
    raise ValueError(f"none of the columns {list(aliases)} is in {df.columns}")


def read_chunks(spark: SparkSession, folder: str, name: str, language: str) -> DataFrame:
    """Chunks as (language, parent_id, chunk_id, text): ids as strings, null text as ''.

    Rows delivered twice with one chunk_id count once. A null chunk_id stays null and its rows are all kept.
    """
    raw = table(spark, folder, name)
    chunks = raw.select(
        F.lit(language).alias("language"),
        F.col("parent_id").cast("string").alias("parent_id"),
        (F.col("chunk_id") if "chunk_id" in raw.columns else F.lit(None)).cast("string").alias("chunk_id"),
        F.coalesce(F.col(resolve_column(raw, TEXT_ALIASES)).cast("string"), F.lit("")).alias("text"),
    )
    return spread(chunks, *chunks.columns).distinct()


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The Tamil and the Hindi chunk tables as one DataFrame with a language column."""
    return read_chunks(spark, folder, "tamil", "ta").unionByName(read_chunks(spark, folder, "hindi", "hi"))


def read_queries(spark: SparkSession, folder: str, name: str = "validation_queries") -> DataFrame:
    """Evaluation questions as (query_id, language, query), whatever their columns are called."""
    raw = table(spark, folder, name)
    return raw.select(
        F.col(resolve_column(raw, QUERY_ID_ALIASES)).cast("string").alias("query_id"),
        F.col("language"),
        F.col(resolve_column(raw, QUERY_ALIASES)).alias("query"),
    )


DEPTH_ANALYSIS = "candidate_depth_100"


def read_labels(raw: DataFrame) -> DataFrame:
    """Relevance labels as (query_id, language, relevant_parent_ids string): of the deep analysis only, where the table has several."""
    rows = raw.where(F.col("analysis_type") == DEPTH_ANALYSIS) if "analysis_type" in raw.columns else raw
    return rows.select(F.col("query_id").cast("string").alias("query_id"), "language", F.col("relevant_parent_ids").cast("string").alias("relevant_parent_ids"))
