"""The queries of the training-data problems: (session, folder of tables) to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vettiver.llm import near_copies, neighbours, one_form, packing, percentiles, sentences, subjects, tokens
from vettiver.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Start and end of each sentence of the Tamil chunks and of the evidence in all its languages."""
    tamil = sentences.sentences(table(spark, folder, "tamil").select("chunk_id", "text"), "chunk_id", "text")
    evidence = sentences.sentences(table(spark, folder, "sourceevidence").select("evidence_id", "text"), "evidence_id", "text")
    both = tamil.withColumn("src", F.lit("tamil")).unionByName(evidence.withColumn("src", F.lit("sourceevidence")))
    return both.select("src", F.col("key").alias("text_key"), "start_pos", "end_pos").distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that show a known question in other characters, and Tamil chunks that read the same."""
    asked = one_form.shown_questions(
        table(spark, folder, "queryrequest").select("request_id", "query"), table(spark, folder, "validation_queries").select("query_id", "query")
    )
    chunks = one_form.equal_looking_pairs(table(spark, folder, "tamil").select("chunk_id", "text"), "chunk_id", "text")
    return asked.select(F.lit("queryrequest").alias("src"), "key_a", "key_b").unionByName(chunks.select(F.lit("tamil").alias("src"), "key_a", "key_b"))


PERCENTS = (50, 70, 90, 95, 99)
METRICS = ("full_rag_ttft_ms", "retrieval_ms", "embed_ms")


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "full_rag_t4_per_query").select("result_id", "language", F.to_date("run_ts").alias("run_day"), "run_id", *METRICS)


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact latency percentiles per language, and per language and run day: the counts of days combine into those of all time."""
    levels = {"language": ["language"], "language_day": ["language", "run_day"]}
    return percentiles.percentiles(_log(spark, folder), "result_id", levels, ["language", "run_day"], METRICS, PERCENTS)


def p1_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The same per language and run: a run is the log's file."""
    return percentiles.percentiles(_log(spark, folder), "result_id", {"language_run": ["language", "run_id"]}, ["language", "run_id"], METRICS, PERCENTS)


_P1 = """
WITH once AS (
  SELECT min(language) AS language, min(CAST(run_ts AS DATE)) AS run_day, min(run_id) AS run_id,
    min(full_rag_ttft_ms) AS a, min(retrieval_ms) AS b, min(embed_ms) AS c
  FROM full_rag_t4_per_query GROUP BY result_id),
long AS (
  SELECT * FROM (
    SELECT language, run_day, run_id, 'full_rag_ttft_ms' AS metric, a AS v FROM once UNION ALL
    SELECT language, run_day, run_id, 'retrieval_ms', b FROM once UNION ALL
    SELECT language, run_day, run_id, 'embed_ms', c FROM once) WHERE v IS NOT NULL AND NOT isnan(v)),
levels AS ({levels}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, language, {part}, metric ORDER BY v) AS r,
    count(*) OVER (PARTITION BY level, language, {part}, metric) AS total FROM levels),
wanted AS (SELECT CAST(unnest([50, 70, 90, 95, 99]) AS INTEGER) AS percent)
SELECT level, language, {part}, metric, percent, total, v AS value
FROM ranked, wanted WHERE r = (total * percent + 99) // 100
"""
P1_SQL = _P1.format(
    levels="SELECT 'language' AS level, language, CAST(NULL AS DATE) AS run_day, metric, v FROM long UNION ALL SELECT 'language_day', language, run_day, metric, v FROM long", part="run_day"
)
P1_RUNS_SQL = _P1.format(levels="SELECT 'language_run' AS level, language, run_id, metric, v FROM long", part="run_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of one language that have at least three quarters of their words in common."""
    found = [near_copies.pairs_of_keys(*near_copies.near_copies(table(spark, folder, name), "chunk_id", "text")) for name in ("tamil", "hindi")]
    return found[0].unionByName(found[1]).select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk of at least eight words with the class of near-copies it belongs to and its number of links."""
    found = [
        near_copies.classes(*near_copies.near_copies(table(spark, folder, name), "chunk_id", "text")).select(F.lit(name).alias("src"), "key", "class_key", "links")
        for name in ("tamil", "hindi")
    ]
    return found[0].unionByName(found[1]).select("src", F.col("key").alias("chunk_id"), F.col("class_key").alias("class_id"), "links")


#: The chance of being retrieved that the tenth neighbour must have; rows without it ask all vectors.
NEED = 0.95


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "metadata").select(F.col("vector_row").alias("row"))
    return neighbours.nearest(table(spark, folder, "vectors"), "vector_row", "embedding", named, need=NEED)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of vector rows of which one is among the ten most similar of the other."""
    found = _nearest(spark, folder)
    return found.select(F.least("row_a", "row_b").alias("row_a"), F.greatest("row_a", "row_b").alias("row_b")).distinct()


def p5_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every vector row that 100 divides, with the chunks of both."""
    found = _nearest(spark, folder).where("row_a % 100 = 0")
    chunks = table(spark, folder, "metadata").where("vector_row IS NOT NULL").groupBy("vector_row").agg(F.min("chunk_id").alias("chunk"))
    a = chunks.select(F.col("vector_row").alias("row_a"), F.col("chunk").alias("chunk_a"))
    b = chunks.select(F.col("vector_row").alias("row_b"), F.col("chunk").alias("chunk_b"))
    return found.join(a, "row_a").join(b, "row_b").select("row_a", "chunk_a", "row_b", "chunk_b", F.round("similarity", 6).alias("similarity"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k; empty and null texts have the empty list."""
    return tokens.token_ids(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that has text in containers of 8,192 tokens."""
    sizes = tokens.token_counts(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, "doc_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects that at least a quarter of each document's sentences or clauses is devoted to."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "source", "kind")
    return subjects.subjects_of(documents, table(spark, folder, "subject_example"), table(spark, folder, "subject_area"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_percentiles": p1_percentiles,
    "p1_runs": p1_runs,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_chunks": p5_chunks,
    "p6_ids": p6_ids,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
}

ORACLE_SQL: dict[str, str] = {
    "p1_percentiles": P1_SQL,
    "p1_runs": P1_RUNS_SQL,
}
