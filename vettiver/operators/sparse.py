"""Inverted index tables, BM25 and its lanes.

Chunks have (language, parent_id, chunk_id, text). Empty chunks count in the number of chunks and the mean length, as a
chunk that is never found. Scores are rounded to nine decimals before they rank, ties go to the smaller chunk_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettiver.functions.lexicon import B, K1, by_language
from vettiver.functions.text import content_terms, retrieval_form, terms

CHUNK_K = 350
PARENT_K = 50
CHUNK_CHARS, CHUNK_STEP = 384, 288
STRONG_IDF = 2.0
ANCHORS = 3


def fixed_chunks(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(parent_id, chunk_no, chunk) of 384 characters, each 288 after the one before; null and empty texts have none."""
    n = F.length(text)
    many = F.greatest(F.ceil((n - CHUNK_CHARS) / CHUNK_STEP), F.lit(0)) + 1
    rows = documents.where(n > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), (many - 1).cast("bigint"))))
    start = (F.col("chunk_no") * CHUNK_STEP + 1).cast("int")
    return rows.select(F.col(key).cast("string").alias("parent_id"), "chunk_no", F.substring(F.col(text), start, F.lit(CHUNK_CHARS)).alias("chunk"))


def postings(chunks: DataFrame) -> DataFrame:
    """(language, parent_id, chunk_id, dl, term, tf): how often each term is in each chunk of dl terms."""
    rows = chunks.withColumn("terms", terms(F.col("text"))).withColumn("dl", F.size("terms").cast("bigint"))
    rows = rows.select("language", "parent_id", "chunk_id", "dl", F.explode("terms").alias("term"))
    return rows.groupBy("language", "parent_id", "chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(language, n_chunks, avgdl): one row for each language."""
    return chunks.groupBy("language").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size(terms(F.col("text"))).cast("double")).alias("avgdl"))


def term_df(chunks: DataFrame) -> DataFrame:
    """(language, term, df): in how many chunks a term is."""
    each = chunks.select("language", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return each.groupBy("language", "term").agg(F.count(F.lit(1)).alias("df"))


def idf_proxy(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(language, term, idf) of the terms of ``wanted`` (language, term): ln(1 + (N + 1) / (df + 1)), 0 for unknown ones."""
    known = term_df(chunks.join(F.broadcast(wanted.select("language").distinct()), "language", "left_semi"))
    found = wanted.select("language", "term").distinct().join(known, ["language", "term"], "left")
    found = found.join(F.broadcast(corpus_stats(chunks)), "language", "left")  # one row for each language
    idf = F.when(F.col("df") > 0, F.ln(1 + (F.col("n_chunks") + 1) / (F.col("df") + 1))).otherwise(F.lit(0.0))
    return found.select("language", "term", F.round(idf, 9).alias("idf"))


def bm25(chunks: DataFrame, asked: DataFrame, k: int = CHUNK_K) -> DataFrame:
    """(query_id, view, rank, language, parent_id, chunk_id, score): the ``k`` best chunks of each question's language.

    ``asked`` has (query_id, view, language, text); a term that a question repeats counts as often. Only postings of
    asked terms are aggregated: the terms of the questions go to the chunks first.
    """
    wanted = asked.select("query_id", "view", "language", F.explode(terms(F.col("text"))).alias("term"))
    wanted = wanted.groupBy("query_id", "view", "language", "term").agg(F.count(F.lit(1)).alias("qtf"))
    vocabulary = wanted.select("language", "term").distinct()
    rows = chunks.withColumn("terms", terms(F.col("text"))).withColumn("dl", F.size("terms").cast("bigint"))
    rows = rows.select("language", "parent_id", "chunk_id", "dl", F.explode("terms").alias("term")).join(vocabulary, ["language", "term"], "left_semi")
    held = rows.groupBy("language", "parent_id", "chunk_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    seen = held.groupBy("language", "term").agg(F.count(F.lit(1)).alias("df"))
    scored = held.join(seen, ["language", "term"]).join(F.broadcast(corpus_stats(chunks)), "language")  # one row for each language
    k1, b = by_language(F.col("language"), K1, K1["ta"]), by_language(F.col("language"), B, B["ta"])
    idf = F.ln(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = scored.select("language", "term", "parent_id", "chunk_id", part.alias("part")).join(wanted, ["language", "term"])
    total = parts.groupBy("query_id", "view", "language", "parent_id", "chunk_id").agg(F.round(F.sum(F.col("qtf") * F.col("part")), 9).alias("score"))
    best = Window.partitionBy("query_id", "view").orderBy(F.col("score").desc(), "chunk_id")
    return total.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def collapse_parents(hits: DataFrame, keys: list[str], k: int = PARENT_K) -> DataFrame:
    """Each parent's first hit, ranked by arrival, the first ``k``; the hits' own cut-off has come before."""
    first = Window.partitionBy(*keys, "parent_id").orderBy("rank")
    once = hits.where("parent_id <> ''").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    again = Window.partitionBy(*keys).orderBy("rank")
    return once.withColumn("parent_rank", F.row_number().over(again)).where(F.col("parent_rank") <= k)


def scored_terms(questions: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, language, query, items): the content terms with -idf and position, the rarest first."""
    asked = questions.select(key, "language", "query", F.posexplode_outer(content_terms(F.col("query"), F.col("language"))).alias("pos", "term"))
    scored = asked.join(idf_proxy(chunks, asked.where("term IS NOT NULL")), ["language", "term"], "left")
    items = F.array_sort(F.collect_list(F.when(F.col("term").isNotNull(), F.struct((-F.coalesce("idf", F.lit(0.0))).alias("neg"), "pos", "term"))))
    return scored.groupBy(key, "language", "query").agg(items.alias("items"))


def anchors_of(items: Column) -> Column:
    """The three rarest terms of ``items`` in the question's order; without a known term the first three."""
    known = F.slice(F.filter(items, lambda x: x["neg"] < 0), 1, ANCHORS)
    in_order = lambda xs: F.transform(F.array_sort(F.transform(xs, lambda x: F.struct(x["pos"].alias("pos"), x["term"].alias("term")))), lambda x: x["term"])
    return F.when(F.size(known) > 0, in_order(known)).otherwise(F.slice(in_order(items), 1, ANCHORS))


def anchor_terms(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, language, query, anchors, top_idf): the three rarest content terms in the question's order.

    Without a known term they are the first three content terms.
    """
    rows = scored_terms(questions, chunks)
    top = F.round(-F.coalesce(F.get("items", F.lit(0))["neg"], F.lit(0.0)), 9)
    return rows.select("query_id", "language", "query", anchors_of(F.col("items")).alias("anchors"), top.alias("top_idf"))


def query_views(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, language, view, text): the full question, and its anchors where one of them is rare enough."""
    rows = anchor_terms(questions, chunks).withColumn("full", retrieval_form(F.col("query"))).withColumn("anchor", F.array_join("anchors", " "))
    wanted = (F.size("anchors") > 0) & (F.col("anchor") != F.col("full")) & (F.col("top_idf") >= STRONG_IDF)
    full = F.struct(F.lit("full").alias("view"), F.col("full").alias("text"))
    views = F.when(wanted, F.array(full, F.struct(F.lit("anchor").alias("view"), F.col("anchor").alias("text")))).otherwise(F.array(full))
    return rows.select("query_id", "language", F.explode(views).alias("v")).select("query_id", "language", "v.view", "v.text")
