"""Registered queries: (session, folder of tables) to DataFrame. Every query reads whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vettiver.functions import text as T
from vettiver.functions.extract import answer_span
from vettiver.functions.lexicon import NOT_FOUND, NOT_FOUND_MESSAGE, NOT_FOUND_MESSAGES, PROMPT, UNSAFE, by_language
from vettiver.operators import candidates, dense, evaluate, fusion, sparse, windows
from vettiver.functions.shared import materialise, spread
from vettiver.sources.tables import DEPTH_ANALYSIS, read_corpus, read_labels, read_queries, table
from vettiver.streaming import transcripts

STAGES = ("embed_ms", "dense_ms", "bm25_ms", "retrieval_ms", "context_ms", "prompt_prep_ms", "model_first_token_ms", "generation_ttft_ms", "full_rag_ttft_ms", "full_rag_complete_ms")
SALT = "vettiver-sample-1"
SAMPLED = 50


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests once each: (request_id, query, language), null query as ''."""
    rows = table(spark, folder, "queryrequest").where("request_id IS NOT NULL")
    return rows.select("request_id", F.coalesce("query", F.lit("")).alias("query"), "language").distinct()


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence once each: (evidence_id, request_id, parent_id, chunk_id, lane, score, text), null text as ''."""
    rows = table(spark, folder, "sourceevidence").where("evidence_id IS NOT NULL")
    score = F.when(~F.isnan("score"), F.col("score"))
    return rows.select("evidence_id", "request_id", "parent_id", "chunk_id", "lane", score.alias("score"), F.coalesce("text", F.lit("")).alias("text")).distinct()


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece of evidence with the request it was found for."""
    return spread(evidence(spark, folder).join(requests(spark, folder), "request_id"), "evidence_id")


def log(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """``columns`` of the result log, each result once; no other column is read."""
    return table(spark, folder, "full_rag_t4_per_query").select("result_id", *columns).distinct()


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(language, query, raw_answer, truncated): the different answers of the log."""
    rows = table(spark, folder, "full_rag_t4_per_query").where("query IS NOT NULL AND raw_answer IS NOT NULL")
    return spread(rows.groupBy("language", "query", "raw_answer").agg(F.max("possibly_truncated").alias("truncated")), "raw_answer")


def validate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    blank = F.trim("text") == ""
    return read_corpus(spark, folder).groupBy("language").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("parent_id").alias("n_parents"), F.count(F.when(F.col("chunk_id").isNull(), 1)).alias("n_null_ids"), F.count(F.when(blank, 1)).alias("n_blank")
    )


def validate_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Counts that must agree before the vectors are searched: rows, usable rows, rows with metadata."""
    vectors = table(spark, folder, "vectors")
    usable = dense.usable_vectors(vectors).select("vector_row")
    named = table(spark, folder, "metadata").select("vector_row").distinct().withColumn("named", F.lit(1))
    rows = vectors.select("vector_row").distinct()
    joined = rows.join(usable.withColumn("usable", F.lit(1)), "vector_row", "left").join(named, "vector_row", "left")
    ready = F.count(F.when(F.col("usable").isNotNull() & F.col("named").isNotNull(), 1))
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count("usable").alias("n_usable"), F.count("named").alias("n_named"), ready.alias("n_ready"))


def embedding_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and dimension of the usable vectors, and the mean length of those in the first thousand rows."""
    v = dense.usable_vectors(table(spark, folder, "vectors"))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("embedding")).cast("bigint").alias("dimension"), F.round(F.avg(F.when(F.col("vector_row") < 1000, size)), 6).alias("mean_sample_norm"))


def tokenize_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = sparse.postings(read_corpus(spark, folder)).groupBy("language", "term").agg(F.sum("tf").alias("n"))
    return rows.groupBy("language").agg(F.sum("n").alias("n_tokens"), F.count(F.lit(1)).alias("n_distinct"))


def content_terms(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("request_id", F.array_join(T.content_terms(F.col("query"), F.coalesce("language", F.lit(""))), " ").alias("terms"))


def informative_terms(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("request_id", F.array_join(T.informative_terms(F.col("query"), F.coalesce("language", F.lit(""))), " ").alias("terms"))


def required_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("request_id", F.array_join(T.required_anchors(F.col("query"), F.coalesce("language", F.lit(""))), " ").alias("anchors"))


def fuzzy_matches(spark: SparkSession, folder: str) -> DataFrame:
    """How many terms of the request each piece of evidence matches, by each of the three matchers."""
    rows = pairs(spark, folder).withColumn("language", F.coalesce("language", F.lit("")))
    rows = rows.withColumn("asked", F.array_distinct(T.terms(F.col("query")))).withColumn("shown", F.array_distinct(T.terms(F.col("text"))))
    engine = T.matched_count(F.col("asked"), F.col("shown"), lambda a, b: T.match_engine(a, b, F.col("language")))
    return rows.select(
        "evidence_id",
        engine.alias("n_engine"),
        T.matched_count(F.col("asked"), F.col("shown"), T.match_evidence).alias("n_evidence"),
        T.matched_count(F.col("asked"), F.col("shown"), T.match_guardrail).alias("n_guardrail"),
    )


def grounding_form(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("request_id", T.grounding_form(F.col("query")).alias("form"))


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.fixed_chunks(table(spark, folder, "documents"))


def postings(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.postings(read_corpus(spark, folder)).select("language", "chunk_id", "term", "tf", "dl")


def term_df(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.term_df(read_corpus(spark, folder))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.corpus_stats(read_corpus(spark, folder)).withColumn("avgdl", F.round("avgdl", 9))


def idf_proxy(spark: SparkSession, folder: str) -> DataFrame:
    """Of the terms of all requests in Tamil and Hindi."""
    asked = requests(spark, folder).where("language IN ('ta', 'hi')").select("language", F.explode(T.terms(F.col("query"))).alias("term"))
    return sparse.idf_proxy(read_corpus(spark, folder), asked)


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    return read_queries(spark, folder).select("query_id", F.lit("full").alias("view"), "language", F.col("query").alias("text"))


def bm25_chunk_topk(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.bm25(read_corpus(spark, folder), _asked(spark, folder)).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def bm25_parent_collapse(spark: SparkSession, folder: str) -> DataFrame:
    hits = sparse.bm25(read_corpus(spark, folder), _asked(spark, folder))
    return sparse.collapse_parents(hits, ["query_id"]).select("query_id", "parent_rank", "parent_id", "chunk_id")


def anchor_terms(spark: SparkSession, folder: str) -> DataFrame:
    found = sparse.anchor_terms(read_queries(spark, folder), read_corpus(spark, folder))
    return found.select("query_id", F.array_join("anchors", " ").alias("anchors"), F.round("top_idf", 6).alias("top_idf"))


def query_views(spark: SparkSession, folder: str) -> DataFrame:
    return sparse.query_views(read_queries(spark, folder), read_corpus(spark, folder)).select("query_id", "view", "text")


def sparse_lanes(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, lane, parent_id, rank) of the sparse lanes of all views."""
    corpus = read_corpus(spark, folder)
    hits = sparse.bm25(corpus, sparse.query_views(read_queries(spark, folder), corpus))
    lanes = sparse.collapse_parents(hits, ["query_id", "view"])
    return lanes.select("query_id", F.concat(F.lit("sparse_"), "view").alias("lane"), "parent_id", F.col("parent_rank").alias("rank"))


def sparse_fused(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.fuse(sparse_lanes(spark, folder), "query_id").select("query_id", "rank", "parent_id", "rrf")


def _vector_hits(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "metadata").select("vector_row").distinct()
    vectors = dense.usable_vectors(table(spark, folder, "vectors")).join(named, "vector_row", "left_semi")
    return dense.exact_topk_among(vectors, F.expr("vector_row % 100 = 0"))


def vector_topk_cosine(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred nearest of every vector row that 100 divides, among all rows."""
    return _vector_hits(spark, folder).select("query_row", "rank", "vector_row", F.round("similarity", 6).alias("similarity"))


def dense_parent_collapse(spark: SparkSession, folder: str) -> DataFrame:
    parents = table(spark, folder, "metadata").groupBy("vector_row").agg(F.min("parent_id").alias("parent_id"))
    hits = _vector_hits(spark, folder).join(parents, "vector_row")
    return sparse.collapse_parents(hits, ["query_row"]).select("query_row", "parent_rank", "parent_id", "vector_row")


def lane_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return fusion.lane_ranking(evidence(spark, folder)).select("request_id", "lane", "rank", "parent_id")


def rrf_v3(spark: SparkSession, folder: str) -> DataFrame:
    lanes = fusion.lane_ranking(evidence(spark, folder))
    return fusion.fuse(lanes).select("request_id", "rank", "parent_id", "rrf", fusion.lanes_agree(F.col("lanes")).alias("agree"))


def rrf_v1(spark: SparkSession, folder: str) -> DataFrame:
    lanes = fusion.lane_ranking(evidence(spark, folder))
    return fusion.fuse_v1(lanes, requests(spark, folder)).select("request_id", "rank", "parent_id", "rrf")


def ranking_parity(spark: SparkSession, folder: str) -> DataFrame:
    lanes = fusion.lane_ranking(evidence(spark, folder))
    each = evaluate.ranking_parity(fusion.fuse_v1(lanes, requests(spark, folder)), fusion.fuse(lanes), "request_id")
    return each.groupBy("places").agg(F.count(F.lit(1)).alias("n_requests"), F.sum("same").alias("n_same"))


def support_signal(spark: SparkSession, folder: str) -> DataFrame:
    """How far each piece of evidence, as one unit, supports an answer to its request; and its pack score."""
    rows = T.with_support(pairs(spark, folder))
    ok = F.col("anchors_ok") & F.col("constraints_ok") & ~F.col("contradiction")
    score = T.pack_score(F.col("score"), F.col("strong"), ok)
    return rows.select("evidence_id", "matched", "total", F.round("coverage", 6).alias("coverage"), "anchors_ok", "constraints_ok", "contradiction", "strong", F.round("score", 6).alias("score"), F.round(score, 6).alias("pack_score"))


def evidence_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = evidence(spark, folder).select("evidence_id", F.posexplode(T.evidence_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.select("evidence_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


def _unit_support(spark: SparkSession, folder: str) -> DataFrame:
    units = T.evidence_units(T.evidence_sentences(F.col("text")))
    rows = pairs(spark, folder).drop("score").select("evidence_id", "request_id", "parent_id", "lane", "language", "query", F.posexplode(units).alias("pos", "unit"))
    return T.with_support(rows, unit="unit")


def evidence_units(spark: SparkSession, folder: str) -> DataFrame:
    units = T.evidence_units(T.evidence_sentences(F.col("text")))
    rows = evidence(spark, folder).select("evidence_id", F.posexplode(units).alias("pos", "unit"))
    return rows.select("evidence_id", F.col("pos").cast("bigint").alias("pos"), "unit")


def _strongest(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece of evidence with its best unit: strong first, then score, coverage, matches; the first of equals."""
    best = F.max_by(F.struct("unit", "strong", "score", "coverage", "matched", "anchors_ok", "constraints_ok", "contradiction"), F.struct("strong", "score", F.round("coverage", 9), "matched", (-F.col("pos")).alias("first")))
    rows = _unit_support(spark, folder).groupBy("evidence_id", "request_id", "parent_id", "lane", "language", "query").agg(best.alias("b")).select("*", "b.*").drop("b")
    ok = F.col("anchors_ok") & F.col("constraints_ok") & ~F.col("contradiction")
    return rows.withColumn("pack_score", T.pack_score(F.col("score"), F.col("strong"), ok))


def strongest_unit(spark: SparkSession, folder: str) -> DataFrame:
    return _strongest(spark, folder).select("evidence_id", "unit", "strong", F.round("score", 6).alias("score"), F.round("pack_score", 6).alias("pack_score"))


def merged_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence that is shown for each request and parent, and the chunk that is kept as the alternate."""
    rows = candidates.merged_evidence(evidence(spark, folder))
    return rows.select("request_id", "parent_id", "preferred.chunk_id", "preferred.lane", "preferred.score", F.col("alternate.chunk_id").alias("other_chunk"), F.col("alternate.lane").alias("other_lane"))


def _best(spark: SparkSession, folder: str) -> DataFrame:
    """The best candidate of each fused parent of each request, with its snippet."""
    rows = evidence(spark, folder)
    asked = requests(spark, folder).withColumn("language", F.coalesce("language", F.lit("")))
    fused = fusion.fuse(fusion.lane_ranking(rows)).select("request_id", "parent_id")
    merged = candidates.merged_evidence(rows).join(fused, ["request_id", "parent_id"], "left_semi")
    return candidates.best_candidates(candidates.parent_candidates(merged, read_corpus(spark, folder), asked), asked, windows.CHARS)


def best_candidate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _best(spark, folder)
    return rows.select("request_id", "parent_id", "chunk_id", "lane", "snippet", F.round("evidence", 6).alias("evidence"))


def _featured(best: DataFrame, fused: DataFrame, corpus: DataFrame, key: str = "request_id") -> DataFrame:
    """``best`` (of fused parents) with the features of the reranking, taken from the snippet.

    A term weighs its corpus idf, at least 1 and at most 8; anchors are the three terms with the highest idf. Questions and
    snippets are compared in their retrieval form; each different question is looked up once.
    """
    asked = best.select("language", F.col("query").alias("asked")).distinct().withColumn("query", T.retrieval_form(F.col("asked")))
    scored = sparse.scored_terms(asked, corpus, "asked").select("language", F.col("asked").alias("query"), "items")
    rows = fused.select(key, "parent_id", "rrf", "lanes").join(best, [key, "parent_id"]).join(scored, ["language", "query"])
    rows = spread(rows, key, "parent_id").withColumn("anchors", sparse.anchors_of(F.col("items"))).withColumn("form", T.retrieval_form(F.col("snippet")))
    lang, items, anchors = F.col("language"), F.col("items"), F.col("anchors")
    weight = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.greatest(F.lit(1.0), F.least(-x["neg"], F.lit(8.0))))

    def aligned(shown: Column) -> Column:
        hit = lambda t: F.exists(shown, lambda b: T.match_engine(t, b, lang))
        anchor = F.when(F.size(anchors) == 0, F.lit(0.0)).otherwise(F.size(F.filter(anchors, hit)) / F.size(anchors))
        matched = F.filter(items, lambda x: hit(x["term"]))
        coverage = F.when(F.size(items) == 0, F.lit(0.0)).otherwise(weight(matched) / weight(items))
        return F.struct(anchor.alias("anchor_coverage"), coverage.alias("coverage"))

    rows = rows.withColumn("a", T.let(T.terms(F.col("form")), aligned))
    phrase = (F.size(anchors) > 0) & F.contains("form", F.array_join(anchors, " "))
    return rows.select(
        key, "parent_id", "query", "language", *candidates.FIELDS, "snippet", "rrf", "evidence", "a.anchor_coverage", "a.coverage", fusion.lanes_agree(F.col("lanes")).alias("agree"),
        phrase.alias("phrase"), F.size(anchors).alias("n_anchors"),
    )


def _features(spark: SparkSession, folder: str) -> DataFrame:
    fused = fusion.fuse(fusion.lane_ranking(evidence(spark, folder)))
    return _featured(_best(spark, folder), fused, read_corpus(spark, folder))


def alignment_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = _features(spark, folder)
    return rows.select("request_id", "parent_id", F.round("anchor_coverage", 6).alias("anchor_coverage"), F.round("coverage", 6).alias("coverage"), "agree", "phrase")


def rerank_v3(spark: SparkSession, folder: str) -> DataFrame:
    rows = fusion.rerank(_features(spark, folder))
    return rows.select("request_id", "new_rank", "parent_id", F.round("rerank_score", 6).alias("rerank_score"))


def context_pack(spark: SparkSession, folder: str) -> DataFrame:
    ranked = fusion.rerank(_features(spark, folder)).select("request_id", "parent_id", F.col("new_rank").alias("rank"), "snippet")
    return fusion.packed(ranked)


def evidence_window(spark: SparkSession, folder: str) -> DataFrame:
    return windows.evidence_windows(pairs(spark, folder).select("evidence_id", "query", "text", "language"), "evidence_id")


def _packed(spark: SparkSession, folder: str, budget: int) -> DataFrame:
    ranked = fusion.rerank(_features(spark, folder)).withColumn("rank", F.col("new_rank"))
    return candidates.packed_blocks(ranked, budget, windows.CHARS, 2)


def context_pack_v3(spark: SparkSession, folder: str) -> DataFrame:
    """The snippets of the first two reranked parents; with their gap they always fit the budget of 490."""
    return _packed(spark, folder, 490).select("request_id", "block", "parent_id", F.col("snippet").alias("window"))


def context_pack_shrunk(spark: SparkSession, folder: str) -> DataFrame:
    """The same under a budget of 350: what does not fit is cut to what is left; with what the response says of each block."""
    return _packed(spark, folder, 350).select("request_id", "block", "parent_id", "chunk_id", "lane", "score", F.col("snippet").alias("window"))


def input_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    """The first reason against each request; null if there is none."""
    code = input_code(F.col("query"), F.col("language"))
    return requests(spark, folder).select("request_id", code.alias("code"), code.isNull().alias("allowed"))


def grounding_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a request has a parent and a context that is not blank."""
    found = context_pack(spark, folder).groupBy("request_id").agg(F.count(F.lit(1)).alias("blocks"))
    rows = requests(spark, folder).select("request_id").distinct().join(found, "request_id", "left")
    return rows.select("request_id", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.when(F.col("blocks").isNull(), "no_grounded_context").alias("code"))


def answer_shape(spark: SparkSession, folder: str) -> DataFrame:
    """The log's different answers, cleaned, with the tests of their shape."""
    lang = F.coalesce("language", F.lit(""))
    rows = answers(spark, folder).withColumn("answer", T.cleaned_answer(F.col("raw_answer")))
    a, q = F.col("answer"), F.col("query")
    return rows.select(
        "language", "query", "raw_answer", "answer", T.answer_type_ok(q, a, lang).alias("type_ok"), T.script_ok(a, lang).alias("script_ok"),
        T.echoes(a, q).alias("echo"), T.repeats(a).alias("repeats"), T.shape_ok(a, q, lang).alias("shape_ok"),
    )


def _contexts(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """``asked`` (language, query) with the best evidence found for the same question, its form, and its strongest unit.

    (language, query, context, form, strong_forms, best, span): the forms of all strong units, and of the strongest unit,
    if it is strong, the extracted span. Each question is worked on once, however many answers it has.
    """
    found = pairs(spark, folder).where(F.col("score").isNotNull() & (F.trim("text") != ""))
    context = found.groupBy("query").agg(F.max_by("text", F.struct("score", "evidence_id")).alias("context"))
    return understood(asked.join(context, "query").select("language", "query", "context"))


def understood(rows: DataFrame) -> DataFrame:
    """``rows`` (language, query, context) with lang, form, strong_forms, best and span of their context."""
    rows = spread(rows.withColumn("lang", F.coalesce("language", F.lit(""))), "query")
    units = rows.select("lang", "query", "language", F.posexplode(T.evidence_units(T.evidence_sentences(F.col("context")))).alias("pos", "unit"))
    judged = T.with_support(units, unit="unit")
    first = F.struct("strong", "score", F.round("coverage", 9), "matched", (-F.col("pos")).alias("first"))
    best = judged.groupBy("lang", "query").agg(F.max_by(F.struct("unit", "strong"), first).alias("best"))
    strong = judged.where("strong").withColumn("form", T.grounding_form(F.col("unit"))).groupBy("lang", "query").agg(F.collect_set("form").alias("strong_forms"))
    joined = rows.withColumn("form", T.grounding_form(F.col("context"))).join(best, ["lang", "query"], "left").join(strong, ["lang", "query"], "left")
    span = F.when(F.col("best.strong"), answer_span(F.col("query"), F.col("best.unit"), F.col("lang")))
    return joined.withColumn("strong_forms", F.coalesce("strong_forms", F.array().cast("array<string>"))).withColumn("span", span)


def _supported(form: Column) -> Column:
    """A strong unit holds the answer, or the whole context does; false without a context."""
    inside = F.exists("strong_forms", lambda unit: T.grounded(form, unit))
    return F.coalesce(inside | T.grounded(form, F.col("form")), F.lit(False))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    """The log's different answers with the context of their question, and whether it holds them."""
    rows = answers(spark, folder)
    contexts = _contexts(spark, folder, rows.select("language", "query").distinct()).drop("language").withColumnRenamed("query", "q")
    joined = rows.withColumn("l", F.coalesce("language", F.lit(""))).join(contexts, (F.col("l") == F.col("lang")) & (F.col("query") == F.col("q")), "left").drop("l", "q")
    joined = spread(joined, "raw_answer")
    return joined.withColumn("answer", T.cleaned_answer(F.col("raw_answer"))).withColumn("answer_form", T.grounding_form(F.col("answer")))


def answer_grounded(spark: SparkSession, folder: str) -> DataFrame:
    held = F.coalesce(T.grounded(F.col("answer_form"), F.col("form")), F.lit(False))
    return _judged(spark, folder).select("language", "query", "raw_answer", "answer", held.alias("grounded"))


def engine_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The engine's own check: the cleaned answer as it stands in the context, else the sentinel."""
    clean = T.engine_cleaned(F.col("raw_answer"))
    rows = _judged(spark, folder).select("language", "query", "raw_answer", "form", clean.alias("clean")).withColumn("clean_form", T.grounding_form(F.col("clean")))
    held = F.coalesce(T.engine_grounded(F.col("clean_form"), F.coalesce("form", F.lit(""))), F.lit(False))
    return rows.select("language", "query", "raw_answer", F.when(held, F.col("clean")).otherwise(NOT_FOUND).alias("engine_answer"))


def extract_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The span that the rules find in each piece of evidence's best unit."""
    rows = _strongest(spark, folder).withColumn("a", answer_span(F.col("query"), F.col("unit"), F.coalesce("language", F.lit(""))))
    return rows.select("evidence_id", F.col("a.span").alias("span"), F.col("a.confidence").alias("confidence"), F.col("a.method").alias("method"))


def guarded(rows: DataFrame) -> DataFrame:
    """``rows`` with final_answer, source and code by the output ladder.

    ``rows`` has language, query, raw_answer, truncated, answer and answer_form (cleaned), form, strong_forms and span. A sure
    span of a strong unit comes first, then the cleaned answer, then a likely span, else a message and the reason.
    """
    lang, q = F.coalesce("language", F.lit("")), F.col("query")
    missing = F.trim("raw_answer").startswith(NOT_FOUND)
    rows = rows.withColumn("missing", missing).withColumn("span_form", T.grounding_form(F.col("span.span")))
    fine = F.coalesce(T.shape_ok(F.col("span.span"), q, lang) & _supported(F.col("span_form")), F.lit(False))
    rows = rows.withColumn("sure", fine & (F.col("span.confidence") >= 0.90)).withColumn("likely", fine & (F.col("span.confidence") >= 0.60))
    kept = ~F.col("missing") & (F.col("answer") != "") & T.shape_ok(F.col("answer"), q, lang) & _supported(F.col("answer_form"))
    source = F.when(F.coalesce("sure", F.lit(False)), "span").when(F.coalesce(kept, F.lit(False)), "answer").when(F.coalesce("likely", F.lit(False)), "repair").otherwise("message")
    echo = (F.col("answer") != "") & T.echoes(F.col("answer"), q)
    code = F.when(F.col("missing"), "model_abstained").when(F.col("truncated"), "truncated_unsupported").when(echo, "question_echo").otherwise("unsupported_answer")
    message = by_language(lang, NOT_FOUND_MESSAGES, NOT_FOUND_MESSAGE)
    rows = rows.withColumn("source", source)
    final = F.when(F.col("source").isin("span", "repair"), F.col("span.span")).when(F.col("source") == "answer", F.col("answer")).otherwise(message)
    return rows.withColumn("final_answer", final).withColumn("code", F.when(F.col("source") == "message", code))


def output_guardrail(spark: SparkSession, folder: str) -> DataFrame:
    return guarded(_judged(spark, folder)).select("language", "query", "raw_answer", "final_answer", "source", "code")


def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.hash_sample(read_queries(spark, folder), SAMPLED, SALT).select("language", "nth", "query_id")


def parse_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "full_rag_t4_per_query").select("raw_answer").distinct()
    return rows.select("raw_answer", F.array_join(evaluate.parsed_list(F.col("raw_answer")), "|").alias("items"), F.size(evaluate.parsed_list(F.col("raw_answer"))).cast("bigint").alias("n_items"))


def recall_at_20(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and hit of the fused sparse lanes; relevant are the parents that were evidence for the same question."""
    questions = read_queries(spark, folder)
    relevant = pairs(spark, folder).join(questions.select("query_id", "query"), "query").where("parent_id <> ''").select("query_id", "parent_id")
    found = evaluate.recall_and_hit(fusion.fuse(sparse_lanes(spark, folder), "query_id", 20), relevant)
    return found.select("query_id", "relevant", "hits", F.round("recall_20", 6).alias("recall_20"), "hit_20")


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.latency_report(log(spark, folder, "language", *STAGES), ["language"], STAGES)


def under_200_share(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder, "language", "run_id", "full_rag_ttft_ms").groupBy("language", "run_id").agg(F.count(F.lit(1)).alias("n"), evaluate.share_under("full_rag_ttft_ms").alias("under_200"))


def abstention_report(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate.abstention_report(log(spark, folder, "language", "run_id", "hit_20", "packed_hit", "is_not_found", "possibly_truncated"), ["language", "run_id"])


def expected_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, language, expected): of each evaluation question the answer that was most often given on packed evidence."""
    rows = log(spark, folder, "query_id", "packed_hit", "is_not_found", "output_guardrail_code", "answer").where("packed_hit AND NOT is_not_found AND output_guardrail_code IS NULL AND answer <> ''")
    counted = rows.groupBy("query_id", "answer").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("query_id").agg(F.min_by("answer", F.struct((-F.col("n")).alias("n"), "answer")).alias("expected"))
    return read_queries(spark, folder).select("query_id", "language").join(best, "query_id")


def corpus_hits(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, expected): the expected answers that some chunk of the language holds.

    Every chunk is looked at once, with the answers of its language as one array: the evaluation questions are a fixed set.
    """
    wanted = expected_answers(spark, folder).withColumn("form", T.without_endings(T.grounding_form(F.col("expected")))).where("form <> ''")
    lists = wanted.groupBy("language").agg(F.collect_list(F.struct("query_id", "expected", "form")).alias("wanted"))
    chunks = read_corpus(spark, folder).select("language", T.grounding_form(F.col("text")).alias("shown"))
    held = chunks.join(lists, "language").select(F.explode(F.filter("wanted", lambda x: F.contains(F.col("shown"), x["form"]))).alias("x"))
    return held.select("x.query_id", "x.expected").distinct()


def failure_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """How many results were lost at each stage: the expected answer is looked for in the corpus, the raw and the final answer."""
    c = F.col
    rows = log(spark, folder, "query_id", "hit_20", "packed_hit", "answer", "raw_answer", "output_guardrail_code")
    known = expected_answers(spark, folder).select("query_id", T.grounding_form(c("expected")).alias("form")).join(corpus_hits(spark, folder).select("query_id", F.lit(True).alias("in_corpus")), "query_id", "left")
    rows = rows.join(known, "query_id", "left").withColumns({"raw": T.grounding_form(c("raw_answer")), "final": T.grounding_form(c("answer"))})
    true = lambda x: F.coalesce(x, F.lit(False))
    failure = evaluate.failure_class(
        true(c("in_corpus")), true(c("hit_20")), true(c("packed_hit")), T.contains_expected(c("form"), c("raw")), c("output_guardrail_code").isNull(), T.contains_expected(c("form"), c("final"))
    )
    return evaluate.failure_report(rows, failure)


def latency_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Of each result the time to the first token and to the end, summed up from its stages where it was not logged, and the rest."""
    c = lambda x: F.when(~F.isnan(x), F.col(x))
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    stages = ("retrieval_ms", "context_ms", "prompt_prep_ms", "model_first_token_ms")
    rows = log(spark, folder, "full_rag_ttft_ms", "full_rag_complete_ms", "generation_ttft_ms", *stages)
    first = F.coalesce(c("full_rag_ttft_ms"), sum((zero(x) for x in stages), F.lit(0.0)))
    complete = F.coalesce(c("full_rag_complete_ms"), zero("retrieval_ms") + zero("context_ms") + zero("generation_ttft_ms"))
    rest = F.greatest(complete - sum((zero(x) for x in stages), F.lit(0.0)), F.lit(0.0))
    return rows.where("result_id IS NOT NULL").select("result_id", F.round(first, 6).alias("ttft_ms"), F.round(complete, 6).alias("complete_ms"), F.round(rest, 6).alias("overhead_ms"))


SAMPLES = 5


def sample_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The first five questions of each language that have a result, with their first result's answer."""
    rows = log(spark, folder, "language", "query_id", "answer").where("query_id IS NOT NULL")
    first = rows.groupBy("language", "query_id").agg(F.min_by("answer", F.struct("result_id", "answer")).alias("answer"))
    nth = F.row_number().over(Window.partitionBy("language").orderBy("query_id"))
    return first.withColumn("nth", nth).where(F.col("nth") <= SAMPLES).select("language", "nth", "query_id", "answer")


def spoken_queries(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.spoken_queries(transcripts.frames(table(spark, folder, "events")))


def encoded_audio(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.encoded_audio(transcripts.frames(table(spark, folder, "events")))


def transcript_events(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.typed(transcripts.frames(table(spark, folder, "events"))).select("session", "ts", "event", "is_final")


def stt_final_latency(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.final_latency(transcripts.frames(table(spark, folder, "events")))


def input_code(query: Column, language: Column) -> Column:
    """The first reason against a question: empty, too long, of another language, unsafe; null if there is none."""
    code = F.when(T.collapsed(query) == "", "empty_query").when(F.length(query) > 500, "query_too_long")
    return code.when(~F.coalesce(language.isin("ta", "hi"), F.lit(False)), "unsupported_language").when(query.rlike(UNSAFE), "unsafe_content")


def dense_hits(vectors: DataFrame, metadata: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, view, rank, parent_id, chunk_id, score): nearest chunks of the same language for each view.

    There is no model that embeds a question: the vector of the view's best sparse chunk that has one stands for it, and is
    itself no hit.
    """
    named = metadata.where("vector_row IS NOT NULL").groupBy("vector_row").agg(F.min("parent_id").alias("parent_id"), F.min("chunk_id").alias("chunk_id"), F.min("language").alias("language"))
    held = dense.usable_vectors(vectors).join(named, "vector_row")
    by_chunk = held.where("chunk_id IS NOT NULL").groupBy("language", "chunk_id").agg(F.min("vector_row").alias("query_row"))
    seeds = hits.join(by_chunk, ["language", "chunk_id"]).groupBy("query_id", "view", "language").agg(F.min_by("query_row", "rank").alias("query_row"))
    found = None
    for language in ("ta", "hi"):
        own = held.where(F.col("language") == language).select("vector_row", "embedding")
        asked = own.join(seeds.where(F.col("language") == language).select(F.col("query_row").alias("vector_row")).distinct(), "vector_row", "left_semi")
        each = dense.exact_topk(asked, own)
        found = each if found is None else found.unionByName(each)
    joined = found.join(seeds.select("query_id", "view", "query_row"), "query_row").join(named.select("vector_row", "parent_id", "chunk_id"), "vector_row")
    return joined.select("query_id", "view", "rank", "parent_id", "chunk_id", F.col("similarity").alias("score"))


def _retrieved(spark: SparkSession, folder: str, questions: DataFrame) -> DataFrame:
    """(query_id, lane, rank, parent_id, chunk_id, score): the parents of all lanes of all views."""
    corpus = read_corpus(spark, folder)
    hits = materialise(sparse.bm25(corpus, sparse.query_views(questions, corpus)))
    lanes = None
    for name, rows in (("sparse_", hits), ("dense_", dense_hits(table(spark, folder, "vectors"), table(spark, folder, "metadata"), hits))):
        parents = sparse.collapse_parents(rows, ["query_id", "view"])
        each = parents.select("query_id", F.concat(F.lit(name), "view").alias("lane"), F.col("parent_rank").alias("rank"), "parent_id", "chunk_id", F.col("score").cast("double").alias("score"))
        lanes = each if lanes is None else lanes.unionByName(each)
    return materialise(lanes)


def rag_lanes(spark: SparkSession, folder: str) -> DataFrame:
    """What each lane finds for each evaluation question."""
    return _retrieved(spark, folder, read_queries(spark, folder)).select("query_id", "lane", "rank", "parent_id", "chunk_id", F.round("score", 6).alias("score"))


BUDGET = 490


def rag_response(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation question through the whole path, a lazy batch: blocked questions go round it and come back at the end.

    Input guardrail, views, sparse and dense lanes, fusion, best candidates with siblings, reranking, packing, grounding, and
    the output ladder. No model generates: its answer is the abstention, so that answers are extracted spans or messages.
    """
    corpus = read_corpus(spark, folder)
    asked = read_queries(spark, folder).withColumn("input_code", input_code(F.col("query"), F.col("language")))
    questions = asked.where("input_code IS NULL").select("query_id", "language", "query")
    lanes = _retrieved(spark, folder, questions)
    fused = materialise(fusion.fuse(lanes, "query_id"))
    rows = lanes.join(fused.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_semi").withColumn("evidence_id", F.format_string("%s:%05d", "lane", "rank")).withColumn("text", F.lit(None).cast("string"))
    merged = candidates.merged_evidence(rows, "query_id")
    best = candidates.best_candidates(candidates.parent_candidates(merged, corpus, questions, "query_id"), questions, windows.CHARS, "query_id")
    ranked = fusion.rerank(_featured(best, fused, corpus, "query_id"), "query_id").withColumn("rank", F.col("new_rank"))
    blocks = candidates.packed_blocks(ranked, BUDGET, windows.CHARS, 2, "query_id")
    shown = F.struct("block", "parent_id", "chunk_id", "lane", F.round("score", 6).alias("score"), "snippet")
    packs = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(shown)).alias("sources"))
    context = F.array_join(F.col("sources.snippet"), "\n\n")
    packed = materialise(questions.join(packs, "query_id").withColumn("context", context))
    known = understood(packed.select("language", "query", "context").distinct()).drop("language", "context").withColumnRenamed("query", "q")
    answered = packed.join(known, (F.col("language") == F.col("lang")) & (F.col("query") == F.col("q"))).drop("q", "lang")
    answered = guarded(answered.withColumns({"raw_answer": F.lit(NOT_FOUND), "truncated": F.lit(False), "answer": F.lit(""), "answer_form": F.lit("")}))
    out = asked.join(answered.select("query_id", "context", "sources", "final_answer", "source", "code"), "query_id", "left")
    message = by_language(F.coalesce("language", F.lit("")), NOT_FOUND_MESSAGES, NOT_FOUND_MESSAGE)
    code = F.coalesce("input_code", F.when(F.col("context").isNull(), "no_grounded_context"), "code")
    context = F.coalesce("context", F.lit(""))
    listed = lambda field: F.coalesce(F.array_join(F.transform(f"sources.{field}", lambda x: F.coalesce(x.cast("string"), F.lit("")) if field != "score" else F.coalesce(F.format_string("%.6f", x), F.lit(""))), ","), F.lit(""))
    prompt = F.concat(F.lit(PROMPT), F.lit("\n\nEvidence: "), context, F.lit("\n\nQuestion: "), "query", F.lit("\n\nAnswer:"))
    return out.select(
        "query_id", "language", context.alias("context"), listed("parent_id").alias("parents"), listed("chunk_id").alias("chunks"), listed("lane").alias("lanes"),
        prompt.alias("prompt"), F.coalesce("final_answer", message).alias("answer"), F.coalesce("source", F.lit("message")).alias("source"), code.alias("code"),
    )


def packed_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a relevant parent was packed for each labelled question; labels are the parents that were evidence for it."""
    questions = read_queries(spark, folder)
    found = pairs(spark, folder).join(questions.select("query_id", "query"), "query").where("parent_id <> ''")
    raw = found.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_set("parent_id"))).alias("relevant_parent_ids"))
    labels = read_labels(raw.join(questions.select("query_id", "language"), "query_id").withColumn("analysis_type", F.lit(DEPTH_ANALYSIS)))
    packed = rag_response(spark, folder).select("query_id", F.split("parents", ",").alias("packed"))
    rows = evaluate.with_labels(packed, labels).withColumn("relevant", evaluate.parsed_list(F.col("relevant_parent_ids")))
    return rows.select("query_id", F.size("relevant").cast("bigint").alias("n_relevant"), evaluate.packed_hit(F.col("packed"), F.col("relevant")).alias("packed_hit"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        validate_chunks, validate_vectors, embedding_report, tokenize_stats, content_terms, informative_terms, required_anchors, fuzzy_matches, grounding_form,
        chunk_fixed, postings, term_df, corpus_stats, idf_proxy, bm25_chunk_topk, bm25_parent_collapse, anchor_terms, query_views, sparse_lanes, sparse_fused,
        vector_topk_cosine, dense_parent_collapse, lane_ranking, rrf_v3, rrf_v1, ranking_parity, support_signal, evidence_sentences, evidence_units, strongest_unit, merged_evidence, best_candidate,
        alignment_features, rerank_v3, context_pack, evidence_window, context_pack_v3, context_pack_shrunk, input_guardrail, grounding_guardrail, answer_shape, answer_grounded, engine_answer, extract_answer, output_guardrail, hash_sample, parse_list,
        recall_at_20, latency_percentiles, under_200_share, abstention_report, expected_answers, corpus_hits, failure_attribution, latency_accounting, sample_answers, spoken_queries, encoded_audio, transcript_events, stt_final_latency, rag_lanes, rag_response, packed_hits,
    )
}
