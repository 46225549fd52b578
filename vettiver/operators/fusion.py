"""Lane rankings, rank fusion and reranking. Ranks start at 1; ties go to the smaller parent_id as a string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettiver.functions.lexicon import DENSE_WEIGHT, LANE_WEIGHTS, by_language

DEPTH = 50
RRF_K = 20.0
RRF_K_V1 = 2.0
FUSED_K, FINAL_K = 30, 20


def lane_ranking(evidence: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, lane, parent_id, score, rank): each lane's parents by their best score; rows without lane, score or parent go."""
    rows = evidence.where(F.col("lane").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & (F.col("parent_id") != ""))
    best = rows.groupBy(key, "lane", "parent_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy(key, "lane").orderBy(F.col("score").desc(), "parent_id")
    return best.withColumn("rank", F.row_number().over(order))


def _top(rows: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("rrf").desc(), "parent_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lanes: DataFrame, key: str = "request_id", k: int = FUSED_K) -> DataFrame:
    """(key, parent_id, rrf, lanes, rank): the sum of weight / (20 + rank) over lanes of depth 50; unknown lanes weigh 1."""
    weight = F.lit(1.0)
    for lane, value in LANE_WEIGHTS.items():
        weight = F.when(F.col("lane") == lane, F.lit(value)).otherwise(weight)
    rows = lanes.where(F.col("rank") <= DEPTH).groupBy(key, "parent_id")
    fused = rows.agg(F.round(F.sum(weight / (RRF_K + F.col("rank"))), 9).alias("rrf"), F.array_sort(F.collect_set("lane")).alias("lanes"))
    return _top(fused, key, k)


def fuse_v1(lanes: DataFrame, languages: DataFrame, key: str = "request_id", k: int = FINAL_K) -> DataFrame:
    """(key, parent_id, rrf, rank): two lanes, the sum of 1 / (2 + rank / weight - 1), weights by language (1 for sparse)."""
    rows = lanes.where(F.col("lane").isin("dense_full", "sparse_full") & (F.col("rank") <= DEPTH)).join(languages.select(key, "language"), key)
    weight = F.when(F.col("lane") == "dense_full", by_language(F.col("language"), DENSE_WEIGHT, DENSE_WEIGHT["ta"])).otherwise(F.lit(1.0))
    fused = rows.groupBy(key, "parent_id").agg(F.round(F.sum(1 / (RRF_K_V1 + F.col("rank") / weight - 1)), 9).alias("rrf"))
    return _top(fused, key, k)


def lanes_agree(lanes: Column) -> Column:
    """A dense and a sparse lane both have the parent."""
    return F.exists(lanes, lambda x: x.startswith("dense")) & F.exists(lanes, lambda x: x.startswith("sparse"))


def minmax(value: str, key: str) -> Column:
    """``value`` between the smallest and the largest of its query, 0.5 where they are one."""
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo < 1e-9, F.lit(0.5)).otherwise((F.col(value) - lo) / (hi - lo))


def rerank(features: DataFrame, key: str = "request_id", k: int = FINAL_K) -> DataFrame:
    """(…, rerank_score, new_rank): the weighted features, less a penalty where anchors exist and none is met.

    ``features`` has rrf, evidence, anchor_coverage, coverage, agree, phrase and n_anchors.
    """
    score = 0.28 * minmax("rrf", key) + 0.27 * F.col("anchor_coverage") + 0.20 * F.col("coverage") + 0.15 * minmax("evidence", key)
    score = score + 0.05 * F.col("agree").cast("int") + 0.05 * F.col("phrase").cast("int")
    score = score - F.when((F.col("n_anchors") > 0) & (F.col("anchor_coverage") == 0), 0.18).otherwise(0.0)
    order = Window.partitionBy(key).orderBy(F.col("rerank_score").desc(), "parent_id")
    scored = features.withColumn("rerank_score", F.round(score, 9))
    return scored.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k)


def packed(ranked: DataFrame, key: str = "request_id", budget: int = 350, most: int = 2, chars: int = 175) -> DataFrame:
    """(key, block, parent_id, snippet): numbered snippets in rank order until the budget would be passed.

    ``ranked`` has rank, parent_id and snippet; parents without a snippet are skipped. A block costs its length and 2
    for the gap after it; the first that does not fit ends the packing, so what fits is a running sum.
    """
    short = F.substring("snippet", 1, chars)
    order = Window.partitionBy(key).orderBy("rank")
    rows = ranked.where("snippet <> ''").withColumn("block", F.row_number().over(order)).where(F.col("block") <= most)
    rows = rows.withColumn("snippet", F.concat(F.lit("["), F.col("block").cast("string"), F.lit("] "), short))
    used = F.sum(F.length("snippet") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.withColumn("ends", F.coalesce(used, F.lit(0)) + F.length("snippet"))
    return ends.where(F.col("ends") <= budget).select(key, "block", "parent_id", "snippet")
