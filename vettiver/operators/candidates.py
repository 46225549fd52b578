"""What may show for a parent that was retrieved: the evidence of its lanes, the text of its other chunks, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise, spread
from vettiver.operators.windows import evidence_windows, pack_scores

SIBLING = "sibling"
FIELDS = ("chunk_id", "lane", "score", "text")


def merged_evidence(evidence: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, parent_id, preferred, alternate): of each parent the evidence that is shown, and the other that is kept.

    ``evidence`` has lane, score, evidence_id, chunk_id, text; each lane has its best row. Of the sparse views the higher
    score is preferred (the full view among equals) and a full view that loses is the alternate; of the dense views the
    later one. Sparse evidence wins over dense evidence, which is then the alternate.
    """
    rows = evidence.where(F.col("lane").isNotNull() & F.col("score").isNotNull() & (F.col("parent_id") != ""))
    best = F.min_by(F.struct(*FIELDS), F.struct((-F.col("score")).alias("s"), "evidence_id"))
    lanes = rows.groupBy(key, "parent_id").pivot("lane", ["dense_full", "dense_anchor", "sparse_full", "sparse_anchor"]).agg(best)
    df, da, sf, sa = (F.col(c) for c in ("dense_full", "dense_anchor", "sparse_full", "sparse_anchor"))
    later = sa.isNotNull() & (sf.isNull() | (sa["score"] > sf["score"]))
    sparse, lost = F.when(later, sa).otherwise(sf), F.when(later, sf)
    dense, before = F.coalesce(da, df), F.when(da.isNotNull(), df)
    other = F.when(sparse.isNull(), before).otherwise(F.coalesce(dense, lost))
    return lanes.select(key, "parent_id", F.coalesce(sparse, dense).alias("preferred"), other.alias("alternate")).where(F.col("preferred").isNotNull())


def parent_candidates(merged: DataFrame, chunks: DataFrame, asked: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, parent_id, place, chunk_id, lane, score, text): every candidate once, in the order in which they are looked at.

    ``asked`` has (key, language, query), ``chunks`` the corpus. The preferred and the alternate evidence come first (with
    the chunk's text where their own is empty), then the parent's chunks by chunk_id. Those without text go.
    """
    rows = merged.join(asked.select(key, "language"), key)
    shown = rows.select(key, "parent_id", "language", F.posexplode(F.array("preferred", "alternate")).alias("place", "c")).where("c IS NOT NULL").select(key, "parent_id", "language", "place", "c.*")
    texts = chunks.where("chunk_id IS NOT NULL AND text <> ''").groupBy("language", "chunk_id").agg(F.min("text").alias("known"))
    shown = shown.join(texts, ["language", "chunk_id"], "left").withColumn("text", F.when(F.coalesce("text", F.lit("")) == "", F.col("known")).otherwise(F.col("text")))
    siblings = rows.select(key, "parent_id", "language").join(chunks.where("text <> ''"), ["language", "parent_id"])
    siblings = siblings.select(key, "parent_id", F.lit(2).alias("place"), "chunk_id", F.lit(SIBLING).alias("lane"), F.lit(None).cast("double").alias("score"), "text")
    every = shown.select(key, "parent_id", "place", *FIELDS).unionByName(siblings).where("text IS NOT NULL AND text <> ''")
    # the first of equal chunks and texts stays
    once = Window.partitionBy(key, "parent_id", "chunk_id", "text").orderBy("place")
    return every.withColumn("nth", F.row_number().over(once)).where("nth = 1").drop("nth")


def asked_texts(rows: DataFrame) -> DataFrame:
    """(query, language, text) once each with an ``id``: what is scored is scored once, however many requests repeat it."""
    return spread(rows.select("query", "language", "text").distinct().withColumn("id", text_id()), "id")


def text_id(*more: Column) -> Column:
    """What names a question with a text."""
    return F.sha2(F.concat_ws("\u0001", F.coalesce("language", F.lit("")), "query", "text", *more), 256)


def best_candidates(candidates: DataFrame, asked: DataFrame, chars: int, key: str = "request_id") -> DataFrame:
    """(key, parent_id, query, language, chunk_id, lane, score, text, snippet, evidence): each parent's strongest candidate.

    The strongest is that with the highest pack score, the first of equals; its window of ``chars`` is the snippet, whose
    own pack score is ``evidence``. Parents without a snippet go.
    """
    rows = candidates.join(asked.select(key, "language", "query"), key).withColumn("id", text_id())
    packs = pack_scores(asked_texts(rows), ["id"], "text")
    scored = rows.join(packs, "id", "left").withColumn("pack", F.coalesce("pack", F.lit(0.0)))
    first = Window.partitionBy(key, "parent_id").orderBy(F.col("pack").desc(), "place", F.col("chunk_id").asc_nulls_first(), "text")
    # what follows reads the best candidates several times
    best = materialise(scored.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "pack", "place"))
    windows = materialise(evidence_windows(asked_texts(best), "id", chars).where("window <> ''"))
    shown = best.join(windows, "id").withColumnRenamed("window", "snippet")
    own = asked_texts(shown.select("query", "language", F.col("snippet").alias("text"))).withColumnRenamed("id", "sid")
    value = pack_scores(own, ["sid"], "text").withColumnRenamed("pack", "evidence")
    sid = F.sha2(F.concat_ws("\u0001", F.coalesce("language", F.lit("")), "query", "snippet"), 256)
    # a question with a snippet has its score once
    out = shown.withColumn("sid", sid).join(value, "sid", "left").withColumn("evidence", F.coalesce("evidence", F.lit(0.0)))
    return out.select(key, "parent_id", "query", "language", *FIELDS, "snippet", "evidence")


def packed_blocks(ranked: DataFrame, budget: int, chars: int, most: int, key: str = "request_id", least: int = 80) -> DataFrame:
    """(key, block, parent_id, chunk_id, lane, score, snippet): snippets in rank order under a budget of characters.

    ``ranked`` has rank, query, language, text and snippet (the window of ``chars``). A block costs its length and, after
    the first, 2 for the gap. One that does not fit is cut to a window of what is left if that is ``least`` or more; else
    packing ends there. ``most`` is a small constant: each block is one step.
    """
    order = Window.partitionBy(key).orderBy("rank")
    rows = ranked.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).withColumn("gap", F.when(F.col("at") > 1, 2).otherwise(0))
    done = None
    rows = materialise(rows)
    used = rows.select(key).distinct().select(key, F.lit(0).alias("used"), F.lit(True).alias("open"))
    for block in range(1, most + 1):
        here = rows.where(F.col("at") == block).join(used, key).where("open").withColumn("left", F.lit(budget) - F.col("used") - F.col("gap"))
        here = here.withColumn("fits", F.length("snippet") <= F.col("left"))
        shrunk = here.where(~F.col("fits") & (F.col("left") >= least)).withColumn("id", text_id(F.col("left").cast("string")))
        cut = evidence_windows(shrunk.select("id", "query", "language", "text", "left").distinct(), "id", "left")
        kept = here.where("fits").select(key, "parent_id", *FIELDS, "snippet", "used", "gap")
        kept = kept.unionByName(shrunk.drop("snippet").join(cut.withColumnRenamed("window", "snippet"), "id").where("snippet <> ''").select(key, "parent_id", *FIELDS, "snippet", "used", "gap"))
        kept = kept.withColumn("block", F.lit(block)).withColumn("used", F.col("used") + F.col("gap") + F.length("snippet"))
        done = kept if done is None else done.unionByName(kept)
        used = kept.select(key, "used", F.lit(True).alias("open"))
    return done.select(key, "block", "parent_id", "chunk_id", "lane", "score", "snippet")
