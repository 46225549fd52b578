"""Compact, contiguous windows of evidence around what answers the question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettiver.functions import text as T

CHARS = 240
NEIGHBOURS = 1


def pack_scores(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` with the pack score of the strongest unit of each row's text: 0 where anchors or constraints fail.

    ``df`` has query and language. A text without a unit scores 0.
    """
    units = df.select(*keys, "query", "language", F.posexplode_outer(T.evidence_units(T.evidence_sentences(F.col(text)))).alias("unit_pos", "unit"))
    rows = T.with_support(units, unit="unit")
    best = F.max_by(F.struct("score", "strong", "anchors_ok", "constraints_ok", "contradiction"), F.struct("strong", "score", F.round("coverage", 9), "matched", (-F.col("unit_pos")).alias("first")))
    strongest = rows.where("unit IS NOT NULL").groupBy(*keys).agg(best.alias("b"))
    ok = F.col("b.anchors_ok") & F.col("b.constraints_ok") & ~F.col("b.contradiction")
    return strongest.select(*keys, T.pack_score(F.col("b.score"), F.col("b.strong"), ok).alias("pack"))


def evidence_windows(df: DataFrame, key: str, chars: int | str = CHARS) -> DataFrame:
    """(key, window): the text if it fits, else its best sentence with its neighbours, else the best crop of those.

    ``df`` has the unique key, query, text and language; ``chars`` is a number or the name of a column. Crops are the head,
    the tail and one window for each term of the query, a third of it before the term; of equal scores the first stays.
    Blank and null texts give ''.
    """
    most = (F.lit(chars) if isinstance(chars, int) else F.col(chars)).cast("int").alias("most")
    rows = df.select(key, "query", "language", T.collapsed(F.coalesce("text", F.lit(""))).alias("u"), most).withColumn("sents", T.evidence_sentences(F.col("u")))
    long = rows.where(F.length("u") > F.col("most"))
    each = long.select(key, "query", "language", F.posexplode("sents").alias("pos", "sentence"))
    scored = each.join(pack_scores(each, [key, "pos"], "sentence"), [key, "pos"], "left")
    best = scored.groupBy(key).agg(F.max_by("pos", F.struct(F.coalesce("pack", F.lit(0.0)).alias("pack"), (-F.col("pos")).alias("first"))).alias("best"))
    lo = F.greatest(F.col("best") - NEIGHBOURS, F.lit(0))
    hi = F.least(F.col("best") + NEIGHBOURS + 1, F.size("sents"))
    local = long.join(best, key).select(key, "query", "language", "most", F.array_join(F.slice("sents", lo + 1, hi - lo), " ").alias("local"))
    wide = local.where(F.length("local") > F.col("most"))
    crops = T.let(T.folded(F.col("local")), lambda f: F.filter(F.transform(F.filter(T.terms(F.col("query")), lambda t: F.length(t) >= 2), lambda t: F.instr(f, t)), lambda p: p > 0))
    crops = F.transform(crops, lambda p: F.substring(F.col("local"), F.greatest(p - 1 - F.floor(F.col("most") / 3).cast("int"), F.lit(0)) + 1, F.col("most")))
    ends = F.array(F.substring(F.col("local"), F.lit(1), F.col("most")), F.substring(F.col("local"), F.length("local") - F.col("most") + 1, F.col("most")))
    windows = wide.select(key, "query", "language", F.posexplode(F.transform(F.concat(ends, crops), lambda w: F.trim(w))).alias("pos", "window"))
    judged = windows.join(pack_scores(windows, [key, "pos"], "window"), [key, "pos"], "left").where("window <> ''")
    cropped = judged.groupBy(key).agg(F.max_by("window", F.struct(F.coalesce("pack", F.lit(0.0)).alias("pack"), (-F.col("pos")).alias("first"))).alias("cropped"))
    joined = rows.select(key, "u", "most").join(local.select(key, "local"), key, "left").join(cropped, key, "left")
    return joined.select(key, F.when(F.length("u") <= F.col("most"), F.col("u")).when(F.length("local") <= F.col("most"), F.col("local")).otherwise(F.col("cropped")).alias("window"))
