"""Recall, hits, percentiles, abstention and failure reports, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettiver.functions.lexicon import NOT_FOUND

FAILURES = ("PASS", "CORPUS_MISS", "RETRIEVAL_MISS", "CONTEXT_PACKING_MISS", "GENERATION_MISS", "GROUNDING_REJECTION", "UNKNOWN")


def recall_and_hit(ranked: DataFrame, relevant: DataFrame, key: str = "query_id", k: int = 20) -> DataFrame:
    """(key, relevant, hits, recall_20, hit_20): distinct hits over distinct relevant parents; questions without any are not in it."""
    wanted = relevant.select(key, "parent_id").distinct()
    found = ranked.where(F.col("rank") <= k).select(key, "parent_id", F.lit(1).alias("hit")).distinct()
    both = wanted.join(found, [key, "parent_id"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("relevant"), F.count("hit").alias("hits"))
    return both.withColumns({"recall_20": F.round(F.col("hits") / F.col("relevant"), 9), "hit_20": F.col("hits") > 0})


MARKS = {"p50": 0.5, "p70": 0.7, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Cells of an octave in which values are counted before they are ordered.
PER_OCTAVE = 64


def latency_report(log: DataFrame, keys: Sequence[str], stages: Sequence[str]) -> DataFrame:
    """(keys, stage, n, p50, p70, p90, p95, p99, p100, mean): interpolated percentiles of each stage; null and NaN do not count.

    Values are counted in cells first, which tells the cells that hold the two exact ranks on either side of each mark;
    only the different values of those cells are ordered. No group's values come into one buffer.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("ms")) for s in stages]))
    rows = log.select(*keys, pairs.alias("x")).select(*keys, "x.stage", "x.ms").where(F.col("ms").isNotNull() & ~F.isnan("ms"))
    size = F.floor(F.log2(F.abs("ms") + 1) * PER_OCTAVE)
    values = rows.withColumn("cell", F.when(F.col("ms") < 0, -size).otherwise(size).cast("int")).groupBy(*keys, "stage", "cell", "ms").agg(F.count(F.lit(1)).alias("n"))
    group = [*keys, "stage"]
    cells = values.groupBy(*group, "cell").agg(F.sum("n").alias("held"), F.sum(F.col("ms") * F.col("n")).alias("sum"), F.max("ms").alias("top"))
    every, upto = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumns({"upto": F.sum("held").over(upto), "total": F.sum("held").over(every), "mean": F.sum("sum").over(every) / F.sum("held").over(every), "p100": F.max("top").over(every)})
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("total") - 1) * p), F.ceil((F.col("total") - 1) * p)) for p in MARKS.values()])))
    here = F.filter(wanted, lambda r: (r >= F.col("upto") - F.col("held")) & (r < F.col("upto")))
    held = cells.withColumn("ranks", here).where(F.size("ranks") > 0).select(*[F.col(g).alias(f"_{g}") for g in group], F.col("cell").alias("_cell"), (F.col("upto") - F.col("held")).alias("below"), "total", "mean", "p100", "ranks")
    same = F.col("cell") == F.col("_cell")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    ordered = Window.partitionBy(*group, "cell").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.join(held, same).withColumn("last", F.col("below") + F.sum("n").over(ordered) - 1)
    found = placed.withColumn("rank", F.explode(F.filter("ranks", lambda r: (r <= F.col("last")) & (r > F.col("last") - F.col("n")))))
    ranked = found.groupBy(*group, "total", "mean", "p100").agg(F.map_from_entries(F.collect_list(F.struct("rank", "ms"))).alias("at"))

    def mark(p: float) -> Column:
        spot = (F.col("total") - 1) * p
        lo, hi = F.col("at")[F.floor(spot)], F.col("at")[F.ceil(spot)]
        return F.round(lo + (hi - lo) * (spot - F.floor(spot)), 6)

    return ranked.select(*group, F.col("total").alias("n"), *[mark(p).alias(name) for name, p in MARKS.items()], "p100", F.round("mean", 6).alias("mean"))


def with_labels(ranked: DataFrame, labels: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, language, relevant_parent_ids, ranked, packed): sampled labels with what was found for them.

    A label without a ranking raises ``ValueError``: no label may be lost.
    """
    lost = labels.join(ranked, key, "left_anti").limit(1).count()
    if lost:
        raise ValueError("a label has no question")
    return labels.join(ranked, key)


def packed_hit(packed: Column, relevant: Column) -> Column:
    """A relevant parent is among the packed ones."""
    return F.arrays_overlap(F.coalesce(packed, F.array().cast("array<string>")), relevant)


def missing_names(required: DataFrame, existing: DataFrame) -> DataFrame:
    """The names that are required and not there, once each."""
    return required.distinct().exceptAll(existing.distinct())


def share_under(value: str, limit: float = 200.0) -> Column:
    """The percentage of values below ``limit``, null and NaN left out."""
    good = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    return F.round(F.avg((good < limit).cast("double")) * 100, 6)


def abstention_report(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates of hits, packed hits, abstention, false abstention and truncation, and of answers where evidence was packed."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    packed, missing = F.col("packed_hit"), F.col("is_not_found")
    answered = F.sum((packed & ~missing).cast("bigint"))
    return log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("hit_20")).alias("hit_rate"),
        rate(packed).alias("packed_rate"),
        rate(missing).alias("not_found_rate"),
        rate(packed & missing).alias("false_abstention"),
        rate(F.col("possibly_truncated")).alias("truncation_rate"),
        F.round(answered / F.greatest(F.sum(packed.cast("bigint")), F.lit(1)), 9).alias("answer_rate"),
    )


def failure_class(corpus: Column, retrieved: Column, packed: Column, raw: Column, allowed: Column, final: Column) -> Column:
    """The first stage at which the expected answer was lost."""
    return (
        F.when(final & allowed, "PASS")
        .when(~corpus, "CORPUS_MISS")
        .when(~retrieved, "RETRIEVAL_MISS")
        .when(~packed, "CONTEXT_PACKING_MISS")
        .when(~raw, "GENERATION_MISS")
        .when(~allowed | ~final, "GROUNDING_REJECTION")
        .otherwise("UNKNOWN")
    )


def failure_report(log: DataFrame, failure: Column) -> DataFrame:
    """(failure, n, percent) of every class, those without a row too."""
    spark = log.sparkSession
    domain = spark.createDataFrame([(f,) for f in FAILURES], "failure string")
    counted = log.groupBy(failure.alias("failure")).agg(F.count(F.lit(1)).alias("n"))
    rows = domain.join(counted, "failure", "left").select("failure", F.coalesce("n", F.lit(0)).alias("n"))
    return rows.withColumn("percent", F.round(F.col("n") * 100 / F.greatest(F.sum("n").over(Window.partitionBy(F.lit(1))), F.lit(1)), 6))


def abstained(answer: Column, allowed: Column) -> Column:
    return F.coalesce(answer.startswith(NOT_FOUND), F.lit(True)) | ~allowed


def hash_sample(questions: DataFrame, n: int, salt: str) -> DataFrame:
    """The ``n`` questions of each language with the smallest SHA-256 of salt, language and id."""
    digest = F.sha2(F.concat_ws(":", F.lit(salt), "language", "query_id"), 256)
    order = Window.partitionBy("language").orderBy("digest", "query_id")
    return questions.withColumn("digest", digest).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def parsed_list(value: Column) -> Column:
    """A list from a list's JSON, or one value; null gives none. Items are trimmed, blank ones go; broken JSON is one value."""
    v = F.trim(value)
    parsed = F.when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))
    clean = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(clean)


def ranking_parity(golden: DataFrame, candidate: DataFrame, key: str, k: int = 20) -> DataFrame:
    """(key, golden, same): how many of the first ``k`` places of two rankings hold the same parent."""
    a = golden.where(F.col("rank") <= k).select(key, "rank", F.col("parent_id").alias("golden"))
    b = candidate.where(F.col("rank") <= k).select(key, "rank", F.col("parent_id").alias("candidate"))
    both = a.join(b, [key, "rank"], "left")
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("places"), F.count(F.when(F.col("golden") == F.col("candidate"), 1)).alias("same"))
