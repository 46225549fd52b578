"""Exact percentiles of very large numeric columns by bisection (problem 1).

A percentile is the smallest value that at least that share of its group's values reach: the value of rank
``ceil(n * percent / 100)``. The error is none in rank (``rank_error=0``), or the stated share of the group's count.

1. ``partial_counts`` counts each part's values (a file's, a day's) in cells that do not depend on the data, 32 to an
   octave. Partial results of several parts combine by adding: ``combine`` makes those of a longer period or a larger
   group, and ``intervals`` finds the cell, and so the value interval, that holds each wanted rank.
2. ``resolve`` halves on: it keeps a value interval for each group and percentile and, pass by pass, counts the rows
   below midpoints of all intervals at once (63 midpoints, six halvings), narrowing to the stretch with the rank,
   until the smallest and the largest value of every interval are one. Only rows of the cells found in 1 take part.

All counting is pre-aggregated before a shuffle, so a group with a third of all rows is no task of its own.
Null and NaN values do not count; infinite ones do, at the ends. A group without a value gives no row. Null group keys
are a group. Rows with one id count once (of differing copies each column's smallest value); rows with a null id all
count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise

PER_OCTAVE = 32
MIDPOINTS = 63
# Fixed value: far beyond any cell of a finite double.
BEYOND = 1_000_000
#: Interval tables of up to so many rows (about 100 bytes each) are sent to all executors; larger ones are joined by shuffle.
SMALL = 200_000


def cell_of(value: Column) -> Column:
    """The cell of a value: a number that never falls as the value rises."""
    octave = F.floor(F.log2(F.abs(value)) * PER_OCTAVE)
    return (
        F.when(value == float("inf"), F.lit(2 * BEYOND))
        .when(value == float("-inf"), F.lit(-2 * BEYOND))
        .when(value > 0, octave + BEYOND)
        .when(value < 0, -octave - BEYOND)
        .otherwise(F.lit(0))
        .cast("int")
    )


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``; rows with a null key are all kept."""
    guard = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    rest = [c for c in df.columns if c != key]
    return df.withColumn("__guard", guard).groupBy(key, "__guard").agg(*[F.min(c).alias(c) for c in rest]).select(*df.columns)


def long_values(df: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(groups, metric, v): one row for each value of ``metrics`` that counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]))
    rows = df.select(*groups, pairs.alias("x")).select(*groups, "x.metric", "x.v")
    return rows.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.col("v") + F.lit(0.0))


def partial_counts(values: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, metric, cell, n, lo, hi): how many values each cell holds, and the ends of what it holds."""
    counted = values.groupBy(*groups, "metric", cell_of(F.col("v")).alias("cell"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))


def combine(partials: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Partial counts of the parts that share ``groups``, as one: the parts' counts added."""
    return partials.groupBy(*groups, "metric", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _narrow(counted: DataFrame, group: Sequence[str], at: str, before: Column) -> DataFrame:
    """Each counted stretch with the number of values below it and of its group in all."""
    window = Window.partitionBy(*group).orderBy(at)
    return counted.withColumn("upto", before + F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, 0))).withColumn("below", F.col("upto") - F.col("n"))


def intervals(partials: DataFrame, groups: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """(groups, metric, percent, total, rank, cell, below, n, lo, hi): the value interval with each wanted rank."""
    group = [*groups, "metric"]
    summed = _narrow(partials, group, "cell", F.lit(0)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    wanted = F.array(*[F.struct(F.lit(p).alias("percent"), F.floor((F.col("total") * p + 99) / 100).alias("rank")) for p in percents])
    held = F.filter(wanted, lambda x: (x["rank"] > F.col("below")) & (x["rank"] <= F.col("upto")))
    return summed.withColumn("w", F.explode(held)).select(*group, "w.percent", "total", "w.rank", "cell", "below", "n", "lo", "hi")


def _sent(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= SMALL else small


def resolve(values: DataFrame, wanted: DataFrame, rank_error: float = 0.0) -> DataFrame:
    """(target, value) of each row of ``wanted`` (target, rank, total, below, n, lo, hi).

    ``values`` has (target, v): for each target all values from lo to hi, no others needed.
    """
    state = materialise(wanted.select("target", "rank", "total", "below", "n", "lo", "hi"))
    done = F.expr(f"lo = hi OR n - 1 <= {rank_error!r} * total")
    finished = state.where(done)
    state = state.where(~done)
    while (left := state.count()) > 0:
        sent = state.select("target", "lo", "hi", "below", "rank", "total")
        sent = F.broadcast(sent) if left <= SMALL else sent
        half = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        stretch = F.least(F.floor(half * (MIDPOINTS + 1)), F.lit(MIDPOINTS)).cast("int")
        within = values.join(sent, "target").where("v >= lo AND v <= hi")
        # intervals with infinite ends are cut into the ends and what lies between
        stretch = F.when(F.col("v") == F.col("lo"), F.lit(-1)).when(F.col("v") == F.col("hi"), F.lit(MIDPOINTS + 1)).otherwise(F.coalesce(stretch, F.lit(0)))
        keys = ["target", "rank", "total", F.col("below").alias("start"), stretch.alias("stretch")]
        counted = within.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        summed = _narrow(counted, ["target"], "stretch", F.col("start"))
        state = materialise(summed.where("rank > below AND rank <= upto").select("target", "rank", "total", "below", "n", "lo", "hi"))
        finished = finished.unionByName(state.where(done))
        state = state.where(~done)
    return finished.select("target", F.col("lo").alias("value"))


def percentiles(
    df: DataFrame, key: str, levels: dict[str, Sequence[str]], parts: Sequence[str], metrics: Sequence[str], percents: Sequence[int], rank_error: float = 0.0
) -> DataFrame:
    """(level, columns of ``parts``, metric, percent, total, value) for each level of grouping.

    ``parts`` are the columns that partial results are made for; a level groups by some of them, the others are null
    in its rows.
    """
    rows = once(df.select(key, *parts, *metrics), key)
    values = materialise(long_values(rows, parts, metrics).withColumn("cell", cell_of(F.col("v"))))
    partials = materialise(partial_counts(values, parts))
    found = []
    for level, groups in levels.items():
        each = intervals(combine(partials, groups), groups, percents)
        found.append(each.select(F.lit(level).alias("level"), *[F.col(p) if p in groups else F.lit(None).cast(df.schema[p].dataType).alias(p) for p in parts], *each.columns[len(groups) :]))
    wanted = found[0]
    for more in found[1:]:
        wanted = wanted.unionByName(more)
    names = ["level", *parts, "metric", "percent"]
    wanted = materialise(wanted.withColumn("target", F.xxhash64(*names)))
    open_cells = wanted.where("lo < hi")
    near = []
    for level, groups in levels.items():
        cells = open_cells.where(F.col("level") == level).groupBy(*groups, "metric", "cell").agg(F.collect_list("target").alias("targets"))
        cells = _sent(cells.select(*[F.col(c).alias(f"__{c}") for c in cells.columns]))
        same = (F.col("metric") == F.col("__metric")) & (F.col("cell") == F.col("__cell"))
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
        near.append(values.join(cells, same).select(F.explode("__targets").alias("target"), "v"))
    held = near[0]
    for more in near[1:]:
        held = held.unionByName(more)
    solved = resolve(materialise(held), wanted, rank_error)
    return wanted.join(solved, "target").select(*names, "total", "value")
