"""Exact percentiles against sorting, with all the values that doubles have."""

import math
import random

import pytest

pytest.importorskip("vettiver.llm")
from pyspark.sql import functions as F  # noqa: E402

from vettiver.llm import percentiles as Q  # noqa: E402


def want(values, percent):
    values = sorted(values)
    return values[-(-len(values) * percent // 100) - 1]


def test_every_kind_of_value(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        v = rng.choice([rng.lognormvariate(3, 2), -rng.random(), 0.0, -0.0, 5e-324, 1e308, -1e308, math.inf, -math.inf, math.nan, None, 100 + 1e-12 * rng.random(), round(rng.random() * 9, 2)])
        rows.append((i, rng.choice(["a", "b", None]), rng.randint(0, 3), v))
    df = spark.createDataFrame([*rows, *rows[:500]], "id bigint, g string, d int, v double")
    got = Q.percentiles(df, "id", {"all": ["g"], "day": ["g", "d"]}, ["g", "d"], ["v"], [1, 50, 90, 99, 100])
    got = {(r["level"], r["g"], r["d"], r["percent"]): (r["total"], r["value"]) for r in got.collect()}
    groups = {}
    for _, g, d, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(("all", g, None), []).append(v)
            groups.setdefault(("day", g, d), []).append(v)
    assert got == {(*k, p): (len(x), want(x, p)) for k, x in groups.items() for p in (1, 50, 90, 99, 100)}


def test_rank_error_is_kept(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(4000)]
    df = spark.createDataFrame(list(enumerate(values)), "id bigint, v double").withColumn("g", F.lit("x"))
    for r in Q.percentiles(df, "id", {"g": ["g"]}, ["g"], ["v"], [10, 50, 95], rank_error=0.01).collect():
        rank = sum(v <= r["value"] for v in values)
        assert abs(rank - len(values) * r["percent"] / 100) <= 0.01 * len(values) + 1


def test_null_ids_all_count_and_empty_gives_nothing(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, "x", 1.0), (1, "x", 5.0), (1, "x", 5.0)], "id bigint, g string, v double")
    row = Q.percentiles(df, "id", {"g": ["g"]}, ["g"], ["v"], [50]).first()
    assert (row["total"], row["value"]) == (3, 1.0)
    assert Q.percentiles(df.limit(0), "id", {"g": ["g"]}, ["g"], ["v"], [50]).count() == 0


def test_partials_add_up(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(100)], "id bigint, d int, v double")
    parts = Q.partial_counts(Q.long_values(df, ["d"], ["v"]), ["d"])
    total = Q.combine(parts, [])
    assert total.agg(F.sum("n")).first()[0] == 100
    row = Q.intervals(total, [], [50]).first()
    assert row["below"] < 50 <= row["below"] + row["n"] and row["lo"] <= 49.0 <= row["hi"]
