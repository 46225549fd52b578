"""The output ladder, packing under a budget, candidates, reports and labels, on small cases of our own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vettiver.functions import text as T
from vettiver.operators import candidates, evaluate
from vettiver.plans import catalog as C
from vettiver.sources.tables import read_labels


def ladder(spark, rows):
    df = spark.createDataFrame(rows, "n int, language string, query string, context string, raw_answer string, truncated boolean")
    known = C.understood(df.where("context IS NOT NULL").select("language", "query", "context").distinct()).drop("context")
    joined = df.join(known, ["language", "query"], "left").withColumn("answer", T.cleaned_answer(F.col("raw_answer"))).withColumn("answer_form", T.grounding_form(F.col("answer")))
    return {r["n"]: (r["final_answer"], r["source"], r["code"]) for r in C.guarded(joined).collect()}


def test_every_step_of_the_ladder(spark):
    strong = "The barge Ilse is the oldest boat of Orrin"
    got = ladder(spark, [
        (1, "en", "which boat is oldest at Orrin?", strong, "The barge Ilse", False),
        (2, "en", "which boat is oldest at Orrin?", strong, "NOT_FOUND", False),
        # a span of weak evidence repairs nothing
        (3, "en", "who painted seven harbour walls yearly?", "Maro painted a fence", "NOT_FOUND", False),
        (4, "en", "who painted seven harbour walls yearly?", "Maro painted a fence", "Selim", True),
        (5, "en", "who painted seven harbour walls yearly?", "Maro painted a fence", "harbour walls", False),
        (6, "en", "who painted seven harbour walls yearly?", "Maro painted a fence", "", False),
        (7, "en", "who left?", None, "Maro", False),
    ])
    assert got[1] == ("The barge Ilse", "answer", None)
    assert got[2] == ("The barge Ilse", "repair", None)
    assert got[3][1:] == ("message", "model_abstained")
    assert got[4][1:] == ("message", "truncated_unsupported")
    assert got[5][1:] == ("message", "question_echo")
    assert got[6][1:] == ("message", "unsupported_answer")
    assert got[7][1:] == ("message", "unsupported_answer")


@pytest.mark.parametrize(("budget", "second"), [(490, 200), (350, 148), (300, 98), (281, None)])
def test_packing_cuts_or_stops(spark, budget, second):
    text = "word " * 40
    rows = [("q", r, f"p{r}", "word", "en", f"c{r}", "sparse_full", 1.0, text.strip() + "x", text.strip() + "x") for r in (1, 2, 3)]
    df = spark.createDataFrame(rows, "request_id string, rank int, parent_id string, query string, language string, chunk_id string, lane string, score double, text string, snippet string")
    got = {r["block"]: len(r["snippet"]) for r in candidates.packed_blocks(df, budget, 240, 2).collect()}
    assert got[1] == 200
    assert got.get(2) is None if second is None else second - 1 <= got[2] <= second


def test_sparse_wins_and_dense_is_kept(spark):
    rows = [
        ("q", "a", "sparse_full", 2.0, "e1", "c1", "x"), ("q", "a", "sparse_anchor", 3.0, "e2", "c2", "x"), ("q", "a", "dense_full", 9.0, "e3", "c3", "x"),
        ("q", "b", "dense_full", 0.9, "e4", "c4", "x"), ("q", "b", "dense_anchor", 0.1, "e5", "c5", "x"),
        ("q", "c", "sparse_full", 2.0, "e6", "c6", "x"), ("q", "c", "sparse_anchor", 2.0, "e7", "c7", "x"), ("q", "d", "sparse_full", 1.0, "e8", "c8", "x"), ("q", "d", "sparse_anchor", 2.0, "e9", "c9", "x"),
    ]
    df = spark.createDataFrame(rows, "request_id string, parent_id string, lane string, score double, evidence_id string, chunk_id string, text string")
    got = {r["parent_id"]: (r["preferred"]["chunk_id"], r["alternate"] and r["alternate"]["chunk_id"]) for r in candidates.merged_evidence(df).collect()}
    assert got == {"a": ("c2", "c3"), "b": ("c5", "c4"), "c": ("c6", None), "d": ("c9", "c8")}


def test_latency_report_interpolates(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.lognormal(4, 2, 500), np.full(300, 20.0), [0.0, -3.5, 1e9]])
    rows = [("x", float(v)) for v in values] + [("x", None), ("x", float("nan")), (None, 7.0)]
    got = {r["g"]: r for r in evaluate.latency_report(spark.createDataFrame(rows, "g string, ms double"), ["g"], ["ms"]).collect()}
    for name, p in evaluate.MARKS.items():
        assert got["x"][name] == pytest.approx(np.percentile(values, p * 100), rel=1e-6, abs=1e-5)
        assert got[None][name] == 7.0
    assert got["x"]["n"] == len(values) and got["x"]["p100"] == 1e9
    assert evaluate.latency_report(spark.createDataFrame([], "g string, ms double"), ["g"], ["ms"]).count() == 0


def test_labels(spark):
    raw = spark.createDataFrame([(1, "ta", '["a","b"]', "candidate_depth_100"), (2, "ta", "c", "other")], "query_id int, language string, relevant_parent_ids string, analysis_type string")
    labels = read_labels(raw)
    assert [tuple(r) for r in labels.collect()] == [("1", "ta", '["a","b"]')]
    assert read_labels(raw.drop("analysis_type")).count() == 2
    ranked = spark.createDataFrame([("1", ["b", "z"])], "query_id string, packed array<string>")
    row = evaluate.with_labels(ranked, labels).select(evaluate.packed_hit(F.col("packed"), evaluate.parsed_list(F.col("relevant_parent_ids")))).first()
    assert row[0] is True
    with pytest.raises(ValueError):
        evaluate.with_labels(ranked.where("query_id = '9'"), labels)
    assert [r[0] for r in evaluate.missing_names(spark.createDataFrame([("a",), ("b",)], "x string"), spark.createDataFrame([("a",)], "x string")).collect()] == ["b"]


def test_engine_answers(spark):
    df = spark.createDataFrame([(" Answer: பதில்: Ilse ",), ("not_found",), ("Answer:",)], "a string").select(T.engine_cleaned(F.col("a")))
    assert [r[0] for r in df.collect()] == ["Ilse", "NOT_FOUND", ""]
    df = spark.createDataFrame([("ilse", "the barge ilse"), ("not_found", "x"), ("", "x"), ("maro", "x")], "a string, c string").select(T.engine_grounded(F.col("a"), F.col("c")))
    assert [r[0] for r in df.collect()] == [True, True, False, False]
