"""Operators on small tables: empty ones, nulls, ties, repeated rows and clashing columns too."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vettiver.operators import dense, evaluate, fusion, sparse
from vettiver.sources.tables import resolve_column

CHUNKS = "language string, parent_id string, chunk_id string, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [("en", "p1", "c1", "red red fox"), ("en", "p1", "c2", "fox den"), ("en", "p2", "c3", "blue sky"), ("en", "p3", "c4", ""), ("en", "", "c5", "red")]
    return spark.createDataFrame(rows, CHUNKS)


def test_bm25_is_the_formula(spark, chunks):
    asked = spark.createDataFrame([("q", "full", "en", "red fox red")], "query_id string, view string, language string, text string")
    got = {r["chunk_id"]: r["score"] for r in sparse.bm25(chunks, asked).collect()}
    n, avg, k1, b = 5, 8 / 5, 0.9, 0.4

    def part(df, tf, dl):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + k1 * (1 - b + b * dl / avg))

    assert got["c1"] == pytest.approx(2 * part(2, 2, 3) + part(2, 1, 3), abs=1e-8)
    assert got["c5"] == pytest.approx(2 * part(2, 1, 1), abs=1e-8)
    assert set(got) == {"c1", "c2", "c5"}


def test_parents_collapse_after_the_cut(spark, chunks):
    asked = spark.createDataFrame([("q", "full", "en", "red fox")], "query_id string, view string, language string, text string")
    found = sparse.collapse_parents(sparse.bm25(chunks, asked), ["query_id"]).collect()
    assert [(r["parent_rank"], r["parent_id"], r["chunk_id"]) for r in found] == [(1, "p1", "c1")]


def test_index_of_nothing(spark):
    none = spark.createDataFrame([], CHUNKS)
    asked = spark.createDataFrame([("q", "full", "en", "red")], "query_id string, view string, language string, text string")
    assert sparse.bm25(none, asked).count() == 0
    assert sparse.postings(none).count() == 0


def test_fixed_chunks_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "a" * 384), (2, "b" * 385), (3, None), (4, ""), (5, "c" * 2000)], "doc_id bigint, text string")
    got = {}
    for r in sparse.fixed_chunks(docs).collect():
        got.setdefault(r["parent_id"], []).append((r["chunk_no"], len(r["chunk"])))
    assert sorted(got["1"]) == [(0, 384)]
    assert sorted(got["2"]) == [(0, 384), (1, 97)]
    assert len(got["5"]) == math.ceil((2000 - 384) / 288) + 1
    assert set(got) == {"1", "2", "5"}


def test_exact_topk_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8)).astype("float32")
    x[5] = x[4]
    rows = [(i, [float(v) for v in x[i]]) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [float("nan")] * 8), (63, [1.0]), (3, [float(v) for v in x[3]])]
    v = dense.usable_vectors(spark.createDataFrame(rows, "vector_row bigint, embedding array<float>"), dimension=8)
    assert v.count() == 60
    got = dense.exact_topk(v.where("vector_row % 10 = 0"), v, 5, 8).collect()
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = np.round(u @ u[q], 9)
        s[q] = -9
        want = sorted(range(60), key=lambda i: (-s[i], i))[:5]
        assert [r["vector_row"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_row"] == q] == want


def test_exact_topk_of_many_parts_and_small_rows(spark, monkeypatch):
    monkeypatch.setattr(dense, "PART", 40)
    monkeypatch.setattr(dense, "BLOCK", 16)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    x = np.random.default_rng(2).integers(-2, 3, size=(700, 3)).astype("float32")  # most values are ties
    x[(x == 0).all(axis=1)] = 1
    v = dense.usable_vectors(spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(700)], "vector_row bigint, embedding array<float>"), dimension=3)
    found = dense.exact_topk(v.where("vector_row % 9 = 0"), v, 30, 3)
    # blocks of vectors in one row, copied for each part and joined, filled the memory of broadcasts and workers
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "units#" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r["query_row"], {})[r["rank"]] = (r["vector_row"], r["similarity"])
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    assert set(got) == set(range(0, 700, 9))
    for q, held in got.items():
        s = np.round(u @ u[q], 9)
        s[q] = -9
        assert [held[i + 1][0] for i in range(30)] == sorted(range(700), key=lambda i: (-s[i], i))[:30]
    few = v.where("vector_row < 4")
    assert dense.exact_topk(few, few, 30, 3).count() == 12
    assert dense.exact_topk(few.limit(0), few, 30, 3).count() == 0


def test_dense_parents_of_many_parts(spark, tmp_path, monkeypatch):
    from vettiver.plans import catalog

    monkeypatch.setattr(dense, "PART", 20)
    x = np.random.default_rng(3).normal(size=(240, 256)).astype("float32")
    spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(240)], "vector_row bigint, embedding array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    meta = "vector_row bigint, chunk_id string, parent_id string, language string"
    spark.createDataFrame([(i, f"c{i}", f"p{i % 90:02}", "ta") for i in range(240)], meta).write.parquet(f"{tmp_path}/metadata.parquet")
    found = catalog.dense_parent_collapse(spark, str(tmp_path))
    assert "units#" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r["query_row"], []).append((r["parent_rank"], r["parent_id"]))
    u = x.astype("float64") / np.linalg.norm(x.astype("float64"), axis=1, keepdims=True)
    assert set(got) == {0, 100, 200}
    for q, held in got.items():
        s = np.round(u @ u[q], 9)
        s[q] = -9
        near = sorted(range(240), key=lambda i: (-s[i], i))[:100]
        assert [p for _, p in sorted(held)] == list(dict.fromkeys(f"p{i % 90:02}" for i in near))[: len(held)] and len(held) == 50


def test_dense_parents_send_no_vectors_to_all(spark, tmp_path):
    from vettiver.plans import catalog

    x = np.random.default_rng(4).normal(size=(300, 256)).astype("float32")
    spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(300)], "vector_row bigint, embedding array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    meta = "vector_row bigint, chunk_id string, parent_id string, language string"
    spark.createDataFrame([(i, f"c{i}", f"p{i}", "ta") for i in range(300)], meta).write.parquet(f"{tmp_path}/metadata.parquet")
    found = catalog.dense_parent_collapse(spark, str(tmp_path))
    assert found.count() == 150
    # broadcasts hold keys and parents: blocks of vectors in them, copied for each part, ran out of memory on 0.1 GB
    nodes, sent = [found._jdf.queryExecution().sparkPlan()], []
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "BroadcastHashJoin":
            side = node.right() if node.buildSide().toString() == "BuildRight" else node.left()
            sent += [side.schema().apply(i).dataType().typeName() for i in range(side.schema().size())]
    assert sent and set(sent) <= {"long", "string"}


def test_topk_among_reads_vectors_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dense, "PART", 40)
    x = np.random.default_rng(5).integers(-2, 3, size=(500, 3)).astype("float32")
    x[(x == 0).all(axis=1)] = 1
    spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(500)], "vector_row bigint, embedding array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    v = dense.usable_vectors(spark.read.parquet(f"{tmp_path}/vectors.parquet"), dimension=3)
    found = dense.exact_topk_among(v, v["vector_row"] % 9 == 0, 20, 3)
    # scans for both roles ran at a time and filled a heap of 1 GB on 24 cores
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert sorted(found.collect()) == sorted(dense.exact_topk(v.where("vector_row % 9 = 0"), v, 20, 3).collect())
    assert dense.exact_topk_among(v, F.lit(None).cast("boolean"), 20, 3).count() == 0


def test_dense_parents_read_vectors_once(spark, tmp_path):
    from vettiver.plans import catalog

    spark.createDataFrame([(i, [float(i + 1)] * 256) for i in range(3)], "vector_row bigint, embedding array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    spark.createDataFrame([(i, f"p{i}") for i in range(3)], "vector_row bigint, parent_id string").write.parquet(f"{tmp_path}/metadata.parquet")
    plan = catalog.dense_parent_collapse(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "embedding#" in line for line in plan.splitlines()) == 1


def test_fusion_ties_and_depth(spark):
    lanes = spark.createDataFrame(
        [("q", "dense_full", "b", 1), ("q", "sparse_full", "a", 1), ("q", "sparse_anchor", "z", 51), ("q", "dense_anchor", "b", 2)], "request_id string, lane string, parent_id string, rank int"
    )
    got = [(r["parent_id"], r["rrf"]) for r in fusion.fuse(lanes).orderBy("rank").collect()]
    assert got == [("b", pytest.approx(1 / 21 + 0.7 / 22, abs=1e-9)), ("a", pytest.approx(1 / 21, abs=1e-9))]
    languages = spark.createDataFrame([("q", "hi")], "request_id string, language string")
    v1 = {r["parent_id"]: r["rrf"] for r in fusion.fuse_v1(lanes, languages).collect()}
    assert v1 == {"b": pytest.approx(1 / (2 + 1 / 1.5 - 1), abs=1e-9), "a": pytest.approx(1 / 2, abs=1e-9)}


def test_packing_stops_at_the_first_overflow(spark):
    ranked = spark.createDataFrame([("q", 1, "a", "x" * 200), ("q", 2, "b", ""), ("q", 3, "c", "y" * 200), ("q", 4, "d", "z")], "request_id string, rank int, parent_id string, snippet string")
    got = [(r["block"], r["parent_id"], len(r["snippet"])) for r in fusion.packed(ranked).collect()]
    assert got == [(1, "a", 179)]
    assert len(fusion.packed(ranked, budget=400).collect()) == 2


def test_rerank_penalty_and_constant_columns(spark):
    rows = [("q", "a", 0.5, 1.0, 0.0, 0.5, True, False, 2), ("q", "b", 0.5, 1.0, 1.0, 0.5, False, False, 2)]
    features = spark.createDataFrame(rows, "request_id string, parent_id string, rrf double, evidence double, anchor_coverage double, coverage double, agree boolean, phrase boolean, n_anchors int")
    got = {r["parent_id"]: r["rerank_score"] for r in fusion.rerank(features).collect()}
    assert got["a"] == pytest.approx(0.28 * 0.5 + 0.1 + 0.15 * 0.5 + 0.05 - 0.18)
    assert got["b"] == pytest.approx(0.28 * 0.5 + 0.27 + 0.1 + 0.15 * 0.5)


def test_lists_and_failures(spark):
    df = spark.createDataFrame([(None,), ('["a", " ", "b "]',), ("[broken",), (" one ",), ("",)], "v string")
    got = [r[0] for r in df.select(evaluate.parsed_list(df["v"])).collect()]
    assert got == [[], ["a", "b"], ["[broken"], ["one"], []]
    log = spark.createDataFrame([(True, True)], "x boolean, y boolean")
    report = evaluate.failure_report(log, evaluate.failure_class(*[log["x"]] * 6)).collect()
    assert {r["failure"]: r["n"] for r in report}["PASS"] == 1 and len(report) == 7


def test_latency_ignores_null_and_nan(spark):
    log = spark.createDataFrame([("ta", 1.0), ("ta", 3.0), ("ta", float("nan")), ("ta", None), (None, 5.0)], "language string, ms double")
    got = {r["language"]: (r["n"], r["p50"], r["p100"]) for r in evaluate.latency_report(log, ["language"], ["ms"]).collect()}
    assert got == {"ta": (2, 2.0, 3.0), None: (1, 5.0, 5.0)}


def test_columns_resolve_in_order(spark):
    df = spark.createDataFrame([("x", "y")], "content string, chunk_text string")
    assert resolve_column(df, ("text", "chunk_text", "content")) == "chunk_text"
    with pytest.raises(ValueError):
        resolve_column(df, ("text",))


def test_alignment_weighs_terms_by_their_idf(spark, tmp_path):
    from vettiver.plans import catalog

    texts = ["alpha beta gamma"] * 9 + ["alpha beta gamma delta"]
    chunk = "parent_id string, chunk_id string, text string"
    spark.createDataFrame([("p", f"c{i}", t) for i, t in enumerate(texts)], chunk).write.parquet(f"{tmp_path}/hindi.parquet")
    spark.createDataFrame([], chunk).write.parquet(f"{tmp_path}/tamil.parquet")
    spark.createDataFrame([("r", "alpha beta gamma delta", "hi")], "request_id string, query string, language string").write.parquet(f"{tmp_path}/queryrequest.parquet")
    shown = [("e", "r", "p", "c", "dense_full", 0.5, "delta here")]
    spark.createDataFrame(shown, "evidence_id string, request_id string, parent_id string, chunk_id string, lane string, score double, text string").write.parquet(f"{tmp_path}/sourceevidence.parquet")
    (row,) = catalog.alignment_features(spark, str(tmp_path)).collect()
    rare = math.log(1 + 11 / 2)
    assert row["anchor_coverage"] == pytest.approx(1 / 3, abs=1e-6)
    assert row["coverage"] == pytest.approx(rare / (rare + 3), abs=1e-6)
