"""Keys of terms, clauses, and held-out accuracy on made-up subjects."""

import random

import numpy as np
import pytest

pytest.importorskip("vettiver.llm")
from vettiver.llm import subjects as B  # noqa: E402


@pytest.mark.parametrize(("word", "key"), [("பூச்சிக்கொல்லி", "puuchchikkolli"), ("यात्री", "yaatree"), ("गढ़", "gadh"), ("Molecules", "molecules"), ("12", ""), ("", "")])
def test_keys(word, key):
    assert B.key_of(word) == key


def test_places_and_distinct_values(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(B, "MANY", 1)
    for numbers in (np.array([7]), np.unique(rng.integers(1, 1 << 32, 5000)), np.unique(rng.integers(1, 90, 60)), np.concatenate([np.arange(1, 3000), [(1 << 32) - 1]])):
        wanted = np.concatenate([rng.choice(numbers, 4000), rng.integers(0, 1 << 32, 4000), [0, numbers[0], numbers[-1], (1 << 32) - 1]])
        at = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
        assert B.place_in(numbers, wanted).tolist() == np.where(numbers[at] == wanted, at, len(numbers)).tolist()
    x = rng.integers(0, 50, 1000)
    assert B.distinct(x).tolist() == sorted(set(x.tolist())) and not len(B.distinct(x[:0]))


WORDS = {
    "a": "apple acorn alder", "b": "boat barge brig", "c": "court clause claim", "d": "drum dance duet", "e": "engine exhaust enamel", "f": "fever flu fracture", None: "thing matter",
}


def made(rng, subject, n):
    names = [f"name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    return " ".join(f"{rng.choice(names).title()} saw the {rng.choice(WORDS[subject].split())} near {rng.choice(names)} today." for _ in range(n))


def test_accuracy_and_odd_rows(spark):
    rng = random.Random(6)
    areas = spark.createDataFrame([*[(s,) for s in "abcdef"], (None,)], "subject string")
    examples = spark.createDataFrame([(i, made(rng, s, 3), s) for i, s in enumerate("abcdef" * 10)], "example_id bigint, text string, subject string")
    rows, truth = [], {}
    for i in range(400):
        on = set(rng.sample("abcdef", rng.choice([0, 1, 1, 2])))
        parts = [made(rng, s, 4) for s in sorted(on)] + [made(rng, None, 3)]
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), f"s{i % 3}", "passage"))
        truth[i] = on
    odd = [(900, None, None, None), (901, "", "s1", "passage"), (902, " ", None, "qa_record"), (903, made(rng, "a", 3000), "s0", "run_note")]
    docs = spark.createDataFrame([*rows, *odd], "doc_id bigint, text string, source string, kind string")
    got = {}
    for r in B.subjects_of(docs, examples, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = np.mean([got.get(i, set()) == on for i, on in truth.items()])
    assert right >= 0.9
    assert not {900, 901, 902} & set(got) and got[903] == {"a"}
    assert B.subjects_of(docs.limit(0), examples, areas).count() == 0


def test_terms_are_counted_over_all_documents(spark, monkeypatch):
    rng = random.Random(7)
    areas = spark.createDataFrame([("a",), ("b",)], "subject string")
    examples = spark.createDataFrame([(i, made(rng, s, 3), s) for i, s in enumerate("ab" * 5)], "example_id bigint, text string, subject string")
    docs = spark.createDataFrame([(i, made(rng, "ab"[i % 2], 4), f"s{i % 3}", "passage") for i in range(61)] + [(99, None, "s1", "passage")], "doc_id bigint, text string, source string, kind string")
    read, widen = [], B.widen
    monkeypatch.setattr(B, "widen", lambda documents, terms, frequent, n: read.append((documents.count(), n)) or widen(documents, terms, frequent, n))
    monkeypatch.setattr(B, "COMPOSED", 200)
    assert B.subjects_of(docs, examples, areas, sample=30).count() > 0
    assert read == [(61, 61)] * 3


def test_a_batch_without_any_term():
    terms = B.Terms(["a", "b"], np.array([5]), np.array([[1.0, 0.0]], np.float32))
    words = np.array(B.parse("Nothing known is here. It ends.")[0])
    u = B.lay_out(words, np.array([len(words)]), np.array([4, 2]), np.array([2]), np.array([False]), terms)
    assert u.labels.tolist() == [-1, -1]
    none = np.zeros(0, np.int64)
    assert len(B.lay_out(none, none, none, none, np.zeros(0, bool), terms).labels) == 0


def test_all_examples_count_and_all_sources_have_shares(spark):
    rng = random.Random(8)
    areas = spark.createDataFrame([("a",), ("b",)], "subject string")
    # every example of b comes after the first
    examples = spark.createDataFrame([(i, made(rng, s, 3), s) for i, s in enumerate("a" * 8 + "b" * 8)], "example_id bigint, text string, subject string")
    rows = [(i, made(rng, "ab"[i % 2], 4), f"s{i % 4}", "passage") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string")
    got = {}
    for r in B.subjects_of(docs, examples, areas, sample=1).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    assert np.mean([got.get(i) == {"ab"[i % 2]} for i in range(120)]) >= 0.9


def test_sources_are_drawn_alike_here_and_where_they_lie(spark):
    shares = [(None if i == 3 else f"s{i}", 20 + 5 * i, [0.9, 0.05] if i % 3 else [0.05, 0.4 + 0.01 * i]) for i in range(40)]
    means = B.materialise(spark.createDataFrame(shares, "source string, n bigint, share array<double>").repartition(5))
    y = np.array([[1, 0], [0, 1], [0, 0]] * 3000)
    drawn = [B.drawn_sources(means, 2, y, few, np.random.default_rng(1)) for few in (True, False)]
    held, n = np.array([s for *_, s in shares]), np.array([n for _, n, _ in shares])
    for c in range(3):
        p = B.likely(held, n, y[c] > 0)
        want = (p[:, None] * held).sum(axis=0) / p.sum()
        for d in drawn:
            assert np.abs(d[c::3].mean(axis=0) - want).max() < 0.03
    docs = spark.createDataFrame([(i, s) for i, s in enumerate([x[0] for x in shares] + ["new"])], "key bigint, source string").withColumn("f", B.F.lit(1.0))
    for few in (True, False):
        got = {r["key"]: r["share"] for r in B.shared_out(docs, means, few).collect()}
        assert got == {**{i: x[2] for i, x in enumerate(shares)}, 40: None}
