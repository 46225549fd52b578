"""The prefix-tree join against all pairs, with hot tokens split and in cells."""

import random
from collections import Counter

import pytest

pytest.importorskip("vettiver.llm")
from vettiver.llm import near_copies as N  # noqa: E402


def texts(seed, n=160):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    rare = [f"r{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            base = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(base))
                base[at : at + rng.randint(0, 1)] = [rng.choice(common + rare)]
            rng.shuffle(base)
        else:
            base = [rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.randint(6, 24))]
        out.append((f"k{i:03}", " ".join(base)))
    return out


def all_pairs(rows, threshold=0.75):
    sets = {k: Counter(N.words(t)) for k, t in rows if t and len(N.words(t)) >= 8}
    found = set()
    for a in sets:
        for b in sets:
            if a < b and (sets[a] & sets[b]).total() >= threshold * max(sets[a].total(), sets[b].total()) - 1e-9:
                found.add((a, b))
    return found


@pytest.mark.parametrize(("hot", "block"), [(4096, 50_000), (3, 50_000), (3, 4)])
def test_every_pair_is_found(spark, hot, block):
    rows = texts(7)
    df = spark.createDataFrame([*rows, rows[0], ("n", None), (None, rows[1][1]), ("e", "")], "key string, text string")
    members = N.token_sets(df, "key", "text")
    sets = members.groupBy("sig").agg({"tokens": "first"}).withColumnRenamed("first(tokens)", "tokens")
    links = N.similar_sets(sets, 0.75, hot=hot, block=block)
    got = {tuple(r) for r in N.pairs_of_keys(members.select("key", "sig"), links).collect()}
    assert got == all_pairs(rows)


def test_order_case_and_spelling_do_not_count(spark):
    df = spark.createDataFrame([("a", "One two three four five six seven eight"), ("b", "eight SEVEN six five ｆour three two one"), ("c", "one two three")], "key string, text string")
    assert [tuple(r) for r in N.pairs_of_keys(*N.near_copies(df, "key", "text")).collect()] == [("a", "b")]


def test_nothing(spark):
    none = spark.createDataFrame([], "key string, text string")
    members, links = N.near_copies(none, "key", "text")
    assert members.count() == 0 and links.count() == 0


def test_classes_chain(spark):
    base = [f"t{i}" for i in range(20)]
    rows = [(f"d{k}", " ".join(base[k * 4 :] + [f"n{j}" for j in range(k * 4)])) for k in range(4)] + [("copy", " ".join(base)), ("far", "x1 x2 x3 x4 x5 x6 x7 x8 x9")]
    got = {r["key"]: (r["class_key"], r["links"]) for r in N.classes(*N.near_copies(spark.createDataFrame(rows, "key string, text string"), "key", "text")).collect()}
    assert {got[f"d{k}"][0] for k in range(4)} | {got["copy"][0]} == {"copy"}
    assert got["far"] == ("far", 0)
    assert got["d0"][1] == 2 and got["copy"][1] == 2 and got["d1"][1] == 3
