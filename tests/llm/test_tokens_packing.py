"""Ids against the tokenizer itself, exact joins, and containers."""

import os
import random

import pytest

pytest.importorskip("vettiver.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from vettiver.llm import packing as P  # noqa: E402
from vettiver.llm import tokens as K  # noqa: E402

needs_vocabulary = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary file here")


@needs_vocabulary
def test_ids_are_those_of_the_tokenizer(spark):
    plain = K.encoder(K.VOCABULARY).bpe
    rng = random.Random(3)
    odd = ["", None, " ", "\n\n a\t b  c ", "<|endoftext|>", "it's 12'30 😀é", "தமிழ் மொழி    x", "a" * 9000, "".join(rng.choice("abcd") for _ in range(20_000)), "व" * 3000 + " ", "x\x1cy \x85z"]
    odd += ["".join(rng.choice(" \n\tab'1.க்é。") for _ in range(400)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for part in (K.PART, 100):
        got = {r["doc_id"]: r["ids"] for r in K.token_ids(df, "doc_id", "text", part=part).collect()}
        assert got == {i: plain.encode_ordinary(t) if t else [] for i, t in enumerate(odd)}
        counts = {r["doc_id"]: r["n_tokens"] for r in K.token_counts(df, "doc_id", "text", part=part).collect()}
        assert counts == {i: len(ids) for i, ids in got.items()}
    assert K.token_ids(df.limit(0), "doc_id", "text").count() == 0


@needs_vocabulary
def test_halves_join_exactly(monkeypatch):
    known = K.encoder(K.VOCABULARY)
    monkeypatch.setattr(K, "PIECE", 16)
    rng = random.Random(5)
    for _ in range(150):
        word = "".join(rng.choice("thequickbrownaeiou") for _ in range(rng.randint(17, 600))).encode()
        assert known.piece(word) == known.bpe._encode_single_piece(word)


@needs_vocabulary
def test_long_text_without_blanks_is_a_tree(spark):
    rng = random.Random(8)
    plain = K.encoder(K.VOCABULARY).bpe
    texts = ["".join(rng.choice("thequickbrownமொழி") for _ in range(1_000_000)), "a" * 200_000, "".join(rng.choice("ab1'.。") for _ in range(100_000)), "'" * 50_000 + " " * 50_000 + "x"]
    assert len(K.part_bounds(texts[0])) >= 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r["doc_id"]: r["ids"] for r in K.token_ids(df, "doc_id", "text").collect()} == {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sre1. \n\tக்!é", min_size=1, max_size=60), st.integers(1, 9))
def test_parts_join_to_the_whole(text, part):
    known = K.encoder(K.VOCABULARY)
    bounds = [*K.part_bounds(text, part), (len(text), False)]
    whole = None
    for (a, inner), (b, _) in zip(bounds, bounds[1:], strict=False):
        mine = text[a:b]
        pieces = known.pieces.findall(mine)
        own = {"inner": inner, "head": len(known.piece(pieces[0].encode())), "tail": len(known.piece(pieces[-1].encode())), "ids": known.bpe.encode_ordinary(mine)}
        whole = own if whole is None else K.join_parts(known, whole, own)
    assert whole["ids"] == known.bpe.encode_ordinary(text)


def test_plan_uses_every_item_once_and_fits():
    rng = random.Random(2)
    counts = {rng.randint(1, 8192): rng.randint(1, 50) for _ in range(600)}
    left = dict(counts)
    for _, often, filling in P.plan(counts):
        assert sum(s * k for s, k in filling.items()) <= 8192
        for s, k in filling.items():
            left[s] -= often * k
    assert set(left.values()) == {0}
    used = sum(often for _, often, _ in P.plan(counts))
    assert used <= 1.05 * sum(s * n for s, n in counts.items()) / 8192 + 1


def test_tiers_are_packed_apart_and_gaps_are_filled_from_shorter_ones():
    made = P.plan({5000: 2, 3000: 5, 3100: 1, 1500: 3, 200: 10})
    assert sum(n for t, n, _ in made if t == 8192) == 2
    for tier, _, filling in made:
        assert max(P.tier_of(s) for s in filling) == tier
        if tier == 8192:
            assert filling[5000] == 1 and filling.get(3100, 0) + filling.get(3000, 0) == 1
    # two of the 4,096 tier are packed with each other, their gap is filled from the shorter tiers
    assert all(f.get(3000, 0) + f.get(3100, 0) == 2 and f.get(1500, 0) == 1 for t, _, f in made if t == 4096)


def test_step_groups_have_one_tier(spark):
    rng = random.Random(9)
    sizes = spark.createDataFrame([(i, rng.choice([40, 300, 700, 1500, 3000, 6000])) for i in range(2000)], "doc_id bigint, n_tokens bigint")
    tiers, members = {}, {}
    for r in P.pack(sizes, "doc_id").collect():
        tiers.setdefault(r["step_group"], set()).add(r["tier"])
        members.setdefault(r["step_group"], set()).add(r["container_id"])
    assert all(len(t) == 1 for t in tiers.values()) and max(map(len, members.values())) <= P.GROUP


def test_containers(spark):
    sizes = [(i, n) for i, n in enumerate([100] * 200 + [30_000, 8192, 8193, 0, 5000, 3192, 1])] + [(900, None)]
    got = P.pack(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), "doc_id").collect()
    fill, cover = {}, {}
    for r in got:
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["token_end"] - r["token_start"]
        cover.setdefault(r["doc_id"], []).append((r["token_start"], r["token_end"]))
    assert max(fill.values()) <= 8192 and set(fill) == set(range(len(fill)))
    for i, n in sizes:
        if not n:
            assert i not in cover
            continue
        parts = sorted(cover[i])
        assert parts[0][0] == 0 and parts[-1][1] == n and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        assert len(parts) == -(-n // 8192)
    assert len(fill) == -(-sum(n or 0 for _, n in sizes) // 8192)
    assert P.pack(spark.createDataFrame([], "doc_id bigint, n_tokens bigint"), "doc_id").count() == 0
