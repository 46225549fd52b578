"""The consistent form: cases, idempotence, tables with nulls and repeated rows."""

import pytest

pytest.importorskip("vettiver.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from vettiver.llm import one_form as O  # noqa: E402


@pytest.mark.parametrize(
    ("left", "right"),
    [
        ("GPS", "Ｇ­ΡЅ"), ("Zoë", "Zoë"), ("ஔவை", "ஒளவை"), ("ஔவை", "ஒ‍ள͏வை"), ("கௌரி", "கெளரி"), ("கவிதை", "௧விதை"),
        ("आम", "अाम"), ("दुःख", "दु:ख"), ("a b", " a　\n b "), ("MTC-138", "MTC‑１３８"), ("பொ", "பொ"),
    ],
)
def test_same_reading(left, right):
    assert O.one_form(left) == O.one_form(right)


@pytest.mark.parametrize(("left", "right"), [("Zoë", "Zoe"), ("ZOË", "Zoë"), ("நூல்", "நூள்"), ("ஒளி", "ஔி"), ("கி", "கீ"), ("14", "11"), ("a b", "ab")])
def test_other_reading(left, right):
    assert O.one_form(left) != O.one_form(right)


def test_mapping_has_no_conflicts():
    assert O.check_mapping() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ஒளௌாேவை அाौ‍­Ρ１ "))))
def test_form_of_a_form_is_the_form(text):
    form = O.one_form(text)
    assert O.one_form(form) == form


def test_pairs_and_questions(spark):
    rows = [("b", "GPS x", 1), ("a", " Ｇ­PS  x ", 1), ("a", " Ｇ­PS  x ", 1), ("c", "GPS x ", 1), ("d", None, 1), (None, "ＧPS x", 1), ("e", " ", 1), ("f", "　", 1)]
    df = spark.createDataFrame(rows, "key string, text string, form int")
    assert {tuple(r) for r in O.equal_looking_pairs(df, "key", "text").collect()} == {("a", "b"), ("a", "c")}
    assert O.equal_looking_pairs(df.limit(0), "key", "text").count() == 0
    asked = spark.createDataFrame([("r1", "ＧPS x"), ("r2", "GPS x"), ("r3", None), ("r1", "ＧPS x"), ("r4", "")], "request_id string, query string")
    known = spark.createDataFrame([("q1", "GPS x"), ("q2", ""), ("q3", None)], "query_id string, query string")
    assert [tuple(r) for r in O.shown_questions(asked, known).collect()] == [("r1", "q1")]


def test_very_long_text():
    assert O.one_form("ＡB ­" * 50_000) == " ".join(["AB"] * 50_000)


@pytest.mark.parametrize("many", [1, 36, 38, 60, 500])
def test_any_number_of_invisible_characters(many):
    assert O.one_form("கெ" + "\u200d" * many + "ளரி") == O.one_form("கெளரி") == "கௌரி"
    assert O.one_form("க" + "\u200d" * many + "ெளரி") == "கௌரி"
    assert O.one_form("ஒ" + "\u200b" * many + "ளவை") == O.one_form("ஔவை")


def test_a_form_of_many_rows_and_two_spellings(spark):
    rows = [(f"k{i:04}", "GPS x") for i in range(500)] + [("a", "ＧPS x"), ("z", "GРS x")]
    got = {tuple(r) for r in O.equal_looking_pairs(spark.createDataFrame(rows, "key string, text string"), "key", "text").collect()}
    assert got == {("a", k) for k, _ in rows[:500]} | {(k, "z") for k, _ in rows[:500]} | {("a", "z")}
