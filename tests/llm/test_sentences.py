"""Sentence spans of cases of our own in several scripts."""

import pytest

pytest.importorskip("vettiver.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from vettiver.llm import sentences as S  # noqa: E402


def cut(text):
    return [text[a:b] for a, b in S.sentence_spans(text)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. A. Rao left at 5.30 p.m. sharp.", "He came back!"],
        ["திரு. க. ப. முருகன் வந்தார்.", "மழை 2.5 மி.மீ. பெய்தது?!"],
        ["पं. शर्मा ने कहा।", "कि.मी. 5 दूर है|", "क्या यह ठीक है?"],
        ["昨天老师来了。", "「他走了。」他这样写道。", "很快下雨！"],
        ["Ana asked, “Who? Me!” and left.", "“All is well.”", "Then he slept."],
        ["“Go. Run!” said Tom twice.", "the end came."],
        ["Things to buy:", "1. milk", "(2) eggs", "B) bread", "- salt", "Then go home."],
        ["He waited ... and waited … long.", "Then left."],
        ["He said no.", "Then he left."],
        ["It was vitamin C.", "He slept."],
        ["Prices rose in the U.S.", "Then they fell."],
        ["See no. 5 of Fig. 2 by A. Rao.", "It is old."],
    ],
)
def test_cases(parts):
    listed = any(p[:2] in ("1.", "(2", "B)", "- ") for p in parts)
    text = ("\n" if listed else "" if parts[0][0] == "昨" else " ").join(parts)
    assert cut(text) == parts


def test_blank_may_be_missing_and_lines_wrap():
    assert cut("He finished the study in Oslo.Yoro asked why.\nA wrapped\nline ends. ") == ["He finished the study in Oslo.", "Yoro asked why.", "A wrapped\nline ends."]
    assert cut("one\n\n two") == ["one", "two"]
    assert cut("wait …\n\nnext") == ["wait …", "next"]
    assert cut(None) == cut("") == cut(" \n　") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?“”\"\n1A)-।。「」…க்", max_size=80))
def test_spans_cover_all_but_blanks(text):
    spans = S.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    outside = set(range(len(text))) - {i for a, b in spans for i in range(a, b)}
    assert all(text[i].isspace() for i in outside)
    assert all(not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)


def test_quotations_stay_whole_whatever_their_length():
    for many in (199, 205, 500, 5000):
        assert len(S.sentence_spans("“" + "A short one. " * many + "It ends.” he said. He left.")) == 2


def all_spans(cuts, closings, openings, depth, least):
    """Every start of every span tried: what the search must find."""
    best, came = [0.0], [0]
    for j in range(1, len(cuts)):
        top = None
        for i in range(j):
            m = min([depth[i], *least[i + 1 : j + 1]])
            total = best[i] + openings[i] + closings[j] + S.UNBALANCED * (depth[i] + depth[j] - 2 * m) + S.WITHIN * (m > 0) + S.TOO_SHORT * (cuts[j] - cuts[i] < S.SHORT)
            top = total if top is None else max(top, total)
        best.append(top)
    return best[-1]


def total_of(ends, cuts, closings, openings, depth, least):
    total, i = 0.0, 0
    for j in ends:
        m = min([depth[i], *least[i + 1 : j + 1]])
        total += openings[i] + closings[j] + S.UNBALANCED * (depth[i] + depth[j] - 2 * m) + S.WITHIN * (m > 0) + S.TOO_SHORT * (cuts[j] - cuts[i] < S.SHORT)
        i = j
    return total


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="A. e!“”()", min_size=1, max_size=60))
def test_the_search_is_exact(text):
    parts = S._possible(text, 0, len(text))
    assert total_of(S._best_spans(*parts), *parts) == pytest.approx(all_spans(*parts))


def test_spans_are_judged_as_a_whole():
    assert cut("Oh! A. The cat sat.") == ["Oh!", "A. The cat sat."]
    assert cut("It was vitamin A. The cat sat.") == ["It was vitamin A.", "The cat sat."]


def test_long_text_is_linear():
    assert len(S.sentence_spans("A short one. " * 20_000)) == 20_000
    assert len(S.sentence_spans("“" + "A short one. " * 300)) >= 1


def test_table(spark):
    df = spark.createDataFrame([("a", "Xo. Zed."), ("a", "Xo. Zed."), ("b", None), ("c", " "), (None, "Qui.")], "key string, text string")
    assert sorted((r["key"] or "", r["start_pos"], r["end_pos"]) for r in S.sentences(df, "key", "text").collect()) == [("", 0, 4), ("a", 0, 3), ("a", 4, 8)]
