"""Text expressions against small cases of our own."""

from pyspark.sql import functions as F

from vettiver.functions import text as T


def value(spark, column, **values):
    row = spark.range(1)
    for name, v in values.items():
        row = row.withColumn(name, F.lit(v).cast("string"))
    return row.select(column.alias("x")).first()["x"]


def test_terms_keep_marks_and_digits(spark):
    assert value(spark, T.terms(F.col("a")), a="Ströme, கி.மீ 12x!") == ["ströme", "கி", "மீ", "12x"]
    assert value(spark, T.terms(F.col("a")), a=None) == []
    assert value(spark, T.terms(F.col("a")), a="") == []


def test_retrieval_form_is_nfkc_without_case(spark):
    assert value(spark, T.retrieval_form(F.col("a")), a="Ｇ  PS\n x") == "g ps x"


def test_matchers_differ(spark):
    tamil = F.lit("ta")
    assert value(spark, T.match_engine(F.col("a"), F.col("b"), tamil), a="abcdefgxyz", b="abcdefgpqr")
    assert not value(spark, T.match_engine(F.col("a"), F.col("b"), tamil), a="abcdefwxyz", b="abcdefnpqr")
    assert not value(spark, T.match_engine(F.col("a"), F.col("b"), F.lit("hi")), a="abcdefgxyz", b="abcdefgpqr")
    assert value(spark, T.match_evidence(F.col("a"), F.col("b")), a="rail", b="railway")
    assert not value(spark, T.match_evidence(F.col("a"), F.col("b")), a="rai", b="railway")
    assert value(spark, T.match_guardrail(F.col("a"), F.col("b")), a="railways", b="railwayman")
    assert not value(spark, T.match_guardrail(F.col("a"), F.col("b")), a="12345678", b="1234567")


def test_possessive_particle_needs_a_letter_after_it(spark):
    # the particle before a blank does not count, inside a longer word it does
    assert value(spark, T.required_anchors(F.col("a"), F.lit("hi")), a="झील का पुराना घाट") == []
    assert value(spark, T.required_anchors(F.col("a"), F.lit("hi")), a="नहर में कार्य क्या है") == ["नहर", "में"]
    assert value(spark, T.required_anchors(F.col("a"), F.lit("ta")), a="குளத்தின் பழைய கரை") == ["குளத்தின்"]


def test_constraints_and_contradiction(spark):
    met = T.constraints_met(F.col("q"), F.col("t"), F.lit("hi"))
    assert not value(spark, met, q="राष्ट्रीय पक्षी 2005", t="पक्षी 2005")
    assert value(spark, met, q="राष्ट्रीय पक्षी 2005", t="राष्ट्रीय मोर 2005 में")
    assert not value(spark, met, q="पक्षी 2005", t="पक्षी 20056")
    assert value(spark, T.contradicts(F.col("q"), F.col("t"), F.lit("hi")), q="सबसे बड़ा ग्रह", t="दूसरा सबसे बड़ा")


def test_sentences_and_units(spark):
    found = value(spark, T.evidence_sentences(F.col("a")), a="A first one. Next!  1. Mars is red\r\n2) Venus. is hot\n\nlast")
    assert found == ["A first one.", "Next!", "1. Mars is red", "2) Venus. is hot", "last"]
    units = value(spark, T.evidence_units(T.evidence_sentences(F.col("a"))), a="Sun. 1. Earth\n2. Moon\nend")
    assert units == ["Sun.", "1. Earth", "2. Moon", "end", "Sun. 1. Earth", "1. Earth 2. Moon", "2. Moon end"]
    assert value(spark, T.evidence_units(T.evidence_sentences(F.col("a"))), a="") == []


def test_answers(spark):
    clean = T.cleaned_answer(F.col("a"))
    assert value(spark, clean, a=" Answer: **Delhi** [1]. Because") == "Delhi"
    assert value(spark, clean, a="B) उत्तर: हृदय। क्योंकि") == "हृदय"
    assert value(spark, T.repeats(F.col("a")), a="x go go go")
    assert not value(spark, T.repeats(F.col("a")), a="go go x go")
    assert value(spark, T.echoes(F.col("a"), F.col("q")), a="the bird", q="the national bird?")
    assert not value(spark, T.shape_ok(F.col("a"), F.col("q"), F.lit("ta")), a="x" * 91, q="y")
    assert value(spark, T.without_endings(F.col("a")), a="குளம் ஆகும்") == "குளம்"
