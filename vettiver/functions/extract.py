"""Answer spans by rules over an evidence unit, in a fixed order; the first rule with a usable span wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vettiver.functions import text as T

SPAN = r"([^\s,।.;:()]{2,40})"
TAMIL_SPAN = r"([^\s,.;:()]{2,50})"
# Rules as (method, confidence, language or None, words of the query of which one is asked for, pattern, what is done to the
# first group: taken plainly, without the query's leading terms, or of that the last three terms).
RULES = [
    ("numeric_unit", 1.0, None, ["செல்சியஸ்", "°c"], r"(?i)(?:^|[^\p{L}\p{N}_])(\p{Nd}+(?:[.,]\p{Nd}+)?\s*(?:டிகிரி\s*)?(?:செல்சியஸ்|°c))", "plain"),
    ("numeric_unit", 1.0, None, ["सेल्सियस", "°c"], r"(?i)(?:^|[^\p{L}\p{N}_])(\p{Nd}+(?:[.,]\p{Nd}+)?\s*(?:डिग्री\s*)?(?:सेल्सियस|°c))", "plain"),
    ("pump_relation", 1.0, "hi", [], r"पंप\s+करने\s+वाला\s+" + SPAN, "plain"),
    ("satellite_relation", 1.0, "hi", [], r"उपग्रह\s+(?:है\s*)?[,:\-–—]?\s*" + SPAN, "no_particle"),
    ("capital_relation", 0.95, "hi", [], r"राजधानी\s+(?:है\s+)?" + SPAN, "plain"),
    ("gas_relation", 0.95, "hi", ["गैस"], r"((?:\S+\s+){0,3}\S+)\s+गैस(?:\s|$)", "rest"),
    ("tamil_copula", 1.0, "ta", [], r"^\s*(.{1,60}?)\s+என்பது[\p{L}\p{N}_]", "plain"),
    ("gas_relation", 1.0, "ta", ["வாயு"], r"((?:\S+\s+){0,4}\S+)\s+வாயு(?:வை|வாக|வில்|$)", "last_three"),
    ("capital_relation", 0.95, "ta", [], r"தலைநகர(?:ம்|மாக)\s+" + TAMIL_SPAN, "plain"),
    ("satellite_relation", 0.95, "ta", [], r"துணைக்கோள்(?:\s+ஆகும்|\s+உள்ளது|\s+என்பது)?\s*[,:\-–—]?\s*" + TAMIL_SPAN, "plain"),
    ("list_head", 0.95, None, [], r"^\s*(?:\p{Nd}{1,2}|[A-Da-d])[.)]\s*([^:;\-–—,.।]{1,60}?)\s*[\-–—:]", "plain"),
]
# Particles that are no answer, and what is taken off the ends of a span.
PARTICLES = ["है", "का", "की", "के"]
ENDS = " \t\r\n\"'“”‘’-–—:;,.।()[]{}"
LEADING = 0.65
MOST_TERMS, MOST_CHARS = 6, 80


def _matches(term: Column, others: Column) -> Column:
    return F.exists(others, lambda o: T.match_evidence(term, o))


def _without_leading(terms: Column, asked: Column) -> Column:
    """``terms`` from the first that matches none of ``asked``."""

    def cut(t: Column) -> Column:
        new = F.transform(t, lambda y: ~_matches(y, asked))
        return T.let(F.array_position(new, F.lit(True)).cast("int"), lambda at: F.when(at > 0, F.slice(t, at, F.greatest(F.size(t), F.lit(1)))).otherwise(F.array().cast("array<string>")))

    return T.let(terms, cut)


def cleaned_span(span: Column, query_terms: Column) -> Column:
    """``span`` without marks at its ends and its list mark, or null if it is empty, long, or all in the query."""

    def usable(clean: Column) -> Column:
        good = lambda own: F.size(own).between(1, MOST_TERMS) & (F.length(clean) <= MOST_CHARS) & F.exists(own, lambda t: ~_matches(t, query_terms))
        return F.when(T.let(T.terms(clean), good), clean)

    return T.let(F.trim(F.regexp_replace(F.btrim(span, F.lit(ENDS)), T.LIST_MARK + " *", "")), usable)


def answer_span(query: Column, unit: Column, language: Column) -> Column:
    """(span, confidence, method) of the first rule that gives a usable span, or null; later rules are not tried."""

    def rules(x: Column) -> Column:
        u, q, asked = x["u"], x["q"], x["asked"]
        found = []

        def offer(span: Column, confidence: float, method: str) -> None:
            made = lambda s: F.when(s.isNotNull(), F.struct(s.alias("span"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")))
            found.append(T.let(cleaned_span(span, asked), made))

        for method, confidence, lang, markers, pattern, how in RULES:
            group = F.regexp_extract(u, pattern, 1)
            if how in ("rest", "last_three"):
                last = lambda t: F.array_join(F.when(F.size(t) > 3, F.slice(t, -3, 3)).otherwise(t) if how == "last_three" else t, " ")  # noqa: E731, B023
                group = T.let(_without_leading(T.terms(group), asked), last)
            if how == "no_particle":
                group = T.let(group, lambda g: F.when(~g.isin(PARTICLES), g))
            fits = F.lit(True) if lang is None else language == lang
            for one in [markers] if markers else []:
                fits = fits & F.exists(F.array(*map(F.lit, one)), lambda m: F.contains(q, m))
            offer(F.when(fits, group), confidence, method)

        def leading(w: Column) -> Column:
            flags = T.let(T.informative_terms(query, language), lambda own: F.transform(w, lambda y: F.exists(T.terms(y), lambda t: _matches(t, own))))
            return T.let(F.array_position(flags, F.lit(True)).cast("int"), lambda at: F.when(at.between(2, 5), F.array_join(F.slice(w, F.lit(1), F.greatest(at - 1, F.lit(0))), " ")))

        offer(T.let(F.split(F.trim(F.regexp_replace(u, T.LIST_MARK + " *", "")), " "), leading), LEADING, "leading_entity")
        return F.coalesce(*found)

    return T.let(F.struct(T.collapsed(unit).alias("u"), T.folded(query).alias("q"), T.terms(query).alias("asked")), rules)
