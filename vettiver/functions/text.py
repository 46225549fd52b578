"""Tokens, normal forms, matching and sentences as column expressions.

Null text gives null, or the empty list of tokens. Everything stays in the JVM but ``compatible``, which needs NFKC.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from vettiver.functions.lexicon import ANSWER_ENDINGS, CONTINUES, ENGINE_PREFIXES, GENITIVES, MANDATORY, NOT_FOUND, NUMBER_MARKERS, ONLY_ASKED, ONLY_SHOWN, ORDINALS, QUESTION_TERMS, QUESTION_WORDS, SCRIPTS, SUPERLATIVES, by_language, words_of

# Fixed value: every blank, as the inside of a character class.
BLANK = "\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LIST_MARK = "^ *(?:\\p{Nd}{1,2}|[A-Da-d])[.)]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(text: Column) -> Column:
    """``text`` without case."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def terms(text: Column) -> Column:
    """The runs of letters, marks and numbers of ``text`` without case; none of null."""
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit("[\\p{L}\\p{M}\\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def collapsed(text: Column) -> Column:
    """``text`` with each run of blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANK}]+", " "))


@F.pandas_udf(StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC and casefold, which Spark has no expression for."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore").astype(object)


def retrieval_form(text: Column) -> Column:
    """NFKC, no case, single blanks: what queries are compared in."""
    return collapsed(compatible(text))


def plain_form(text: Column) -> Column:
    """Letters, numbers, underscores and the two scripts; all else a blank."""
    return collapsed(F.regexp_replace(text, f"[^\\p{{L}}\\p{{N}}_{BLANK}{SCRIPTS['hi']}{SCRIPTS['ta']}]", " "))


def grounding_form(text: Column) -> Column:
    """What answers and evidence are compared in; the danda stays on its word, as its block is kept."""
    return plain_form(compatible(text))


def without_endings(form: Column) -> Column:
    """A grounding form without the verb endings, taken off one after the other."""
    for ending in ANSWER_ENDINGS:
        form = F.regexp_replace(form, f"{ending}$", "")
    return F.trim(form)


def content_terms(query: Column, language: Column) -> Column:
    """Terms of two letters or more that are no question words, each once, in order."""
    kept = F.filter(terms(query), lambda t: F.length(t) >= 2)
    return F.array_except(kept, words_of(language, QUESTION_TERMS))


def informative_terms(query: Column, language: Column) -> Column:
    """The like for evidence scoring, which has its own list of question words."""
    kept = F.filter(terms(query), lambda t: F.length(t) >= 2)
    return F.array_except(kept, words_of(language, QUESTION_WORDS))


def _shared(a: Column, b: Column, p: Column) -> Column:
    return F.substring(a, F.lit(1), p) == F.substring(b, F.lit(1), p)


def match_engine(a: Column, b: Column, language: Column) -> Column:
    """Equal, or in Tamil a common beginning of 4 letters and 70 % of the shorter term of 5 letters or more."""
    shorter = F.least(F.length(a), F.length(b))
    p = F.greatest(F.lit(4), F.floor((shorter * 7 + 9) / 10).cast("int"))
    return (a == b) | ((language == "ta") & (shorter >= 5) & _shared(a, b, p))


def match_evidence(a: Column, b: Column) -> Column:
    """Equal, or both of 4 letters or more and one within the other."""
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a)))


def match_guardrail(answer: Column, shown: Column) -> Column:
    """Equal; else, but for numbers, a common beginning of 4 letters and 70 % of the answer's term."""
    p = F.greatest(F.lit(4), F.floor((F.length(answer) * 7 + 9) / 10).cast("int"))
    close = (F.least(F.length(answer), F.length(shown)) >= 4) & (F.length(answer) >= p) & (F.length(shown) >= p) & _shared(answer, shown, p)
    return (answer == shown) | (~answer.rlike("^\\p{Nd}+$") & close)


def matched_count(asked: Column, shown: Column, match) -> Column:
    """How many terms of ``asked`` match one of ``shown``."""
    return let(shown, lambda s: F.size(F.filter(asked, lambda a: F.exists(s, lambda b: match(a, b))))).cast("bigint")


def _any_in(text: Column, markers: Column) -> Column:
    return F.exists(markers, lambda m: F.contains(text, m))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\p{Nd}+"), F.lit(0))


def constraints_met(query: Column, text: Column, language: Column) -> Column:
    """Asked-for markers, "only" and numbers of the query are in the text."""
    both = F.struct(folded(query).alias("q"), folded(text).alias("t"), numbers(query).alias("asked"), numbers(text).alias("shown"))
    return let(both, lambda x: _constraints(x["q"], x["t"], x["asked"], x["shown"], language))


def _constraints(q: Column, t: Column, asked: Column, shown: Column, language: Column) -> Column:
    met = F.lit(True)
    for key, pairs in MANDATORY.items():
        here = F.lit(True)
        for markers in pairs:
            some = F.array(*map(F.lit, markers))
            here = here & (~_any_in(q, some) | _any_in(t, some))
        met = met & ((language != key) | here)
    only = ~_any_in(q, words_of(language, ONLY_ASKED)) | _any_in(t, words_of(language, ONLY_SHOWN))
    return met & only & (F.size(F.array_except(asked, shown)) == 0)


def contradicts(query: Column, text: Column, language: Column) -> Column:
    """A superlative is asked for and an ordinal shown."""
    return let(F.struct(folded(query).alias("q"), folded(text).alias("t")), lambda x: _contradiction(x["q"], x["t"], language))


def _contradiction(q: Column, t: Column, language: Column) -> Column:
    return _any_in(q, words_of(language, SUPERLATIVES)) & _any_in(t, words_of(language, ORDINALS))


def required_anchors(query: Column, language: Column) -> Column:
    """What the answer must be about: in Hindi the terms before the possessive particle, in Tamil a genitive among the first three.

    The particle must be followed by a letter or number inside the same word: vowel signs do not end a word here.
    """
    before = F.regexp_extract(query, "^\\s*(.{1,80}?)\\s+(?:का|की|के)[\\p{L}\\p{N}_]", 1)
    hindi = F.array_distinct(F.filter(terms(before), lambda t: F.length(t) >= 2))
    ends = lambda t: F.exists(F.array(*map(F.lit, GENITIVES)), lambda g: t.endswith(g))
    tamil = F.slice(F.filter(F.slice(terms(query), 1, 3), ends), 1, 1)
    return F.when(language == "hi", hindi).when(language == "ta", tamil).otherwise(F.array().cast("array<string>"))


def all_present(anchors: Column, shown: Column) -> Column:
    return let(shown, lambda s: F.forall(anchors, lambda a: F.exists(s, lambda b: match_evidence(a, b))))


def is_list_item(text: Column) -> Column:
    return text.rlike(LIST_MARK)


def evidence_sentences(text: Column) -> Column:
    """Lines, list items and sentences of ``text``: an item stays whole, other lines end at marks before a blank."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, "\\r", "\n"), f"[{BLANK}]+(?=(?:\\p{{Nd}}{{1,2}}|[A-Da-d])[.)][{BLANK}])", "\n"), "\n+")
    clean = F.filter(F.transform(lines, collapsed), lambda x: x != "")
    parts = F.transform(clean, lambda x: F.when(is_list_item(x), F.array(x)).otherwise(F.split(F.regexp_replace(x, "([?!।.]) ", "$1\u0001"), "\u0001")))
    return F.filter(F.flatten(parts), lambda x: x != "")


def evidence_units(sentences: Column) -> Column:
    """The sentences, then the neighbouring pairs of list items and of sentences that lead on, up to 450 characters."""
    leads = lambda x: F.exists(F.array(*map(F.lit, CONTINUES)), lambda c: x.startswith(c))

    def units(own: Column) -> Column:
        both = F.zip_with(F.slice(own, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        held = F.filter(both, lambda p: is_list_item(p["a"]) | is_list_item(p["b"]) | leads(p["b"]))
        pairs = F.transform(held, lambda p: F.concat_ws(" ", p["a"], p["b"]))
        return F.when(F.size(own) < 2, own).otherwise(F.concat(own, F.filter(pairs, lambda p: F.length(p) <= 450)))

    return let(sentences, units)


def support(query: Column, unit: Column, language: Column) -> Column:
    """How far ``unit`` supports an answer to ``query``: (matched, total, coverage, flags, score, strong)."""

    def judged(x: Column) -> Column:
        m, n, ok = x["matched"], F.size(x["asked"]).cast("bigint"), x["anchors_ok"] & x["constraints_ok"] & ~x["contradiction"]
        c = F.when(n == 0, F.lit(0.0)).otherwise(m / n)
        score = c * 10 + F.least(m, F.lit(3)) * 0.4 + F.when(x["anchors_ok"], 1.0).otherwise(-7.0)
        score = score + F.when(x["constraints_ok"], 0.0).otherwise(-7.0) + F.when(x["contradiction"], -10.0).otherwise(0.0)
        enough = F.when(n <= 2, m == n).when(n == 3, (m >= 2) & (c >= 0.66)).otherwise((m >= 3) & (c >= 0.55))
        strong = (n > 0) & ok & enough & ~(x["listed"] & (c < 0.60))
        return F.struct(
            m.alias("matched"), n.alias("total"), c.alias("coverage"), x["anchors_ok"].alias("anchors_ok"), x["constraints_ok"].alias("constraints_ok"),
            x["contradiction"].alias("contradiction"), F.round(F.greatest(score, F.lit(0.0)), 9).alias("score"), strong.alias("strong"),
        )

    def looked(x: Column) -> Column:
        matched = F.size(F.filter(x["asked"], lambda a: F.exists(x["shown"], lambda b: match_evidence(a, b)))).cast("bigint")
        anchors = F.forall(x["anchors"], lambda a: F.exists(x["shown"], lambda b: match_evidence(a, b)))
        return F.struct(
            x["asked"].alias("asked"), matched.alias("matched"), anchors.alias("anchors_ok"), is_list_item(unit).alias("listed"),
            _constraints(x["q"], x["t"], x["numbers_asked"], x["numbers"], language).alias("constraints_ok"), _contradiction(x["q"], x["t"], language).alias("contradiction"),
        )

    known = F.struct(
        informative_terms(query, language).alias("asked"), terms(unit).alias("shown"), required_anchors(query, language).alias("anchors"), folded(query).alias("q"), folded(unit).alias("t"),
        numbers(query).alias("numbers_asked"), numbers(unit).alias("numbers"),
    )
    return let(let(known, looked), judged)


def with_support(df, query: str = "query", unit: str = "text", language: str = "language"):
    """``df`` with the support columns of each row's unit; a null query or unit counts as empty."""
    q, u = F.coalesce(F.col(query), F.lit("")), F.coalesce(F.col(unit), F.lit(""))
    columns = ("matched", "total", "coverage", "anchors_ok", "constraints_ok", "contradiction", "score", "strong")
    found = df.withColumn("__support", support(q, u, F.coalesce(F.col(language), F.lit(""))))
    return found.withColumns({c: F.col("__support")[c] for c in columns}).drop("__support")


def pack_score(score: Column, strong: Column, ok: Column) -> Column:
    """What a supporting unit counts when evidence is chosen: nothing where anchors or constraints fail."""
    return F.when(ok, score + F.when(strong, 15.0).otherwise(0.0)).otherwise(F.lit(0.0))


def expects_number(query: Column, language: Column) -> Column:
    return let(folded(query), lambda q: _any_in(q, words_of(language, NUMBER_MARKERS)))


def answer_type_ok(query: Column, answer: Column, language: Column) -> Column:
    """A question for a number is answered with a digit."""
    return ~expects_number(query, language) | answer.rlike("\\p{Nd}")


def script_ok(answer: Column, language: Column) -> Column:
    """A letter of the language's script, else a Latin letter, a digit or a unit sign."""
    own = by_language(language, {k: f"[{v}]" for k, v in SCRIPTS.items()}, "[A-Za-z]")
    return F.regexp_like(answer, own) | answer.rlike("[A-Za-z\\p{Nd}°%]")


def echoes(answer: Column, query: Column) -> Column:
    """No term of the answer that the query does not have."""
    return let(terms(query), lambda q: ~F.exists(terms(answer), lambda a: ~F.exists(q, lambda b: match_evidence(a, b))))


def repeats(answer: Column) -> Column:
    """A term three times in a row."""
    def thrice(t: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(t) - 2)
        return F.when(F.size(t) < 3, F.lit(False)).otherwise(F.exists(spots, lambda i: (F.get(t, i - 1) == F.get(t, i)) & (F.get(t, i) == F.get(t, i + 1))))

    return let(terms(answer), thrice)


def cleaned_answer(answer: Column) -> Column:
    """A model's answer without emphasis, citations, option and answer prefixes, cut at the first sentence end or line."""
    x = F.trim(F.regexp_replace(answer, f"^[{BLANK}]+|[{BLANK}]+$", ""))
    x = F.regexp_replace(F.replace(x, F.lit("**"), F.lit("")), "\\[\\s*\\p{Nd}+\\s*\\]", "")
    x = F.regexp_replace(x, "^[A-Da-d][.)]\\s*", "")
    x = F.regexp_replace(x, "^(?i:Answer|Ans|उत्तर|பதில்)\\s*[:\\-–]\\s*", "")
    x = F.replace(x, F.lit("�"), F.lit(""))
    x = F.get(F.split(F.regexp_replace(x, f"[\\n\\r]|([।.!?])[{BLANK}]+", "$1\u0001"), "\u0001"), F.lit(0))
    return F.btrim(collapsed(x), F.lit(" -–—:;,.|।"))


def shape_ok(answer: Column, query: Column, language: Column) -> Column:
    """Short, of the asked type, no echo, in a fitting script, without repetition."""
    return (F.length(answer) <= 90) & (F.length(answer) > 0) & answer_type_ok(query, answer, language) & ~echoes(answer, query) & script_ok(answer, language) & ~repeats(answer)


def grounded(answer_form: Column, evidence_form: Column) -> Column:
    """The answer's form is in the evidence's, or each of its terms is supported there."""
    def held(x: Column) -> Column:
        every = F.forall(x["words"], lambda a: F.exists(x["shown"], lambda b: match_guardrail(a, b)))
        return (x["bare"] != "") & (F.contains(evidence_form, x["bare"]) | every)

    def split(bare: Column) -> Column:
        words = F.filter(F.split(bare, " "), lambda t: t != "")
        return let(F.struct(bare.alias("bare"), words.alias("words"), F.split(evidence_form, " ").alias("shown")), held)

    return let(without_endings(answer_form), split)


def engine_cleaned(answer: Column) -> Column:
    """A model's answer as the engine takes it: without answer prefixes, one after the other, and an exact sentinel."""
    x = btrimmed(answer)
    for prefix in ENGINE_PREFIXES:
        x = F.when(x.startswith(prefix), btrimmed(F.substr(x, F.lit(len(prefix) + 1)))).otherwise(x)
    return F.when(F.upper(x) == NOT_FOUND, NOT_FOUND).otherwise(x)


def btrimmed(text: Column) -> Column:
    """``text`` without blanks of any kind at its ends."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def engine_grounded(answer_form: Column, context_form: Column) -> Column:
    """Fail-closed: the answer's form is a part of the context's, or the sentinel; an empty one is not."""
    return (answer_form != "") & ((answer_form == NOT_FOUND.lower()) | F.contains(context_form, answer_form))


def contains_expected(expected_form: Column, text_form: Column) -> Column:
    """The expected answer's form without its verb ending is in the text's form; an empty one is not."""
    bare = without_endings(expected_form)
    return F.coalesce((bare != "") & F.contains(text_form, bare), F.lit(False))
