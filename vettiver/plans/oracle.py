"""The registered queries as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import unicodedata

from vettiver.functions import extract as X
from vettiver.functions import lexicon as L

BL = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LIST_MARK = r"^ *(?:\p{Nd}{1,2}|[A-Da-d])[.)]"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _by(language: str, values: dict, otherwise: str, show=_list) -> str:
    return f"CASE {language} " + " ".join(f"WHEN {_q(k)} THEN {show(v)}" for k, v in values.items()) + f" ELSE {otherwise} END"


def folded(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters of the basic plane whose compatible form is one other character, those forms, and the frequent longer forms."""
    single = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000}
    ones = {c: f for c, f in single.items() if len(f) == 1 and f != unicodedata.normalize("NFC", c)}
    longer = [(c, f) for c, f in single.items() if len(f) > 1 and f != unicodedata.normalize("NFC", c) and ("\x80" <= c < "\u0250" or "\u2000" <= c < "\u2190" or "\ufb00" <= c < "\ufb07")]
    return "".join(ones), "".join(ones.values()), longer


def nfkc(x: str) -> str:
    """NFKC of ``x``; of forms of several characters only those of Latin letters, punctuation, symbols and ligatures."""
    ones, forms, longer = _compatible()
    for c, f in longer:
        x = f"replace({x}, {_q(c)}, {_q(f)})"
    return f"nfc_normalize(translate({x}, {_q(ones)}, {_q(forms)}))"


def terms(x: str) -> str:
    return rf"coalesce(regexp_extract_all({folded(x)}, '[\p{{L}}\p{{M}}\p{{N}}]+'), [])"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BL}+', ' ', 'g'))"


def plain_form(x: str) -> str:
    return collapsed(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\t-\r\x{{1c}}-\x{{20}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}ऀ-ॿ஀-௿]', ' ', 'g')")


def evidence_match(a: str, b: str) -> str:
    return f"({a} = {b} OR (least(length({a}), length({b})) >= 4 AND (contains({a}, {b}) OR contains({b}, {a}))))"


def engine_match(a: str, b: str, language: str) -> str:
    n = f"least(length({a}), length({b}))"
    p = f"greatest(4, ({n} * 7 + 9) // 10)"
    return f"({a} = {b} OR ({language} = 'ta' AND {n} >= 5 AND left({a}, {p}) = left({b}, {p})))"


def guardrail_match(a: str, b: str) -> str:
    p = f"greatest(4, (length({a}) * 7 + 9) // 10)"
    return rf"({a} = {b} OR (NOT regexp_matches({a}, '^\p{{Nd}}+$') AND least(length({a}), length({b})) >= 4 AND length({a}) >= {p} AND length({b}) >= {p} AND left({a}, {p}) = left({b}, {p})))"


def count_matched(asked: str, shown: str, match) -> str:
    return f"len(list_filter({asked}, lambda a: len(list_filter({shown}, lambda b: {match('a', 'b')})) > 0))"


def any_in(x: str, markers: str) -> str:
    return f"len(list_filter({markers}, lambda m: contains({x}, m))) > 0"


def once(xs: str) -> str:
    """The first of equal items only, in order."""
    return f"list_filter({xs}, lambda t, i: list_position({xs}, t) = i)"


CORPUS = """corpus AS (
  SELECT DISTINCT 'ta' AS language, CAST(parent_id AS VARCHAR) AS parent_id, CAST(chunk_id AS VARCHAR) AS chunk_id, coalesce(text, '') AS text FROM tamil
  UNION SELECT DISTINCT 'hi', CAST(parent_id AS VARCHAR), CAST(chunk_id AS VARCHAR), coalesce(text, '') FROM hindi)"""
REQUESTS = """requests AS (
  SELECT DISTINCT request_id, coalesce(query, '') AS query, language FROM queryrequest WHERE request_id IS NOT NULL)"""
EVIDENCE = """evidence AS (
  SELECT DISTINCT evidence_id, request_id, parent_id, chunk_id, lane, CASE WHEN NOT isnan(score) THEN score END AS score, coalesce(text, '') AS text
  FROM sourceevidence WHERE evidence_id IS NOT NULL)"""
PAIRS = f"""{REQUESTS}, {EVIDENCE},
pairs AS (SELECT e.*, r.query, coalesce(r.language, '') AS lang, r.language FROM evidence e JOIN requests r USING (request_id))"""
TOKENS = f"tok AS (SELECT *, {terms('text')} AS ts FROM corpus)"
STATS = f"""{CORPUS}, {TOKENS},
stats AS (SELECT language, count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS avgdl FROM tok GROUP BY language),
post AS (SELECT language, parent_id, chunk_id, dl, term, count(*) AS tf
  FROM (SELECT language, parent_id, chunk_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY ALL),
df AS (SELECT language, term, count(*) AS df FROM post GROUP BY ALL)"""
ASKED = "asked AS (SELECT query_id, 'full' AS vw, language, query AS text FROM validation_queries)"
CONTENT = f"list_filter({terms('query')}, lambda t: length(t) >= 2 AND NOT list_contains({_by('coalesce(language, chr(0))', L.QUESTION_TERMS, '[]')}, t))"
INFORMATIVE = f"list_filter({terms('query')}, lambda t: length(t) >= 2 AND NOT list_contains({_by('coalesce(language, chr(0))', L.QUESTION_WORDS, '[]')}, t))"
BM25 = f"""wanted AS (SELECT query_id, vw, language, term, count(*) AS qtf FROM (SELECT query_id, vw, language, unnest({terms('text')}) AS term FROM asked) GROUP BY ALL),
part AS (SELECT p.language, p.term, p.parent_id, p.chunk_id,
  ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf / (p.tf + {_by('p.language', L.K1, '0.9', str)} * (1 - {_by('p.language', L.B, '0.4', str)} + {_by('p.language', L.B, '0.4', str)} * p.dl / s.avgdl)) AS part
  FROM post p JOIN df d USING (language, term) JOIN stats s USING (language)),
scored AS (SELECT query_id, vw, language, parent_id, chunk_id, round(sum(qtf * part), 9) AS score FROM part JOIN wanted USING (language, term) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vw ORDER BY score DESC, chunk_id) AS rnk FROM scored) WHERE rnk <= 350),
parents AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vw ORDER BY rnk) AS parent_rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id, vw, parent_id ORDER BY rnk) AS nth FROM hits WHERE parent_id <> '') WHERE nth = 1) WHERE parent_rank <= 50)"""
ANCHORS = f"""{STATS},
listed AS (SELECT query_id, language, query, {CONTENT} AS l FROM validation_queries),
content AS (SELECT query_id, language, query, {once('l')} AS l FROM listed),
items AS (SELECT query_id, language, u.pos AS pos, u.term AS term FROM (SELECT query_id, language, unnest(list_transform(l, lambda t, i: {{'pos': i, 'term': t}})) AS u FROM content)),
idfs AS (SELECT i.*, coalesce(CASE WHEN d.df > 0 THEN round(ln(1 + (s.n + 1) / (d.df + 1)), 9) END, 0) AS idf
  FROM items i LEFT JOIN df d USING (language, term) LEFT JOIN stats s USING (language)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, pos) AS r, max(idf) OVER (PARTITION BY query_id) AS top FROM idfs),
kept AS (SELECT query_id, max(top) AS top_idf, coalesce(list(term ORDER BY pos) FILTER (WHERE r <= 3 AND idf > 0), list(term ORDER BY pos) FILTER (WHERE pos <= 3)) AS anchors FROM ordered GROUP BY query_id),
anchored AS (SELECT v.query_id, v.language, v.query, coalesce(k.anchors, []) AS anchors, coalesce(k.top_idf, 0.0) AS top_idf FROM validation_queries v LEFT JOIN kept k USING (query_id))"""
VIEWS = f"""{ANCHORS},
views AS (
  SELECT query_id, language, 'full' AS vw, {collapsed(folded('query'))} AS text FROM anchored UNION ALL
  SELECT query_id, language, 'anchor', array_to_string(anchors, ' ') FROM anchored
  WHERE len(anchors) > 0 AND array_to_string(anchors, ' ') <> {collapsed(folded('query'))} AND top_idf >= 2.0)"""
LANES_SPARSE = f"""{VIEWS}, asked AS (SELECT query_id, vw, language, text FROM views), {BM25},
sparse_lanes AS (SELECT query_id, 'sparse_' || vw AS lane, parent_id, parent_rank AS rnk FROM parents)"""
USABLE = """usable AS (
  SELECT vector_row, min(embedding) AS v FROM vectors
  WHERE len(embedding) = 256 AND vector_row IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vector_row)"""
VECTOR_HITS = f"""{USABLE},
held AS (SELECT vector_row, CAST(v AS DOUBLE[]) AS v FROM usable WHERE vector_row IN (SELECT vector_row FROM metadata)),
near AS (SELECT q.vector_row AS query_row, h.vector_row, round(list_cosine_similarity(q.v, h.v), 9) AS similarity
  FROM held q, held h WHERE q.vector_row % 100 = 0 AND q.vector_row <> h.vector_row),
vhits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY similarity DESC, vector_row) AS rnk FROM near) WHERE rnk <= 100)"""
RANKING = f"""{EVIDENCE}, {REQUESTS},
lanes AS (SELECT *, row_number() OVER (PARTITION BY request_id, lane ORDER BY score DESC, parent_id) AS rnk FROM
  (SELECT request_id, lane, parent_id, max(score) AS score FROM evidence WHERE lane IS NOT NULL AND score IS NOT NULL AND parent_id <> '' GROUP BY ALL))"""
FUSED = f"""fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rrf DESC, parent_id) AS rnk FROM
  (SELECT request_id, parent_id, round(sum(({_by('lane', L.LANE_WEIGHTS, '1.0', str)})::DOUBLE / (20.0 + rnk)), 9) AS rrf, list(DISTINCT lane) AS in_lanes
   FROM lanes WHERE rnk <= 50 GROUP BY request_id, parent_id)) WHERE rnk <= 30)"""
FUSED_V1 = f"""fused_v1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rrf DESC, parent_id) AS rnk FROM
  (SELECT request_id, parent_id, round(sum(1 / (2.0 + rnk / (CASE WHEN lane = 'dense_full' THEN {_by('language', L.DENSE_WEIGHT, '2.0', str)} ELSE 1.0 END)::DOUBLE - 1)), 9) AS rrf
   FROM lanes JOIN requests USING (request_id) WHERE lane IN ('dense_full', 'sparse_full') AND rnk <= 50 GROUP BY request_id, parent_id)) WHERE rnk <= 20)"""
AGREE = "(len(list_filter(in_lanes, lambda x: starts_with(x, 'dense'))) > 0 AND len(list_filter(in_lanes, lambda x: starts_with(x, 'sparse'))) > 0)"


def _mandatory(q: str, t: str) -> str:
    out = []
    for key, pairs in L.MANDATORY.items():
        each = " AND ".join(f"(NOT ({any_in(q, _list(m))}) OR {any_in(t, _list(m))})" for m in pairs)
        out.append(f"(lang <> {_q(key)} OR ({each}))")
    return " AND ".join(out)


def supported(source: str, unit: str) -> str:
    """CTEs that add the support columns to ``source`` (query, lang, unit)."""
    hindi = r"list_filter(" + terms(r"regexp_extract(query, '^\s*(.{1,80}?)\s+(?:का|की|के)[\p{L}\p{N}_]', 1)") + ", lambda t: length(t) >= 2)"
    tamil = f"list_filter({terms('query')}[1:3], lambda t: " + " OR ".join(f"ends_with(t, {_q(g)})" for g in L.GENITIVES) + ")[1:1]"
    informative = INFORMATIVE.replace("coalesce(language, chr(0))", "lang")
    return f"""s1 AS (SELECT *, {informative} AS l, {terms(unit)} AS shown, {folded('query')} AS fq, {folded(unit)} AS ft,
  CASE lang WHEN 'hi' THEN {hindi} WHEN 'ta' THEN {tamil} ELSE [] END AS anchors FROM {source}),
s2 AS (SELECT *, {once('l')} AS asked FROM s1),
s3 AS (SELECT *, {count_matched('asked', 'shown', evidence_match)} AS matched, len(asked) AS total,
  len(list_filter(anchors, lambda a: len(list_filter(shown, lambda b: {evidence_match('a', 'b')})) = 0)) = 0 AS anchors_ok,
  ({_mandatory('fq', 'ft')}) AND (NOT ({any_in('fq', _by('lang', L.ONLY_ASKED, '[]'))}) OR {any_in('ft', _by('lang', L.ONLY_SHOWN, '[]'))})
    AND len(list_filter(regexp_extract_all(query, '\\p{{Nd}}+'), lambda n: NOT list_contains(regexp_extract_all({unit}, '\\p{{Nd}}+'), n))) = 0 AS constraints_ok,
  {any_in('fq', _by('lang', L.SUPERLATIVES, '[]'))} AND {any_in('ft', _by('lang', L.ORDINALS, '[]'))} AS contradiction FROM s2),
s4 AS (SELECT *, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE matched::DOUBLE / total END AS coverage FROM s3),
s5 AS (SELECT *, round(greatest(coverage * 10 + least(matched, 3) * 0.4::DOUBLE + CASE WHEN anchors_ok THEN 1 ELSE -7 END + CASE WHEN constraints_ok THEN 0 ELSE -7 END
    + CASE WHEN contradiction THEN -10 ELSE 0 END, 0), 9) AS score9,
  total > 0 AND anchors_ok AND constraints_ok AND NOT contradiction AND (CASE WHEN total <= 2 THEN matched = total WHEN total = 3 THEN matched >= 2 AND coverage >= 0.66
    ELSE matched >= 3 AND coverage >= 0.55 END) AND NOT (regexp_matches({unit}, '{LIST_MARK}') AND coverage < 0.60) AS strong FROM s4),
sup AS (SELECT *, CASE WHEN anchors_ok AND constraints_ok AND NOT contradiction THEN score9 + CASE WHEN strong THEN 15 ELSE 0 END ELSE 0 END AS pack9 FROM s5)"""


_LINES = rf"regexp_split_to_array(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '{BL}+((?:\p{{Nd}}{{1,2}}|[A-Da-d])[.)]{BL})', chr(10) || '\1', 'g'), '{BL}+((?:\p{{Nd}}{{1,2}}|[A-Da-d])[.)]{BL})', chr(10) || '\1', 'g'), '\n+')"


def sentences(source: str) -> str:
    """CTE ``sent``: ``source`` with the list ``ss`` of its text's evidence sentences."""
    return rf"""sent AS (SELECT *, list_filter(flatten(list_transform(list_filter(list_transform({_LINES}, lambda x: {collapsed('x')}), lambda x: x <> ''),
  lambda x: CASE WHEN regexp_matches(x, '{LIST_MARK}') THEN [x] ELSE string_split(regexp_replace(x, '([?!।.]) ', '\1' || chr(1), 'g'), chr(1)) END)), lambda x: x <> '') AS ss FROM {source})"""


_PAIR = f"(regexp_matches(ss[i], '{LIST_MARK}') OR regexp_matches(ss[i + 1], '{LIST_MARK}') OR " + " OR ".join(f"starts_with(ss[i + 1], {_q(c)})" for c in L.CONTINUES) + ") AND length(ss[i]) + 1 + length(ss[i + 1]) <= 450"
UNITS = f"list_concat(ss, list_transform(list_filter(range(1, len(ss)), lambda i: {_PAIR}), lambda i: ss[i] || ' ' || ss[i + 1]))"
UNIT_ROWS = f"""units AS (SELECT * EXCLUDE (u, ss), u.pos AS pos, u.unit AS unit FROM (SELECT *, unnest(list_transform({UNITS}, lambda x, i: {{'pos': i - 1, 'unit': x}})) AS u FROM sent))"""
STRONGEST = f"""{PAIRS}, {sentences('pairs')}, {UNIT_ROWS}, {supported('units', 'unit')},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY strong DESC, score9 DESC, round(coverage, 9) DESC, matched DESC, pos) AS nth FROM sup) WHERE nth = 1)"""
_TRIMMED = rf"regexp_replace(raw_answer, '^{BL}+|{BL}+$', '', 'g')"
_C1 = rf"regexp_replace(replace({_TRIMMED}, '**', ''), '\[\s*\p{{Nd}}+\s*\]', '', 'g')"
_C2 = rf"regexp_replace(regexp_replace({_C1}, '^[A-Da-d][.)]\s*', ''), '^(?i:Answer|Ans|उत्तर|பதில்)\s*[:\-–]\s*', '')"
CLEANED = rf"trim({collapsed(rf'''string_split(regexp_replace(replace({_C2}, chr(65533), ''), '[\n\r]|([।.!?]){BL}+', '\1' || chr(1), 'g'), chr(1))[1]''')}, ' -–—:;,.|।')"
ANSWERS = """answers AS (SELECT language, query, raw_answer, max(possibly_truncated) AS truncated FROM full_rag_t4_per_query
  WHERE query IS NOT NULL AND raw_answer IS NOT NULL GROUP BY ALL)"""
_ECHO = f"len(list_filter({terms('answer')}, lambda a: len(list_filter({terms('query')}, lambda b: {evidence_match('a', 'b')})) = 0)) = 0"
SHAPED = rf"""{ANSWERS}, cleaned AS (SELECT *, coalesce(language, '') AS lang, {CLEANED} AS answer FROM answers),
shaped AS (SELECT *, NOT ({any_in(folded('query'), _by('lang', L.NUMBER_MARKERS, '[]'))}) OR regexp_matches(answer, '\p{{Nd}}') AS type_ok,
  regexp_matches(answer, {_by('lang', {k: f'[{v}]' for k, v in L.SCRIPTS.items()}, "'[A-Za-z]'", _q)}) OR regexp_matches(answer, '[A-Za-z\p{{Nd}}°%]') AS script_ok,
  {_ECHO} AS echo,
  len(list_filter(range(1, len({terms('answer')}) - 1), lambda i: {terms('answer')}[i] = {terms('answer')}[i + 1] AND {terms('answer')}[i + 1] = {terms('answer')}[i + 2])) > 0 AS repeats FROM cleaned),
judged0 AS (SELECT *, length(answer) <= 90 AND length(answer) > 0 AND type_ok AND NOT echo AND script_ok AND NOT repeats AS shape_ok FROM shaped)"""


def _bare(x: str) -> str:
    for ending in L.ANSWER_ENDINGS:
        x = f"regexp_replace({x}, '{ending}$', '')"
    return f"trim({x})"


def grounding_form(x: str) -> str:
    return plain_form(folded(nfkc(x)))


def held_in(bare: str, form: str) -> str:
    """The form ``bare`` (without verb endings) is a part of ``form``, or each of its words is supported there."""
    return f"""({form} IS NOT NULL AND {bare} <> '' AND (contains({form}, {bare}) OR len(list_filter(list_filter(string_split({bare}, ' '), lambda t: t <> ''),
  lambda a: len(list_filter(string_split({form}, ' '), lambda b: {guardrail_match('a', 'b')})) = 0)) = 0))"""


def supported_by(bare: str) -> str:
    return f"coalesce(len(list_filter(coalesce(forms, []), lambda u: {held_in(bare, 'u')})) > 0 OR {held_in(bare, 'form')}, false)"


def spans(source: str) -> str:
    """CTE ``spanned``: ``source`` (query, lang, unit) with the list ``found`` of usable spans in the order of the rules."""
    u = collapsed("unit")
    rules = []
    for method, confidence, lang, markers, pattern, how in X.RULES:
        group = f"regexp_extract({u}, {_q(pattern)}, 1)"
        if how in ("rest", "last_three"):
            group = f"array_to_string(list_filter({terms(group)}, lambda x, i: len(list_filter({terms(group)}[1:i], lambda y: len(list_filter({terms('query')}, lambda o: {evidence_match('y', 'o')})) = 0)) > 0){'[-3:]' if how == 'last_three' else ''}, ' ')"
        if how == "no_particle":
            group = f"CASE WHEN {group} NOT IN ({', '.join(map(_q, X.PARTICLES))}) THEN {group} END"
        fits = ["true"] + ([f"lang = {_q(lang)}"] if lang else []) + ([any_in(folded("query"), _list(markers))] if markers else [])
        rules.append(f"{{'span': CASE WHEN {' AND '.join(fits)} THEN {group} END, 'confidence': {confidence}::DOUBLE, 'method': {_q(method)}}}")
    informative = INFORMATIVE.replace("coalesce(language, chr(0))", "lang")
    words = f"string_split(trim(regexp_replace({u}, '{LIST_MARK} *', '')), ' ')"
    flags = f"list_transform(ws, lambda w: len(list_filter({terms('w')}, lambda t: len(list_filter(inf, lambda o: {evidence_match('t', 'o')})) > 0)) > 0)"
    ends = _q(X.ENDS)
    clean = f"trim(regexp_replace(trim(x.span, {ends}), '{LIST_MARK} *', ''))"
    usable = f"x.span IS NOT NULL AND len({terms('x.span')}) BETWEEN 1 AND 6 AND length(x.span) <= 80 AND len(list_filter({terms('x.span')}, lambda t: len(list_filter(qt, lambda o: {evidence_match('t', 'o')})) = 0)) > 0"
    return f"""x1 AS (SELECT *, {words} AS ws, {informative} AS inf, {terms('query')} AS qt FROM {source}),
x2 AS (SELECT *, list_position({flags}, true) AS spot FROM x1),
x3 AS (SELECT *, [{', '.join(rules)}, {{'span': CASE WHEN spot BETWEEN 2 AND 5 THEN array_to_string(ws[1:spot - 1], ' ') END, 'confidence': {X.LEADING}::DOUBLE, 'method': 'leading_entity'}}] AS cand FROM x2),
x4 AS (SELECT *, list_transform(cand, lambda x: {{'span': {clean}, 'confidence': x.confidence, 'method': x.method}}) AS cleaned_spans FROM x3),
spanned AS (SELECT *, list_filter(cleaned_spans, lambda x: {usable}) AS found FROM x4)"""


GROUNDS = f"""{sentences('ctx')}, {UNIT_ROWS}, {supported('units', 'unit')},
gbest AS (SELECT lang, query, unit FROM (SELECT *, row_number() OVER (PARTITION BY lang, query ORDER BY strong DESC, score9 DESC, round(coverage, 9) DESC, matched DESC, pos) AS nth FROM sup) WHERE nth = 1 AND strong),
{spans('gbest')},
gspan AS (SELECT lang, query, found[1].span AS sp, found[1].confidence AS conf FROM spanned WHERE len(found) > 0),
gforms AS (SELECT lang, query, list(DISTINCT {grounding_form('unit')}) AS forms FROM sup WHERE strong GROUP BY lang, query),"""
JUDGED = f"""{PAIRS}, context AS (SELECT query, max_by(text, {{'a': score, 'b': evidence_id}}) AS context FROM pairs WHERE score IS NOT NULL AND trim(text) <> '' GROUP BY query),
{SHAPED},
ctx AS (SELECT a.lang, a.lang AS language, a.query, c.context, c.context AS text FROM (SELECT DISTINCT coalesce(language, '') AS lang, query FROM answers) a JOIN context c USING (query)),
{GROUNDS}
j1 AS (SELECT j.*, c.context, {_bare(grounding_form('answer'))} AS bare, {grounding_form('c.context')} AS form, f.forms, g.sp, g.conf
  FROM judged0 j LEFT JOIN ctx c ON c.lang = j.lang AND c.query = j.query LEFT JOIN gforms f ON f.lang = j.lang AND f.query = j.query LEFT JOIN gspan g ON g.lang = j.lang AND g.query = j.query),
judged AS (SELECT *, coalesce({held_in('bare', 'form')}, false) AS grounded FROM j1)"""
LOG = "log AS (SELECT DISTINCT * FROM full_rag_t4_per_query)"
_PCT = "round(quantile_cont(ms, {0}), 6)"
STAGES = "embed_ms dense_ms bm25_ms retrieval_ms context_ms prompt_prep_ms model_first_token_ms generation_ttft_ms full_rag_ttft_ms full_rag_complete_ms".split()
KINDS = {"view": "audio", "click": "partial", "purchase": "final", "signup": "begin", "error": "error"}
FRAMES = f"""frames AS (SELECT DISTINCT user_id AS session, ts, event_id AS seq, {_by('event_type', KINDS, "'other'", _q)} AS kind FROM events)"""
_MESSAGE = _by("coalesce(language, chr(0))", L.NOT_FOUND_MESSAGES, _q(L.NOT_FOUND_MESSAGE), _q)
_EMPTY = "[" + "''" + "][1:0]"

def _scored(rows: str, name: str, col: str, by: str) -> str:
    """CTE ``name``: ``rows`` (by, lang, language, query, col) with the pack score of the strongest unit of ``col``."""
    inner = f"{name}_t AS (SELECT {by}, lang, language, query, {col} AS text FROM {rows}), " + sentences(f"{name}_t").replace("sent AS", f"{name}_s AS", 1)
    inner += ", " + UNIT_ROWS.replace("units AS", f"{name}_u AS", 1).replace("FROM sent)", f"FROM {name}_s)")
    sup = supported(f"{name}_u", "unit")
    for cte in ("s1", "s2", "s3", "s4", "s5", "sup"):
        sup = sup.replace(f"{cte} AS (", f"{name}_{cte} AS (").replace(f"FROM {cte})", f"FROM {name}_{cte})")
    return f"{inner}, {sup}, {name} AS (SELECT {by}, pack9 FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY strong DESC, score9 DESC, round(coverage, 9) DESC, matched DESC, pos) AS nth FROM {name}_sup) WHERE nth = 1)"


def windows(source: str, p: str) -> str:
    """CTEs that end in ``{p}windows`` (evidence_id, win): windows of ``source`` (evidence_id, query, lang, language, text, mx)."""
    return f"""{p}r AS (SELECT evidence_id, query, lang, language, mx, {collapsed('text')} AS text FROM {source}), {sentences(p + 'r').replace('sent AS', p + 'sent AS', 1)},
{p}long AS (SELECT * FROM {p}sent WHERE length(text) > mx),
{p}each AS (SELECT evidence_id, lang, language, query, u.p AS p, u.x AS x FROM (SELECT *, unnest(list_transform(ss, lambda x, i: {{'p': i, 'x': x}})) AS u FROM {p}long)),
{_scored(p + 'each', p + 'sc', 'x', 'evidence_id, p')},
{p}best AS (SELECT evidence_id, p FROM (SELECT e.evidence_id, e.p, row_number() OVER (PARTITION BY e.evidence_id ORDER BY coalesce(s.pack9, 0) DESC, e.p) AS nth FROM {p}each e LEFT JOIN {p}sc s USING (evidence_id, p)) WHERE nth = 1),
{p}local AS (SELECT l.evidence_id, l.query, l.lang, l.language, l.mx, array_to_string(l.ss[greatest(b.p - 1, 1):b.p + 1], ' ') AS loc FROM {p}long l JOIN {p}best b USING (evidence_id)),
{p}cand AS (SELECT evidence_id, query, lang, language, list_concat([left(loc, mx), right(loc, mx)], list_transform(list_filter(list_transform(list_filter({terms('query')}, lambda t: length(t) >= 2),
  lambda t: instr({folded('loc')}, t)), lambda q: q > 0), lambda q: substring(loc, greatest(q - 1 - mx // 3, 0) + 1, mx))) AS ws FROM {p}local WHERE length(loc) > mx),
{p}win AS (SELECT evidence_id, query, lang, language, u.p AS p, u.x AS x FROM (SELECT *, unnest(list_transform(ws, lambda w, i: {{'p': i, 'x': trim(w)}})) AS u FROM {p}cand)),
{_scored(p + 'win', p + 'ws', 'x', 'evidence_id, p')},
{p}crop AS (SELECT evidence_id, x FROM (SELECT w.evidence_id, w.x, row_number() OVER (PARTITION BY w.evidence_id ORDER BY coalesce(s.pack9, 0) DESC, w.p) AS nth FROM {p}win w LEFT JOIN {p}ws s USING (evidence_id, p) WHERE w.x <> '') WHERE nth = 1),
{p}windows AS (SELECT r.evidence_id, CASE WHEN length(r.text) <= mx THEN r.text WHEN length(l.loc) <= r.mx THEN l.loc ELSE c.x END AS win FROM {p}r r LEFT JOIN (SELECT evidence_id, loc FROM {p}local) l USING (evidence_id) LEFT JOIN {p}crop c USING (evidence_id))"""


MERGE = f"""m1 AS (SELECT * FROM (SELECT request_id, parent_id, lane, {{'chunk_id': chunk_id, 'lane': lane, 'score': score, 'text': text}} AS c,
  row_number() OVER (PARTITION BY request_id, parent_id, lane ORDER BY score DESC, evidence_id) AS nth FROM evidence WHERE lane IS NOT NULL AND score IS NOT NULL AND parent_id <> '') WHERE nth = 1),
m2 AS (SELECT request_id, parent_id, {', '.join(f"any_value(c) FILTER (lane = {_q(x)}) AS {x}" for x in L.LANE_WEIGHTS)} FROM m1 GROUP BY request_id, parent_id),
m3 AS (SELECT *, sparse_anchor IS NOT NULL AND (sparse_full IS NULL OR sparse_anchor.score > sparse_full.score) AS later FROM m2),
m4 AS (SELECT *, CASE WHEN later THEN sparse_anchor ELSE sparse_full END AS sparse, CASE WHEN later THEN sparse_full END AS lost, coalesce(dense_anchor, dense_full) AS dense, CASE WHEN dense_anchor IS NOT NULL THEN dense_full END AS earlier FROM m3),
merged AS (SELECT request_id, parent_id, coalesce(sparse, dense) AS preferred, CASE WHEN sparse IS NULL THEN earlier ELSE coalesce(dense, lost) END AS alternate FROM m4 WHERE coalesce(sparse, dense) IS NOT NULL)"""
MERGED = f"{PAIRS}, {MERGE}"
ID = "md5(concat_ws(chr(1), lang, query, {0}))"


def best_of(merged: str) -> str:
    """CTEs that end in ``chosen``: the best candidate of each row of ``merged`` (request_id, parent_id, preferred, alternate) with its snippet."""
    return f"""k0 AS (SELECT m.*, r.query, coalesce(r.language, '') AS lang, coalesce(r.language, '') AS language FROM {merged} m JOIN requests r USING (request_id)),
k1 AS (SELECT request_id, parent_id, query, lang, language, 0 AS place, preferred AS c FROM k0 UNION ALL SELECT request_id, parent_id, query, lang, language, 1, alternate FROM k0 WHERE alternate IS NOT NULL),
kt AS (SELECT language, chunk_id, min(text) AS known FROM corpus WHERE chunk_id IS NOT NULL AND text <> '' GROUP BY language, chunk_id),
k2 AS (SELECT request_id, parent_id, query, lang, k1.language AS language, place, c.chunk_id AS chunk_id, c.lane AS lane, c.score AS score, CASE WHEN coalesce(c.text, '') = '' THEN kt.known ELSE c.text END AS text
  FROM k1 LEFT JOIN kt ON kt.language = k1.language AND kt.chunk_id = (k1.c).chunk_id
  UNION ALL SELECT k0.request_id, k0.parent_id, query, lang, k0.language, 2, o.chunk_id, 'sibling', NULL, o.text FROM k0 JOIN corpus o ON o.language = k0.language AND o.parent_id = k0.parent_id WHERE o.text <> ''),
k3 AS (SELECT *, {ID.format('text')} AS tid FROM (SELECT *, row_number() OVER (PARTITION BY request_id, parent_id, chunk_id, text ORDER BY place) AS nth FROM k2 WHERE text IS NOT NULL AND text <> '') WHERE nth = 1),
kd AS (SELECT DISTINCT tid, lang, language, query, text FROM k3),
{_scored('kd', 'kp', 'text', 'tid')},
k4 AS (SELECT * FROM (SELECT k3.* EXCLUDE (nth), row_number() OVER (PARTITION BY request_id, parent_id ORDER BY coalesce(kp.pack9, 0) DESC, place, chunk_id ASC NULLS FIRST, text) AS nth FROM k3 LEFT JOIN kp USING (tid)) WHERE nth = 1),
kw AS (SELECT DISTINCT tid AS evidence_id, query, lang, language, text, 240 AS mx FROM k4), {windows('kw', 'kw_')},
k5 AS (SELECT k4.*, w.win AS snippet, {ID.format('w.win')} AS sid FROM k4 JOIN kw_windows w ON w.evidence_id = k4.tid WHERE w.win <> ''),
ke AS (SELECT DISTINCT sid, lang, language, query, snippet FROM k5), {_scored('ke', 'ks', 'snippet', 'sid')},
chosen AS (SELECT k5.*, coalesce(ks.pack9, 0) AS evidence FROM k5 LEFT JOIN ks USING (sid))"""


def featured(chosen: str) -> str:
    """CTEs that end in ``feat``: ``chosen`` candidates of ``fused`` parents with idf-weighted coverage and anchors."""
    content = f"list_filter({terms('qf')}, lambda t: length(t) >= 2 AND NOT list_contains({_by('language', L.QUESTION_TERMS, '[]')}, t))"
    return f"""z0 AS (SELECT DISTINCT query, language, {collapsed(folded(nfkc('query')))} AS qf FROM {chosen}),
z1 AS (SELECT *, {content} AS l FROM z0), z2 AS (SELECT query, language, {once('l')} AS l FROM z1),
z3 AS (SELECT query, language, u.p AS p, u.t AS t FROM (SELECT query, language, unnest(list_transform(l, lambda t, i: {{'p': i, 't': t}})) AS u FROM z2)),
z4 AS (SELECT z3.*, coalesce(CASE WHEN d.df > 0 THEN round(ln(1 + (s.n + 1) / (d.df + 1)), 9) END, 0) AS idf FROM z3 LEFT JOIN df d ON d.language = z3.language AND d.term = z3.t LEFT JOIN stats s ON s.language = z3.language),
z5 AS (SELECT *, row_number() OVER (PARTITION BY query, language ORDER BY idf DESC, p) AS r FROM z4),
z6 AS (SELECT query, language, list({{'t': t, 'w': greatest(1.0, least(idf, 8.0))::DOUBLE}} ORDER BY p) AS items,
  coalesce(list(t ORDER BY p) FILTER (WHERE r <= 3 AND idf > 0), list(t ORDER BY p) FILTER (WHERE p <= 3), []) AS anch FROM z5 GROUP BY query, language),
f1 AS (SELECT c.*, f.rrf, f.in_lanes, coalesce(z6.items, []) AS items, coalesce(z6.anch, []) AS anch, {collapsed(folded(nfkc('c.snippet')))} AS form FROM fused f JOIN {chosen} c USING (request_id, parent_id) LEFT JOIN z6 ON z6.query = c.query AND z6.language = c.language),
f2 AS (SELECT *, {terms('form')} AS shown FROM f1),
feat AS (SELECT request_id, parent_id, query, lang, language, chunk_id, lane, score, text, snippet, rrf, evidence AS ev, {AGREE} AS agree, len(anch) AS n_anchors,
  CASE WHEN len(anch) = 0 THEN 0.0 ELSE ({count_matched('anch', 'shown', lambda a, b: engine_match(a, b, 'lang'))})::DOUBLE / len(anch) END AS anchor_coverage,
  CASE WHEN len(items) = 0 THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform(list_filter(items, lambda x: len(list_filter(shown, lambda b: {engine_match('x.t', 'b', 'lang')})) > 0), lambda x: x.w)), 0) / list_sum(list_transform(items, lambda x: x.w)) END AS cov,
  len(anch) > 0 AND contains(form, array_to_string(anch, ' ')) AS phrase FROM f2)"""


_MM = "(CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-9 THEN 0.5 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END)"
_LANES = RANKING.replace(EVIDENCE + ", " + REQUESTS + ",", "").strip()
BEST = f"""{STATS}, {MERGED}, {_LANES}, {FUSED}, held AS (SELECT m.* FROM merged m SEMI JOIN fused f USING (request_id, parent_id)), {best_of('held')}"""
FEATURES = f"{BEST}, {featured('chosen')}"
RERANK = f"""rr AS (SELECT * EXCLUDE (score), score AS own_score, round(0.28 * {_MM.format('rrf')} + 0.27 * anchor_coverage + 0.20 * cov + 0.15 * {_MM.format('ev')} + 0.05 * agree::INT + 0.05 * phrase::INT
  - CASE WHEN n_anchors > 0 AND anchor_coverage = 0 THEN 0.18 ELSE 0 END, 9) AS score FROM feat WINDOW w AS (PARTITION BY request_id)),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, parent_id) AS new_rank FROM rr) WHERE new_rank <= 20)"""
RERANKED = f"{FEATURES}, {RERANK}"
PACKED = f"""{RERANKED},
p1 AS (SELECT request_id, parent_id, new_rank, row_number() OVER (PARTITION BY request_id ORDER BY new_rank) AS block, left(snippet, 175) AS short FROM reranked WHERE snippet <> ''),
p2 AS (SELECT request_id, parent_id, block, '[' || block || '] ' || short AS snippet FROM p1 WHERE block <= 2),
p3 AS (SELECT *, coalesce(sum(length(snippet) + 2) OVER (PARTITION BY request_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(snippet) AS ends FROM p2),
packed AS (SELECT request_id, CAST(block AS INTEGER) AS block, parent_id, snippet FROM p3 WHERE ends <= 350)"""


def blocks(budget: int) -> str:
    """CTEs that end in ``blocks``: the first two reranked snippets under ``budget``, the second cut if it must be."""
    return f"""b0 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY new_rank) AS spot FROM reranked),
b1 AS (SELECT * FROM b0 WHERE spot = 1 AND length(snippet) <= {budget}),
b2 AS (SELECT b0.*, {budget} - length(b1.snippet) - 2 AS room, {ID.format('b0.text').replace('lang', 'b0.lang').replace('query', 'b0.query')} || ':' || ({budget} - length(b1.snippet) - 2) AS bid FROM b0 JOIN b1 USING (request_id) WHERE b0.spot = 2),
bw AS (SELECT DISTINCT bid AS evidence_id, query, lang, language, text, room AS mx FROM b2 WHERE length(snippet) > room AND room >= 80), {windows('bw', 'bw_')},
blocks AS (SELECT request_id, 1 AS block, parent_id, chunk_id, lane, own_score AS score, snippet FROM b1
  UNION ALL SELECT request_id, 2, parent_id, chunk_id, lane, own_score, snippet FROM b2 WHERE length(snippet) <= room
  UNION ALL SELECT request_id, 2, parent_id, chunk_id, lane, own_score, w.win FROM b2 JOIN bw_windows w ON w.evidence_id = b2.bid WHERE w.win <> '')"""


_SHAPE = rf"""length(sp) <= 90 AND length(sp) > 0 AND (NOT ({any_in(folded('query'), _by('lang', L.NUMBER_MARKERS, '[]'))}) OR regexp_matches(sp, '\p{{Nd}}'))
  AND NOT ({_ECHO.replace('answer', 'sp')}) AND (regexp_matches(sp, {_by('lang', {k: f'[{v}]' for k, v in L.SCRIPTS.items()}, "'[A-Za-z]'", _q)}) OR regexp_matches(sp, '[A-Za-z\p{{Nd}}°%]'))
  AND len(list_filter(range(1, len({terms('sp')}) - 1), lambda i: {terms('sp')}[i] = {terms('sp')}[i + 1] AND {terms('sp')}[i + 1] = {terms('sp')}[i + 2])) = 0"""
GUARDED = f"""WITH {JUDGED},
g1 AS (SELECT *, {_bare(grounding_form('sp'))} AS sbare, starts_with(trim(raw_answer), '{L.NOT_FOUND}') AS missing FROM judged),
g2 AS (SELECT *, coalesce({_SHAPE} AND {supported_by('sbare')}, false) AS fine, coalesce(NOT missing AND answer <> '' AND shape_ok AND {supported_by('bare')}, false) AS kept FROM g1),
g3 AS (SELECT *, CASE WHEN fine AND conf >= 0.90 THEN 'span' WHEN kept THEN 'answer' WHEN fine AND conf >= 0.60 THEN 'repair' ELSE 'message' END AS source FROM g2)
SELECT language, query, raw_answer, CASE source WHEN 'answer' THEN answer WHEN 'message' THEN {_MESSAGE} ELSE sp END AS final_answer, source,
  CASE WHEN source = 'message' THEN CASE WHEN missing THEN 'model_abstained' WHEN truncated THEN 'truncated_unsupported' WHEN answer <> '' AND echo THEN 'question_echo' ELSE 'unsupported_answer' END END AS code FROM g3"""
_CLEAN = _TRIMMED
for _prefix in L.ENGINE_PREFIXES:
    _CLEAN = f"CASE WHEN starts_with({_CLEAN}, {_q(_prefix)}) THEN regexp_replace(substring({_CLEAN}, {len(_prefix) + 1}), '^{BL}+|{BL}+$', '', 'g') ELSE {_CLEAN} END"
ENGINE = f"""WITH {JUDGED}, e1 AS (SELECT language, query, raw_answer, form, {_CLEAN} AS c FROM judged),
e2 AS (SELECT *, CASE WHEN upper(c) = '{L.NOT_FOUND}' THEN '{L.NOT_FOUND}' ELSE c END AS clean FROM e1), e3 AS (SELECT *, {grounding_form('clean')} AS cf FROM e2)
SELECT language, query, raw_answer, CASE WHEN coalesce(cf <> '' AND (cf = '{L.NOT_FOUND.lower()}' OR contains(coalesce(form, ''), cf)), false) THEN clean ELSE '{L.NOT_FOUND}' END AS engine_answer FROM e3"""

RAG_LANES = f"""{VIEWS}, asked AS (SELECT query_id, vw, language, text FROM views), {BM25}, {USABLE},
rm AS (SELECT vector_row, min(parent_id) AS parent_id, min(chunk_id) AS chunk_id, min(language) AS language FROM metadata WHERE vector_row IS NOT NULL GROUP BY vector_row),
rv AS (SELECT u.vector_row, CAST(u.v AS DOUBLE[]) AS v, rm.parent_id, rm.chunk_id, rm.language FROM usable u JOIN rm USING (vector_row)),
rc AS (SELECT language, chunk_id, min(vector_row) AS query_row FROM rv WHERE chunk_id IS NOT NULL GROUP BY ALL),
rs AS (SELECT query_id, vw, language, min_by(query_row, rnk) AS query_row FROM hits JOIN rc USING (language, chunk_id) GROUP BY ALL),
rn AS (SELECT d.query_row, h.vector_row, round(list_cosine_similarity(q.v, h.v), 9) AS similarity FROM (SELECT DISTINCT language, query_row FROM rs) d JOIN rv q ON q.vector_row = d.query_row JOIN rv h ON h.language = d.language AND h.vector_row <> d.query_row),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY similarity DESC, vector_row) AS rnk FROM rn) WHERE rnk <= 100),
rh AS (SELECT rs.query_id, rs.vw, rt.rnk, rm.parent_id, rm.chunk_id, rt.similarity FROM rt JOIN rs USING (query_row) JOIN rm USING (vector_row) WHERE rm.parent_id <> ''),
rp AS (SELECT *, row_number() OVER (PARTITION BY query_id, vw ORDER BY rnk) AS parent_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, vw, parent_id ORDER BY rnk) AS nth FROM rh) WHERE nth = 1),
lanes AS (SELECT query_id AS request_id, 'sparse_' || vw AS lane, parent_rank AS rnk, parent_id, chunk_id, score FROM parents
  UNION ALL SELECT query_id, 'dense_' || vw, parent_rank, parent_id, chunk_id, similarity FROM rp WHERE parent_rank <= 50)"""
RAG = f"""WITH {RAG_LANES}, {FUSED},
requests AS (SELECT query_id AS request_id, query, language FROM validation_queries),
evidence AS (SELECT l.request_id, l.parent_id, l.lane, l.score, l.chunk_id, CAST(NULL AS VARCHAR) AS text, l.lane || ':' || lpad(CAST(l.rnk AS VARCHAR), 5, '0') AS evidence_id FROM lanes l SEMI JOIN fused f USING (request_id, parent_id)),
{MERGE}, {best_of('merged')}, {featured('chosen')}, {RERANK}, {blocks(490)},
packs AS (SELECT request_id, string_agg(snippet, chr(10) || chr(10) ORDER BY block) AS context, string_agg(parent_id, ',' ORDER BY block) AS parents, string_agg(coalesce(chunk_id, ''), ',' ORDER BY block) AS chunks, string_agg(lane, ',' ORDER BY block) AS lanes
  FROM blocks GROUP BY request_id),
ctx AS (SELECT DISTINCT r.language AS lang, r.language, r.query, p.context, p.context AS text FROM packs p JOIN requests r USING (request_id)), {GROUNDS}
o1 AS (SELECT v.query_id, v.language, v.language AS lang, v.query, p.context, p.parents, p.chunks, p.lanes, g.sp, g.conf, {grounding_form('p.context')} AS form, f.forms, {_bare(grounding_form('g.sp'))} AS sbare
  FROM validation_queries v LEFT JOIN packs p ON p.request_id = v.query_id LEFT JOIN gspan g ON g.lang = v.language AND g.query = v.query LEFT JOIN gforms f ON f.lang = v.language AND f.query = v.query),
o2 AS (SELECT *, coalesce({_SHAPE} AND {supported_by('sbare')} AND conf >= 0.60, false) AS fine FROM o1)
SELECT query_id, language, coalesce(context, '') AS context, coalesce(parents, '') AS parents, coalesce(chunks, '') AS chunks, coalesce(lanes, '') AS lanes,
  {_q(L.PROMPT)} || chr(10) || chr(10) || 'Evidence: ' || coalesce(context, '') || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || 'Answer:' AS prompt,
  CASE WHEN fine THEN sp ELSE {_by('language', L.NOT_FOUND_MESSAGES, _q(L.NOT_FOUND_MESSAGE), _q)} END AS answer, CASE WHEN fine AND conf >= 0.90 THEN 'span' WHEN fine THEN 'repair' ELSE 'message' END AS source,
  CASE WHEN context IS NULL THEN 'no_grounded_context' WHEN fine THEN NULL ELSE 'model_abstained' END AS code FROM o2"""

EXPECTED = f"""{LOG}, x1 AS (SELECT query_id, answer, count(*) AS n FROM log WHERE packed_hit AND NOT is_not_found AND output_guardrail_code IS NULL AND answer <> '' GROUP BY ALL),
x2 AS (SELECT query_id, answer AS expected, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, answer) AS nth FROM x1),
expected AS (SELECT v.query_id, v.language, x.expected, {_bare(grounding_form('x.expected'))} AS bare FROM validation_queries v JOIN x2 x USING (query_id) WHERE nth = 1),
forms AS (SELECT language, {grounding_form('text')} AS shown FROM corpus),
found AS (SELECT e.query_id, e.expected FROM expected e WHERE bare <> '' AND EXISTS (SELECT 1 FROM forms f WHERE f.language = e.language AND contains(f.shown, e.bare)))"""
_NUM = "CASE WHEN NOT isnan({0}) THEN {0} END"
_ZERO = "coalesce(CASE WHEN NOT isnan({0}) THEN {0} END, 0)"
_STAGES = " + ".join(_ZERO.format(x) for x in ("retrieval_ms", "context_ms", "prompt_prep_ms", "model_first_token_ms"))

ORACLE_SQL: dict[str, str] = {
    "validate_chunks": f"WITH {CORPUS} SELECT language, count(*) AS n_chunks, count(DISTINCT parent_id) AS n_parents, count(*) FILTER (WHERE chunk_id IS NULL) AS n_null_ids, count(*) FILTER (WHERE trim(text) = '') AS n_blank FROM corpus GROUP BY language",
    "validate_vectors": f"WITH {USABLE}, r AS (SELECT DISTINCT vector_row FROM vectors), j AS (SELECT r.vector_row, r.vector_row IN (SELECT vector_row FROM usable) AS u, r.vector_row IN (SELECT vector_row FROM metadata) AS m FROM r) SELECT count(*) AS n_rows, count(*) FILTER (WHERE u) AS n_usable, count(*) FILTER (WHERE m) AS n_named, count(*) FILTER (WHERE u AND m) AS n_ready FROM j",
    "embedding_report": f"WITH {USABLE} SELECT count(*) AS n_rows, max(len(v)) AS dimension, round(avg(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)))) FILTER (WHERE vector_row < 1000), 6) AS mean_sample_norm FROM usable",
    "tokenize_stats": f"WITH {CORPUS}, {TOKENS}, t AS (SELECT language, unnest(ts) AS term FROM tok) SELECT language, count(*) AS n_tokens, count(DISTINCT term) AS n_distinct FROM t GROUP BY language",
    "content_terms": f"WITH {REQUESTS}, x AS (SELECT request_id, {CONTENT} AS l FROM requests) SELECT request_id, array_to_string({once('l')}, ' ') AS terms FROM x",
    "informative_terms": f"WITH {REQUESTS}, x AS (SELECT request_id, {INFORMATIVE} AS l FROM requests) SELECT request_id, array_to_string({once('l')}, ' ') AS terms FROM x",
    "required_anchors": f"WITH {REQUESTS}, r AS (SELECT request_id, query, coalesce(language, '') AS lang, query AS unit FROM requests), {supported('r', 'unit')}, a AS (SELECT request_id, anchors AS l FROM s1) SELECT request_id, array_to_string({once('l')}, ' ') AS anchors FROM a",
    "fuzzy_matches": f"WITH {PAIRS}, x AS (SELECT evidence_id, lang, list_distinct({terms('query')}) AS q, list_distinct({terms('text')}) AS t FROM pairs) SELECT evidence_id, {count_matched('q', 't', lambda a, b: engine_match(a, b, 'lang'))} AS n_engine, {count_matched('q', 't', evidence_match)} AS n_evidence, {count_matched('q', 't', guardrail_match)} AS n_guardrail FROM x",
    "chunk_fixed": "WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS parent_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 384) / 288), 0) AS BIGINT) + 1)) AS chunk_no FROM documents WHERE length(text) > 0) SELECT parent_id, chunk_no, substring(text, chunk_no * 288 + 1, 384) AS chunk FROM d",
    "postings": f"WITH {STATS} SELECT language, chunk_id, term, tf, dl FROM post",
    "term_df": f"WITH {STATS} SELECT language, term, df FROM df",
    "corpus_stats": f"WITH {CORPUS}, {TOKENS} SELECT language, count(*) AS n_chunks, round(avg(CAST(len(ts) AS DOUBLE)), 9) AS avgdl FROM tok GROUP BY language",
    "idf_proxy": f"WITH {STATS}, {REQUESTS}, a AS (SELECT DISTINCT language, unnest({terms('query')}) AS term FROM requests WHERE language IN ('ta', 'hi')) SELECT a.language, a.term, round(CASE WHEN d.df > 0 THEN ln(1 + (s.n + 1) / (d.df + 1)) ELSE 0 END, 9) AS idf FROM a LEFT JOIN df d USING (language, term) LEFT JOIN stats s USING (language)",
    "bm25_chunk_topk": f"WITH {STATS}, {ASKED}, {BM25} SELECT query_id, rnk AS rank, chunk_id, round(score, 6) AS score FROM hits",
    "bm25_parent_collapse": f"WITH {STATS}, {ASKED}, {BM25} SELECT query_id, parent_rank, parent_id, chunk_id FROM parents",
    "anchor_terms": f"WITH {ANCHORS} SELECT query_id, array_to_string(anchors, ' ') AS anchors, round(top_idf, 6) AS top_idf FROM anchored",
    "query_views": f"WITH {VIEWS} SELECT query_id, vw AS view, text FROM views",
    "sparse_lanes": f"WITH {LANES_SPARSE} SELECT query_id, lane, parent_id, rnk AS rank FROM sparse_lanes",
    "sparse_fused": f"WITH {LANES_SPARSE}, lanes AS (SELECT query_id AS request_id, lane, parent_id, rnk FROM sparse_lanes), {FUSED} SELECT request_id AS query_id, rnk AS rank, parent_id, rrf FROM fused",
    "vector_topk_cosine": f"WITH {VECTOR_HITS} SELECT query_row, rnk AS rank, vector_row, round(similarity, 6) AS similarity FROM vhits",
    "dense_parent_collapse": f"WITH {VECTOR_HITS}, m AS (SELECT vector_row, min(parent_id) AS parent_id FROM metadata GROUP BY vector_row), h AS (SELECT * FROM vhits JOIN m USING (vector_row) WHERE parent_id <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY query_row, parent_id ORDER BY rnk) AS nth FROM h), g AS (SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY rnk) AS parent_rank FROM f WHERE nth = 1) SELECT query_row, parent_rank, parent_id, vector_row FROM g WHERE parent_rank <= 50",
    "lane_ranking": f"WITH {RANKING} SELECT request_id, lane, rnk AS rank, parent_id FROM lanes",
    "rrf_v3": f"WITH {RANKING}, {FUSED} SELECT request_id, rnk AS rank, parent_id, rrf, {AGREE} AS agree FROM fused",
    "rrf_v1": f"WITH {RANKING}, {FUSED_V1} SELECT request_id, rnk AS rank, parent_id, rrf FROM fused_v1",
    "ranking_parity": f"WITH {RANKING}, {FUSED}, {FUSED_V1}, b AS (SELECT g.request_id, count(*) AS places, count(*) FILTER (WHERE g.parent_id = c.parent_id) AS same FROM fused_v1 g LEFT JOIN fused c ON g.request_id = c.request_id AND g.rnk = c.rnk AND c.rnk <= 20 GROUP BY g.request_id) SELECT places, count(*) AS n_requests, CAST(sum(same) AS BIGINT) AS n_same FROM b GROUP BY places",
    "support_signal": f"WITH {PAIRS}, {supported('pairs', 'text')} SELECT evidence_id, matched, total, round(coverage, 6) AS coverage, anchors_ok, constraints_ok, contradiction, strong, round(score9, 6) AS score, round(pack9, 6) AS pack_score FROM sup",
    "evidence_sentences": f"WITH {EVIDENCE}, {sentences('evidence')}, u AS (SELECT evidence_id, unnest(list_transform(ss, lambda x, i: {{'pos': i - 1, 'x': x}})) AS u FROM sent) SELECT evidence_id, u.pos AS pos, u.x AS sentence FROM u",
    "evidence_units": f"WITH {EVIDENCE}, {sentences('evidence')}, {UNIT_ROWS} SELECT evidence_id, pos, unit FROM units",
    "strongest_unit": f"WITH {STRONGEST} SELECT evidence_id, unit, strong, round(score9, 6) AS score, round(pack9, 6) AS pack_score FROM best",
    "alignment_features": f"WITH {FEATURES} SELECT request_id, parent_id, round(anchor_coverage, 6) AS anchor_coverage, round(cov, 6) AS coverage, agree, phrase FROM feat",
    "rerank_v3": f"WITH {RERANKED} SELECT request_id, new_rank, parent_id, round(score, 6) AS rerank_score FROM reranked",
    "context_pack": f"WITH {PACKED} SELECT * FROM packed",
    "evidence_window": f"WITH {PAIRS}, wr AS (SELECT evidence_id, query, lang, language, text, 240 AS mx FROM pairs), {windows('wr', 'w_')} SELECT evidence_id, win AS window FROM w_windows",
    "context_pack_v3": f"WITH {RERANKED}, {blocks(490)} SELECT request_id, CAST(block AS INTEGER) AS block, parent_id, snippet AS window FROM blocks",
    "context_pack_shrunk": f"WITH {RERANKED}, {blocks(350)} SELECT request_id, CAST(block AS INTEGER) AS block, parent_id, chunk_id, lane, score, snippet AS window FROM blocks",
    "merged_evidence": f"WITH {MERGED} SELECT request_id, parent_id, preferred.chunk_id AS chunk_id, preferred.lane AS lane, preferred.score AS score, alternate.chunk_id AS other_chunk, alternate.lane AS other_lane FROM merged",
    "best_candidate": f"WITH {BEST} SELECT request_id, parent_id, chunk_id, lane, snippet, round(evidence, 6) AS evidence FROM chosen",
    "grounding_form": f"WITH {REQUESTS} SELECT request_id, {grounding_form('query')} AS form FROM requests",
    "engine_answer": ENGINE,
    "input_guardrail": rf"WITH {REQUESTS}, c AS (SELECT request_id, CASE WHEN {collapsed('query')} = '' THEN 'empty_query' WHEN length(query) > 500 THEN 'query_too_long' WHEN language IS NULL OR language NOT IN ('ta', 'hi') THEN 'unsupported_language' WHEN regexp_matches(query, '(?i)\bhow\s+to\s+make\s+a?\s*(bomb|explosive)\b|\bkill\s+myself\b|\bsuicide\s+method\b|\bchild\s+sexual\b') THEN 'unsafe_content' END AS code FROM requests) SELECT request_id, code, code IS NULL AS allowed FROM c",
    "grounding_guardrail": f"WITH {PACKED}, n AS (SELECT request_id, count(*) AS blocks FROM packed GROUP BY request_id) SELECT r.request_id, coalesce(n.blocks, 0) AS blocks, CASE WHEN n.blocks IS NULL THEN 'no_grounded_context' END AS code FROM (SELECT DISTINCT request_id FROM requests) r LEFT JOIN n USING (request_id)",
    "answer_shape": f"WITH {SHAPED} SELECT language, query, raw_answer, answer, type_ok, script_ok, echo, repeats, shape_ok FROM judged0",
    "answer_grounded": f"WITH {JUDGED} SELECT language, query, raw_answer, answer, grounded FROM judged",
    "extract_answer": f"WITH {STRONGEST}, b2 AS (SELECT evidence_id, query, lang, language, unit FROM best), {spans('b2')} SELECT evidence_id, found[1].span AS span, found[1].confidence AS confidence, found[1].method AS method FROM spanned",
    "output_guardrail": GUARDED,
    "hash_sample": "WITH s AS (SELECT language, query_id, row_number() OVER (PARTITION BY language ORDER BY sha256(concat_ws(':', 'vettiver-sample-1', language, query_id)), query_id) AS nth FROM validation_queries) SELECT language, CAST(nth AS INTEGER) AS nth, query_id FROM s WHERE nth <= 50",
    "parse_list": f"WITH a AS (SELECT DISTINCT raw_answer FROM full_rag_t4_per_query), p AS (SELECT raw_answer, CASE WHEN raw_answer IS NULL THEN {_EMPTY} WHEN starts_with(trim(raw_answer), '[') THEN coalesce(TRY_CAST(TRY_CAST(trim(raw_answer) AS JSON) AS VARCHAR[]), [trim(raw_answer)]) ELSE [trim(raw_answer)] END AS l FROM a), c AS (SELECT raw_answer, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS l FROM p) SELECT raw_answer, array_to_string(l, '|') AS items, len(l) AS n_items FROM c",
    "recall_at_20": f"WITH {LANES_SPARSE}, lanes AS (SELECT query_id AS request_id, lane, parent_id, rnk FROM sparse_lanes), {FUSED}, {PAIRS}, rel AS (SELECT DISTINCT v.query_id, p.parent_id FROM pairs p JOIN validation_queries v ON p.query = v.query WHERE p.parent_id <> ''), j AS (SELECT r.query_id, count(*) AS relevant, count(f.parent_id) AS hits FROM rel r LEFT JOIN fused f ON f.request_id = r.query_id AND f.parent_id = r.parent_id AND f.rnk <= 20 GROUP BY r.query_id) SELECT query_id, relevant, hits, round(hits / relevant, 6) AS recall_20, hits > 0 AS hit_20 FROM j",
    "latency_percentiles": f"WITH {LOG}, u AS ({' UNION ALL '.join(f'SELECT language, {_q(s)} AS stage, {s} AS ms FROM log' for s in STAGES)}) SELECT language, stage, count(*) AS n, {_PCT.format(0.5)} AS p50, {_PCT.format(0.7)} AS p70, {_PCT.format(0.9)} AS p90, {_PCT.format(0.95)} AS p95, {_PCT.format(0.99)} AS p99, max(ms) AS p100, round(avg(ms), 6) AS mean FROM u WHERE ms IS NOT NULL AND NOT isnan(ms) GROUP BY language, stage",
    "under_200_share": f"WITH {LOG} SELECT language, run_id, count(*) AS n, round(avg(CASE WHEN full_rag_ttft_ms IS NULL OR isnan(full_rag_ttft_ms) THEN NULL WHEN full_rag_ttft_ms < 200 THEN 1.0 ELSE 0.0 END) * 100, 6) AS under_200 FROM log GROUP BY language, run_id",
    "abstention_report": f"WITH {LOG} SELECT language, run_id, count(*) AS n, round(avg(hit_20::INT), 9) AS hit_rate, round(avg(packed_hit::INT), 9) AS packed_rate, round(avg(is_not_found::INT), 9) AS not_found_rate, round(avg((packed_hit AND is_not_found)::INT), 9) AS false_abstention, round(avg(possibly_truncated::INT), 9) AS truncation_rate, round(sum((packed_hit AND NOT is_not_found)::INT) / greatest(sum(packed_hit::INT), 1), 9) AS answer_rate FROM log GROUP BY language, run_id",
    "expected_answers": f"WITH {CORPUS}, {EXPECTED} SELECT query_id, language, expected FROM expected",
    "corpus_hits": f"WITH {CORPUS}, {EXPECTED} SELECT query_id, expected FROM found",
    "latency_accounting": f"WITH {LOG}, a AS (SELECT result_id, coalesce({_NUM.format('full_rag_ttft_ms')}, {_STAGES}) AS t, coalesce({_NUM.format('full_rag_complete_ms')}, {_ZERO.format('retrieval_ms')} + {_ZERO.format('context_ms')} + {_ZERO.format('generation_ttft_ms')}) AS c, {_STAGES} AS s FROM log WHERE result_id IS NOT NULL) SELECT result_id, round(t, 6) AS ttft_ms, round(c, 6) AS complete_ms, round(greatest(c - s, 0), 6) AS overhead_ms FROM a",
    "sample_answers": f"WITH {LOG}, a AS (SELECT language, query_id, answer, row_number() OVER (PARTITION BY language, query_id ORDER BY result_id, answer) AS k FROM log WHERE query_id IS NOT NULL), b AS (SELECT language, query_id, answer, row_number() OVER (PARTITION BY language ORDER BY query_id) AS nth FROM a WHERE k = 1) SELECT language, CAST(nth AS INTEGER) AS nth, query_id, answer FROM b WHERE nth <= 5",
    "spoken_queries": "WITH e AS (SELECT DISTINCT user_id, event_id, event_type, props FROM events) SELECT user_id || '-' || event_id AS request_id, trim(props) AS query FROM e WHERE event_type = 'purchase' AND trim(props) <> ''",
    "encoded_audio": """WITH e AS (SELECT DISTINCT user_id, event_id, event_type, props FROM events) SELECT user_id AS session, event_id AS seq, to_base64(encode(CASE WHEN props IS NULL THEN '{"kind":"audio"}' ELSE '{"kind":"audio","text":' || to_json(props) || '}' END)) AS audio FROM e WHERE event_type = 'view'""",
    "failure_attribution": f"WITH {CORPUS}, {EXPECTED}, b AS (SELECT f.query_id IS NOT NULL AS corpus, coalesce(hit_20, false) AS retrieved, coalesce(packed_hit, false) AS packed, coalesce(e.bare <> '' AND contains({grounding_form('l.raw_answer')}, e.bare), false) AS raw, output_guardrail_code IS NULL AS allowed, coalesce(e.bare <> '' AND contains({grounding_form('l.answer')}, e.bare), false) AS final FROM log l LEFT JOIN expected e ON e.query_id = l.query_id LEFT JOIN found f ON f.query_id = l.query_id), c AS (SELECT CASE WHEN final AND allowed THEN 'PASS' WHEN NOT corpus THEN 'CORPUS_MISS' WHEN NOT retrieved THEN 'RETRIEVAL_MISS' WHEN NOT packed THEN 'CONTEXT_PACKING_MISS' WHEN NOT raw THEN 'GENERATION_MISS' WHEN NOT allowed OR NOT final THEN 'GROUNDING_REJECTION' ELSE 'UNKNOWN' END AS failure FROM b), d AS (SELECT unnest(['PASS', 'CORPUS_MISS', 'RETRIEVAL_MISS', 'CONTEXT_PACKING_MISS', 'GENERATION_MISS', 'GROUNDING_REJECTION', 'UNKNOWN']) AS failure), n AS (SELECT d.failure, count(c.failure) AS n FROM d LEFT JOIN c ON d.failure = c.failure GROUP BY d.failure) SELECT failure, n, round(n * 100.0 / greatest(sum(n) OVER (), 1), 6) AS percent FROM n",
    "transcript_events": f"WITH {FRAMES} SELECT session, ts, kind AS event, kind = 'final' AS is_final FROM frames WHERE kind IN ('partial', 'final', 'begin', 'end', 'error')",
    "stt_final_latency": f"WITH {FRAMES}, w AS (SELECT *, min(ts) FILTER (WHERE kind = 'audio') OVER (PARTITION BY session ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS first_audio FROM frames) SELECT session, seq, round((epoch_us(ts) - epoch_us(first_audio)) / 1000, 3) AS latency_ms FROM w WHERE kind = 'final'",
    "rag_lanes": f"WITH {RAG_LANES} SELECT request_id AS query_id, lane, rnk AS rank, parent_id, chunk_id, round(score, 6) AS score FROM lanes",
    "rag_response": RAG,
    "packed_hits": f"WITH rag AS ({RAG}), {PAIRS}, rel AS (SELECT v.query_id, list(DISTINCT p.parent_id) AS relevant FROM pairs p JOIN validation_queries v ON p.query = v.query WHERE p.parent_id <> '' GROUP BY v.query_id) SELECT query_id, len(relevant) AS n_relevant, len(list_intersect(string_split(parents, ','), relevant)) > 0 AS packed_hit FROM rel JOIN rag USING (query_id)",
}
