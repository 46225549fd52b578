"""Sentence spans in any language and script (problem 3).

Empty lines and list lines fix boundaries first. Between them, every end mark is a possible boundary, and semi-Markov
dynamic programming picks the whole spans with the best total score. A span's score joins

- its closing: the end mark and the last word, which may be a shortened word, an initial, or one that only shortens
  before a number;
- its opening: the first word, which may be one that opens sentences, one of saying that carries a quotation on, or a
  mark that nothing opens with;
- its length: spans of a letter or two are no sentences;
- the balance of its quotations and brackets, inside the span: what it opens and does not close, what it closes and has
  not opened, and whether all of it lies within a quotation.

The search is exact and linear: what depends on both ends of a span is its length, which is 0 but for the nearest starts,
and its least depth of quotation, by which the best starts are kept on a stack.

Positions count code points of the stored text. Null, empty and blank texts have no sentence. A text is one row of work,
whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the parts of a span's score weigh.
CLEAR_END, FULL_STOP, LETTER_END, SHORTENED = 2.0, 1.5, -2.0, -6.0
OPENER, CAPITAL, RUN_ON, CARRIED_ON = 2.5, 0.5, -4.0, -9.0
UNBALANCED, WITHIN = -6.0, -4.0
SHORT, TOO_SHORT = 4, -1.5

# Shortened words after which a full stop ends nothing (initials of one letter are found by rule).
ABBREVIATIONS = {
    "ta": "திரு பேரா திருமதி செல்வி டாக்டர் பக் மு எஸ் ஆர் இரா கே எ.கா ஜே எம் எண் ரூ கி.பி கி.மு மி.மீ கி.மீ தொ.எண் வி என் பி சி டி ஏ",
    "hi": "सुश्री श्री श्रीमती प्रो डॉ पं एस के आर वि एम जे एन बी सी डी पी टी वी पृ उदा रु सं क्र दू.सं ई.पू ई कि.मी मि.मी कु",
    "en": "mr mrs ms dr prof rev st jr sr vs cf e.g i.e vol approx rs no fig pp ed eds al hon gen col lt sgt capt dept est",
}
# Words that carry a sentence on after a closing quotation mark.
SAYING = {
    "ta": "என்று எனக் என என்றார் என்றாள் என்றான் எனவும் என்றும் என்ற என்பது எனும் என்கிறார் என்றனர்",
    "hi": "ऐसा यह और कहकर कहते बोला बोली बोले कहा पूछा ने तथा",
    "en": "said and came asked wrote replied says adds added noted answered cried or but was is were are",
    "zh": "他 她 我们 我",
    "ja": "と って という",
}
# Shortened words that are whole words, too: a full stop after them ends nothing only before a number.
BEFORE_NUMBERS = "no fig எண் सं पृ"
# Pronouns, articles, prepositions, conjunctions and adverbs that open sentences.
OPENERS = {
    "en": "a an the this that these those i you he she it we they one some many most few all each every both none nobody everybody someone everyone nothing "
    "in on at by for from with without within under over after before during since until about among between through according despite to "
    "and but or so yet if when while as although though because once however therefore moreover meanwhile then there here now today later "
    "also again still only even first next last finally another other such what who whom whose which where why how my your his her its our their not",
    "ta": "அவர் அவள் அவன் அது இது அவை இவை இவர் நான் நாம் நாங்கள் நீங்கள் அவர்கள் இவர்கள் இந்த அந்த ஆனால் எனினும் மேலும் பின்னர் பிறகு எனவே ஆகவே அதனால் இதனால் அங்கு இங்கு",
    "hi": "वह वे यह ये हम मैं आप तुम इस उस इन उन इसके उसके इसकी उसकी लेकिन परंतु किंतु फिर तब इसलिए वहाँ वहां यहाँ यहां जब अब",
}

ABBREVIATED = frozenset(" ".join(ABBREVIATIONS.values()).split())
SAID = "(?:he|she|they|we|I|you) (?:said|asked|wrote|replied|says|adds|added|noted|answered|cried)"
CARRIES_ON = re.compile("(?:" + "|".join(SAYING["zh"].split() + SAYING["ja"].split()) + rf")|(?:{SAID}|" + "|".join(w for k in ("ta", "hi", "en") for w in SAYING[k].split()) + r")(?![^\W\d_]|[ऀ-ःऺ-ॏஂா-ௗ])")
OPENS = frozenset(" ".join(OPENERS.values()).split())
NUMBERED = frozenset(BEFORE_NUMBERS.split())
FIRST_WORD = re.compile("[^\\s.,;:!?।॥|。，、…\"“”‘’()\\[\\]「」『』\\d]+")
INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]")
HIDDEN = "[\\u00ad\\u034f\\u200b-\\u200f\\u2060-\\u2064\\ufeff]*"
# Fixed value: the letters of list marks, with their full-width and look-alike forms.
LETTER = "[A-DＡ-ＤАВСΑΒ]"
EMPTY_LINE = re.compile(r"\n[^\S\n]*\n\s*")
LIST_LINE = re.compile(
    rf"^[^\S\n]*{HIDDEN}(?:[(\[（]{HIDDEN}(?:\d{{1,2}}|{LETTER}){HIDDEN}[.)\]）．]+|(?:\d{{1,2}}|{LETTER}){HIDDEN}[.)．）](?!\d)|[-‐‑‒–−－•‣◦▪●*·]{HIDDEN}(?=\s))",
    re.MULTILINE,
)
LETTER_DOT = re.compile(rf"[^\S\n]*{HIDDEN}{LETTER}{HIDDEN}[.．]")
MARKS = ".．?!？！।॥|。｡…"
END = re.compile(rf"[{MARKS}](?:{HIDDEN}[{MARKS}])*(?:{HIDDEN}[”’\"」』»)\]）】›])*")
FINAL_MARK = re.compile(rf"[?!？！।॥|。｡.．]+{HIDDEN}[”’\"」』»)\]]*\s*$")
QUOTE = re.compile("[“”‘’\"「」『』«»()（）]")
OPENING = dict(zip("“‘「『«(（", "”’」』»)）", strict=True))
LAST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}͏.]*$")


def _closing(text: str, at: int, after: int) -> float | None:
    """What a span gains by closing with the single full stop at ``at``; None if that is no end mark at all."""
    nxt = text[after] if after < len(text) else " "
    before = text[at - 1] if at else " "
    if before.isdigit() and nxt.isdigit():
        return None
    word = INVISIBLE.sub("", LAST_WORD.search(text, max(0, at - 24), at)[0]).lstrip(".")
    if not word:
        return FULL_STOP
    bare = word.casefold()
    if bare in ABBREVIATED:
        return SHORTENED if bare not in NUMBERED or text[after : after + 4].lstrip()[:1].isdigit() else FULL_STOP
    if nxt.isalnum() and bare + "." + nxt in ABBREVIATED_HEADS:
        return SHORTENED
    letters = regex.findall(r"\X", word.rpartition(".")[2])
    if len(letters) == 1 and letters[0][0].isalpha():
        return LETTER_END
    return FULL_STOP


def _opening(text: str, after: int, rest: int, hi: int, closed: bool, stop: bool) -> float:
    """What a span gains by opening at ``rest``, where the end mark before it, a full stop or not, ends at ``after``."""
    if rest >= hi:
        return 0.0
    first = text[rest]
    if first in MARKS or closed and (first in ",;:、，—" or CARRIES_ON.match(text, rest, hi)):
        return CARRIED_ON
    word = FIRST_WORD.match(text, rest, hi)
    known = word is not None and word[0].casefold() in OPENS
    gain = OPENER if known else CAPITAL if first.isupper() else 0.0
    if rest == after and stop and not closed and first.isascii() and first.islower():
        gain += 0.0 if known else RUN_ON
    return gain


ABBREVIATED_HEADS = frozenset(w[: i + 2] for w in ABBREVIATED for i in range(len(w) - 1) if w[i + 1 - 1] == ".") | frozenset(
    w.partition(".")[0] + "." + w.partition(".")[2][:1] for w in ABBREVIATED if "." in w
)


def _depths(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """(position after the mark, depth from there on) of quotations and brackets; an unopened one opens at the start."""
    events: list[list[int]] = []
    stack: list[str] = []
    unopened = 0
    for m in QUOTE.finditer(text, lo, hi):
        mark, at = m[0], m.start()
        if mark == '"':
            if stack and '"' in stack:
                while stack.pop() != '"':
                    pass
                events.append([m.end(), len(stack)])
            elif not stack and at > lo and text[at - 1] in MARKS and (m.end() == hi or text[m.end()].isspace()):
                unopened += 1
                events = [[p, d + 1] for p, d in events] + [[m.end(), 0]]
            else:
                stack.append('"')
                events.append([m.end(), len(stack)])
        elif mark in OPENING:
            stack.append(OPENING[mark])
            events.append([m.end(), len(stack)])
        elif mark in stack:
            while stack.pop() != mark:
                pass
            events.append([m.end(), len(stack)])
        elif mark == "’" and 0 < at < hi - 1 and text[at - 1].isalpha() and text[at + 1].isalpha():
            continue
        elif mark not in ")）" and not stack:
            unopened += 1
            events = [[p, d + 1] for p, d in events] + [[m.end(), 0]]
    return [(lo, unopened and 1)] + [(p, d) for p, d in events]


def _possible(text: str, lo: int, hi: int) -> tuple[list[int], list[float], list[float], list[int], list[int]]:
    """The possible boundaries of ``text[lo:hi]``: (cuts, closings, openings, depths, least depths since the cut before)."""
    cuts, closings, openings, depth, least = [lo], [0.0], [0.0], [0], [0]
    quoted = QUOTE.search(text, lo, hi) is not None
    depths = _depths(text, lo, hi) if quoted else []
    level = 0
    if quoted:
        depth[0] = least[0] = depths[0][1]
    for m in END.finditer(text, lo, hi):
        at, after = m.start(), m.end()
        if after >= hi:
            break
        marks = m[0]
        stops = INVISIBLE.sub("", marks).rstrip("”’\"」』»)]）】›")
        if "…" in stops or "..." in stops:
            continue
        closed = len(marks) > len(stops)
        closing = CLEAR_END
        if stops in (".", "．"):
            closing = _closing(text, at, after if not closed else at + 1)
            if closing is None:
                continue
        if stops == "|" and not ("ऀ" <= text[max(lo, at - 2) : at].strip()[-1:] <= "ॿ"):
            continue
        low = depth[-1]
        if quoted:
            if closed and marks[-1] == '"' and not any(p == after and d == 0 for p, d in depths) and text[after : after + 1].strip():
                # the straight mark opens the next sentence, the blank before it is missing
                after -= 1
            while level + 1 < len(depths) and depths[level + 1][0] <= after:
                level += 1
                low = min(low, depths[level][1])
        rest = after
        while rest < hi and (text[rest].isspace() or INVISIBLE.match(text[rest])):
            rest += 1
        cuts.append(after)
        closings.append(closing)
        openings.append(_opening(text, after, rest, hi, closed, stops in (".", "．")))
        depth.append(depths[level][1] if quoted else 0)
        least.append(low)
    cuts.append(hi)
    closings.append(0.0)
    openings.append(0.0)
    # what is cut off at the end of the text is not held against its last sentence
    depth.append(0)
    least.append(0)
    return cuts, closings, openings, depth, least


def _best_spans(cuts: list[int], closings: list[float], openings: list[float], depth: list[int], least: list[int]) -> list[int]:
    """The boundaries of the spans with the best total score: for every cut the best of all starts before it.

    A span from i to j whose least depth is m opens depth[j] - m and closes depth[i] - m marks that are not balanced in
    it, and lies within a quotation if m > 0.
    """
    n = len(cuts)
    best, came = [0.0] * n, [0] * n
    # starts that are not near: (least depth since, value, start), depths rising; the unclosed share is added per cut
    stack: list[tuple[int, float, int]] = []
    near: list[tuple[int, int]] = []
    for j in range(1, n):
        near.append((j - 1, depth[j - 1]))
        low = least[j]
        near = [(i, min(m, low)) for i, m in near]
        while near and cuts[j] - cuts[near[0][0]] >= SHORT:
            i, m = near.pop(0)
            value = best[i] + openings[i] + UNBALANCED * (depth[i] - m)
            stack.append((m, value, i))
        # starts whose least depth has fallen to ``low`` are one: the best of them
        top = None
        while stack and stack[-1][0] >= low:
            m, value, i = stack.pop()
            value += UNBALANCED * (m - low)
            if top is None or value > top[1] + 1e-9:
                top = (low, value, i)
        if top:
            stack.append(top)
        score, by = -1e18, 0
        for m, value, i in stack:
            total = value + UNBALANCED * (depth[j] - m) + (WITHIN if m > 0 else 0.0)
            if total >= score - 1e-9:
                score, by = total, i
        for i, m in near:
            total = best[i] + openings[i] + UNBALANCED * (depth[i] + depth[j] - 2 * m) + (WITHIN if m > 0 else 0.0) + TOO_SHORT
            if total > score + 1e-9:
                score, by = total, i
        best[j], came[j] = score + closings[j], by
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = came[j]
    return ends[::-1]


def _spans(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The sentences of ``text[lo:hi]``, in which no line is a list line and none is empty."""
    cuts, closings, openings, depth, least = _possible(text, lo, hi)
    at = lo
    for j in _best_spans(cuts, closings, openings, depth, least):
        yield at, cuts[j]
        at = cuts[j]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of each sentence of ``text``, in order.

    >>> sentence_spans("Dr. A left. He came.")
    [(0, 11), (12, 20)]
    """
    if text is None or not text.strip():
        return []
    pieces: list[tuple[int, int, bool]] = []
    blocks, at = [], 0
    if "\n" in text:
        for m in EMPTY_LINE.finditer(text):
            blocks.append((at, m.start()))
            at = m.end()
    blocks.append((at, len(text)))
    for lo, hi in blocks:
        at = lo
        for m in LIST_LINE.finditer(text, lo, hi):
            if m.start() < at or m.start() > lo and text[m.start() - 1] != "\n":
                continue
            stop = text.find("\n", m.end(), hi)
            stop = hi if stop < 0 else stop
            if LETTER_DOT.match(text, m.start()) and FINAL_MARK.search(text, m.end(), stop):
                continue
            pieces += [(at, m.start(), False), (m.start(), stop, True)]
            at = stop
        pieces.append((at, hi, False))
    out = []
    for lo, hi, whole in pieces:
        if lo >= hi:
            continue
        for a, b in [(lo, hi)] if whole else _spans(text, lo, hi):
            piece = text[a:b]
            left = len(piece) - len(piece.lstrip())
            if left < len(piece):
                out.append((a + left, a + len(piece.rstrip())))
    return out


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, starts, ends = [], [], []
        for key, text in zip(batch["key"], batch["text"], strict=True):
            for a, b in sentence_spans(text):
                keys.append(key)
                starts.append(a)
                ends.append(b)
        yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "start_pos": pd.Series(starts, dtype="int64"), "end_pos": pd.Series(ends, dtype="int64")})


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start_pos, end_pos): one row for each sentence of each text; rows delivered twice count once."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    return rows.mapInPandas(_split, "key string, start_pos bigint, end_pos bigint")
