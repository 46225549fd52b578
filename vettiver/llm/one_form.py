"""One consistent form for texts that read the same (problem 4).

A transducer over grapheme clusters, compiled once per Python worker, rewrites a text in one left-to-right pass.
Its table is built from rules: compatibility forms (widths, ligatures), composition of accents, blanks of any kind,
characters without a visible mark, and look-alike letters. It maps each character to its wholly decomposed form with
the look-alikes replaced, so that a cluster is composed once and its result is final. At each position the longest entry
wins; an entry may span two clusters (the two-letter spelling of a Tamil vowel), with any number of invisible characters
between them. ``check_mapping`` proves that no entry's result is itself rewritten, so that the form of a form is the form.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise

# Look-alike letters, as pairs of strings read position by position.
LOOK_ALIKES = {
    "greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυατ", "ABEZHIKMNOPTYXovikpuat"),
    "cyrillic": ("АВЕЅІЈКМНОРСТХУаеорсухіјѕһԁԛԝӀӏѵ", "ABESIJKMHOPCTXYaeopcyxijshdqwIlv"),
    "armenian": ("ՕՏՍԼօոսհյզց", "OSULonuhjqg"),
    "cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏚᏙᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRSVLCPKB"),
    "latin": ("ıɑɡᴏᴄᴠᴡᴢꜱ", "iagocvwzs"),
    "dashes": ("‐‑‒–﹣－−", "-------"),
    "tamil digits": ("௧௨௪௭௮", "கஉசஎஅ"),
    "marks": ("’‘“”ः", "''\"\":"),
}
# Look-alikes of more than one character; the longer spelling on the left.
LOOK_ALIKE_CLUSTERS = {
    "ஒள": "ஔ",
    "அா": "ஆ",
    "अा": "आ",
    "अौ": "औ",
    "अो": "ओ",
    "एे": "ऐ",
    "अॅ": "ॲ",
    "अॉ": "ऑ",
}
# Fixed value: the Tamil vowel sign of au is also spelt as the sign of e and the letter lla.
SPLIT_AU = ("ெ", "ள", "ௌ")


# Fixed value: characters beyond the basic plane, kept out of the large classes, which are slow with them.
ASTRAL = "[\U00010000-\U0010ffff]"


# The planes that have characters with a form of their own.
ASSIGNED = (*range(0x40000), *range(0xE0000, 0xE1000))
#: Stretches that a worker remembers, and characters of one at most.
KEPT, REMEMBERED = 100_000, 64


@functools.cache
def _tables() -> tuple[dict[str, str], str, str, str, str]:
    """(single-character table, ignorable characters, first and second characters of compositions, marks)."""
    every = "".join(chr(code) for code in ASSIGNED if not 0xD800 <= code < 0xE000)
    ignorable = "".join(regex.findall(r"[\p{Default_Ignorable_Code_Point}\p{Cf}]", every)) + "".join(
        chr(c) for c in [*range(0x00, 0x09), *range(0x0E, 0x1C), *range(0x7F, 0x85), *range(0x86, 0xA0)]
    )
    hidden = set(ignorable)
    alike = {a: b for left, right in LOOK_ALIKES.values() for a, b in zip(left, right, strict=True)}
    single: dict[str, str] = {}
    firsts, seconds, marks = set(), set(), set()
    # ideographs and syllables that neither come apart nor compose with anything here are left out
    for char in regex.sub(r"[\p{Unified_Ideograph}\uac00-\ud7a3\p{Cn}\p{Co}]", lambda m: m[0] if m[0] in hidden else "", every):
        category = unicodedata.category(char)
        if char in hidden:
            single[char] = ""
        elif char.isspace() or category in ("Zs", "Zl", "Zp"):
            single[char] = " "
        else:
            apart = unicodedata.normalize("NFKD", char)
            # an accent that stands alone would be a blank and a combining accent: it stays as it is
            if apart[0] == " " and len(apart) > 1 and apart.strip():
                apart = char
            form = "".join("" if c in hidden else alike.get(c, c) for c in apart)
            if unicodedata.normalize("NFC", form) != char:
                single[char] = form if form.strip() else " "
        if category[0] == "M":
            marks.add(char)
        split = unicodedata.decomposition(char).split()
        if len(split) == 2 and split[0][0] != "<":
            pair = [chr(int(x, 16)) for x in split]
            if unicodedata.normalize("NFC", "".join(pair)) == char:
                firsts.add(pair[0])
                seconds.add(pair[1])
    single.pop(" ")
    return single, ignorable, "".join(firsts), "".join(seconds), "".join(marks - hidden)


def _set(chars: str) -> str:
    """``chars`` as the inside of a character class, with runs as ranges."""
    codes = sorted(set(map(ord, chars)))
    parts, start = [], 0
    for i in range(1, len(codes) + 1):
        if i == len(codes) or codes[i] != codes[i - 1] + 1:
            parts.append((codes[start], codes[i - 1]))
            start = i
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in parts)


@functools.cache
def _transducer() -> re.Pattern[str]:
    """The compiled pattern of all stretches that may change; anything else is copied."""
    single, ignorable, firsts, seconds, marks = _tables()
    basic = lambda chars: _set("".join(c for c in chars if c <= "\uffff"))
    hidden, mark = basic(ignorable), basic(marks)
    combining = basic(m for m in marks if unicodedata.combining(m))
    longest = sorted(LOOK_ALIKE_CLUSTERS, key=len, reverse=True)
    spaced = "|".join(f"[{hidden}]*".join(map(re.escape, x)) + f"(?![{hidden}]*[{mark}])" for x in longest)
    e_sign, lla, _ = SPLIT_AU
    return re.compile(
        f"{spaced}"
        f"|[{hidden}]*{e_sign}[{hidden}]*{lla}(?![{hidden}]*[{mark}])"
        f"|[{basic(firsts)}][{mark}{hidden}]*?[{basic(seconds)}][{mark}{hidden}]*"
        f"|[{basic(single)}][{mark}{hidden}]*"
        f"|{ASTRAL}+[{mark}{hidden}]*"
        f"|[\u1100-\u11ff]+"
        f"|[{combining}][{hidden}]*[{combining}][{mark}{hidden}]*"
    )


@functools.cache
def _entries() -> dict[str, str]:
    """The entries of more than one character, by what is visible of them."""
    return {unicodedata.normalize("NFC", x): y for x, y in LOOK_ALIKE_CLUSTERS.items()} | {SPLIT_AU[0] + SPLIT_AU[1]: SPLIT_AU[2]}


#: Forms of stretches, remembered by each worker; emptied when full.
MEMORY: dict[str, str] = {}


def _rewrite(found: re.Match[str]) -> str:
    """The form of one matched stretch: characters mapped, composed once, and looked up as a whole."""
    stretch = found[0]
    held = MEMORY.get(stretch)
    if held is None:
        single = _tables()[0]
        held = unicodedata.normalize("NFC", "".join([single.get(c, c) for c in stretch]))
        entries = _entries()
        if held in entries:
            held = entries[held]
        elif held[:2] in entries:
            # an entry and the marks that belong to it
            held = unicodedata.normalize("NFC", entries[held[:2]] + held[2:])
        if len(stretch) <= REMEMBERED:
            if len(MEMORY) >= KEPT:
                MEMORY.clear()
            MEMORY[stretch] = held
    return held


@functools.cache
def _suspects() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """Patterns of single characters, and of beginnings of longer entries, that may change."""
    single = _tables()[0]
    heads = sorted({c[0] for c in LOOK_ALIKE_CLUSTERS})
    tails = sorted({c[1] for c in LOOK_ALIKE_CLUSTERS})
    e_sign, lla, _ = SPLIT_AU
    plain = "".join(c for c in single if c <= "\uffff")
    return re.compile(f"[{_set(plain)}]"), re.compile(f"[{''.join(heads)}][{''.join(tails)}]|{e_sign}{lla}|{ASTRAL}")


def _unchanged(text: str) -> bool:
    """Whether a quick look proves that the transducer would copy all of ``text``."""
    one, more = _suspects()
    return unicodedata.is_normalized("NFC", text) and not one.search(text) and not more.search(text)


def one_form(text: str | None) -> str | None:
    """The consistent form of ``text``; null stays null, blank text becomes ''.

    Runs of blanks, line breaks included, read as one blank; those at the ends go.

    >>> one_form(" Ｇ\\u00adΡＳ  x ")
    'GPS x'
    """
    if text is None:
        return None
    if text.isascii() and text.isprintable() or _unchanged(text):
        out = text
    else:
        out = _transducer().sub(_rewrite, text)
    return " ".join(out.split())


def check_mapping() -> list[str]:
    """Entries whose result would be rewritten again; the mapping is sound when there are none."""
    single = _tables()[0]
    bad = [c for c, form in single.items() if form.strip() and one_form(form) != one_form(c)]
    return bad + [c for c, form in LOOK_ALIKE_CLUSTERS.items() if one_form(form) != one_form(c)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys with digests of the form and of the spelling of their texts; rows without a visible mark go."""
    for batch in batches:
        known: dict[str, tuple[bytes, bytes] | None] = {}
        at, forms, spellings = [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if text not in known:
                form = one_form(text)
                known[text] = (xxhash.xxh3_128_digest(form), xxhash.xxh3_128_digest(text.strip())) if form else None
            held = known[text]
            if held is not None:
                at.append(i)
                forms.append(held[0])
                spellings.append(held[1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(forms, pa.binary()), pa.array(spellings, pa.binary())], ["k", "form", "spelling"])


def readings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, form, spelling): 128-bit digests of what each text reads as and of how it is spelt, each different row once.

    Blanks at the ends are no spelling. Null keys and texts, and texts without a visible mark, have no reading. Texts
    are read once, spread by key, as one file may hold them all.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull()).repartition("k")
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(_read, f"k {kind}, form binary, spelling binary").distinct()


def equal_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs (key_a, key_b) of different keys whose texts read the same but differ in their characters.

    Blanks at the ends do not count as a difference; blank and null texts and null keys are in no pair. Keys are
    strings; the smaller comes first. Spellings of one form meet, not rows: only the keys of two different spellings are
    brought together, so a form whose rows are all spelt alike, however many, meets nothing.
    """
    rows = materialise(readings(df, key, text))
    spelt = rows.groupBy("form", "spelling").agg(F.count(F.lit(1)).alias("n"))
    mixed = spelt.groupBy("form").agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi")).where("lo <> hi").select("form")
    kinds = materialise(spelt.join(mixed, "form", "left_semi").select("form", "spelling"))
    a, b = kinds.withColumnRenamed("spelling", "spelling_a"), kinds.withColumnRenamed("spelling", "spelling_b")
    met = a.join(b, "form").where("spelling_a < spelling_b")
    ka, kb = (rows.select("form", F.col("spelling").alias(f"spelling_{x}"), F.col("k").alias(f"k_{x}")) for x in "ab")
    both = met.join(ka, ["form", "spelling_a"]).join(kb, ["form", "spelling_b"]).where("k_a <> k_b")
    return both.select(F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b")).distinct()


def shown_questions(requests: DataFrame, questions: DataFrame) -> DataFrame:
    """(key_a, key_b): request_id and query_id where the query reads as the question but is spelt otherwise.

    ``requests`` has request_id and query, ``questions`` has query_id and query. A question that many requests repeat is
    rewritten once for each batch of rows.
    """
    asked = readings(requests, "request_id", "query").select(F.col("k").alias("key_a"), "form", F.col("spelling").alias("asked"))
    known = readings(questions, "query_id", "query").select(F.col("k").alias("key_b"), "form", F.col("spelling").alias("question"))
    return asked.join(known, "form").where("asked <> question").select("key_a", "key_b").distinct()
