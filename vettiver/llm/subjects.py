"""The subject areas that a document is about, by calibrated classifier chains with beam search (problem 8).

Terms of all scripts share one space: a word's key is its letters in Latin script, so a term learned in Tamil or
Devanagari is known in Latin spelling too. Documents are read once: each word becomes a number (hashes of its key and of
the beginning that its inflected forms share, and whether it ends a unit), each text a row of numbers and the sizes of its
units; everything after that is arithmetic on arrays. Hashes have 31 bits: a term takes a fixed share of all units, so
what rare words add to it by chance does not count.

The labelled examples give the first term statistics; they are widened over all documents, added up by partition: units
of text that the model labels, and unlabelled units of documents with a leading subject, are counted for each frequent
term, and terms that keep to a subject join the model. The same counts tell which words open and close sentences, by
which unpunctuated speech falls into clauses.

The document model is a chain of one logistic classifier for each subject over term features (shares of units, of
words and of hits), source features (the source's own subject shares) and structure features (kind,
number of units, share of units without a subject), each seeing the labels before it in the chain, so that it learns
which subjects occur together. It is trained on composed documents: kind and label combination are drawn as often as
they were counted over all documents, the source as often as it has such a combination, the units from the labelled
examples and from the counted sizes of units without a subject; a held-out part calibrates each link. A beam search over
the chain picks the most probable combination of labels. Null, empty and blank texts have no subject.

The model is of bounded size: a term must occur in a fixed share of the documents' units. Every document is classified,
whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise
from vettiver.llm.one_form import one_form
from vettiver.llm.sentences import ABBREVIATED, SAYING

#: Up to so many sources are sent to all workers and drawn from by the driver; more are joined and drawn from where they lie.
SAMPLE = 20_000
ROUNDS = 3
COMPOSED = 6_000
#: The share of composed documents whose labels are drawn evenly.
EVENLY = 0.2
BEAM = 6
KEPT = 400_000
SHARE = 0.25
# The letters of the two scripts in Latin letters, in the order of their code points.
TAMIL = dict(zip("கஙசஜஞடணதநனபமயரறலளழவஶஷஸஹ", "k ng ch j nj d n th n n p m y r r l l zh v sh sh s h".split(), strict=True))
TAMIL_VOWELS = dict(zip("அஆஇஈஉஊஎஏஐஒஓஔ", "a aa i ii u uu e ee ai o oo au".split(), strict=True))
TAMIL_SIGNS = dict(zip("ாிீுூெேைொோௌ", "aa i ii u uu e ee ai o oo au".split(), strict=True))
HINDI = dict(
    zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split(), strict=True)
)
HINDI_VOWELS = dict(zip("अआइईउऊऋएऐओऔऑ", "a aa i ee u oo ri e ai o au o".split(), strict=True))
HINDI_SIGNS = dict(zip("ािीुूृेैोौॉ", "aa i ee u oo ri e ai o au o".split(), strict=True))
CONSONANTS, VOWELS, SIGNS = TAMIL | HINDI, TAMIL_VOWELS | HINDI_VOWELS, TAMIL_SIGNS | HINDI_SIGNS
SILENT = {"்", "्"}
NASAL = {"ं": "n", "ँ": "n", "ः": "h"}
END_MARKS = ".．?!？！।॥|。｡"
CLOSERS = "”’\"'」』»)）]"
# Words that speech is filled with.
FILLERS = frozenset("uh um ம் हाँ hmm".split())


#: Marks in a half-written key: the vowel that a Tamil or a Hindi consonant holds by itself, a vowel sign, a silencer.
TAMIL_A, HINDI_A, SIGN, SILENCER = "\x01", "\x02", "\x03", "\x04"
LETTERS = str.maketrans(
    {c: x + TAMIL_A for c, x in TAMIL.items()}
    | {c: x + HINDI_A for c, x in HINDI.items()}
    | VOWELS
    | {c: SIGN + x for c, x in SIGNS.items()}
    | dict.fromkeys(SILENT, SILENCER)
    | NASAL
    | {"़": ""}
)
VOWELLED = re.compile(f"[{TAMIL_A}{HINDI_A}][{SIGN}{SILENCER}]|{HINDI_A}$")


def key_of(word: str) -> str:
    """The letters of ``word`` in Latin script and lower case; '' if it has none."""
    key = word.casefold()
    if not key.isascii():
        key = VOWELLED.sub("", key.translate(LETTERS)).replace(TAMIL_A, "a").replace(HINDI_A, "a")
    return key if key.isalpha() else "".join(filter(str.isalpha, key))


def stem_of(key: str) -> str | None:
    """The beginning that a term's inflected forms share, or None where the term is short."""
    return key[:6] + "*" if len(key) >= 8 else None


GOES_ON = frozenset(" ".join(SAYING[k] for k in ("ta", "hi", "en")).split())
QUOTES_OPEN, QUOTES_CLOSE = "“‘「『", "”’」』"
MARKED = re.compile(f"[{re.escape(END_MARKS + CLOSERS + QUOTES_OPEN)}(（\\[…]")
#: The number of the first term that is the beginning of several words; smaller numbers are whole words, 0 is none.
STEMS = 1 << 31
#: What is known of raw words, kept by each worker: (number, ends a unit, quotation marks opened less closed, carries a sentence on).
RAW: dict[str, tuple] = {}


def number_of(key: str) -> int:
    """A word's or a beginning's number: 31 bits, never 0."""
    return xxhash.xxh64_intdigest(key) % (STEMS - 1) + 1


def raw_word(raw: str) -> tuple:
    held = RAW.get(raw)
    if held is None:
        ends, quote = False, 0
        word = raw
        if MARKED.search(raw):
            quote = sum(map(raw.count, QUOTES_OPEN)) - sum(map(raw.count, QUOTES_CLOSE))
            quote = quote or ('"' if raw.count('"') == 1 else 0)
            bare = raw.rstrip(CLOSERS)
            tail = bare.rstrip(END_MARKS)
            word = tail.strip(QUOTES_OPEN + CLOSERS + "(（[")
            ends = len(tail) < len(bare) and "…" not in bare and not bare.endswith("...")
        form = one_form(word)
        lower = form.casefold()
        key = key_of(form)
        if ends and bare[-1] in ".．" and (lower in ABBREVIATED or len(key) == 1):
            ends = False
        stem = stem_of(key)
        number = (number_of(stem) if stem else 0) << 32 | (number_of(key) if key else 0) << 1 | ends
        held = (number, ends, quote, lower in GOES_ON)
        if len(RAW) >= KEPT:
            RAW.clear()
        RAW[raw] = held
    return held


def parse(text: str) -> tuple[list[int], list[int], bool]:
    """The numbers of a text's words, the sizes of its units (of its lines, in unpunctuated speech), and whether it is speech."""
    known = RAW.get
    lines = [[known(raw) or raw_word(raw) for raw in line.split()] for line in text.split("\n")]
    many = sum(map(len, lines))
    if many > 14 and sum(map(text.count, END_MARKS)) * 40 < many:
        kept = [x for x in ([w[0] for w in line if w[0] > 1] for line in lines) if x]
        return [w for x in kept for w in x], [len(x) for x in kept], True
    units: list[list[int]] = []
    wrapped: list[int] = []
    for at, line in enumerate(lines):
        if not line:
            if wrapped:
                units.append(wrapped)
                wrapped = []
            continue
        start = quoted = 0
        for i in [i for i, w in enumerate(line) if w[1] or w[2]]:
            w = line[i]
            if w[2]:
                quoted = (0 if quoted else 1) if w[2] == '"' else max(0, quoted + w[2])
            if w[1] and not quoted and not (w[2] and i + 1 < len(line) and line[i + 1][3]):
                units.append(wrapped + [x[0] for x in line[start : i + 1] if x[0]])
                wrapped, start = [], i + 1
        rest = wrapped + [x[0] for x in line[start:] if x[0] > 1]
        wrapped = rest if len(line) > 5 and at + 1 < len(lines) and lines[at + 1] else []
        if rest and not wrapped:
            units.append(rest)
    return [w for u in units for w in u], _merged([len(u) for u in units]), False


def _merged(sizes: list[int]) -> list[int]:
    """Sizes of units, those of one or two words counted to the unit before."""
    out: list[int] = []
    for n in sizes:
        if n and n < 3 and out:
            out[-1] += n
        elif n:
            out.append(n)
    return out


@dataclass
class Terms:
    """What is known of terms: shares of subjects by rising number, and which words open and close sentences."""

    subjects: list[str]
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    shares: np.ndarray | None = None
    opens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    closes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def find(self, words: np.ndarray) -> np.ndarray:
        """For each word the place of its term, or of its beginning's, in ``numbers``; its length for none."""
        at = place_in(self.numbers, word_of(words))
        rest = np.flatnonzero((at == len(self.numbers)) & (words >> 32 > 0))
        at[rest] = place_in(self.numbers, (words[rest] >> 32) + STEMS)
        return at


def word_of(words: np.ndarray) -> np.ndarray:
    return (words >> 1) & (STEMS - 1)


#: Lookups from which on a table of beginnings pays.
MANY = 50_000


def place_in(numbers: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each of ``wanted`` in the rising ``numbers``; their length where it is none of them."""
    if not len(numbers):
        return np.zeros(len(wanted), dtype=np.int64)
    if len(wanted) < MANY:
        at = np.searchsorted(numbers, wanted)
    else:
        # numbers are hashes, so their leading bits lead to within a few places
        bits = int(max(numbers[-1], wanted.max())).bit_length()
        shift = max(0, bits - len(numbers).bit_length() - 2)
        at = np.searchsorted(numbers, np.arange((1 << bits - shift) + 1, dtype=np.int64) << shift)[wanted >> shift]
        left = np.flatnonzero(at < len(numbers))
        while len(left := left[numbers[at[left]] < wanted[left]]):
            at[left] += 1
            left = left[at[left] < len(numbers)]
    at = np.minimum(at, len(numbers) - 1)
    return np.where(numbers[at] == wanted, at, len(numbers))


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values of ``x``, rising; by sorting, which is several times as fast here as the hashing of ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@dataclass
class Units:
    """The units of several documents: words and sizes in a row, the document of each unit, and the units' labels."""

    words: np.ndarray
    sizes: np.ndarray
    document: np.ndarray
    documents: int
    labels: np.ndarray


def lay_out(words: np.ndarray, in_document: np.ndarray, sizes: np.ndarray, lines: np.ndarray, speech: np.ndarray, terms: Terms) -> Units:
    """The units of documents by ``terms``: speech is cut into clauses, then every unit gets its subject, -1 for none.

    ``in_document`` and ``lines`` are the numbers of words and of sizes of each document.
    """
    documents = len(in_document)
    if speech.any():
        flags = (place_in(terms.opens, word_of(words)) < len(terms.opens)) + 2 * ((place_in(terms.closes, word_of(words)) < len(terms.closes)) | (words & 1 > 0))
        at, line = np.concatenate([[0], np.cumsum(in_document)]), np.concatenate([[0], np.cumsum(lines)])
        parts = np.split(sizes, line[1:-1])
        for d in np.flatnonzero(speech):
            parts[d] = np.array(_clauses(flags[at[d] : at[d + 1]], parts[d].tolist()), dtype=np.int64)
        sizes, lines = np.concatenate(parts), np.array([len(p) for p in parts])
    document = np.repeat(np.arange(documents), lines)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    many = len(terms.subjects)
    scores = np.zeros((len(sizes), many))
    if len(terms.numbers):
        place = terms.find(words)
        hit = np.flatnonzero(place < len(terms.numbers))
        shares = terms.shares[place[hit]]
        for s in range(many):
            scores[:, s] = np.bincount(unit[hit], weights=shares[:, s], minlength=len(sizes))
    return Units(words, sizes, document, documents, _labels(scores, document, documents))


def _clauses(flags: np.ndarray, lines: list[int]) -> list[int]:
    """Sizes of the clauses of unmarked speech, cut before words that open sentences (1) and after those that close them (2)."""
    out: list[int] = []
    lo = 0
    for n in lines:
        start = lo
        for p in np.flatnonzero(flags[lo : lo + n]).tolist():
            p += lo
            if flags[p] & 1 and p - start >= 4:
                out.append(p - start)
                start = p
            if flags[p] & 2 and p + 1 - start >= 4:
                out.append(p + 1 - start)
                start = p + 1
        lo += n
        out.append(lo - start)
    return _merged(out)


def _labels(scores: np.ndarray, document: np.ndarray, documents: int, least: float = 0.4) -> np.ndarray:
    """The subject of each unit, -1 for none; where two are close, the document's leading subject decides."""
    if not len(scores):
        return np.zeros(0, dtype=np.int64)
    clear = scores.max(axis=1) >= least
    lead = np.stack([np.bincount(document[clear], weights=scores[clear, s], minlength=documents) for s in range(scores.shape[1])], axis=1).astype(float)
    total = lead.sum(axis=1, keepdims=True)
    tilt = np.divide(0.25 * lead, total, out=np.zeros_like(lead), where=total > 0)
    return np.where(clear, (scores + tilt[document]).argmax(axis=1), -1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers: (key, source, kind, speech, words, sizes)."""
    for batch in batches:
        speech, words, sizes = [], [], []
        for text in batch.column(3).to_pylist():
            w, n, spoken = parse(text)
            words.append(np.array(w, dtype=np.int64))
            sizes.append(n)
            speech.append(spoken)
        edge = np.zeros(len(words) + 1, dtype=np.int32)
        np.cumsum([len(w) for w in words], out=edge[1:])
        flat = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(words) if words else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(speech, pa.bool_()), flat, pa.array(sizes, pa.list_(pa.int32()))], ["key", "source", "kind", "speech", "words", "sizes"])


def _units_of(batch: pa.RecordBatch, terms: Terms) -> Units:
    """The units of a batch with columns speech, words and sizes."""
    words, sizes = batch.column("words"), batch.column("sizes")
    return lay_out(
        words.flatten().to_numpy(),
        np.diff(words.offsets.to_numpy()),
        sizes.flatten().to_numpy().astype(np.int64),
        np.diff(sizes.offsets.to_numpy()),
        batch.column("speech").to_numpy(zero_copy_only=False),
        terms,
    )


def _occurrences(u: Units) -> tuple[np.ndarray, np.ndarray]:
    """(unit, term) of the words and of the beginnings of words of all units."""
    unit = np.repeat(np.arange(len(u.sizes)), u.sizes)
    own, stem = word_of(u.words), u.words >> 32
    a, b = np.flatnonzero(own), np.flatnonzero(stem)
    return np.concatenate([unit[a], unit[b]]), np.concatenate([own[a], stem[b] + STEMS])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): how many occurrences each term has in the batches, added up."""
    names, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        words = batch.column(0).flatten().to_numpy()
        found, n = np.unique(words, return_counts=True)
        own, stem = word_of(found), (found >> 32) + STEMS
        both, place = np.unique(np.concatenate([names, own[own > 0], stem[stem > STEMS]]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, n[own > 0], n[stem > STEMS]]), minlength=len(both)).astype(np.int64)
        names = both
    if len(names):
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts)], ["term", "n"])


#: Sizes of units without a subject from which on they count as one.
LONGEST = 100


def _count_terms(model):
    """Statistics of the frequent terms: (place, v: n, opens, closes, by subject), added up for each partition.

    Places below 0 are -1 - size: how many units without a subject have that size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, frequent = model.value
        many, n = len(terms.subjects), len(frequent)
        v = np.zeros((n, 3 + many))
        bare = np.zeros(LONGEST + 1)
        for batch in batches:
            u = _units_of(batch, terms)
            if not len(u.sizes):
                continue
            bare += np.bincount(np.minimum(u.sizes[u.labels < 0], LONGEST), minlength=LONGEST + 1)
            labelled = np.flatnonzero(u.labels >= 0)
            found = np.bincount(u.document[labelled] * many + u.labels[labelled], minlength=u.documents * many).reshape(-1, many)
            # the evidence for a term is what the document's other units are about, never its own unit
            around = found[u.document].astype(float)
            around[labelled, u.labels[labelled]] -= 1
            rest = around.sum(axis=1)
            around /= np.maximum(rest, 1)[:, None]
            last = np.cumsum(u.sizes) - 1
            first = last - u.sizes + 1
            whole = (u.words[last] & 1 > 0) & (u.sizes >= 4)
            for column, spot in ((1, first), (2, last)):
                place = place_in(frequent, word_of(u.words[spot[whole]]))
                v[:, column] += np.bincount(place, minlength=n + 1)[:n]
            unit, term = _occurrences(u)
            place = place_in(frequent, term)
            keep = (place < n) & (rest[unit] >= 2)
            both = distinct(unit[keep] * n + place[keep])
            unit, place = both // max(1, n), both % max(1, n)
            v[:, 0] += np.bincount(place, minlength=n)
            for s in range(many):
                v[:, 3 + s] += np.bincount(place, weights=around[unit, s], minlength=n)
        seen = np.flatnonzero(v.any(axis=1))
        sized = np.flatnonzero(bare)
        places = np.concatenate([seen, -1 - sized]).astype(np.int32)
        rows = [*v[seen], *[np.concatenate([[bare[k]], np.zeros(2 + many)]) for k in sized]]
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], ["place", "v"])

    return run


def _keeping(counts: np.ndarray, totals: np.ndarray, least: float, pure: float, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which terms occur ``least`` times and keep to one subject, or share two, more than terms do on average; and the shares of all."""
    base = counts.sum(axis=0) / max(1.0, totals.sum()) if base is None else base
    share = counts / (totals + 0.5)[:, None]
    best = share.argmax(axis=1) if len(share) else np.zeros(0, dtype=np.int64)
    top = -np.sort(-share, axis=1)
    first = top[:, 0]
    second = top[:, 1] if top.shape[1] > 1 else np.zeros(len(top))
    over = lambda x: base[best] + x * (1 - base[best])
    one = first >= np.maximum(pure, over(0.3))
    two = (first >= np.maximum(0.3, over(0.2))) & (first + second >= pure + 0.1) & (second >= 0.2)
    sure = first - np.sqrt(np.maximum(0.0, first * (1 - first)) / np.maximum(totals, 1e-9)) >= over(0.15)
    return (totals >= least) & sure & (one | two), np.where(share >= 0.15, share, 0).astype(np.float32)


def _count_examples(subjects: list[str]):
    """(term, s, n): in how many examples of each subject each term occurs, added up for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text, subject in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = np.array(parse(text)[0], dtype=np.int64)
                own, stem = word_of(words), words >> 32
                seen.append(distinct(np.concatenate([own[own > 0], stem[stem > 0] + STEMS])))
                of.append(np.full(len(seen[-1]), subjects.index(subject)))
            both, n = np.unique(np.stack([np.concatenate(seen), np.concatenate(of)]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1].astype(np.int32)), pa.array(n)], ["term", "s", "n"])

    return run


def terms_of_examples(labelled: DataFrame, subjects: list[str]) -> Terms:
    """The first model: terms of the labelled examples (text, subject) that keep to a subject."""
    counted = materialise(labelled.mapInArrow(_count_examples(subjects), "term bigint, s int, n bigint").groupBy("term", "s").agg(F.sum("n").alias("n")))
    each = np.zeros(len(subjects))
    for r in counted.groupBy("s").agg(F.sum("n").alias("n")).collect():
        each[r["s"]] = r["n"]
    by_subject = [F.sum(F.when(F.col("s") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(len(subjects))]
    rows = sorted(tuple(r) for r in counted.groupBy("term").agg(*by_subject, F.sum("n").alias("n")).where("n >= 3").drop("n").collect())
    numbers = np.array([r[0] for r in rows], dtype=np.int64)
    counts = np.array([r[1:] for r in rows], dtype=float).reshape(-1, len(subjects))
    keep, shares = _keeping(counts, counts.sum(axis=1), 3, 0.75, each / max(1.0, each.sum()))
    return Terms(subjects, numbers[keep], shares[keep])


def _count_pools(model):
    """(s, label, size, n): the units of the examples of each subject, by their label and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = model.value
        for batch in batches:
            rows = []
            for text, subject in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, size, speech = parse(text)
                u = lay_out(np.array(words, np.int64), np.array([len(words)]), np.array(size, np.int64), np.array([len(size)]), np.array([speech]), terms)
                rows.append(np.stack([np.full(len(u.labels), terms.subjects.index(subject)), u.labels, u.sizes]))
            if rows:
                found, n = np.unique(np.concatenate(rows, axis=1), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[pa.array(x.astype(np.int32)) for x in found], pa.array(n)], ["s", "label", "size", "n"])

    return run


def pools_of(labelled: DataFrame, terms: Terms) -> list[np.ndarray]:
    """For each subject the rows (label, size, n) of the units of its examples."""
    model = labelled.sparkSession.sparkContext.broadcast(terms)
    counted = labelled.mapInArrow(_count_pools(model), "s int, label int, size int, n bigint").groupBy("s", "label", "size").agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in counted.collect())  # at most a row for each size that occurs, label and subject
    return [np.array([r[1:] for r in rows if r[0] == k], dtype=np.int64).reshape(-1, 3) for k in range(len(terms.subjects))]


#: A term must occur that many times for each document, and at least so often.
OCCURS, LEAST = 5e-4, 4


def frequent_terms(read: DataFrame, documents: int) -> np.ndarray:
    """The numbers of all terms that occur often enough to join the model: at most the words of a document over ``OCCURS``."""
    counted = read.select("words").mapInArrow(_tally, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    return np.array(sorted(r["term"] for r in counted.where(F.col("n") >= max(LEAST, documents * OCCURS)).select("term").collect()), dtype=np.int64)


def widen(read: DataFrame, terms: Terms, frequent: np.ndarray, documents: int) -> tuple[Terms, np.ndarray]:
    """The model with the terms that keep to a subject in ``read`` (speech, words, sizes), and the sizes of units without one."""
    model = read.sparkSession.sparkContext.broadcast((terms, frequent))
    many = 3 + len(terms.subjects)
    rows = read.select("speech", "words", "sizes").mapInArrow(_count_terms(model), "place int, v array<double>")
    summed = rows.groupBy("place").agg(*[F.sum(F.col("v")[i]).alias(f"c{i}") for i in range(many)]).collect()  # at most a row for each frequent term
    least = max(LEAST, documents * OCCURS)
    bare = np.zeros(LONGEST + 1)
    for r in summed:
        if r["place"] < 0:
            bare[-1 - r["place"]] = r["c0"]
    kept = sorted((r for r in summed if r["place"] >= 0 and r["c0"] >= least), key=lambda r: r["place"])
    v = np.array([r[1:] for r in kept], dtype=float).reshape(-1, many)
    numbers = frequent[np.array([r["place"] for r in kept], dtype=np.int64)]
    keep, shares = _keeping(v[:, 3:], v[:, 0], least, 0.4)
    usual = (v[:, 0] >= 5 * least) & (numbers < STEMS)
    old = place_in(numbers, terms.numbers) == len(numbers)
    joined = np.concatenate([terms.numbers[old], numbers[keep]])
    order = np.argsort(joined)
    return Terms(
        terms.subjects,
        joined[order],
        np.concatenate([terms.shares[old], shares[keep]])[order],
        numbers[usual & (v[:, 1] >= 0.6 * v[:, 0])],
        numbers[usual & (v[:, 2] >= 0.6 * v[:, 0])],
    ), bare


KINDS = ("passage", "qa_record", "run_note", "voice_transcript")


def features(u: Units, kinds: list[str | None], many: int) -> np.ndarray:
    """Term features of each document and subject (share of units, of words and of hits) and structure features."""
    n = np.bincount(u.document, minlength=u.documents)
    on = np.flatnonzero(u.labels >= 0)
    at = u.document[on] * many + u.labels[on]
    found = np.bincount(at, minlength=u.documents * many).reshape(-1, many)
    words = np.bincount(at, weights=u.sizes[on], minlength=u.documents * many).reshape(-1, many)
    every = np.bincount(u.document, weights=u.sizes, minlength=u.documents)
    some = np.maximum(n, 1)[:, None]
    structure = [np.log1p(n) / 5, 1 - found.sum(axis=1) / some[:, 0], (n == 1).astype(float), *[np.array([k == x for k in kinds], dtype=float) for x in KINDS]]
    out = np.hstack([found / some, words / np.maximum(every, 1)[:, None], found / np.maximum(1, found.sum(axis=1))[:, None], np.stack(structure, axis=1)])
    out[n == 0] = 0
    return out.astype(np.float32)


@dataclass
class Chain:
    """Logistic links in the order of the subjects; each sees its own term features, structure, source and the labels before."""

    many: int
    weights: list[np.ndarray] = field(default_factory=list)
    scale: list[tuple[float, float]] = field(default_factory=list)

    def inputs(self, x: np.ndarray, source: np.ndarray, s: int, before: np.ndarray) -> np.ndarray:
        m = self.many
        own = x[:, [s, m + s, 2 * m + s]]
        over = np.maximum(0, own[:, :1] - SHARE)
        rest = np.delete(x[:, :m], s, axis=1).max(axis=1, keepdims=True)
        one = np.ones((len(x), 1))
        return np.hstack([one, own, over, np.log(own[:, :1] + 0.02), rest, x[:, 3 * m :], source[:, s : s + 1], before[:, :s]])

    def fit(self, x: np.ndarray, source: np.ndarray, y: np.ndarray) -> None:
        half = len(x) * 3 // 4
        for s in range(self.many):
            z = self.inputs(x, source, s, y)
            w = _logistic(z[:half], y[:half, s])
            self.weights.append(w)
            margin = z[half:] @ w
            self.scale.append(tuple(_logistic(np.stack([np.ones(len(margin)), margin], axis=1), y[half:, s], 1e-2)))

    def probability(self, x: np.ndarray, source: np.ndarray, s: int, before: np.ndarray) -> np.ndarray:
        """Of each row and each of its beams; ``before`` is (rows, beams, subjects)."""
        a, b = self.scale[s]
        w = self.weights[s]
        own = self.inputs(x, source, s, np.zeros((len(x), 0))) @ w[: len(w) - s]
        margin = own[:, None] + before[:, :, :s] @ w[len(w) - s :]
        return 1 / (1 + np.exp(-np.clip(a + b * margin, -30, 30)))

    def decode(self, x: np.ndarray, source: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The most probable label combination of each row, by beam search along the chain."""
        n = len(x)
        labels = np.zeros((n, 1, self.many))
        score = np.zeros((n, 1))
        for s in range(self.many):
            p = np.clip(self.probability(x, source, s, labels), 1e-9, 1 - 1e-9)
            both = np.concatenate([score + np.log(1 - p), score + np.log(p)], axis=1)
            on = labels.copy()
            on[:, :, s] = 1
            choices = np.concatenate([labels, on], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            score = np.take_along_axis(both, top, 1)
            labels = np.take_along_axis(choices, top[:, :, None], 1)
        return labels[:, 0]


def _logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Newton's method for a logistic model with a small ridge."""
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(z) + ridge * w
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def compose(pools: list[np.ndarray], drawn: list[tuple[str, tuple[int, ...], int]], bare: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of ``COMPOSED`` documents made of units of labelled examples and of units without a subject.

    ``pools`` has the examples' units, ``drawn`` (kind, labels, how many documents), ``bare`` how many units without a
    subject have each size. A part of the combinations is drawn evenly, so that every link has cases.
    """
    many = len(pools)
    upto = [np.cumsum(p[:, 2]) for p in pools]
    some = [k for k in range(many) if len(pools[k])]
    weight = np.array([n for *_, n in drawn], dtype=float)
    pick = rng.choice(len(drawn), COMPOSED, p=weight / weight.sum()) if len(drawn) else None
    lengths = np.arange(len(bare))[bare > 0] if bare.any() else np.array([8])
    chance = bare[bare > 0] / bare.sum() if bare.any() else np.ones(1)
    fill = iter(rng.choice(lengths, COMPOSED * 8, p=chance).tolist())
    x, y = [], []
    for t in range(COMPOSED):
        if pick is None or rng.random() < EVENLY:
            kind, labels = KINDS[rng.integers(len(KINDS))], tuple(rng.permutation(some)[: rng.integers(0, 4)].tolist())
        else:
            kind, labels = drawn[pick[t]][:2]
        units: list[tuple[int, int, int]] = []
        for k in labels:
            if len(pools[k]):
                picked = np.searchsorted(upto[k], rng.integers(upto[k][-1], size=rng.integers(1, 9)), side="right")
                units += [(k, *pools[k][i, :2].tolist()) for i in picked]
        units += [(-1, -1, next(fill)) for _ in range(rng.integers(0 if units else 1, 7))]
        truth, found, size = (np.array(c) for c in zip(*units, strict=True))
        u = Units(np.zeros(0, np.int64), size, np.zeros(len(units), np.int64), 1, found)
        x.append(features(u, [kind], many)[0])
        on = np.bincount(truth[truth >= 0], minlength=many) / len(units) >= SHARE
        y.append(on.astype(float))
    return np.array(x), np.array(y)


def likely(sources: np.ndarray, n: np.ndarray, on: np.ndarray) -> np.ndarray:
    """How likely a document with the labels ``on`` is of each source: by its number of documents and its subject shares."""
    return n * np.prod(np.maximum(sources[:, on], 1e-4), axis=1)


def drawn_sources(means: DataFrame, many: int, y: np.ndarray, few: bool, rng: np.random.Generator) -> np.ndarray:
    """The subject shares of a source drawn for each row of labels ``y``, among all of ``means`` (source, n, share).

    A ``few`` sources are drawn from by the driver. Of more, each partition adds up its weights for each combination of
    labels; the driver draws a partition and a place in it, and the partition looks up the source there.
    """
    kinds, which = np.unique(y > 0, axis=0, return_inverse=True)
    which = which.ravel()
    out = np.zeros((len(y), many))
    if few:
        rows = sorted(means.collect(), key=lambda r: (-r["n"], r["source"] is not None, r["source"]))
        shares, n = np.array([r["share"] for r in rows], dtype=float).reshape(-1, many), np.array([r["n"] for r in rows], dtype=float)
        for c, on in enumerate(kinds):
            if len(rows):
                mine = np.flatnonzero(which == c)
                weight = likely(shares, n, on)
                out[mine] = shares[rng.choice(len(rows), len(mine), p=weight / weight.sum())]
        return out

    def weights(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        shares = batch.column(2).flatten().to_numpy().reshape(-1, many)
        n = batch.column(1).to_numpy().astype(float)
        return shares, np.stack([likely(shares, n, on) for on in kinds])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(len(kinds))
        for batch in batches:
            if batch.num_rows:
                part, total = batch.column(0)[0].as_py(), total + weights(batch)[1].sum(axis=1)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tolist()])], ["part", "w"])

    # written rows keep their partitions and their order there
    lying = means.select(F.spark_partition_id().alias("part"), "n", "share")
    parts = sorted((r["part"], r["w"]) for r in lying.mapInArrow(add_up, "part int, w array<double>").collect())
    held = np.array([w for _, w in parts])
    asked: dict[int, list[tuple[int, int, float]]] = {}
    for c in range(len(kinds)):
        mine = np.flatnonzero(which == c)
        for t, p in zip(mine.tolist(), rng.choice(len(parts), len(mine), p=held[:, c] / held[:, c].sum()).tolist(), strict=True):
            asked.setdefault(parts[p][0], []).append((t, c, rng.random() * held[p, c]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, total = None, np.zeros(len(kinds))
        for batch in batches:
            if not batch.num_rows:
                continue
            left = asked.get(batch.column(0)[0].as_py(), []) if left is None else left
            shares, weight = weights(batch)
            upto = np.cumsum(weight, axis=1)
            end = total + weight.sum(axis=1)
            here = [(t, shares[min(np.searchsorted(upto[c], at - total[c], side="right"), len(shares) - 1)].tolist()) for t, c, at in left if at < end[c]]
            left = [x for x in left if x[2] >= end[x[1]]]
            total = end
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in here], pa.int32()), pa.array([x for _, x in here], pa.list_(pa.float64()))], ["t", "share"])

    for r in lying.mapInArrow(look_up, "t int, share array<double>").collect():
        out[r["t"]] = r["share"]
    return out


def _features_of(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = model.value
        for batch in batches:
            f = features(_units_of(batch, terms), batch.column(2).to_pylist(), len(terms.subjects))
            edge = np.arange(0, (len(f) + 1) * f.shape[1], f.shape[1], dtype=np.int32)
            made = pa.ListArray.from_arrays(pa.array(edge), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], ["key", "source", "kind", "f"])

    return run


def _classify(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subjects, chain, base = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            source = np.array([base if s is None else s for s in batch.column(1).to_pylist()])
            on = chain.decode(x, source) > 0
            on &= x[:, : len(subjects)] > 0
            row, subject = np.nonzero(on)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([subjects[s] for s in subject], pa.string())], ["key", "subject"])

    return run


def shared_out(held: DataFrame, means: DataFrame, few: bool) -> DataFrame:
    """(key, share, f): each document with the subject shares of its source, null for a source without."""
    own = means.select(F.col("source").alias("of"), "share")
    return held.join(F.broadcast(own) if few else own, F.col("source").eqNullSafe(F.col("of")), "left").select("key", "share", "f")


def subjects_of(documents: DataFrame, examples: DataFrame, areas: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """(key, subject): the subjects that each document is about, none, one or several rows.

    ``documents`` has the unique key, text, source and kind; ``examples`` text and subject; ``areas`` subject. Up to
    ``sample`` sources are sent to all workers, more are joined by shuffle; every source of 20 documents has shares of its own.
    """
    spark = documents.sparkSession
    subjects = [r["subject"] for r in areas.select("subject").where("subject IS NOT NULL").distinct().orderBy("subject").collect()]
    labelled = examples.select("text", "subject").where(F.col("subject").isin(subjects) & (F.col("text") != ""))
    rows = documents.select(F.col(key).alias("key"), "source", "kind", "text").where("text IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    # one file may hold all documents: they are spread before their texts are read, once
    read = materialise(rows.repartition("key").mapInArrow(_read, f"key {kind}, source string, kind string, speech boolean, words array<bigint>, sizes array<int>"))
    total = read.count()
    terms, bare = terms_of_examples(labelled, subjects), np.zeros(LONGEST + 1)
    frequent = frequent_terms(read, total)
    for _ in range(ROUNDS):
        terms, bare = widen(read, terms, frequent, total)
    made = read.select("key", "source", "kind", "speech", "words", "sizes").mapInArrow(_features_of(spark.sparkContext.broadcast(terms)), f"key {kind}, source string, kind string, f array<float>")
    held = materialise(made)
    many = len(subjects)
    share = F.array(*[F.avg(F.col("f")[i]) for i in range(many)]).alias("share")
    means = materialise(held.groupBy("source").agg(F.count(F.lit(1)).alias("n"), share).where("n >= 20"))
    few = means.count() <= sample
    weighed = means.agg(F.sum("n"), *[F.sum(F.col("n") * F.col("share")[i]) for i in range(many)]).first()
    base = np.array(weighed[1:], dtype=float) / weighed[0] if weighed[0] else np.zeros(many)
    # how often each combination of subjects occurs in each kind: fewer than 5 subjects can have a quarter each
    combined = F.filter(F.transform(F.slice("f", 1, many), lambda x, i: F.when(x >= SHARE, i)), lambda i: i.isNotNull()).alias("labels")
    counted = held.select(F.when(F.col("kind").isin(*KINDS), F.col("kind")).alias("kind"), combined).groupBy("kind", "labels").agg(F.count(F.lit(1)).alias("n")).collect()
    drawn = sorted(((r["kind"] or "", tuple(r["labels"]), r["n"]) for r in counted))
    chain = Chain(many)
    if labelled.take(1):
        rng = np.random.default_rng(0)
        x, y = compose(pools_of(labelled, terms), drawn, bare, rng)
        chain.fit(x, drawn_sources(means, many, y, few, rng), y)
        model = spark.sparkContext.broadcast((subjects, chain, base))
        return shared_out(held, means, few).mapInArrow(_classify(model), f"key {kind}, subject string").withColumnRenamed("key", key)
    return held.where(F.lit(False)).select(F.col("key").alias(key), F.lit("").alias("subject"))
