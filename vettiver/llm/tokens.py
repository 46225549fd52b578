"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

A text falls into stretches (a word with the blank before it, or a run of blanks) that no token crosses, so a stretch
is encoded once per worker and looked up afterwards. Long text is encoded as a tree: texts above ``PART`` characters
are cut, inside words and runs of blanks too, into parts that other tasks encode at the same time, and neighbours are
joined two by two, in as many rounds as the number of parts halves. Where two halves of one piece meet, a growing window
around the join is encoded again until both of its ends agree exactly with their neighbours: a row of BPE tokens is the
encoding of its bytes if and only if each two neighbours are the encoding of theirs. Within a task, a stretch above
``PIECE`` bytes is encoded in halves in the same way.

Empty and null texts have the empty list of ids. Marker-like strings are plain text.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public tokenizer divides text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the white space of the Unicode standard.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
STRETCH = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
BLANK = re.compile(f"[{SPACE}]")
LETTER, NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
#: Characters of a part of a long text.
PART = 1 << 14
PIECE = 1 << 12
KEPT = 300_000
LONG_WORD = 256


class Encoder:
    """The ids of texts as packed 32-bit integers."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pieces = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> bytes:
        stretches = STRETCH.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, stretches))
        except KeyError:
            return b"".join(map(self._stretch, stretches))

    def _stretch(self, stretch: str) -> bytes:
        held = self.known.get(stretch)
        if held is None:
            if len(stretch) > PIECE // 4:
                return np.array([i for piece in self.pieces.findall(stretch) for i in self.piece(piece.encode())], dtype=np.int32).tobytes()
            held = np.array(self.bpe.encode_ordinary(stretch), dtype=np.int32).tobytes()
            if len(stretch) <= LONG_WORD:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[stretch] = held
        return held

    def piece(self, data: bytes) -> list[int]:
        """The ids of one undivided piece, in halves where it is long."""
        if len(data) <= PIECE:
            return self.bpe._encode_single_piece(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def agree(self, left: int, right: int) -> bool:
        return self.bpe._encode_single_piece(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two halves of one piece together."""
        if not left or not right or self.agree(left[-1], right[0]):
            return left + right
        width = 4
        while True:
            head, tail = left[: max(0, len(left) - width)], right[width:]
            window = self.bpe._encode_single_piece(b"".join(self.bytes_of[i] for i in left[len(head) :] + right[:width]))
            if (not head or self.agree(head[-1], window[0])) and (not tail or self.agree(window[-1], tail[0])):
                return head + window + tail
            width *= 2


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


def _kind(char: str) -> int:
    return 1 if LETTER.match(char) else 2 if NUMBER.match(char) else 3


def joint(text: str, at: int) -> bool | None:
    """Whether a cut of ``text`` at ``at`` lies inside a piece (True), between pieces (False), or may not be made (None).

    A cut changes no piece but the one that it lies in: not beside a blank, unless three blanks surround it, and not
    where an apostrophe may open a contraction on either side of it.
    """
    left, right = text[at - 1], text[at]
    if BLANK.match(left) or BLANK.match(right):
        return True if BLANK.match(left) and BLANK.match(right) and BLANK.match(text[at + 1 : at + 2]) else None
    if right == "'" and LETTER.match(text[at + 1 : at + 2]) or LETTER.match(right) and "'" in text[max(0, at - 3) : at]:
        return None
    return _kind(left) == _kind(right)


def part_bounds(text: str, part: int = PART) -> list[tuple[int, bool]]:
    """(start, whether it goes on with the piece before) of each part of ``text``: every ``part`` characters or a little on."""
    bounds = [(0, False)]
    at = part
    while at < len(text):
        inner = joint(text, at)
        if inner is None:
            at += 1
        else:
            bounds.append((at, inner))
            at += part
    return bounds


def _parts(part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, inners, pieces = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                bounds = part_bounds(text, part)
                for k, (start, inner) in enumerate(bounds):
                    keys.append(key)
                    numbers.append(k)
                    inners.append(inner)
                    pieces.append(text[start : bounds[k + 1][0] if k + 1 < len(bounds) else len(text)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), pa.array(numbers, pa.int32()), pa.array(inners, pa.bool_()), pa.array(pieces, pa.string())], ["key", "part", "inner", "text"]
            )

    return run


def _encode_parts(path: str):
    """Each part's ids, and how many of them its first and its last piece have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            heads, tails, ids = [], [], []
            for text in batch.column(3).to_pylist():
                stretches = STRETCH.findall(text)
                first, last = known.pieces.match(stretches[0])[0], known.pieces.findall(stretches[-1])[-1]
                heads.append(len(known.piece(first.encode())))
                tails.append(len(known.piece(last.encode())))
                ids.append(np.frombuffer(known.packed(text), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(heads, pa.int32()), pa.array(tails, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], ["key", "part", "inner", "head", "tail", "ids"])

    return run


def join_parts(known: Encoder, a: dict, b: dict) -> dict:
    """Two neighbouring parts (inner, head, tail, ids) as one."""
    left, right = list(a["ids"]), list(b["ids"])
    if not b["inner"]:
        return {"inner": a["inner"], "head": a["head"], "tail": b["tail"], "ids": left + right}
    cut = len(left) - a["tail"]
    met = known.join(left[cut:], right[: b["head"]])
    head = len(met) if cut == 0 else a["head"]
    tail = len(met) if b["head"] == len(right) else b["tail"]
    return {"inner": a["inner"], "head": head, "tail": tail, "ids": left[:cut] + met + right[b["head"] :]}


def _join_two(path: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        parts = rows[["inner", "head", "tail", "ids"]].to_dict("records")
        made = parts[0] if len(parts) == 1 else join_parts(encoder(path), parts[0], parts[1])
        return pd.DataFrame({"key": rows["key"].iloc[:1], "part": rows["part"].iloc[:1] // 2, **{c: [made[c]] for c in ("inner", "head", "tail")}, "ids": [np.asarray(made["ids"], dtype=np.int32)]}, index=rows.index[:1])

    return run


def _encode(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            packed = [known.packed(text) if text else b"" for text in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.array([len(x) // 4 for x in packed], dtype=np.int64)
            if counts_only:
                made = pa.array(sizes)
            else:
                offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
                np.cumsum(sizes, out=offsets[1:])
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
            names = batch.schema.names[:-1] + ["n_tokens" if counts_only else "ids"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names)

    return run


def _split_long(df: DataFrame, key: str, text: str, path: str, part: int) -> tuple[DataFrame, DataFrame, str]:
    """(rows of short texts, ids of long ones as (key, ids), the type of the key)."""
    # one file may hold all texts: they are spread before they are encoded
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key")
    kind = rows.schema["key"].dataType.simpleString()
    long = F.coalesce(F.length("text") > part, F.lit(False))
    parts = rows.where(long).mapInArrow(_parts(part), f"key {kind}, part int, inner boolean, text string").repartition("key", "part")
    columns = f"key {kind}, part int, inner boolean, head int, tail int, ids array<int>"
    held = materialise(parts.mapInArrow(_encode_parts(path), columns))
    many = (held.agg(F.max("part")).first()[0] or 0) + 1
    while many > 1:
        held = held.groupBy("key", F.shiftright("part", 1).alias("pair")).applyInPandas(_join_two(path), columns)
        many = -(-many // 2)
    return rows.where(~long), held.select("key", "ids"), kind


def token_ids(df: DataFrame, key: str, text: str, path: str = VOCABULARY, part: int = PART) -> DataFrame:
    """(key, ids): the ids of each row's text without special tokens. ``key`` is unique for each row."""
    short, long, kind = _split_long(df, key, text, path, part)
    whole = short.mapInArrow(_encode(path, False), f"key {kind}, ids array<int>")
    return whole.unionByName(long).withColumnRenamed("key", key)


def token_counts(df: DataFrame, key: str, text: str, path: str = VOCABULARY, part: int = PART) -> DataFrame:
    """(key, n_tokens): how many ids ``token_ids`` gives for each row."""
    short, long, kind = _split_long(df, key, text, path, part)
    whole = short.mapInArrow(_encode(path, True), f"key {kind}, n_tokens bigint")
    return whole.unionByName(long.select("key", F.size("ids").cast("bigint").alias("n_tokens"))).withColumnRenamed("key", key)
