"""Texts that share most of their words, by a prefix-tree join (problem 2).

A text is the multiset of its words in the consistent form of problem 4; a word's k-th repeat is a token of its own, so
a multiset becomes a set of 64-bit tokens. Tokens have one global order, rare ones first: by exact counts for the heavy
ones, by counters over all texts for the rest. Two sets of sizes n and m overlap in ``ceil(threshold * max(n, m))`` tokens
at least, so their first common token lies in both prefixes. Every set is sent to the tokens of its prefix, followed by
the tokens after that one, as many as may differ and a few more; there the sets of one token form a tree whose edges hold
runs of tokens, and each set walks the tree once: the overlap gathered on an edge is shared by all sets below it, and a
subtree is left as soon as the overlap so far and what is left on the shorter side cannot reach the bound. The tree works
on 16-bit codes, which can only overstate an overlap; the found pairs are then counted exactly on the 64-bit tokens.

Skew: equal multisets are joined once, as a class. Tokens that no other text can hold are not sent at all. A token in
more than ``hot`` sets is split by the next common token (two levels of the tree become the key) and by cells of salted
blocks, so that no task gets all texts of a frequent token; the number of blocks follows from the token's count.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise
from vettiver.llm.one_form import one_form

WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}_]+")
#: Counters at least and at most, as powers of two; 4 bytes each are sent to all executors.
COUNTER_BITS, MOST_BITS = 20, 24
COUNTERS_A_ROW = 4096
#: Heavy tokens that are sent to all executors at most, as a power of two: tokens of so large a share of all are heavy.
HEAVY_BITS = 20
HOT = 4096
#: Sets of a block of a hot token.
BLOCK = 16_384
#: Codes that are sent beyond those that may differ.
BEYOND = 8
#: Pairs and rows that a task holds before it passes them on; words it remembers.
HELD_PAIRS, HELD_ROWS, KEPT = 100_000, 20_000, 300_000


def words(text: str) -> list[str]:
    """The words of ``text``: runs of letters, marks, digits and underscores of its consistent form, without case."""
    return WORD.findall(one_form(text).casefold())


#: Tokens of words, remembered by each worker; emptied when full.
MEMORY: dict[str, int] = {}


def tokens(found: list[str]) -> np.ndarray:
    """One sorted 64-bit token for each word; repeats of a word get tokens of their own."""
    if len(MEMORY) >= KEPT:
        MEMORY.clear()
    out = []
    for word, n in Counter(found).items():
        first = MEMORY.get(word)
        if first is None:
            first = MEMORY[word] = xxhash.xxh64_intdigest(word)
        out.append(first)
        out += [xxhash.xxh64_intdigest(word, k) for k in range(1, n)]
    return np.sort(np.array(out, dtype=np.uint64).view(np.int64))


def _tokenise(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [(key, found) for key, text in zip(batch["key"], batch["text"], strict=True) if len(found := words(text)) >= least]
            sets = [tokens(found) for _, found in held]
            yield pd.DataFrame({
                "key": [key for key, _ in held],
                "sig": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "tokens": sets,
            })

    return run


def token_sets(df: DataFrame, key: str, text: str, least: int = 8) -> DataFrame:
    """(key, sig, tokens) of each text of at least ``least`` words; sig names the multiset. Null keys and texts go."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    return rows.distinct().mapInPandas(_tokenise(least), "key string, sig binary, tokens array<bigint>")


def counters(sets: DataFrame, bits: int) -> np.ndarray:
    """How many tokens of all sets fall on each of ``2 ** bits`` counters, as 4 bytes each: a bound on a token's texts."""
    slot = F.col("token").bitwiseAND(F.lit((1 << bits) - 1))
    counted = sets.select(F.explode("tokens").alias("token")).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    blocks = counted.groupBy(F.shiftright("slot", 12).cast("int").alias("block")).applyInPandas(_pack_counters, "block int, packed binary")
    out = np.zeros(1 << bits, dtype=np.uint32)
    for block, packed in blocks.collect():  # at most 2 ** (bits - 12) rows of 16 KB
        out[block * COUNTERS_A_ROW : (block + 1) * COUNTERS_A_ROW] = np.frombuffer(packed, dtype=np.uint32)
    return out


def _pack_counters(part: pd.DataFrame) -> pd.DataFrame:
    packed = np.zeros(COUNTERS_A_ROW, dtype=np.uint32)
    packed[part["slot"].to_numpy() % COUNTERS_A_ROW] = np.minimum(part["n"].to_numpy(), (1 << 32) - 1)
    return pd.DataFrame({"block": [part["slot"].iloc[0] >> 12], "packed": [packed.tobytes()]})


def _above(known, least: int):
    """The tokens whose counter is above ``least``: all that may be in more sets, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            found = batch.column(0).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(found[counts[found & (len(counts) - 1)] > least])], ["token"])

    return run


def heavy_tokens(sets: DataFrame, known, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that are in more than ``least`` sets, in order, and in how many each is."""
    counted = sets.select("tokens").mapInArrow(_above(known, least), "token bigint").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    held = sorted((r["token"], r["n"]) for r in counted.where(F.col("n") > least).collect())  # at most 2 ** HEAVY_BITS rows
    return np.array([t for t, _ in held], dtype=np.int64), np.array([n for _, n in held], dtype=np.int64)


def _weights(found: np.ndarray, known: tuple) -> np.ndarray:
    """In how many sets each token is: exactly for heavy ones, at most for others."""
    counts, names, exact, least = known
    weight = counts[found & (len(counts) - 1)].astype(np.int64)
    over = np.flatnonzero(weight > least)
    if len(over):
        weight[over] = least
        if len(names):
            at = np.minimum(np.searchsorted(names, found[over]), len(names) - 1)
            hit = names[at] == found[over]
            weight[over[hit]] = exact[at[hit]]
    return weight


#: What a row says before its codes: the set's size, how many codes are not sent, how many tokens the key stands for.
HEAD = "<16sIIB"
HEAD_SIZE = struct.calcsize(HEAD)
#: A set that only builds the tree, only walks it, does both.
BUILDS, WALKS, BOTH = 0, 1, 2


def _send(threshold: float, sent, hot: int, block: int):
    """Each set to the tokens of its prefix: (spot, role, pack)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        spots: list[int] = []
        roles: list[int] = []
        packs: list[bytes] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(spots, pa.int64()), pa.array(roles, pa.int32()), pa.array(packs, pa.binary())], ["spot", "role", "pack"])
            spots.clear(), roles.clear(), packs.clear()
            return out

        for batch in batches:
            lists = batch.column(1)
            every, edge = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            weights = _weights(every, known)
            for sig, lo, hi in zip(batch.column(0).to_pylist(), edge, edge[1:], strict=False):
                found, weight = every[lo:hi], weights[lo:hi]
                order = np.lexsort((found, weight))
                found, weight = found[order], weight[order]
                n = len(found)
                may_differ = n - math.ceil(threshold * n - 1e-9)
                codes = ((found ^ (found >> 31)) & 0xFFFF).astype(np.uint16)
                most = may_differ + BEYOND

                def pack(after: int, shared: int) -> bytes:
                    rest = codes[after + 1 : after + 1 + most]
                    return struct.pack(HEAD, sig, n, n - after - 1 - len(rest), shared) + rest.tobytes()

                for at in range(may_differ + 1):
                    if weight[at] <= 1:
                        continue
                    if weight[at] <= hot:
                        spots.append(int(found[at]))
                        roles.append(BOTH)
                        packs.append(pack(at, 1))
                        continue
                    blocks = -(-int(weight[at]) // block)
                    own = int.from_bytes(sig[:4], "big") % blocks
                    # a pair that shares this token alone reaches the bound only if that is one token
                    for nxt in range(at + 1, min(may_differ + 2, n)):
                        rest = pack(nxt, 2)
                        for other in range(blocks):
                            first, second = min(own, other), max(own, other)
                            key = xxhash.xxh64_intdigest(struct.pack("<qqII", found[at], found[nxt], first, second)) - (1 << 63)
                            spots.append(key)
                            roles.append(BOTH if first == second else WALKS if own == second else BUILDS)
                            packs.append(rest)
                        if len(spots) >= HELD_ROWS:
                            yield flush()
            if spots:
                yield flush()

    return run


class _Edge:
    """A run of codes that all sets below share, the sets that end here, the subtrees, and what is at most left below."""

    __slots__ = ("codes", "held", "ends", "below", "longest", "unsent")

    def __init__(self, codes: tuple, ends: list, unsent: int):
        self.codes, self.held, self.ends, self.below = codes, frozenset(codes), ends, {}
        self.longest, self.unsent = len(codes), unsent


def _insert(root: dict, codes: tuple, entry: tuple) -> None:
    level, unsent = root, entry[4]
    while True:
        if not codes:
            held = level.setdefault(None, _Edge((), [], unsent))
            held.ends.append(entry)
            held.unsent = max(held.unsent, unsent)
            return
        edge = level.get(codes[0])
        if edge is None:
            level[codes[0]] = _Edge(codes, [entry], unsent)
            return
        edge.longest, edge.unsent = max(edge.longest, len(codes)), max(edge.unsent, unsent)
        same = 0
        limit = min(len(codes), len(edge.codes))
        while same < limit and codes[same] == edge.codes[same]:
            same += 1
        if same < len(edge.codes):
            lower = _Edge(edge.codes[same:], edge.ends, edge.unsent)
            lower.below = edge.below
            lower.longest = max([len(lower.codes), *(len(lower.codes) + x.longest for x in lower.below.values())])
            edge.codes, edge.held, edge.ends, edge.below = edge.codes[:same], frozenset(edge.codes[:same]), [], {lower.codes[0]: lower}
        codes, level = codes[same:], edge.below
        if not codes:
            edge.ends.append(entry)
            return


def _walk(root: dict, own: frozenset, entry: tuple, sent: int, threshold: float, found: set) -> None:
    """Add to ``found`` the pairs of ``entry`` with the sets of the tree that may reach the bound.

    Of two sets, that whose sent codes end first in the global order has met all partners of those: their overlap is at
    most the codes in common and what the one or the other has not sent, whichever is more.
    """
    sig, n, shared, spare, unsent = entry
    least = math.ceil(threshold * n - 1e-9)
    waiting = [(edge, shared) for edge in root.values()]
    while waiting:
        edge, overlap = waiting.pop()
        if overlap + min(sent, edge.longest) + spare + max(unsent, edge.unsent) < least:
            continue
        overlap += len(own & edge.held)
        for other, m, _, other_spare, other_unsent in edge.ends:
            bound = math.ceil(threshold * max(n, m) - 1e-9)
            if overlap + max(spare, other_spare) + max(unsent, other_unsent) >= bound and min(n, m) >= bound and other != sig:
                found.add((sig, other) if sig < other else (other, sig))
        waiting += [(below, overlap) for below in edge.below.values()]


def _meet(threshold: float):
    """Within runs of one spot, the pairs of sets that may reach the bound; builders come before walkers."""

    def pairs(found: set) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["sig_a", "sig_b"])
        found.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set = set()
        root: dict = {}
        first: tuple | None = None
        last = None

        def parsed(pack: bytes) -> tuple:
            sig, n, unsent, shared = struct.unpack_from(HEAD, pack)
            codes = tuple(memoryview(pack)[HEAD_SIZE:].cast("H"))
            own = frozenset(codes)
            return codes, own, (sig, n, shared, len(codes) - len(own), unsent)

        for batch in batches:
            for spot, role, pack in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if spot != last:
                    # most sets are alone with a token: the tree is begun with the second
                    root, first, last = {}, (role, pack), spot
                    continue
                if first is not None:
                    if first[0] != WALKS:
                        codes, _, entry = parsed(first[1])
                        _insert(root, codes, entry)
                    first = None
                codes, own, entry = parsed(pack)
                if role != BUILDS:
                    _walk(root, own, entry, len(codes), threshold, found)
                if role != WALKS:
                    _insert(root, codes, entry)
                if len(found) >= HELD_PAIRS:
                    yield pairs(found)
        if found:
            yield pairs(found)

    return run


def similar_sets(sets: DataFrame, threshold: float, *, bits: int | None = None, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(sig_a, sig_b, overlap) of the different multisets that are at least ``threshold`` alike.

    ``sets`` has one row for each sig, with its tokens. Alike is the overlap over the larger size. Every link is
    found; there is no cap on partners.
    """
    context = sets.sparkSession.sparkContext
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    bits = bits or min(MOST_BITS, max(COUNTER_BITS, math.ceil(math.log2(total + 1)) - 1))
    counts = counters(sets, bits)
    # a token is heavy above the bound of hot ones, or above a share of all: there are at most 2 ** HEAVY_BITS
    least = max(hot, total >> HEAVY_BITS)
    names, exact = heavy_tokens(sets, context.broadcast(counts), least) if (counts > least).any() else (np.zeros(0, np.int64),) * 2
    known = context.broadcast((counts, names, exact, least))  # 2 ** (bits + 2) bytes and 16 for each heavy token
    sent = sets.select("sig", "tokens").mapInArrow(_send(threshold, known, hot, block), "spot bigint, role int, pack binary")
    met = sent.repartition("spot").sortWithinPartitions("spot", "role").mapInArrow(_meet(threshold), "sig_a binary, sig_b binary")
    pairs = materialise(met.distinct())
    # only sets of a pair are brought together
    paired = pairs.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).distinct()
    held = sets.join(paired, "sig", "left_semi").select("sig", "tokens")
    a = held.select(F.col("sig").alias("sig_a"), F.col("tokens").alias("tokens_a"))
    b = held.select(F.col("sig").alias("sig_b"), F.col("tokens").alias("tokens_b"))
    overlap = F.size(F.array_intersect("tokens_a", "tokens_b"))
    larger = F.greatest(F.size("tokens_a"), F.size("tokens_b"))
    counted = pairs.join(a, "sig_a").join(b, "sig_b").select("sig_a", "sig_b", overlap.alias("overlap"), larger.alias("larger"))
    return counted.where(F.col("overlap") >= F.ceil(F.lit(threshold) * F.col("larger") - 1e-9)).select("sig_a", "sig_b", "overlap")


def near_copies(df: DataFrame, key: str, text: str, threshold: float = 0.75, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (key, sig) says which multiset a text is, links (sig_a, sig_b, overlap) which are alike.

    Together they hold every pair: two keys are alike if they have one sig or linked sigs. Null keys, null texts and
    texts of fewer than ``least`` words are in neither; a row delivered twice counts once.
    """
    rows = materialise(token_sets(df, key, text, least))
    sets = materialise(rows.groupBy("sig").agg(F.first("tokens").alias("tokens")))
    return rows.select("key", "sig"), similar_sets(sets, threshold)


def pairs_of_keys(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), the smaller first, of all keys of linked or equal multisets."""
    a = members.select(F.col("key").alias("a"), F.col("sig").alias("sig_a"))
    b = members.select(F.col("key").alias("b"), F.col("sig").alias("sig_b"))
    linked = links.select("sig_a", "sig_b").join(a, "sig_a").join(b, "sig_b").select("a", "b")
    several = members.groupBy("sig").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("sig")
    held = members.join(several, "sig", "left_semi")
    equal = held.select(F.col("key").alias("a"), "sig").join(held.select(F.col("key").alias("b"), "sig"), "sig").where("a < b").select("a", "b")
    both = linked.where("a <> b").unionByName(equal)
    return both.select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, root): the smallest sig that is reachable over ``links``, by min-label spreading with shortcuts.

    Every round joins labels over links and then labels over labels, so chains halve; the loop ends when no label
    changes. Labels are written to the shared checkpoint folder each round.
    """
    both = materialise(
        links.select(F.col("sig_a").alias("u"), F.col("sig_b").alias("v")).unionByName(links.select(F.col("sig_b").alias("u"), F.col("sig_a").alias("v")))
    )
    labels = materialise(both.groupBy(F.col("u").alias("sig")).agg(F.min("v").alias("m")).select("sig", F.least("sig", "m").alias("root")))
    changed = True
    while changed:
        seen = both.join(labels.select(F.col("sig").alias("v"), "root"), "v").groupBy(F.col("u").alias("sig")).agg(F.min("root").alias("near"))
        closer = labels.join(seen, "sig", "left").select("sig", "root", F.least("root", F.coalesce("near", "root")).alias("now"))
        jumped = closer.alias("x").join(closer.select(F.col("sig").alias("at"), F.col("now").alias("far")).alias("y"), F.col("x.now") == F.col("y.at"), "left")
        after = materialise(jumped.select("sig", F.least("now", F.coalesce("far", "now")).alias("next"), "root"))
        changed = bool(after.where("next <> root").limit(1).count())
        labels = after.select("sig", F.col("next").alias("root"))
    return nodes.select("sig").distinct().join(labels, "sig", "left").select("sig", F.coalesce("root", "sig").alias("root"))


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class_key, links): the smallest key of each text's class, and to how many other texts it is alike."""
    found = materialise(links.select("sig_a", "sig_b"))
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first"))
    ends = found.select(F.col("sig_a").alias("sig"), F.col("sig_b").alias("other")).unionByName(found.select(F.col("sig_b").alias("sig"), F.col("sig_a").alias("other")))
    reach = ends.join(sizes.select(F.col("sig").alias("other"), F.col("copies").alias("theirs")), "other").groupBy("sig").agg(F.sum("theirs").alias("theirs"))
    roots = components(members, found)
    named = roots.join(sizes, "sig")
    tops = named.groupBy("root").agg(F.min("first").alias("class_key"))
    counted = named.join(tops, "root").join(reach, "sig", "left").select("sig", "class_key", (F.col("copies") - 1 + F.coalesce("theirs", F.lit(0))).alias("links"))
    return members.join(counted, "sig").select("key", "class_key", "links")
