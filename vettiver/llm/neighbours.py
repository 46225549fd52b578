"""The k most similar vectors of every vector, by multi-index hashing (problem 5).

Codes: a rotation is learned on a bounded sample (principal directions, then the rotation that brings them closest to
the corners of a cube), and the signs of the rotated vector are its binary code. The code is cut into substrings of two
halves each, and each half of each substring is an index of its own.

Probing: two codes that differ in at most ``2 * substrings - 1`` bits agree but for one bit in some substring, and so
wholly in one of its halves. In the bucket of a half every code therefore looks up the codes whose other half is the
same or one flipped bit away, and keeps those within the Hamming radius. So every code within that guarantee is
retrieved, and most of those up to the radius.

Rerank: retrieved codes are grouped by cells (the nearest of pivots learned on the sample), and a vector's floats go to
the cells in which a code was retrieved for it, nowhere else; there they are multiplied with those of the cell, and the
k best of each vector are kept.

The rest: the chance that a neighbour at a given similarity is retrieved follows from the number of bits. A vector that
found fewer than k others, or whose k-th is at a similarity where that chance is below ``need``, is asked of all vectors
in blocks.

Halves grow with the logarithm of the number of vectors. Equal vectors are one vector with its smallest k + 1 rows (ties
go to the smaller row, so no further row can be in any result). Buckets and cells above ``BUCKET`` and ``BLOCK`` are
split into blocks that all their askers visit, so none is a task of its own and none is cut.

A vector is usable when it has ``dimension`` finite numbers, not all zero.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise

DIMENSION = 256
BITS = 256
#: Vectors that the rotation and the pivots are learned on, at most.
SAMPLE = 8192
RADIUS = 64
#: Bits of half a substring, as a share of the logarithm of the number of vectors.
HALF = 0.42
#: Cells at most, and vectors of a cell on average while there are fewer cells.
PIVOTS, CELL = 2048, 4096
#: Vectors of a block of a cell, codes of a block of a bucket, vectors of a block that is asked as a whole.
BLOCK, BUCKET, WHOLE = 16_384, 65_536, 32_768
#: Codes of a cell that a bucket's askers try first; pairs that are looked at at a time.
FIRST, PAIRS = 8, 4_000_000
#: Blocks at least in which leftover vectors ask all.
PARTS = 8


def usable(vectors: DataFrame, row: str, vector: str, dimension: int = DIMENSION) -> DataFrame:
    """(row, vector) of the rows with a row number and a usable vector, as often as they were delivered."""
    rows = vectors.select(F.col(row).alias("row"), F.col(vector).cast("array<float>").alias("vector"))
    return rows.where(F.col("row").isNotNull() & (F.size("vector") == dimension))


def _units(batch: pa.RecordBatch, dimension: int) -> tuple[pa.Array, np.ndarray]:
    """Row numbers and unit vectors of the usable rows of a batch (row, vector)."""
    x = batch.column(1).flatten()
    x = (x.fill_null(float("nan")) if x.null_count else x).to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x = x[good] / np.abs(x[good]).max(axis=1, keepdims=True)
    unit = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
    return batch.column(0).filter(pa.array(good)), unit


def _floats(dimension: int):
    """Unit vectors as 16-bit numbers with a scale of their own, which halves what is shuffled (error about 1e-5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = _units(batch, dimension)
            scale = np.abs(unit).max(axis=1, keepdims=True) if len(unit) else np.ones((0, 1), np.float32)
            short = np.round(unit / scale * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays([rows, pa.array([x.tobytes() for x in short], pa.binary())], ["row", "unit"])

    return run


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """The unit vectors that ``_floats`` packed, as 32-bit floats."""
    x = np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(-1, dimension).astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def sampled(vectors: DataFrame, total: int, dimension: int, sample: int = SAMPLE) -> np.ndarray:
    """The unit vectors of about ``sample`` rows, spread by hash."""
    every = max(1, -(-total // sample))
    spread = vectors.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).mapInArrow(_floats(dimension), "row bigint, unit binary")
    held = sorted((r["row"], bytes(r["unit"])) for r in spread.collect())  # about sample rows of 2 x dimension bytes
    return _matrix(pa.array([u for _, u in held], pa.binary()), dimension) if held else np.zeros((0, dimension), np.float32)


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(mean, dimension x bits matrix) whose signs are the code, learned on the unit vectors ``x``."""
    dimension = x.shape[1]
    if not len(x):
        return np.zeros(dimension, np.float32), np.zeros((dimension, bits), np.float32)
    x = x.astype(np.float64)
    mean = x.mean(axis=0)
    x = x - mean
    _, directions = np.linalg.eigh(x.T @ x)
    directions = directions[:, ::-1][:, :bits]
    z = x @ directions
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = (u @ vt).T
    return mean.astype(np.float32), (directions @ turn).astype(np.float32)


def learn_pivots(x: np.ndarray, many: int, rounds: int = 6) -> np.ndarray:
    """At most ``many`` unit vectors in the middle of the clusters of the unit vectors ``x``."""
    if not len(x):
        return np.eye(1, x.shape[1], dtype=np.float32)
    pivots = x[np.random.default_rng(0).permutation(len(x))[:many]].astype(np.float32)
    for _ in range(rounds):
        own = (x @ pivots.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        middle = np.add.reduceat(x[order].astype(np.float64), first, axis=0)
        size = np.sqrt((middle * middle).sum(axis=1, keepdims=True))
        pivots[used] = np.where(size > 1e-9, middle / np.maximum(size, 1e-9), pivots[used])
    return pivots


def half_of(total: int, bits: int) -> int:
    """Bits of half a substring for ``total`` vectors."""
    return max(1, min(bits // 2, 12, max(4, round(HALF * math.log2(max(2, total))))))


def chance(p: np.ndarray, bits: int, half: int, radius: int) -> np.ndarray:
    """How likely a code is retrieved of which each bit differs with the probability ``p``."""
    same = (1 - p) ** half
    meet = 1 - (1 - same * (same + half * p * (1 - p) ** (half - 1))) ** (2 * (bits // (2 * half)))
    spread = np.sqrt(np.maximum(bits * p * (1 - p), 1e-9))
    within = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in np.ravel((radius + 0.5 - bits * p) / spread)])
    return meet * within.reshape(np.shape(p))


def stretch_of(x: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int) -> float:
    """The share of differing bits of near vectors over their angle as a share of half a turn, on the sample ``x``."""
    if len(x) < 2:
        return 1.0
    signs = np.where((x - mean) @ turn > 0, np.float32(1), np.float32(-1))
    some = np.arange(min(len(x), 512))
    likeness = x[some] @ x.T
    likeness[some, some] = -2
    near = np.argsort(-likeness, axis=1)[:, : min(k, len(x) - 1)]
    apart = 0.5 - np.einsum("ad,abd->ab", signs[some], signs[near]) / (2 * signs.shape[1])
    angle = np.arccos(np.clip(np.take_along_axis(likeness, near, 1), -1, 1)) / np.pi
    return float(apart.sum() / max(1e-9, angle.sum()))


def sure_similarity(need: float, stretch: float, bits: int, half: int, radius: int) -> float:
    """The similarity from which on a vector is retrieved with the chance ``need`` at least."""
    at = np.linspace(1, -1, 4001)
    good = chance(np.clip(stretch * np.arccos(at) / np.pi, 0, 0.5), bits, half, radius) >= need
    return float(at[good.argmin() - 1]) if not good.all() and good[0] else (-1.0 if good.all() else 2.0)


def _code(learned, dimension: int):
    """Each usable vector's cell, code, and a digest by which equal vectors are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turn, pivots = learned.value
        for batch in batches:
            rows, unit = _units(batch, dimension)
            codes = np.packbits((unit - mean) @ turn > 0, axis=1)
            cells = (unit @ pivots.T).argmax(axis=1).astype(np.int32)
            digests = [hashlib.blake2b(np.round(u, 6).tobytes(), digest_size=12).digest() for u in unit + np.float32(0)]
            yield pa.RecordBatch.from_arrays([rows, pa.array(cells), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(digests, pa.binary())], ["row", "cell", "code", "digest"])

    return run


def _halves(codes: np.ndarray, half: int) -> np.ndarray:
    """The value of each half of each substring of packed codes; halves 2k and 2k + 1 are those of substring k."""
    signs = np.unpackbits(codes, axis=1)
    many = signs.shape[1] // (2 * half) * 2
    weights = (1 << np.arange(half, dtype=np.int32))[::-1]
    return signs[:, : many * half].reshape(len(signs), many, half).astype(np.int32) @ weights


def _half_at(codes: np.ndarray, h: int, half: int) -> np.ndarray:
    """Column ``h`` of ``_halves``."""
    lo = h * half
    signs = np.unpackbits(codes[:, lo // 8 : -(-(lo + half) // 8)], axis=1)[:, lo % 8 : lo % 8 + half]
    return signs.astype(np.int16) @ (1 << np.arange(half, dtype=np.int16))[::-1]


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _tally(half: int):
    """(spot, n): how many codes of each batch are in each bucket; a spot is an index and a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = _halves(_codes(batch.column(0)), half)
                spots, n = np.unique(values + (np.arange(values.shape[1], dtype=np.int32) << half), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(spots.astype(np.int32)), pa.array(n)], ["spot", "n"])

    return run


def _packed(data: np.ndarray, edge: np.ndarray) -> pa.Array:
    """The runs of ``data`` between ``edge`` as bytes."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((edge * data.strides[0]).astype(np.int32)), pa.py_buffer(data)])


#: Rows of a pack: held by the bucket and asking in it, only asking, only held.
BOTH, ASKS, HELD = 0, 2, 1


def _index(half: int, split):
    """Each batch's codes in the buckets of all halves: (spot, block, role, rows, cells, codes), packed by bucket.

    ``split`` names the buckets of several blocks and their number: a code is held by one block and asks in all.
    """
    names = ["spot", "block", "role", "rows", "cells", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = split.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, cells, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int16), _codes(batch.column(2))
            values = _halves(codes, half)
            salt = _shuffled(rows)
            for h in range(values.shape[1]):
                order = np.argsort(values[:, h], kind="stable")
                value = values[order, h]
                edge = np.concatenate([[0], np.flatnonzero(np.diff(value)) + 1, [len(value)]])
                spots = (value[edge[:-1]] + (h << half)).astype(np.int32)
                hot = np.array([s in blocks for s in spots.tolist()]) if blocks else np.zeros(len(spots), bool)
                sent = [(order[np.repeat(~hot, np.diff(edge))], np.concatenate([[0], np.cumsum(np.diff(edge)[~hot])]), spots[~hot], np.zeros((~hot).sum(), np.int32), np.full((~hot).sum(), BOTH, np.int32))]
                for g in np.flatnonzero(hot):
                    mine, many = order[edge[g] : edge[g + 1]], blocks[int(spots[g])]
                    for b in range(many):
                        own = (salt[mine] % many) == b
                        for some, role in ((mine[own], BOTH), (mine[~own], ASKS)):
                            if len(some):
                                sent.append((some, np.array([0, len(some)]), spots[g : g + 1], np.array([b], np.int32), np.array([role], np.int32)))
                for who, e, s, b, r in sent:
                    if len(s):
                        packs = [_packed(x[who], e) for x in (rows, cells, codes)]
                        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(b), pa.array(r), *packs], names)

    return run


def _shuffled(rows: np.ndarray) -> np.ndarray:
    """Row numbers in an order of no meaning, the same everywhere; not negative."""
    x = rows.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ (x >> np.uint64(33))).astype(np.int64) & np.int64(0x7FFFFFFFFFFFFFFF)


def _probe(radius: int, half: int, bits: int):
    """In each block of each bucket, the cells in which codes are retrieved for each asking row: (row, cell)."""
    near = np.bitwise_count(np.arange(1 << half, dtype=np.uint16)) <= 1
    width = bits // 8

    def unpack(packs: list[tuple], spot: int) -> tuple[np.ndarray, ...]:
        rows, cells = (np.frombuffer(b"".join(p[i] for p in packs), dtype=t) for i, t in enumerate((np.int64, np.int16)))
        codes = np.frombuffer(b"".join(p[2] for p in packs), dtype=np.uint8).reshape(len(rows), width)
        # the other half is a part of the code: it isn't sent
        others = _half_at(codes, (spot >> half) ^ 1, half)
        return rows, cells, others, codes.view(np.uint64) if width % 8 == 0 else codes

    def ask(asking: tuple, held: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(held[1], kind="stable")
        names, cells, others, codes = (x[order] for x in held)
        edge = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1])
        run = np.repeat(np.arange(len(edge)), np.diff(np.concatenate([edge, [len(cells)]])))
        first = np.flatnonzero(np.arange(len(cells)) - edge[run] < FIRST)
        step = max(1, PAIRS // len(names))
        for lo in range(0, len(asking[0]), step):
            rows, _, mine, own = (x[lo : lo + step] for x in asking)
            close = near[mine[:, None] ^ others[None, :]]
            hit = np.zeros((len(rows), len(edge)), dtype=bool)

            def retrieve(i: np.ndarray, j: np.ndarray) -> None:
                for at in range(0, len(i), PAIRS // 4):
                    a, b = i[at : at + PAIRS // 4], j[at : at + PAIRS // 4]
                    good = np.bitwise_count(own[a] ^ codes[b]).sum(axis=1, dtype=np.int32) <= radius
                    good &= rows[a] != names[b]
                    hit[a[good], run[b[good]]] = True

            i, j = np.nonzero(close[:, first])
            retrieve(i, first[j])
            # of the cells that are not settled by their first codes, all others
            close[:, first] = False
            close &= ~hit[:, run]
            retrieve(*np.nonzero(close))
            a, b = np.nonzero(hit)
            yield rows[a], cells[edge[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[tuple] = []
        many = 0
        held: list[tuple] = []
        built = None
        last = None

        def settle() -> None:
            nonlocal many
            for got in ask(built, built):
                met.append(got)
                many += len(got[0])

        def flush() -> pa.RecordBatch:
            both = np.sort(np.concatenate([m[0] for m in met]) * PIVOTS + np.concatenate([m[1] for m in met]))
            both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(both // PIVOTS), pa.array((both % PIVOTS).astype(np.int32))], ["row", "cell"])

        for batch in batches:
            for spot, block, role, *pack in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (spot, block) != last:
                    if held and built is None:
                        built = unpack(held, last[0])
                        settle()
                    held, built, last = [], None, (spot, block)
                if role == BOTH:
                    held.append(tuple(pack))
                elif held:
                    if built is None:
                        built = unpack(held, spot)
                        settle()
                    for got in ask(unpack([tuple(pack)], spot), built):
                        met.append(got)
                        many += len(got[0])
                if many >= 500_000:
                    yield flush()
                    many = 0
        if held and built is None:
            built = unpack(held, last[0])
            settle()
        if met:
            yield flush()

    return run


def _rerank(k: int, dimension: int):
    """In runs of one place and block, the k best of each asking vector: (row_a, row_b, similarity).

    Vectors that are held come first (they may ask, too); those that only ask follow and are read as a stream.
    """

    def best(asking: np.ndarray, x: np.ndarray, names: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        top = min(k + 7, len(names))
        for lo in range(0, len(asking), 512):
            mine, q = asking[lo : lo + 512], x[lo : lo + 512]
            likeness = q @ y.T
            near = np.argpartition(-likeness, top - 1, axis=1)[:, :top] if top < len(names) else np.broadcast_to(np.arange(top), likeness.shape)
            exact = np.einsum("ad,abd->ab", q.astype(np.float64), y[near].astype(np.float64))
            exact[names[near] == mine[:, None]] = -9
            ranked = np.lexsort((names[near], -np.round(exact, 8)), axis=1)[:, :k]
            near, exact = np.take_along_axis(near, ranked, 1), np.take_along_axis(exact, ranked, 1)
            keep = exact.ravel() > -8
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(mine, near.shape[1])[keep]), pa.array(names[near].ravel()[keep]), pa.array(exact.ravel()[keep])], ["row_a", "row_b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        built: tuple | None = None
        last = None

        def build() -> tuple:
            rows = np.concatenate([x.column(3).to_numpy() for x in held])
            role = np.concatenate([x.column(2).to_numpy() for x in held])
            y = np.concatenate([_matrix(x.column(4), dimension) for x in held])
            return rows, y, role == BOTH

        def own(made: tuple) -> Iterator[pa.RecordBatch]:
            rows, y, asks = made
            yield from best(rows[asks], y[asks], rows, y)

        for batch in batches:
            if not batch.num_rows:
                continue
            late = (batch.column(2).to_numpy() == ASKS).astype(np.int64)
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), late], axis=1)
            edge = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edge, edge[1:], strict=False):
                key, part = tuple(keys[a][:2]), batch.slice(a, b - a)
                if key != last:
                    if held and built is None:
                        yield from own(build())
                    held, built, last = [], None, key
                if not keys[a][2]:
                    held.append(part)
                elif held:
                    if built is None:
                        built = build()
                        yield from own(built)
                    yield from best(part.column(3).to_numpy(), _matrix(part.column(4), dimension), built[0], built[1])
        if held and built is None:
            yield from own(build())

    return run


def _best(sent: DataFrame, k: int, dimension: int) -> DataFrame:
    """The k best of each asking row over all its places; ``sent`` has (place, block, role, row, unit)."""
    grouped = sent.select("place", "block", "role", "row", "unit").repartition("place", "block").sortWithinPartitions("place", "block", "role")
    found = grouped.mapInArrow(_rerank(k, dimension), "row_a bigint, row_b bigint, similarity double")
    order = Window.partitionBy("row_a").orderBy(F.round("similarity", 8).desc(), "row_b")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def retrieve(codes: DataFrame, half: int, radius: int, bits: int) -> DataFrame:
    """(row, cells): the cells in which multi-index hashing retrieves codes for each row of ``codes`` (row, cell, code)."""
    counted = codes.select("code").mapInArrow(_tally(half), "spot int, n bigint").groupBy("spot").agg(F.sum("n").alias("n"))
    # at most one row for each value of each half: fewer than bits * 2 ** half / half
    hot = {r["spot"]: -(-r["n"] // BUCKET) for r in counted.where(F.col("n") > BUCKET).collect()}
    split = codes.sparkSession.sparkContext.broadcast(hot)
    packs = codes.select("row", "cell", "code").mapInArrow(_index(half, split), "spot int, block int, role int, rows binary, cells binary, codes binary")
    met = packs.repartition("spot", "block").sortWithinPartitions("spot", "block", "role").mapInArrow(_probe(radius, half, bits), "row bigint, cell int")
    return met.groupBy("row").agg(F.collect_set("cell").alias("cells"))


def places(units: DataFrame, asked: DataFrame, sizes: DataFrame) -> DataFrame:
    """(place, block, role, row, unit): every row of ``units`` (row, cell, unit) in one block of its cell, and wherever it asks.

    ``asked`` has (row, cells), ``sizes`` (cell, blocks) with at most ``PIVOTS`` rows. A row asks in all blocks of a cell.
    """
    rows = units.join(asked, "row", "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<int>")))
    each = rows.withColumn("place", F.explode(F.array_union(F.array("cell"), "cells"))).join(F.broadcast(sizes.select(F.col("cell").alias("place"), "blocks")), "place")
    own = F.when(F.col("place") == F.col("cell"), F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).otherwise(F.lit(-1))
    each = each.withColumn("own", own).withColumn("asks", F.array_contains("cells", F.col("place")))
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("asks") | (F.col("block") == F.col("own")))
    role = F.when(F.col("block") != F.col("own"), ASKS).when(F.col("asks"), BOTH).otherwise(HELD)
    return each.select("place", "block", role.alias("role"), "row", "unit")


def _ask_all(units: DataFrame, askers: DataFrame, total: int) -> DataFrame:
    """The rows of ``askers`` (row) sent to all blocks that the rows of ``units`` (row, unit) are held in."""
    blocks = max(PARTS, -(-total // WHOLE))
    held = units.select(F.lit(-1).alias("place"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(HELD).alias("role"), "row", "unit")
    asks = units.join(askers, "row", "left_semi").select(F.lit(-1).alias("place"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(ASKS).alias("role"), "row", "unit")
    return held.unionByName(asks)


def nearest(
    vectors: DataFrame, row: str, vector: str, among: DataFrame | None = None, k: int = 10, *, dimension: int = DIMENSION, bits: int = BITS, radius: int = RADIUS, need: float = 0.999
) -> DataFrame:
    """(row_a, row_b, similarity): the ``k`` rows most similar by cosine to each usable row.

    ``among``, if given, has the one column row and says which rows take part. Ties go to the smaller row; a row is no
    neighbour of itself, but equal vectors of other rows are. Rows delivered twice count once. With fewer than two
    usable rows the result is empty. ``need`` is the chance of being retrieved that a row's k-th neighbour must have;
    rows without it ask all.
    """
    spark = vectors.sparkSession
    raw = usable(vectors, row, vector, dimension)
    total = max(2, raw.count())
    sample = sampled(raw, total, dimension)
    mean, turn = learn_rotation(sample, bits)
    half = half_of(total, bits)
    sure = sure_similarity(need, stretch_of(sample, mean, turn, k), bits, half, radius)
    # dimension x bits and at most PIVOTS x dimension floats
    learned = spark.sparkContext.broadcast((mean, turn, learn_pivots(sample, min(PIVOTS, -(-total // CELL)))))
    codes = raw.mapInArrow(_code(learned, dimension), "row bigint, cell int, code binary, digest binary")
    if among is not None:
        codes = codes.join(among.select("row").distinct(), "row", "left_semi")
    codes = materialise(codes.groupBy("row").agg(F.min(F.struct("digest", "cell", "code")).alias("x")).select("row", "x.cell", "x.code", "x.digest"))
    # equal vectors are one; the rows of a class that ties let into any result are its k + 1 smallest
    several = materialise(codes.groupBy("digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    twins = codes.join(several, "digest").select("rep", "row")
    copied = bool(several.take(1))
    lone = materialise(codes.join(several, "digest", "left").where("rep IS NULL OR rep = row").select("row", "cell", "code")) if copied else codes.select("row", "cell", "code")
    asked = retrieve(lone, half, radius, bits)
    sizes = lone.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    floats = raw.mapInArrow(_floats(dimension), "row bigint, unit binary")
    units = floats.join(lone.select("row", "cell"), "row").groupBy("row").agg(F.min(F.struct("unit", "cell")).alias("x")).select("row", "x.cell", "x.unit")
    found = materialise(_best(places(units, asked, sizes), k, dimension))
    known = found.groupBy(F.col("row_a").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("kth")).where((F.col("n") >= k) & (F.col("kth") >= sure))
    left = materialise(lone.select("row").join(known, "row", "left_anti"))
    if left.take(1):
        rest = _best(_ask_all(units, left, total), k, dimension)
        found = found.join(left.select(F.col("row").alias("row_a")), "row_a", "left_anti").unionByName(rest)
    if not copied:
        return found
    return _with_copies(found, codes, several, twins, k)


def _with_copies(found: DataFrame, codes: DataFrame, several: DataFrame, twins: DataFrame, k: int) -> DataFrame:
    """The result for all rows from that for the first rows of equal vectors."""
    found = materialise(found)
    shown = materialise(twins.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("row"))).where(F.col("r") <= k + 1).select("rep", "row"))
    # rows of neighbours with copies, and of askers with copies
    others = found.join(shown.select(F.col("rep").alias("row_b"), F.col("row").alias("other")), "row_b", "left")
    others = others.select(F.col("row_a").alias("rep"), F.coalesce("other", "row_b").alias("row_b"), "similarity")
    equal = shown.select("rep", F.col("row").alias("row_b"), F.lit(1.0).alias("similarity"))
    best = Window.partitionBy("rep").orderBy(F.round("similarity", 8).desc(), "row_b")
    lists = others.unionByName(equal).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    askers = twins.unionByName(codes.join(several, "digest", "left_anti").select(F.col("row").alias("rep"), "row"))
    asked = lists.join(askers, "rep").where("row <> row_b")
    mine = Window.partitionBy("row").orderBy("r")
    return asked.withColumn("at", F.row_number().over(mine)).where(F.col("at") <= k).select(F.col("row").alias("row_a"), "row_b", "similarity")
