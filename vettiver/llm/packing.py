"""Filling containers of fixed capacity with documents, over several lengths (problem 7).

Documents are items sized in tokens; one above the capacity gives full containers and a rest. Every item is routed to
the tier of the shortest context that holds it. The plan is made on the counts of each size, at most ``capacity``
numbers whatever the input: from the longest tier down, a tier's items are packed among themselves, the longest first,
and then the gaps of its containers are filled from the shorter tiers, the longest that fits first, tier by tier. What
the gaps take is no longer there when the shorter tier is packed. A filling is repeated as often as the counts allow.

Items find their container by their rank within their size, which is counted in salted buckets, so that a size that a
third of all documents share is spread over many tasks. Within each tier, containers are numbered by falling cost and
dealt to step groups in turns, there and back, so that the groups of a tier cost about the same in a training step.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vettiver.functions.shared import materialise

CAPACITY = 8192
TIERS = (512, 1024, 2048, 4096, 8192)
GROUP = 8
#: Buckets of one size at least, and items of a bucket, about.
BUCKETS, ITEMS = 64, 500_000
#: Bits of a rank within a size.
RANKS = 46


def tier_of(size: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The shortest context of ``tiers`` that holds ``size``; the longest holds what is longer."""
    return next((t for t in tiers if size <= t), tiers[-1])


def _fill(left: dict[int, int], sizes: list[int], gap: int) -> dict[int, int]:
    """{size: how many}: the longest of ``sizes`` (rising) that fit into ``gap``, as many as there are left."""
    filling: dict[int, int] = {}
    at = len(sizes)
    while gap > 0 and (at := bisect.bisect_right(sizes, gap, 0, at)) > 0:
        size = sizes[at - 1]
        filling[size] = min(gap // size, left[size])
        gap -= filling[size] * size
        at -= 1
    return filling


def _take(left: dict[int, int], sizes: list[int], filling: dict[int, int], often: int) -> None:
    for s, k in filling.items():
        left[s] -= often * k
        if not left[s]:
            sizes.pop(bisect.bisect_left(sizes, s))


def plan(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, dict[int, int]]]:
    """(tier, how often, {size: how many}) fillings that use up ``counts``.

    Every filling but a tier's last empties a size or fills all gaps of one kind: there are at most two for each size
    and tier.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    routed: dict[int, list[int]] = {t: [] for t in tiers}
    for s in sorted(left):
        routed[tier_of(s, tiers)].append(s)
    made = []
    for at in range(len(tiers) - 1, -1, -1):
        own = routed[tiers[at]]
        packed: list[tuple[int, int, dict[int, int]]] = []
        while own:
            filling = _fill(left, own, capacity)
            often = min(left[s] // k for s, k in filling.items())
            _take(left, own, filling, often)
            packed.append((capacity - sum(s * k for s, k in filling.items()), often, filling))
        # gaps of this tier's containers, the smallest first, from the shorter tiers
        for gap, often, filling in sorted(packed, key=lambda p: p[0]):
            while often:
                more: dict[int, int] = {}
                rest = gap
                for shorter in reversed(tiers[:at]):
                    extra = _fill(left, routed[shorter], rest)
                    more |= extra
                    rest -= sum(s * k for s, k in extra.items())
                now = min([often, *(left[s] // k for s, k in more.items())])
                for shorter in tiers[:at]:
                    _take(left, routed[shorter], {s: k for s, k in more.items() if tier_of(s, tiers) == shorter}, now)
                made.append((tiers[at], now, filling | more))
                often -= now
    return made


def cost(filling: dict[int, int]) -> int:
    """What a container costs in a step: its tokens' attention pairs, within documents, and the tokens themselves."""
    return sum(k * (s * s + CAPACITY * s) for s, k in filling.items())


def _place(slots):
    """Each item's container by binary search of its size and rank: (key, piece, token_start, token_end, tier, container_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lo, base, k, tier = slots.value
        for batch in batches:
            # ranks of different sizes in one rising order; the last slot that begins at or before the rank
            rank = batch.column(5).to_numpy() + (batch.column(4).to_numpy().astype(np.int64) << RANKS)
            at = np.searchsorted(lo, rank, side="right") - 1
            container = base[at] + (rank - lo[at]) // k[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(tier[at]), pa.array(container)], [*batch.schema.names[:4], "tier", "container_id"])

    return run


def pack(sizes: DataFrame, key: str, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS, group: int = GROUP) -> DataFrame:
    """(key, piece, token_start, token_end, tier, container_id, step_group) of each piece of each document.

    ``sizes`` has the unique key and n_tokens; rows without tokens (null, empty) are in no container. Only a document
    above ``capacity`` has several pieces: full ones and a rest. ``tier`` is that of the container, the context that its
    longest item needs; a step group has containers of one tier.
    """
    spark = sizes.sparkSession
    sized = materialise(sizes.where("n_tokens > 0").select(F.col(key).alias("key"), "n_tokens"))
    buckets = max(BUCKETS, -(-sized.count() // ITEMS))
    start = F.col("piece") * F.lit(capacity)
    items = (
        sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int"))))
        .select("key", "piece", start.cast("bigint").alias("token_start"), F.least(start + capacity, F.col("n_tokens")).cast("bigint").alias("token_end"))
        .withColumn("size", (F.col("token_end") - F.col("token_start")).cast("int"))
        .withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    )
    in_bucket = items.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_bucket.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    counts = {r["size"]: r["n"] for r in in_bucket.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    made = sorted(plan(counts, capacity, tiers), key=lambda x: (-x[0], -cost(x[2])))
    slots, base, given, ends = [], 0, dict.fromkeys(counts, 0), {}
    for tier, often, filling in made:
        for size, k in filling.items():
            slots.append((size, given[size] + (size << RANKS), base, k, tier))
            given[size] += often * k
        base += often
        ends[tier] = base
    # at most one slot for each filling and size, which the capacity bounds
    sent = spark.sparkContext.broadcast([np.array(c, dtype=np.int64) for c in zip(*sorted(slots), strict=True)] if slots else [np.zeros(0, np.int64)] * 5)
    rank = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "piece")) - 1
    ranked = items.withColumn("r", rank).join(offsets, ["size", "bucket"]).select("key", "piece", "token_start", "token_end", "size", (F.col("r") + F.col("offset")).cast("bigint").alias("rank"))
    kind = ranked.schema["key"].dataType.simpleString()
    placed = ranked.mapInArrow(_place(sent), f"key {kind}, piece int, token_start bigint, token_end bigint, tier bigint, container_id bigint")
    # of each tier, the first container and the first step group
    begins, group_at = F.lit(0), F.lit(0)
    first = steps_before = 0
    many = F.lit(1)
    for tier in sorted(ends, reverse=True):
        steps = max(1, -(-(ends[tier] - first) // group))
        here = F.col("tier") == tier
        begins, many, group_at = F.when(here, F.lit(first)).otherwise(begins), F.when(here, F.lit(steps)).otherwise(many), F.when(here, F.lit(steps_before)).otherwise(group_at)
        first, steps_before = ends[tier], steps_before + steps
    nth = F.col("container_id") - begins
    turn, place = F.floor(nth / many), F.pmod(nth, many)
    return placed.select(
        F.col("key").alias(key),
        "piece",
        "token_start",
        "token_end",
        F.col("tier").cast("int").alias("tier"),
        "container_id",
        (group_at + F.when(turn % 2 == 0, place).otherwise(many - 1 - place)).cast("bigint").alias("step_group"),
    )
