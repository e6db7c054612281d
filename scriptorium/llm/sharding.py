"""Sampled splitters: range-partition records into shards of nearly equal bytes.

Records are ordered by a hash of their text, so equal texts are neighbours. Key samples, drawn in
proportion to record sizes, give quantile boundaries of many ranges: wide ones, and in the last part of
the order narrow ones, with which shards are evened out. A key that takes much of the sample gets a range
of its own; ranges that turn out overfull are subdivided. Whole ranges are then dealt to shards, the
largest first and each to the emptiest shard, so a group of equal texts stays together. Only a group
larger than a shard's share is dealt in parts.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.runtime import Bound, checkpointed, few_rows, place_among, positive_hash, quantiles, text_of

#: Bound of the wide ranges, and of the narrow ones, which share one part in NARROW_PART of the order.
MAX_RANGES, NARROW_PART = 2048, 32
RANGES_PER_SHARD = 64
#: Expected samples a wide range; the sample is bounded by MAX_RANGES times this, with its spread.
SAMPLES_PER_RANGE = 48
#: A range is overfull beyond this many times the wide ranges' mean.
OVERFULL = 2.0
#: Parts of a shard's share in which a group larger than it is dealt.
PARTS_PER_SHARE = 16
OVERHEAD_BYTES = 8
_TOP = 1 << 63


def _filled(slim: DataFrame, bounds: list[Bound]) -> dict[int, tuple[int, int]]:
    """Bytes and rows of every range that has rows."""
    found = slim.groupBy(place_among(bounds, F.col("key"), F.col("salt")).alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    return {r["range"]: (r["bytes"], r["rows"]) for r in found.collect()}


def _splitters(slim: DataFrame, total: int, share: float, ranges: int) -> tuple[list[Bound], dict[int, int]]:
    """Boundaries of the ranges, and the keys that have ranges of their own with their bytes."""
    chance = SAMPLES_PER_RANGE * ranges / max(total, 1)
    drawn = slim.where(F.pmod(F.xxhash64("salt", F.lit(7)), F.lit(1 << 30)) < F.col("size") * F.lit(chance * (1 << 30)))
    sample = sorted(r["key"] for r in drawn.select("key").collect())
    narrow = len(sample) - len(sample) // NARROW_PART
    often = {k for k, n in Counter(sample).items() if 2 * n >= SAMPLES_PER_RANGE}
    keys = {*quantiles(sample[:narrow], ranges), *quantiles(sample[narrow:], ranges), *often, *(k + 1 for k in often if k + 1 < _TOP)}
    bounds = sorted((k, 0) for k in keys)

    mean, alone = total / max(ranges, 1), {}
    for at, (size, _) in _filled(slim, bounds).items():
        low = bounds[at - 1][0] if at else 0
        if low in often and at:
            alone[low] = size
        elif size > OVERFULL * mean:
            high = bounds[at][0] if at < len(bounds) else _TOP
            inside = sample[bisect_left(sample, low) : bisect_left(sample, high)]
            keys.update(quantiles(inside, -(-size // max(1, int(mean)))))
    parts = []
    for key, size in alone.items():
        ways = -(-size // max(1, int(min(OVERFULL * mean, share / PARTS_PER_SHARE))))
        parts += [(key, _TOP // ways * k) for k in range(1, ways)]
    return sorted([*((k, 0) for k in keys), *parts]), alone


def _dealt(bounds: list[Bound], filled: dict[int, tuple[int, int]], alone: dict[int, int], share: float, shards: int) -> list[tuple[int, int, int]]:
    """(range, shard, rows of the shard in earlier ranges); the ranges of a group within a share go together."""
    units = defaultdict(list)
    for at in filled:
        key = bounds[at - 1][0] if at else -1
        units[("group", key) if key in alone and alone[key] <= share else ("range", at)].append(at)
    sizes = {name: sum(filled[at][0] for at in members) for name, members in units.items()}
    open_shards, home = [(0, s) for s in range(shards)], {}
    for name in sorted(units, key=lambda u: (-sizes[u], units[u])):
        size, shard = heapq.heappop(open_shards)
        heapq.heappush(open_shards, (size + sizes[name], shard))
        home.update(dict.fromkeys(units[name], shard))
    rows, out = Counter(), []
    for at in sorted(filled):
        out.append((at, home[at], rows[home[at]]))
        rows[home[at]] += filled[at][1]
    return out


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """One row a row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null texts count as empty and null identifiers as any other value; repeated rows are placed each.
    An empty table gives no rows. Groups of equal texts larger than a shard's share are split, others
    never; beside such groups shards differ by about one narrow range, or record if that is larger.
    """
    slim = checkpointed(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text_of()) + OVERHEAD_BYTES).cast("long").alias("size"),
            F.crc32(text_of()).alias("text_crc32"),
            positive_hash(text_of()).alias("key"),
        ).withColumn("salt", positive_hash("doc_id", "key", F.monotonically_increasing_id()))
    )
    total = slim.agg(F.sum("size")).first()[0] or 0
    share, ranges = total / shards, min(MAX_RANGES, shards * RANGES_PER_SHARD)
    bounds, alone = _splitters(slim, total, share, ranges)
    dealt = _dealt(bounds, _filled(slim, bounds), alone, share, shards)
    homes = few_rows(slim.sparkSession, dealt, "range int, shard int, rows_before long")
    within = Window.partitionBy("range").orderBy("salt", "doc_id", "size")
    return (
        slim.withColumn("range", place_among(bounds, F.col("key"), F.col("salt")))
        .withColumn("n", F.row_number().over(within)).join(F.broadcast(homes), "range")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rows_before") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
