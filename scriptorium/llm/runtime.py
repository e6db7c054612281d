"""Shared helpers: durable lineage cuts, default columns and bounded bitmap filters."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.durable import checkpointed, shared_dir

__all__ = ["checkpointed", "shared_dir"]

#: Bits of a membership bitmap, 1 MB at least and 16 MB at most, the proven bound of what is broadcast.
FILTER_BITS, MOST_FILTER_BITS = 1 << 23, 1 << 27
BITS_PER_KEY = 8
#: Bits in one bitmap row, as ``bitmap_construct_agg`` lays them out (4 KB).
BITMAP_ROW_BITS = 8 * 4096
#: A splitter of records ordered by two longs.
Bound = tuple[int, int]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python at most so many rows at a time in this session, for whole texts are long; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def bounded_bytes(spark: SparkSession, megabytes: int = 16) -> None:
    """Hand Python at most about so many bytes at a time in this session, for packed rows are large; a smaller setting stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(setting).strip().lower()
    size = int(said.rstrip("bkmgt") or -1) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(said.rstrip("b")[-1:], 0)
    if not 0 < size <= megabytes << 20:
        spark.conf.set(setting, f"{megabytes}m")


def few_rows(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A frame of a bounded list of rows of numbers, made without Python workers."""
    names = [f.split()[0] for f in fields.split(", ")]
    said = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    kind = ", ".join(":".join(f.split()) for f in fields.split(", "))
    return spark.range(1).select(F.explode(F.from_json(F.lit(said), f"array<struct<{kind}>>")).alias("row")).select("row.*")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def positive_hash(*columns: Column | str) -> Column:
    """A 63-bit hash that is never negative."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def bits_for(keys: int) -> int:
    """Bits of a bitmap for so many keys; beyond the bound it lets more rows through, never fewer."""
    return min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << max(0, BITS_PER_KEY * keys - 1).bit_length()))


def kept_by(rows: DataFrame, keys: DataFrame, count: int, of_row: Column, of_key: Column) -> DataFrame:
    """``rows`` with ``maybe``: whether a bitmap of ``keys``, sized by their number, may hold the row's key."""
    bits = bits_for(count)
    return probe_filter(rows, bitmap_filter(keys, of_key, bits), of_row, bits)


def bitmap_filter(keys: DataFrame, key_hash: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A bitmap of hashed keys: (filter_row, bitmap), at most ``bits / 32768`` rows of 4 KB.

    ``key_hash`` is a non-negative long. A key that was put in always tests true; others test true
    at about the share of set bits, so the filter only ever saves work.
    """
    position = F.pmod(key_hash, F.lit(bits))
    return (
        keys.select(position.alias("position"))
        .groupBy(F.floor(F.col("position") / BITMAP_ROW_BITS).cast("long").alias("filter_row"))
        .agg(F.bitmap_construct_agg(F.col("position") % BITMAP_ROW_BITS).alias("bitmap"))
    )


def probe_filter(rows: DataFrame, bitmap: DataFrame, key_hash: Column, bits: int = FILTER_BITS) -> DataFrame:
    """Adds boolean ``maybe``: false only if the row's key isn't in the bitmap."""
    position = F.pmod(key_hash, F.lit(bits))
    within = (position % BITMAP_ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    probed = rows.withColumn("filter_row", F.floor(position / BITMAP_ROW_BITS).cast("long")).join(
        F.broadcast(bitmap), "filter_row", "left"
    )
    bit = F.getbit(byte, within % 8)
    return probed.withColumn("maybe", F.coalesce(bit == 1, F.lit(False))).drop("filter_row", "bitmap")


def place_among(bounds: list[Bound], key: Column, salt: Column) -> Column:
    """How many bounds are at or below (key, salt), by binary search over two constant arrays."""
    if not bounds:
        return F.lit(0)
    keys, salts = (F.from_json(F.lit(str([b[k] for b in bounds])), "array<bigint>") for k in (0, 1))
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]

    def descend(at: Column, step: Column) -> Column:
        to = at + step
        bound, tie = F.try_element_at(keys, to), F.try_element_at(salts, to)
        return F.when((to <= len(bounds)) & ((bound < key) | ((bound == key) & (tie <= salt))), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), descend)


def quantiles(sample: list, parts: int) -> list:
    return [sample[len(sample) * k // parts] for k in range(1, parts)] if sample else []


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``place``, counted from 0 by the order over all of them.

    Rows are range-partitioned by the order, of which every column counts, so equal first columns don't
    meet in one task; a row's place is its place in its range plus the rows of the ranges before.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["part"]: r["n"] for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return dealt.withColumn("place", F.lit(0).cast("long")).drop("_at")
    before, ahead = [], 0
    for k in sorted(sizes):
        before.append((k, ahead))
        ahead += sizes[k]
    offsets = F.broadcast(few_rows(spark, before, "_part long, _ahead long"))
    place = F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(offsets, "_part").withColumn("place", place).drop("_at", "_part", "_ahead")
