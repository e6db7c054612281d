"""Nearest vectors by inner product: several shifted Hilbert curves, windows on them, and an exact check.

Vectors are scaled by the greatest length and given one more component that makes all lengths equal, so
the largest inner product is the least distance. Every curve projects them onto a few random directions,
shifts them by an offset of its own, and orders them by their Hilbert key. The orders are range-partitioned
by Spark; a query's candidates are the rows within a window around its place on each curve. They are
ranked by their exact inner products, and the curves' lists are merged.

In many dimensions the nearest rows need not be near on any curve. The check that follows takes what the
windows found as the score to beat: rows are blocks in the order of the first curve, queries are chunks of
that order, and the centres and radii of both bound every inner product between them. A chunk is compared
only with those blocks in which that bound reaches the least score of its queries. So the result is the
exact one; where vectors have no structure the bounds exclude little, and the queries meet all rows, in
blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_bytes, checkpointed, placed
from scriptorium.llm.vector_codes import finite

CURVES, AXES, BITS = 4, 8, 7
#: Places before and after a query on a curve whose rows are its candidates.
WINDOW = 128
#: Places of a curve that one task compares at a time; places of a chunk of queries; rows scored at once.
BLOCK, CHUNK, AT_ONCE = 2048, 16_384, 256
#: Block summaries that meet chunk summaries in one key.
TILE = 1024
_LAST = (1 << 63) - 1
FOUND = "asker long, hits array<struct<low:double,id:bigint,rid:bigint>>"
PACKED = "part long, centre array<double>, radius double, reach double, least double, ids binary, rids binary, vectors binary, beat binary"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve through a grid of (2**bits) ** axes cells; neighbours on the curve are neighbours in the grid."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in range(axes):
            turned = x[k] >> level & 1 == 1
            swapped = np.where(turned, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(turned, below, swapped)
            x[k] ^= swapped
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flips ^= np.where(x[-1] >> level & 1 == 1, (1 << level) - 1, 0)
    x ^= flips
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << 1 | (x[k] >> level & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int, longest: float) -> np.ndarray:
    """Keys of vectors on one of the curves."""
    own = vectors / longest
    whole = np.column_stack([own, np.sqrt(np.maximum(0, 1 - (own**2).sum(axis=1)))])
    axes = min(AXES, whole.shape[1])
    chance = np.random.default_rng(curve)
    directions = np.linalg.qr(chance.normal(size=(whole.shape[1], axes)))[0]
    at = (whole @ directions + 1) / 2 + chance.random(axes) / 2  # within 0 and 1.5
    return hilbert_keys(np.clip((at / 1.5 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1), BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, components added from the first to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rids: np.ndarray, asked: np.ndarray, top: int, beat: np.ndarray | None = None) -> list[list[dict]]:
    """Each query's ``top`` best rows among those asked for, by score, then identifier; ``beat`` is the least score that counts."""
    near = queries @ vectors.T
    near[~asked] = -np.inf
    least = np.partition(near, -top, axis=1)[:, -top] if near.shape[1] > top else np.full(len(queries), -np.inf)
    if beat is not None:
        least = np.maximum(least, beat)
    at = np.linalg.norm(queries, axis=1) * max(1e-300, float(np.linalg.norm(vectors, axis=1).max(initial=0)))
    which, row = np.nonzero(asked & (near >= (least - 1e-9 * at)[:, None]))
    score = products(queries[which], vectors[row])
    if beat is not None:
        enough = score >= beat[which]
        which, row, score = which[enough], row[enough], score[enough]
    order = np.lexsort((rids[row], ids[row], -score, which))
    which, row, score = which[order], row[order], score[order]
    begin = np.searchsorted(which, np.arange(len(queries) + 1))
    return [
        [{"low": -float(score[k]), "id": int(ids[row[k]]), "rid": int(rids[row[k]])} for k in range(b, min(e, b + top))]
        for b, e in zip(begin, begin[1:], strict=False)
    ]


def _batch(askers: list[int], hits: list[list[dict]]) -> pa.Table:
    kind = pa.list_(pa.struct([("low", pa.float64()), ("id", pa.int64()), ("rid", pa.int64())]))
    return pa.table([pa.array(askers, pa.int64()), pa.array(hits, kind)], names=["asker", "hits"])


def _within_windows(places: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """asker, hits: what each query finds in each block of places that its windows reach."""
    block = F.floor(F.col("place") / BLOCK).cast("long")
    rows = places.join(kept, "rid").select("curve", "place", "rid", "id", "asks", "vector")
    reached = F.array_distinct(F.array(*[F.floor(F.greatest(F.col("place") + step, F.lit(0)) / BLOCK).cast("long") for step in (-WINDOW, 0, WINDOW)]))
    parts = F.explode(F.when(F.col("asks"), reached).otherwise(F.array(block)))
    dealt = rows.select("*", block.alias("home"), parts.alias("block"))

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _batch([], [])
        table = table.combine_chunks()
        curve, place, rid, ids, home, part = (table.column(c).to_numpy() for c in ("curve", "place", "rid", "id", "home", "block"))
        asks, vectors = table.column("asks").to_numpy(), _matrix(table.column("vector").chunk(0))
        own, asker, hits = np.flatnonzero(home == part), [], []
        everyone = np.flatnonzero(asks)
        for at in range(0, len(everyone), AT_ONCE):
            q = everyone[at : at + AT_ONCE]
            asked = (np.abs(place[q, None] - place[own]) <= WINDOW) & (curve[q, None] == curve[own]) & (rid[q, None] != rid[own])
            asker += rid[q].tolist()
            hits += best(vectors[q], vectors[own], ids[own], rid[own], asked, top)
        return _batch(asker, hits)

    return dealt.groupBy("block").applyInArrow(run, FOUND).where(F.size("hits") > 0)


def _merged(found: DataFrame, top: int) -> DataFrame:
    """asker, hits: the best of all lists of a query, each row once; a query has a bounded number of lists of ``top``."""
    return found.groupBy("asker").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, top).alias("hits"))


def _packs(rows: DataFrame, size: int) -> DataFrame:
    """One row for each run of ``size`` places of the first curve: its vectors, and a ball that holds them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        vectors = _matrix(table.column("vector").chunk(0)) if table.num_rows else np.zeros((0, 1))
        centre = vectors.mean(axis=0) if len(vectors) else np.zeros(1)
        beat = table.column("beat").to_numpy()
        values = [
            int(table.column("part")[0].as_py()), centre.tolist(), float(np.linalg.norm(vectors - centre, axis=1).max(initial=0)), float(np.linalg.norm(vectors, axis=1).max(initial=0)),
            float(beat.min(initial=np.inf)), table.column("id").to_numpy().tobytes(), table.column("rid").to_numpy().tobytes(), vectors.tobytes(), beat.tobytes(),
        ]
        return pa.table([pa.array([v]) for v in values], names=[f.split()[0] for f in PACKED.split(", ")])

    dealt = rows.select(F.floor(F.col("place") / size).cast("long").alias("part"), "id", "rid", "vector", "beat")
    return dealt.groupBy("part").applyInArrow(run, PACKED)


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _checked(first: DataFrame, kept: DataFrame, merged: DataFrame, top: int) -> DataFrame:
    """asker, hits: rows that reach the score to beat, from the blocks that can hold one."""
    everyone = first.join(kept, "rid")
    beat = F.when(F.size("hits") == top, -F.element_at("hits", -1)["low"]).otherwise(F.lit(float("-inf")))
    asking = everyone.where("asks").join(merged.select(F.col("asker").alias("rid"), beat.alias("beat")), "rid", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
    blocks, chunks = checkpointed(_packs(everyone.withColumn("beat", F.lit(0.0)), BLOCK)), checkpointed(_packs(asking, CHUNK))
    few = lambda t, to: t.select(*(F.col(c).alias(f"{to}_{c}") for c in ("part", "centre", "radius", "reach", "least")))
    tiles = blocks.count() // TILE
    pairs = few(chunks, "q").withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles)))).join(few(blocks, "x").withColumn("tile", F.floor(F.col("x_part") / TILE).cast("int")), "tile")
    middle = lambda side: F.sqrt(F.aggregate(f"{side}_centre", F.lit(0.0), lambda s, x: s + x * x))
    bound = _dot("q_centre", "x_centre") + middle("q") * F.col("x_radius") + middle("x") * F.col("q_radius") + F.col("q_radius") * F.col("x_radius")
    reach = F.col("q_reach") * F.col("x_reach")
    pairs = pairs.where(F.least(bound, reach) + 1e-9 * reach >= F.col("q_least")).select("q_part", "x_part")
    q = chunks.select(F.col("part").alias("q_part"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "rids", "vectors", "beat")))
    x = blocks.select(F.col("part").alias("x_part"), *(F.col(c).alias(f"x_{c}") for c in ("ids", "rids", "vectors")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                raw = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: B023, E731
                asker, beats, ids, rids = raw("q_rids", np.int64), raw("q_beat", np.float64), raw("x_ids", np.int64), raw("x_rids", np.int64)
                asking, vectors = raw("q_vectors", np.float64).reshape(len(asker), -1), raw("x_vectors", np.float64).reshape(len(ids), -1)
                for at in range(0, len(asker), AT_ONCE):
                    own = slice(at, at + AT_ONCE)
                    hits = best(asking[own], vectors, ids, rids, asker[own, None] != rids, top, beats[own])
                    kept_ones = [j for j, found in enumerate(hits) if found]
                    yield from _batch(asker[own][kept_ones].tolist(), [hits[j] for j in kept_ones]).to_batches()

    return pairs.join(q, "q_part").join(x, "x_part").select(*q.columns[1:], *x.columns[1:]).mapInArrow(run, FOUND)


def nearest_vectors(vectors: DataFrame, top: int = 20, every: int = 20, check: bool = True) -> DataFrame:
    """Each query's nearest rows of ``vectors`` (vec_id, embedding): query_id, rank, vec_id, score, on_curve.

    Queries are the rows whose vec_id is divisible by ``every``; a query's own row is no candidate, other
    rows of its vec_id are. Nearness is the inner product in double precision; ties go to the smaller
    vec_id, null ones last, then to any of the equal rows. ``on_curve`` says whether the windows had found
    the row; without ``check`` nothing else is given. Vectors that are null, empty or zero, hold null or
    non-finite components, or have another length than the one with the smallest vec_id take no part. An
    empty table gives no rows; other columns are ignored.
    """
    bounded_bytes(vectors.sparkSession)
    size = F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(finite(F.col("vector"))).where(size > 0)
    first = sound.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(1).collect()
    nothing = vectors.sparkSession.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(True).alias("on_curve"))
    if not first:
        return nothing
    kept = sound.where(F.size("vector") == len(first[0]["vector"])).select(
        F.monotonically_increasing_id().alias("rid"), F.coalesce("vec_id", F.lit(_LAST)).alias("id"), F.coalesce(F.pmod("vec_id", F.lit(every)) == 0, F.lit(False)).alias("asks"), "vector"
    )
    kept = checkpointed(kept)
    longest = kept.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rid, own = batch.column(0), _matrix(batch.column(1))
                for curve in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), curve, np.int32)), pa.array(curve_keys(own, curve, longest)), rid], names=["curve", "key", "rid"])

    keyed = kept.select("rid", "vector").mapInArrow(keys, "curve int, key long, rid long")
    places = placed(checkpointed(keyed), "curve", "key", "rid").select("curve", "place", "rid")
    merged = checkpointed(_merged(_within_windows(places, kept, top), top))
    final = merged.select("asker", "hits", F.transform("hits", lambda h: h["rid"]).alias("seen"))
    if check:
        more = _merged(_checked(places.where("curve = 0"), kept, merged, top).unionByName(merged), top)
        final = more.join(final.select("asker", "seen"), "asker", "left")
    ids = kept.where("asks").select(F.col("rid").alias("asker"), F.col("id").alias("query_id"))
    hit = F.col("hit")
    return (
        final.join(ids, "asker").select("query_id", "seen", F.posexplode("hits").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.when(hit["id"] != _LAST, hit["id"]).alias("vec_id"), (-hit["low"]).alias("score"), F.coalesce(F.array_contains("seen", hit["rid"]), F.lit(False)).alias("on_curve"))
    )
