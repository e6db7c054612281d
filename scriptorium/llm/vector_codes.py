"""Vector codes: product quantisation in whole numbers, fitted by Lloyd rounds that skip what can't change.

A vector's components are scaled and floored, and the vector is cut into equal parts; each part gets the
index of the nearest entry of its position's codebook. A block of vectors is a row that keeps, for every
part position, one heap an entry: the parts assigned to it, keyed by the slack between the distance to
the second nearest entry (a lower bound for all others) and the distance to their own (an upper bound).
When entries move, a part's slack can shrink by no more than its entry's drift and the largest drift of
another entry. Those drifts are added up over the rounds in one threshold for each heap, and the keys hold
the threshold of the time when they were pushed: a pass pops what lies at or below the threshold, scans
those parts exactly, and pushes them where they belong now. The others are not looked at.

A heap is held as a sorted run, which is a heap whose pops are a prefix. Blocks never leave their task;
what moves between tasks is a sum for each entry. The codebooks, bounded by parts and entries, are all
that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_bytes, checkpointed

#: Vectors in a block, and parts that are scanned at once.
BLOCK_ROWS, SCAN_ROWS = 16_384, 4_096
#: A component beyond this is held at it, so that it stays a long.
MOST = 1 << 62
_LOW = (1 << 31) - 1
BLOCKS = "ids array<bigint>, labels array<string>, dimension int, width int, components binary, codes binary, bounds binary, order binary, keys binary, sums binary"
#: Labels up to which their sums are broadcast.
FEW_LABELS = 100_000


def finite(vector: Column) -> Column:
    """Whether a vector has components, all of them finite."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, sound), F.lit(False))


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 x) as longs; ±2**62 is the most."""
    with np.errstate(over="ignore"):
        found = np.floor(values.astype(np.float64) * 256.0)
    return np.clip(found, -float(MOST), float(MOST)).astype(np.int64)


def _fits(*arrays: np.ndarray) -> bool:
    """Whether squared distances between rows of such numbers fit into longs."""
    most = max(int(max(a.max(initial=0), -int(a.min(initial=0)))) for a in arrays)
    return (2 * most) ** 2 * max(1, arrays[0].shape[-1]) < MOST


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each part the index of its nearest entry, the lower one at a tie, and its two least squared distances, exact."""
    codes, best, second = np.zeros(len(parts), np.uint8), np.zeros(len(parts)), np.full(len(parts), np.inf)
    kind = np.int64 if _fits(parts, book) else object
    book = book.astype(kind)
    for at in range(0, len(parts), SCAN_ROWS):
        own = parts[at : at + SCAN_ROWS].astype(kind)
        far = np.zeros((len(own), len(book)), kind)
        for k in range(own.shape[1]):
            far += (own[:, k, None] - book[None, :, k]) ** 2
        found = far.argmin(axis=1)
        rows = np.arange(len(own))
        codes[at : at + len(own)] = found
        best[at : at + len(own)] = far[rows, found].astype(np.float64)
        if len(book) > 1:
            far[rows, found] = far.max() + 1
            second[at : at + len(own)] = far.min(axis=1).astype(np.float64)
    return codes, best, second


def _slack(best: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.sqrt(second) - np.sqrt(best)


class Block:
    """Components (rows, parts, width), codes (parts, rows), heaps as sorted runs, and sums of each entry's parts."""

    def __init__(self, components: np.ndarray, codes: np.ndarray, bounds: np.ndarray, order: np.ndarray, keys: np.ndarray, sums: np.ndarray) -> None:
        self.components, self.codes, self.bounds, self.order, self.keys, self.sums = components, codes, bounds, order, keys, sums

    @classmethod
    def scanned(cls, components: np.ndarray, book: np.ndarray) -> Block:
        """A block whose parts are all scanned."""
        n, parts, width = components.shape
        entries = book.shape[1]
        block = cls(
            components, np.zeros((parts, n), np.uint8), np.zeros((parts, entries + 1), np.int64), np.zeros((parts, n), np.uint16),
            np.zeros((parts, n)), np.zeros((parts, entries, width + 1, 2), np.int64),
        )
        for p in range(parts):
            codes, best, second = nearest(components[:, p], book[p])
            block._heapify(p, codes, _slack(best, second))
            block._count(p, np.arange(n), codes, 1)
        return block

    def _heapify(self, p: int, codes: np.ndarray, keys: np.ndarray) -> None:
        order = np.lexsort((keys, codes))
        self.codes[p], self.order[p], self.keys[p] = codes, order, keys[order]
        self.bounds[p] = np.searchsorted(codes[order], np.arange(self.bounds.shape[1]))

    def _count(self, p: int, rows: np.ndarray, codes: np.ndarray, sign: int) -> None:
        """Add or take away parts; a component's high and low bits are summed apart."""
        own = self.components[rows, p].astype(np.int64)
        high, low = np.pad(own >> 31, ((0, 0), (1, 0))), np.pad(own & _LOW, ((0, 0), (1, 0)), constant_values=1)
        np.add.at(self.sums[p], codes, sign * np.stack([high, low], axis=2))

    def popped(self, p: int, limits: np.ndarray) -> np.ndarray:
        """Places in the runs of the parts whose bounds the drift so far has violated: a prefix of each heap."""
        ends = [
            begin + int(np.searchsorted(self.keys[p, begin:stop], limit + 1e-6 * (1 + limit), side="right"))
            for begin, stop, limit in zip(self.bounds[p], self.bounds[p, 1:], limits, strict=False)
        ]
        return np.concatenate([np.arange(b, e) for b, e in zip(self.bounds[p], ends, strict=False)]).astype(np.int64)

    def moved(self, book: np.ndarray, limits: np.ndarray) -> int:
        """Assign to the entries as they are now, and count the parts that had to be scanned."""
        looked_at = 0
        for p in range(len(self.codes)):
            places = self.popped(p, limits[p])
            if not len(places):
                continue
            looked_at += len(places)
            rows = self.order[p, places].astype(np.int64)
            before = self.codes[p, rows].copy()
            codes, best, second = nearest(self.components[rows, p], book[p])
            keys = np.empty(self.order.shape[1])
            keys[self.order[p]] = self.keys[p]
            keys[rows] = _slack(best, second) + limits[p, codes]
            changed = codes != before
            self._count(p, rows[changed], before[changed], -1)
            self._count(p, rows[changed], codes[changed], 1)
            everything = self.codes[p].copy()
            everything[rows] = codes
            self._heapify(p, everything, keys)
        return looked_at

    def errors(self, book: np.ndarray) -> np.ndarray:
        """Squared distances summed over each vector's parts; what no long holds is held at the largest."""
        kind = np.int64 if (2 * max(int(np.abs(self.components.astype(np.int64)).max(initial=0)), int(np.abs(book).max(initial=0)))) ** 2 * self.components[0].size < MOST else object
        total = np.zeros(len(self.components), kind)
        for p in range(len(self.codes)):
            total += ((self.components[:, p].astype(kind) - book[p].astype(kind)[self.codes[p]]) ** 2).sum(axis=1)
        return total if kind is np.int64 else np.array([min(int(v), (1 << 63) - 1) for v in total], np.int64)

    def row(self, ids: pa.Array, labels: pa.Array) -> pa.RecordBatch:
        n = len(ids)
        small = self.components.astype(np.min_scalar_type(min(-1, -int(np.abs(self.components).max(initial=1)) - 1)))
        lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a) for a in (ids, labels)]
        rest = [small, self.codes, self.bounds, self.order, self.keys, self.sums]
        return pa.RecordBatch.from_arrays(
            [*lists, pa.array([self.components.shape[1] * self.components.shape[2]], pa.int32()), pa.array([small.itemsize], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in rest)],
            names=[f.split()[0] for f in BLOCKS.split(", ")],
        )

    @classmethod
    def read(cls, batch: pa.RecordBatch, k: int, parts: int, entries: int) -> Block:
        got = {name: batch.column(name)[k] for name in batch.schema.names}
        n, dimension = len(got["ids"]), got["dimension"].as_py()
        raw = lambda name, kind, *shape: np.frombuffer(got[name].as_buffer(), kind).reshape(shape).copy()
        return cls(
            raw("components", f"i{got['width'].as_py()}", n, parts, dimension // parts), raw("codes", np.uint8, parts, n), raw("bounds", np.int64, parts, entries + 1),
            raw("order", np.uint16, parts, n), raw("keys", np.float64, parts, n), raw("sums", np.int64, parts, entries, dimension // parts + 1, 2),
        )


def _first_pass(kept: DataFrame, book: np.ndarray, dimension: int) -> DataFrame:
    parts = len(book)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels, vectors = (table.column(k).chunk(0) for k in range(3))
        return Block.scanned(scaled(vectors.flatten().to_numpy()).reshape(-1, parts, dimension // parts), book).row(ids, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                if held and sum(b.num_rows for b in held) + batch.num_rows > BLOCK_ROWS:
                    yield block(held)
                    held = []
                held.append(batch)
        if held and held[0].num_rows:
            yield block(held)

    return kept.select("vec_id", "label", "vector").mapInArrow(run, BLOCKS)


def _next_pass(blocks: DataFrame, book: np.ndarray, limits: np.ndarray) -> DataFrame:
    parts, entries = book.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.read(batch, k, parts, entries)
                block.moved(book, limits)
                yield block.row(batch.column("ids")[k].values, batch.column("labels")[k].values)

    return blocks.mapInArrow(run, BLOCKS)


def _sums(blocks: DataFrame, shape: tuple[int, ...]) -> list[tuple[int, int]]:
    """For each place of each entry its sum and, at place 0, how many parts it has: as many rows as the codebooks have numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(np.prod(shape)) * 2, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.frombuffer(packed.as_buffer(), np.int64)
        places = np.flatnonzero(total.reshape(-1, 2).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[2 * places]), pa.array(total[2 * places + 1])], names=["place", "high", "low"])

    rows = blocks.select("sums").mapInArrow(run, "place long, high long, low long").groupBy("place").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    found = {r["place"]: (r["high"], r["low"]) for r in rows}
    return [found.get(k, (0, 0)) for k in range(int(np.prod(shape)))]


def _updated(book: np.ndarray, sums: list[tuple[int, int]]) -> np.ndarray:
    """Every entry the floor of its parts' mean; an entry without parts stays."""
    parts, entries, width = book.shape
    new = book.copy()
    for p in range(parts):
        for j in range(entries):
            at = (p * entries + j) * (width + 1)
            count = sums[at][1]
            if count:
                new[p, j] = [((high << 31) + low) // count for high, low in sums[at + 1 : at + 1 + width]]
    return new


def _drift(book: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each entry its own drift and the largest one of another entry, added."""
    apart = book.astype(object) - new.astype(object)
    own = np.sqrt((apart**2).sum(axis=2).astype(np.float64))
    if own.shape[1] == 1:
        return own
    top = np.sort(own, axis=1)
    return own + np.where(np.arange(own.shape[1]) == own.argmax(axis=1)[:, None], top[:, -2:-1], top[:, -1:])


def _coded(blocks: DataFrame, book: np.ndarray, limits: np.ndarray) -> DataFrame:
    parts, entries = book.shape[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = Block.read(batch, k, parts, entries)
                block.moved(book, limits)
                said, step = np.ascontiguousarray(block.codes.T).tobytes().hex(), 2 * parts
                codes = pa.array([said[at : at + step] for at in range(0, len(said), step)], pa.string())
                columns = [batch.column("ids")[k].values, batch.column("labels")[k].values, codes, pa.array(block.errors(book))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, "vec_id long, label string, code string, error long")


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """A row for each kept row of ``vectors`` (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or empty, hold null or non-finite components, or have another length than the
    vector with the smallest vec_id are dropped. The codebooks start with the vectors of the smallest
    vec_ids (null ones come last, equal ones by their vectors); with fewer vectors than ``entries`` they
    are shorter. Components beyond 2**62 after scaling are held there, errors at the largest long.
    Repeated rows count as often as they stand there. An empty table gives no rows; a length that
    ``parts`` doesn't divide is an error; other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    bounded_bytes(vectors.sparkSession)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector")).where(finite(F.col("vector")))

    def seeds(rows: DataFrame) -> list[list[float]]:
        return [list(r["vector"]) for r in rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()]

    first = seeds(kept.select("vec_id", "vector"))
    if not first:
        return kept.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    dimension = len(first[0])
    if dimension % parts:
        raise ValueError(f"{parts} parts don't divide {dimension} components")
    kept = kept.where(F.size("vector") == dimension)
    if any(len(v) != dimension for v in first):
        first = seeds(kept.select("vec_id", "vector"))

    book = np.ascontiguousarray(scaled(np.array(first)).reshape(len(first), parts, -1).transpose(1, 0, 2))
    limits = np.zeros(book.shape[:2])
    blocks = checkpointed(_first_pass(kept, book, dimension))
    for k in range(rounds):
        new = _updated(book, _sums(blocks, (*book.shape[:2], book.shape[2] + 1)))
        limits, book = limits + _drift(book, new), new
        if k + 1 < rounds:
            blocks = checkpointed(_next_pass(blocks, book, limits))
    coded = checkpointed(_coded(blocks, book, limits))

    said = hashlib.sha256(",".join(str(int(v)) for v in book.ravel()).encode()).hexdigest()
    largest = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    totals = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")).cast("decimal(38,0)"), largest).cast("long").alias("label_error"))
    totals = checkpointed(totals.withColumnRenamed("label", "of_label"))
    told = F.broadcast(totals) if totals.count() <= FEW_LABELS else totals
    return coded.join(told, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
