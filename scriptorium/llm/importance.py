"""Importance resampling towards a target: hashed word n-grams, their gains, and a weighted draw.

Every n-gram of a text falls into one of a fixed number of buckets, as many as a 16-bit number can name.
One pass over the texts writes the buckets as packed streams with each document's offset. Counting is an
external sort: every block of a stream is sorted and run-length encoded as it is written, and the runs of
all blocks are merged by bucket. What a bucket is worth follows from its share in the raw and in the target
texts. A second pass reads the streams again, gathers the gains and adds them up between offsets. The draw
orders documents by weight plus Gumbel noise from their identifiers, so it can be repeated.

The checksum of an n-gram is composed from those of its words: a checksum is linear in its bits, so
appending so many bytes is a table look-up.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_batches, bounded_bytes, checkpointed, placed, shared_path

BUCKETS, RUNS = 10_000, 3
#: Words whose checksums a task remembers, and words of a block.
CACHE_WORDS, BLOCK_WORDS = 100_000, 400_000
#: Longer words are taken in steps of so many bytes.
STEP = 64
#: A-Z are lowered; all ASCII but digits and letters parts words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
STREAMS = "doc_ids array<bigint>, words array<bigint>, features array<bigint>, stream binary, runs binary, counts binary"


class _Checksums(dict):
    """A word's checksum and, above it, its length."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = zlib.crc32(word) | len(word) << 32
        return found


_checksums = _Checksums()


@cache
def _shifts() -> np.ndarray:
    """What appending 0 to STEP zero bytes makes of a checksum's four bytes: (STEP + 1, 4, 256)."""
    byte = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    table = np.zeros((STEP + 1, 4, 256), np.uint32)
    for k in range(4):
        table[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for length in range(STEP):
        before = table[length]
        table[length + 1] = byte[before & np.uint32(255)] ^ (before >> np.uint32(8))
    return table


def appended(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of byte strings from those of their left parts and of their right parts of the given lengths."""
    table, rest = _shifts(), length
    while len(rest):
        step = np.minimum(rest, STEP)
        left = table[step, 0, left & 255] ^ table[step, 1, left >> 8 & 255] ^ table[step, 2, left >> 16 & 255] ^ table[step, 3, left >> 24]
        rest = rest - step
        if not rest.any():
            break
    return left ^ right


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def bucket_stream(sizes: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of texts of so many words each, text by text, and each text's number of them."""
    sums, lengths = (coded & 0xFFFFFFFF).astype(np.uint32), (coded >> 32).astype(np.int64)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(coded))  # words from here to the text's end
    buckets, there = np.zeros((len(coded), RUNS), np.uint16), np.zeros((len(coded), RUNS), bool)
    so_far, space = sums, np.uint32(zlib.crc32(b" "))
    for k in range(RUNS):
        if k:
            at = np.arange(len(coded) - k) if len(coded) > k else np.zeros(0, np.int64)
            one = np.ones(len(at), np.int64)
            so_far = appended(appended(so_far[at], np.full(len(at), space, np.uint32), one), sums[at + k], lengths[at + k])
        buckets[: len(so_far), k] = so_far % np.uint32(BUCKETS)
        there[:, k] = left > k
    return buckets[there], sum(np.maximum(sizes - k, 0) for k in range(RUNS))


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stream sorted and run-length encoded."""
    ordered = np.sort(stream)
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return ordered[begin], np.diff(np.r_[begin, len(ordered)])


def write_streams(texts: DataFrame, name: str) -> DataFrame:
    """The streams of (doc_id, text) as a table in the shared folder; a row for each block."""

    def row(ids: list[int | None], sizes: list[int], coded: list[np.ndarray]) -> pa.RecordBatch:
        size = np.array(sizes, np.int64)
        stream, features = bucket_stream(size, np.concatenate([np.zeros(0, np.uint64), *coded]))
        runs, counts = run_lengths(stream)
        lists = [pa.array([v], pa.list_(pa.int64())) for v in (ids, sizes, features.tolist())]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([a.tobytes()], pa.binary()) for a in (stream, runs, counts.astype(np.uint32)))], names=[f.split()[0] for f in STREAMS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, coded, held = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                ids.append(doc_id)
                sizes.append(len(found))
                coded.append(np.fromiter(map(_checksums.__getitem__, found), np.uint64, len(found)))
                held += len(found)
                if held >= BLOCK_WORDS or len(ids) >= BLOCK_WORDS:
                    yield row(ids, sizes, coded)
                    ids, sizes, coded, held = [], [], [], 0
        if ids:
            yield row(ids, sizes, coded)
        _checksums.clear()

    bounded_batches(texts.sparkSession)
    bounded_bytes(texts.sparkSession)
    path = shared_path(texts.sparkSession, name)
    texts.mapInArrow(run, STREAMS).write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(STREAMS).parquet(path)


def bucket_counts(streams: DataFrame) -> np.ndarray:
    """How often each bucket is in the streams: the blocks' runs merged; the driver sees a number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for runs, counts in zip(batch.column(0), batch.column(1), strict=True):
                total[np.frombuffer(runs.as_buffer(), np.uint16)] += np.frombuffer(counts.as_buffer(), np.uint32)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "count"])

    merged = streams.select("runs", "counts").mapInArrow(run, "bucket long, count long").groupBy("bucket").agg(F.sum("count").alias("count"))
    total = np.zeros(BUCKETS, np.int64)
    for r in merged.collect():
        total[r["bucket"]] = r["count"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of each bucket's smoothed share in the target over that in the raw texts, floored."""
    everything, wanted = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (everything + BUCKETS) / ((s + 1) * (wanted + BUCKETS)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None) -> int:
    """Gumbel noise times a thousand, floored, from the identifier alone."""
    h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def added_up(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each of consecutive runs of ``values``; an empty run's is 0."""
    begin = np.cumsum(sizes) - sizes
    filled, total = sizes > 0, np.zeros(len(sizes), np.int64)
    if filled.any():
        total[filled] = np.add.reduceat(values, begin[filled])
    return total


def _weighed(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, size, features, stream in zip(*(batch.column(k) for k in range(4)), strict=True):
                n = features.values.to_numpy()
                weight = added_up(gain[np.frombuffer(stream.as_buffer(), np.uint16)], n)
                drawn = weight + np.array([noise(i) for i in ids.values.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, size.values, features.values, pa.array(weight), pa.array(drawn)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return streams.select("doc_ids", "words", "features", "stream").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def importance_sample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): doc_id, n_features, weight, score, rank.

    ``target`` has a column text. Of the documents with at least ``least_words`` words, ``percent`` in a
    hundred are drawn, rounded down; rank counts them by falling score, then by doc_id (null ones last),
    number of features and weight. A null text has no words; a document without features weighs nothing
    and gets noise alone. The noise of a null identifier is that of an empty one. Repeated rows count and
    are drawn each for themselves. An empty ``docs`` gives no rows; an empty target is smoothing alone;
    other columns are ignored.
    """
    raw = write_streams(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "raw-stream")
    wanted = write_streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), "target-stream")
    gain = gains(bucket_counts(raw), bucket_counts(wanted))
    scored = checkpointed(_weighed(raw, gain))
    eligible = F.col("n_words") >= least_words
    draw = percent * scored.where(eligible).count() // 100
    in_order = placed(scored, F.when(eligible, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    return in_order.select("doc_id", "n_features", "weight", "score", F.when(eligible & (F.col("place") < draw), F.col("place") + 1).alias("rank"))
