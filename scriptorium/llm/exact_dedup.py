"""Exact deduplication by a log-structured merge index of text digests.

Each input partition is a memtable: it is sorted by digest and flushed as one run, a Parquet file
with minimum, maximum and a Bloom filter on the digest. Compaction merges all runs into one entry a
digest with the identifier that stays and the number of rows. Rows whose digest has several entries
are hits; a bitmap of the hit digests, of bounded size, picks them out of a second scan, and their
bytes are compared: the hits are grouped by digest and whole text. Rows that agree in the digest but
not in the bytes become groups of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import kept_by, shared_path, text_of


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _digest_hash() -> Column:
    return F.xxhash64("digest").bitwiseAND(F.lit((1 << 63) - 1))


@dataclass
class DigestIndex:
    """An index over one or more flushed batches; ``keep`` is ``"smallest"`` or ``"largest"``."""

    spark: object
    path: str
    keep: str = "smallest"
    batches: int = 0

    @property
    def runs(self) -> DataFrame:
        """The flushed entries: digest, doc_id, entry (its number within a batch)."""
        return self.spark.read.parquet(*[f"{self.path}/level0/batch={k}" for k in range(self.batches)])

    @property
    def compacted(self) -> DataFrame:
        """One entry a digest: digest, keep_id, keep_entry, group_size."""
        return self.spark.read.parquet(f"{self.path}/level1")

    def flush(self, docs: DataFrame) -> None:
        """Sort every partition's digests and write them as a run; no row moves between tasks."""
        (
            docs.select(_digest(text_of()).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"))
            .withColumn("entry", F.monotonically_increasing_id() * 1024 + F.lit(self.batches))
            .sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .parquet(f"{self.path}/level0/batch={self.batches}")
        )
        self.batches += 1

    def compact(self) -> None:
        """Merge the runs; partial aggregation leaves one entry a digest and task before the shuffle."""
        pick = F.max if self.keep == "largest" else F.min
        order = F.struct("doc_id", (-F.col("entry") if self.keep == "largest" else F.col("entry")).alias("entry"))
        (
            self.runs.groupBy("digest")
            .agg(pick(order).alias("kept"), F.count("*").alias("group_size"))
            .select("digest", F.col("kept.doc_id").alias("keep_id"), F.abs("kept.entry").alias("keep_entry"), "group_size")
            .sortWithinPartitions("digest")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .parquet(f"{self.path}/level1")
        )

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Point lookup of a bounded list; Parquet's Bloom filters and ranges skip the other row groups."""
        return self.compacted.where(F.col("digest").isin([bytearray(d) for d in digests]))

    @property
    def hits(self) -> DataFrame:
        return self.compacted.where("group_size > 1")

    def split(self, docs: DataFrame) -> DataFrame:
        """``docs`` with digest and ``maybe``: false for rows that surely have no equal."""
        return kept_by(docs.withColumn("digest", _digest(text_of())), self.hits, self.hits.count(), _digest_hash(), _digest_hash())

    def collided(self, docs: DataFrame) -> DataFrame:
        """Byte verification: digests under which the hits hold more than one text."""
        verified = self.split(docs.select("doc_id", "text")).where("maybe").select("digest", text_of().alias("bytes"))
        ends = verified.groupBy("digest").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most"))
        return ends.where("least <> most").select("digest")


def build_index(docs: DataFrame, keep: str = "smallest") -> DigestIndex:
    index = DigestIndex(docs.sparkSession, shared_path(docs.sparkSession, "digests"), keep)
    index.flush(docs)
    index.compact()
    return index


def _by_bytes(docs: DataFrame, collided: DataFrame, keep: str) -> DataFrame:
    """Groups of the collided digests by whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("bytes"), _digest(text_of()).alias("digest"))
    rows = rows.join(collided, "digest", "left_semi")
    pick = F.max if keep == "largest" else F.min
    groups = rows.groupBy("digest", "bytes").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, ["digest", "bytes"]).select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def exact_groups(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty, so nulls and empty texts are one group. Of repeated rows with the
    same identifier and text one is kept. A null identifier is smaller than any other. An empty table
    gives no rows; other columns are ignored.
    """
    index = build_index(docs, keep)
    found = index.runs.join(index.compacted, "digest").select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("entry") == F.col("keep_entry")).alias("kept")
    )
    collided = index.collided(docs)
    if not collided.isEmpty():
        found = found.join(collided, "digest", "left_anti").unionByName(_by_bytes(docs, collided, keep))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Rows without an equal pass without a shuffle; only hits are joined to the index.
    """
    index = build_index(docs, keep)
    collided = index.collided(docs)
    marked = index.split(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    alone = marked.where("not maybe").select("row.*")
    hits = marked.where("maybe").select("row", "digest", F.col("doc_id").cast("long").alias("doc_id"))
    if not collided.isEmpty():
        clash = hits.join(collided, "digest", "left_semi")
        hits = hits.join(collided, "digest", "left_anti")
        pick = F.max if keep == "largest" else F.min
        first = clash.groupBy("digest", text_of("row.text").alias("bytes")).agg(pick("doc_id").alias("keep_id"))
        clash = clash.withColumn("bytes", text_of("row.text")).join(first, ["digest", "bytes"]).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        alone = alone.unionByName(clash.dropDuplicates(["digest", "bytes"]).select("row.*"))
    kept = hits.join(index.compacted.select("digest", "keep_id"), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return alone.unionByName(kept.dropDuplicates(["digest"]).select("row.*"))
