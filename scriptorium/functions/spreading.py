"""Dealing tables over tasks: a small one over all cores, a large one into parts that stay small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in one part; a task holds up to about a hundred times that in the sorts of a long chain of windows.
PART_BYTES = 4_000_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` in as many partitions as the cluster has cores, if a few files gave fewer; else as they are.

    One small file is one task, however much work its texts are. A large table has more partitions than
    cores and isn't moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def dealt(rows: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``rows`` dealt by key into parts whose number grows with the texts, so that what a task holds doesn't.

    The texts are measured first. There are never fewer parts than the session's shuffles have.
    """
    size = rows.agg(F.sum(F.octet_length(text)).alias("size")).first()["size"] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-size // part_bytes)), key)
