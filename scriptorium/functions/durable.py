"""Cutting long plans on storage that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in a local session that configures none."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='scriptorium-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir() or found
    return found


def checkpointed(rows: DataFrame, stays_dealt: bool = False) -> DataFrame:
    """Materialise once in the shared folder; lost executors don't lose it.

    ``stays_dealt``: what reads it knows how ``rows`` are dealt and doesn't deal them again. An adaptive plan
    doesn't tell that, so ``rows`` are planned without; they should have fixed numbers of partitions.
    """
    spark = rows.sparkSession
    shared_dir(spark)
    if not stays_dealt:
        return rows.checkpoint(eager=True)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return rows.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
