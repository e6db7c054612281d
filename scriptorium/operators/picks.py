"""Suggestions from a catalogue, by priority: weak sections, then the target role, then general ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 5
#: General options are written into the plan; more than so many are refused.
MAX_GENERAL = 1000
#: A name counts as shown in a document by its part before one of these, if that has more letters than this.
NAME_END, LEAST_CHARS = r"[(/\-–]", 4


def picks(docs: DataFrame, weak: DataFrame, catalogue: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n, name: at most ``limit`` options a document.

    ``docs`` (doc_id, text, role), ``weak`` (doc_id, section, rank: weakest first), ``catalogue`` (name,
    kind, topic, ord) with kind ``section``, ``role`` or ``general``. All options of a weaker section come
    before those of the next; roles take turns by ``ord``. An option that appears twice keeps its first
    place; options that the document already shows are left out.
    """
    general = catalogue.where("kind = 'general'").groupBy("name").agg(F.min("ord").alias("ord")).limit(MAX_GENERAL + 1).collect()
    if len(general) > MAX_GENERAL:
        raise ValueError(f"more than {MAX_GENERAL} general options")
    listed = F.array(*[F.struct(F.lit(r["ord"]).cast("int").alias("ord"), F.lit(r["name"]).alias("name")) for r in general]) if general else F.array().cast("array<struct<ord:int,name:string>>")
    sections, roles = (catalogue.where(F.col("kind") == kind).select("topic", "ord", "name") for kind in ("section", "role"))
    by_section = weak.join(sections, weak["section"] == sections["topic"]).select("doc_id", F.lit(0).alias("priority"), F.col("rank").alias("first"), F.col("ord").alias("then"), "topic", "name")
    by_role = docs.join(roles, docs["role"] == roles["topic"]).select("doc_id", F.lit(1).alias("priority"), F.col("ord").alias("first"), F.lit(0).alias("then"), "topic", "name")
    always = docs.select("doc_id", F.explode(listed).alias("g")).select("doc_id", F.lit(2).alias("priority"), F.col("g.ord").alias("first"), F.lit(0).alias("then"), F.lit("").alias("topic"), "g.name")
    place = ["priority", "first", "then", "topic", "name"]
    rows = by_section.unionByName(by_role).unionByName(always)
    rows = rows.groupBy("doc_id", "name").agg(F.min(F.struct(*place)).alias("place"))
    rows = rows.join(docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")), "doc_id")
    told = F.lower(F.trim(F.get(F.split("name", NAME_END), F.lit(0))))
    rows = rows.where(~((F.char_length(told) > LEAST_CHARS) & F.col("low").contains(told)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))).where(F.col("n") <= limit).select("doc_id", "n", "name")
