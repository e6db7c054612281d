"""Positive selection of a CV's content, and whether a name in the body is a person's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.patterns import has
from scriptorium.operators.lines import current
from scriptorium.operators.redaction import is_phone

PROSE_LINE_WORDS, PROSE_WORDS, MIN_SECTIONS, MIN_SHARE = 10, 25, 2, 0.55
INSTITUTION = r"\b(?:universit(?:y|ä|a)t?\w*|hochschule|school|schule|institute?|institut|gymnasium|college|akademie|academy|faculty|fakultät)\b"
TITLE_BEFORE = r"(?:dr|prof|professor|herr|frau|mr|mrs|ms|miss)\.?\s*$"


def select_content(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, text, applied, dropped_lines, sections: the text from the first heading on, where that can be trusted.

    It can't with fewer than two headings, with a header that holds a date range or prose, or where less
    than 55 % of the lines would stay.
    """
    own = Window.partitionBy("doc_id")
    marks = headings.select("doc_id", "line_no", F.lit(1).alias("mark"))
    rows = lines.join(marks, ["doc_id", "line_no"], "left")
    rows = rows.withColumn("first", F.min(F.when(F.col("mark") == 1, F.col("line_no"))).over(own))
    words = F.when(F.trim("line") == "", 0).otherwise(F.size(F.split(F.trim("line"), r"(?U)\s+")))
    rows = rows.withColumn("words", words).withColumn("real", F.trim("line") != "").withColumn("head", F.coalesce(F.col("line_no") < F.col("first"), F.lit(False)))
    top = F.min(F.when(F.col("real"), F.col("line_no"))).over(own)
    rows = rows.withColumn("later", F.col("head") & (F.col("line_no") > top))
    ordered = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    found = rows.groupBy("doc_id").agg(
        F.count("mark").alias("sections"), ordered(F.lit(True)).alias("whole"), ordered(~F.col("head")).alias("kept"),
        F.bool_or(F.col("head") & P.has_range(F.col("line"))).alias("dated"), F.max(F.when(F.col("head"), F.col("words")).otherwise(0)).alias("longest"),
        F.sum(F.when(F.col("later"), F.col("words")).otherwise(0)).alias("later_words"), F.count_if("real").alias("real"), F.count_if(F.col("real") & ~F.col("head")).alias("left"),
    )
    content = F.col("dated") | (F.col("longest") >= PROSE_LINE_WORDS) | (F.col("later_words") >= PROSE_WORDS)
    applied = (F.col("sections") >= MIN_SECTIONS) & ~content & (F.col("real") > 0) & (F.col("left") >= MIN_SHARE * F.col("real"))
    return found.select("doc_id", F.when(applied, F.col("kept")).otherwise(F.col("whole")).alias("text"), applied.alias("applied"), F.when(applied, F.col("real") - F.col("left")).otherwise(0).alias("dropped_lines"), "sections")


def corroborated(names: DataFrame, lines: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, name, person, institution_only of candidate names (doc_id, name).

    A name is a person's if a line with it stands under references, has a title right before it, or has an
    address or number beside it; it is an institution's if every line with it names one.
    """
    marks = headings.select("doc_id", "line_no", "display")
    rows = lines.join(marks, ["doc_id", "line_no"], "left").withColumn("under", current("display"))
    rows = rows.join(names, "doc_id").where(F.col("line").contains(F.col("name")))
    before = F.expr("substring(line, 1, instr(line, name) - 1)")
    number = F.exists(P.every(F.col("line"), P.PHONE), lambda m: is_phone(m, F.col("line")))
    beside = F.col("line").rlike(r"@|\[EMAIL REDACTED\]|\[PHONE REDACTED\]") | number
    person = F.coalesce(F.col("under") == "References", F.lit(False)) | has(before, TITLE_BEFORE) | beside
    found = rows.groupBy("doc_id", "name").agg(F.bool_or(person).alias("person"), F.bool_and(has(F.col("line"), INSTITUTION)).alias("institution_only"))
    return names.join(found, ["doc_id", "name"], "left").select("doc_id", "name", F.coalesce("person", F.lit(False)).alias("person"), F.coalesce("institution_only", F.lit(False)).alias("institution_only"))
