"""Documents as ordered lines, and the ordered-line operators built on them.

All windows are per document; a document's lines are what one task sees, never a table's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scriptorium.functions.patterns import unified_lines
from scriptorium.functions.vocabulary import MIN_MARKER_USES

def by_line() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("line_no")


def split_lines(text: Column) -> Column:
    return F.split(unified_lines(text), "\n")


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line; an empty or null text has one empty line."""
    return docs.select("doc_id", F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def text_of(lines: DataFrame, line: str = "line") -> DataFrame:
    """doc_id, text: lines joined in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.col(line).alias("line"))))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def current(column: str, window: WindowSpec | None = None) -> Column:
    """As-of: the last non-null value at or above the line."""
    return F.last(column, ignorenulls=True).over((window or by_line()).rowsBetween(Window.unboundedPreceding, 0))


def running(flag: Column, window: WindowSpec | None = None) -> Column:
    """How many flagged lines there are up to and with this one."""
    return F.sum(flag.cast("int")).over((window or by_line()).rowsBetween(Window.unboundedPreceding, 0))


def learned_markers(lines: DataFrame, uses: int = MIN_MARKER_USES) -> DataFrame:
    """doc_id, marker, uses: signs before a blank that open at least ``uses`` lines of a document."""
    mark = F.regexp_extract("line", r"(?U)^\s*([^\w\s])[\s\x{A0}]+\S", 1)
    found = lines.select("doc_id", mark.alias("marker")).where("marker <> ''").groupBy("doc_id", "marker").agg(F.count("*").alias("uses"))
    return found.where(F.col("uses") >= uses)


def with_plain_bullets(lines: DataFrame, uses: int = MIN_MARKER_USES) -> DataFrame:
    """Learned markers rewritten to a hyphen."""
    own = learned_markers(lines, uses).groupBy("doc_id").agg(F.collect_set("marker").alias("markers"))
    mark = F.regexp_extract("line", r"(?U)^\s*([^\w\s])[\s\x{A0}]+\S", 1)
    plain = F.regexp_replace("line", r"(?U)^(\s*)[^\w\s]([\s\x{A0}]+\S)", "$1-$2")
    return lines.join(own, "doc_id", "left").withColumn("line", F.when(F.array_contains("markers", mark), plain).otherwise(F.col("line"))).drop("markers")


def private_use_stripped(lines: DataFrame) -> DataFrame:
    """Lines without icon-font characters; ``had_icon`` marks the lines that lost one."""
    from scriptorium.functions.patterns import PRIVATE_USE

    clean = F.regexp_replace("line", PRIVATE_USE, "")
    return lines.withColumn("had_icon", clean != F.col("line")).withColumn("line", F.when(clean != F.col("line"), F.ltrim(F.regexp_replace(clean, r"^[ \t\x{A0}]+", ""))).otherwise(F.col("line")))
