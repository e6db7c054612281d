"""Entries of a section: a dated line, its title, its bullets and its description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.patterns import has, swap
from scriptorium.operators.lines import running

MAX_TITLE_CHARS, MIN_INDENTED_CHARS = 100, 25


def by_section() -> WindowSpec:
    return Window.partitionBy("doc_id", "section").orderBy("line_no")


def is_bullet(line: Column) -> Column:
    """No date range, and a mark before it, a bullet inside it, or an indented long line."""
    marked = has(line, P.BULLET_LINE, False) | has(line, P.INLINE_BULLET, False)
    return ~P.has_range(line) & (marked | (line.rlike(P.INDENTED_LINE) & (F.char_length(F.trim(line)) > MIN_INDENTED_CHARS)))


def bullet_text(line: Column) -> Column:
    return F.trim(F.regexp_replace(swap(F.trim(line), r"^\s*o\s+(?=[A-ZÄÖÜ])", "", False), f"^[{P.BULLETS[0]}\\{P.BULLETS[1:]} ]+".replace("[-\\", "[\\-"), ""))


def is_anchor(line: Column) -> Column:
    return (P.has_range(line) | has(line, P.DATE_END, False)) & ~is_bullet(line) & (F.trim(line) != "")


def title_shaped(line: Column) -> Column:
    """Whether a line doesn't begin with a small letter, as wrapped text does."""
    return (F.trim(line) != "") & ~F.trim(line).rlike(r"^\p{Ll}")


def entries_of(lines: DataFrame) -> DataFrame:
    """doc_id, section, entry_no, line_no, line, title_line, bullets, description, stacked_with_next.

    ``lines`` (doc_id, section, line_no, line) are a section's body. The title of a dated line is, in
    order: below a line of dates alone, the next line of the two below; a title-shaped undated line
    right below; a title-shaped undated line, else a dated one, of the two above.
    """
    at = lambda k: F.coalesce(F.trim(F.lead("line", k).over(by_section()) if k > 0 else F.lag("line", -k).over(by_section())), F.lit(""))
    rows = lines.select("doc_id", "section", "line_no", "line", is_anchor(F.col("line")).alias("anchor"), is_bullet(F.col("line")).alias("bullet"), *[at(k).alias(f"n{k}" if k > 0 else f"p{-k}") for k in (1, 2, -1, -2)])
    usable = lambda c: (F.col(c) != "") & ~is_bullet(F.col(c))
    dates_alone = F.trim(swap(F.col("line"), P.RANGE, ""), F.lit(" \t,|–—-")) == ""
    undated = lambda c: usable(c) & ~P.has_range(F.col(c))
    below = usable("n1") & ~is_anchor(F.col("n1")) & title_shaped(F.col("n1")) & (F.char_length("n1") <= MAX_TITLE_CHARS) & ~F.col("n1").endswith(".")
    above = lambda c: usable(c) & ~is_anchor(F.col(c)) & title_shaped(F.col(c))
    title = F.coalesce(
        F.when(dates_alone & undated("n1"), F.col("n1")), F.when(dates_alone & undated("n2"), F.col("n2")), F.when(below, F.col("n1")),
        F.when(above("p1"), F.col("p1")), F.when(above("p2"), F.col("p2")),
        F.when(usable("p1") & P.has_range(F.col("p1")), F.col("p1")), F.when(usable("p2") & P.has_range(F.col("p2")), F.col("p2")), F.lit(""),
    )
    rows = rows.withColumn("title", F.when(F.col("anchor"), title)).withColumn("entry_no", running(F.col("anchor"), by_section()) - 1).where("entry_no >= 0")
    own = Window.partitionBy("doc_id", "section", "entry_no")
    rows = rows.withColumn("title_line", F.max("title").over(own))
    ordered = lambda flag, value: F.transform(F.array_sort(F.collect_list(F.when(flag, F.struct("line_no", value.alias("v"))))), lambda x: x["v"])
    described = ~F.col("anchor") & ~F.col("bullet") & (F.trim("line") != "") & (F.trim("line") != F.col("title_line"))
    found = rows.groupBy("doc_id", "section", "entry_no").agg(
        F.max(F.when(F.col("anchor"), F.col("line_no"))).alias("line_no"), F.trim(F.max(F.when(F.col("anchor"), F.col("line")))).alias("line"),
        F.max("title_line").alias("title_line"), ordered(F.col("bullet"), bullet_text(F.col("line"))).alias("bullets"), ordered(described, F.trim("line")).alias("description"),
    )
    following = F.lead("line_no").over(Window.partitionBy("doc_id", "section").orderBy("entry_no"))
    return found.withColumn("stacked_with_next", F.coalesce(following == F.col("line_no") + 1, F.lit(False)))
