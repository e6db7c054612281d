"""Date ranges as month numbers (12 * year + month), and gaps, overlaps and order over them.

``as_of`` stands for today; nothing here reads a clock. A bare year is read as widely as it can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.patterns import every, has, java
from scriptorium.functions.vocabulary import CHRONOLOGY_MARGIN_MONTHS, GAP_MONTHS, MONTH_LABELS, MONTH_NUMBERS
from scriptorium.operators.lines import running


def month_index(year: Column, month: Column | int) -> Column:
    return (year * 12 + month).cast("int")


def month_label(index: Column, language: str = "en") -> Column:
    names = F.array(*[F.lit(n) for n in MONTH_LABELS.get(language, MONTH_LABELS["en"])])
    return F.concat(F.get(names, F.pmod(index - 1, F.lit(12)).cast("int")), F.lit(" "), F.floor((index - 1) / 12).cast("string"))


#: A word where a month stands and the year after it; a ratio from which the word is taken for a month.
BEFORE_YEAR, MONTH_RATIO = r"\b([A-Za-z0-9]{3,4})\.?\s+((?:19|20)\d{2})\b", 0.6


def month_typos(docs: DataFrame) -> DataFrame:
    """doc_id, pos, written, meant: words before a year that are one letter from a month's name.

    Known months and plain numbers are none. Names of as many letters are compared, of several alike the
    first in the list's order counts. Distinct words are compared once. A null text has none.
    """
    from scriptorium.operators.headings import similarity

    part = lambda k: F.regexp_extract("written", java(BEFORE_YEAR), k)
    rows = docs.where(has(F.col("text"), r"(?:19|20)\d{2}", False)).select("doc_id", F.posexplode(every(F.col("text"), BEFORE_YEAR, False)).alias("pos", "written"))
    rows = rows.select("doc_id", "pos", "written", F.lower(part(1)).alias("word"), part(2).alias("year"))
    rows = rows.where(~F.col("word").rlike(r"^\d+$") & ~F.col("word").isin(list(MONTH_NUMBERS)))
    listed = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name")) for k, name in enumerate(MONTH_NUMBERS)])
    near = rows.select("word").distinct().select("word", F.explode(listed).alias("m")).where(F.char_length("word") == F.char_length("m.name")).select("word", "m.ord", "m.name")
    near = near.where(similarity("word", "name") >= MONTH_RATIO).groupBy("word").agg(F.min_by("name", "ord").alias("name"))
    return rows.join(near, "word").select("doc_id", "pos", "written", F.concat(F.initcap("name"), F.lit(" "), "year").alias("meant"))


def endpoint(token: Column, is_end: bool, as_of: str) -> Column:
    """STRUCT<index, explicit> of one end of a range; a null index where it can't be read."""
    day = F.lit(as_of).cast("date")
    months = F.create_map(*[F.lit(x) for pair in MONTH_NUMBERS.items() for x in pair])
    text, widest = F.trim(token), 12 if is_end else 1
    numeric, named = r"^(\d{1,2})\s*[./]\s*((?:19|20)\d{2})$", r"^([A-Za-zÀ-ÖØ-öø-ÿ0-9]{3,9})\.?[,/-]?\s*((?:19|20)\d{2})$"
    part = lambda pattern, group: F.regexp_extract(text, pattern, group)
    known = F.try_element_at(months, F.lower(part(named, 1)))
    made = lambda index, explicit: F.struct(index.cast("int").alias("index"), explicit.alias("explicit"))
    return (
        F.when(has(text, rf"^(?:{P.PRESENT})$"), made(month_index(F.year(day), F.month(day)), F.lit(True)))
        .when(text.rlike(numeric), made(month_index(part(numeric, 2).cast("int"), part(numeric, 1).cast("int")), F.lit(True)))
        .when(text.rlike(named), made(month_index(part(named, 2).cast("int"), F.coalesce(known, F.lit(widest))), known.isNotNull()))
        .when(text.rlike(r"^(?:19|20)\d{2}$"), made(month_index(text.cast("int"), widest), F.lit(False)))
    )


def ranges_of(lines: DataFrame, as_of: str, column: str = "line") -> DataFrame:
    """``lines`` joined to their ranges: raw, pos, s, e, months_explicit; unreadable and reversed ones are left out."""
    rows = lines.where(F.col(column).rlike(r"(?:19|20)\d{2}")).select("*", F.posexplode(every(F.col(column), P.RANGE)).alias("pos", "raw"))
    part = lambda k: F.regexp_extract("raw", java(P.RANGE, True), k)
    day = F.lit(as_of).cast("date")
    now = F.struct(month_index(F.year(day), F.month(day)).alias("index"), F.lit(True).alias("explicit"))
    rows = rows.withColumn("a", F.when(part(1) != "", endpoint(part(1), False, as_of)).otherwise(endpoint(part(2), False, as_of)))
    rows = rows.withColumn("b", F.when(part(1) != "", now).otherwise(endpoint(part(3), True, as_of)))
    rows = rows.where("a.index IS NOT NULL AND b.index IS NOT NULL AND b.index >= a.index")
    return rows.select("*", F.col("a.index").alias("s"), F.col("b.index").alias("e"), (F.col("a.explicit") & F.col("b.explicit")).alias("months_explicit")).drop("a", "b").withColumn("raw", F.trim("raw"))


def join_split_ranges(lines: DataFrame) -> DataFrame:
    """Two lines that hold one end each become one line with the range, from the top on.

    Runs of such lines are islands; in each the odd ones take their successor.
    """
    window = Window.partitionBy("doc_id").orderBy("line_no")
    bare = F.regexp_extract("line", java(rf"^\s*({P.ENDPOINT})\s*$"), 1)
    rows = lines.withColumn("bare", F.when(bare != "", bare))
    rows = rows.withColumn("island", running(F.col("bare").isNull(), window))
    order = Window.partitionBy("doc_id", "island", F.col("bare").isNull()).orderBy("line_no")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("bare").over(order))
    first = F.col("bare").isNotNull() & (F.col("n") % 2 == 1) & F.col("next").isNotNull()
    second = F.col("bare").isNotNull() & (F.col("n") % 2 == 0)
    return rows.withColumn("line", F.when(first, F.concat_ws(" - ", "bare", "next")).otherwise(F.col("line"))).where(~second).drop("bare", "island", "n", "next")


def _neighbours(ranges: DataFrame, *keys: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("s", "e", "raw")
    return ranges.select("*", F.lead("s").over(window).alias("next_s"), F.lead("e").over(window).alias("next_e"), F.lead("raw").over(window).alias("next_raw"), F.lead("months_explicit").over(window).alias("next_explicit"))


def findings(ranges: DataFrame, *keys: str) -> DataFrame:
    """keys, kind (gap or overlap), first, second, months between neighbours in order of their starts."""
    rows = _neighbours(ranges, *keys)
    nested = "((s <= next_s AND next_e <= e) OR (next_s <= s AND e <= next_e))"
    overlap = rows.where(f"e > next_s AND NOT {nested} AND months_explicit AND next_explicit").withColumn("kind", F.lit("overlap")).withColumn("months", F.lit(None).cast("int"))
    gap = rows.where(F.col("next_s") - F.col("e") > GAP_MONTHS).withColumn("kind", F.lit("gap")).withColumn("months", F.col("next_s") - F.col("e"))
    return overlap.unionByName(gap).select(*keys, "kind", F.col("raw").alias("first"), F.col("next_raw").alias("second"), "months")


def uncovered_runs(ranges: DataFrame) -> DataFrame:
    """doc_id, section, first, second, unexplained: the longest part of a gap that no other section's range covers.

    Ranges that stand in the gap's own section are left out by their text. A range join clips the others
    to the gap; a running maximum of their ends finds the holes.
    """
    gaps = _neighbours(ranges, "doc_id", "section").where(F.col("next_s") - F.col("e") > GAP_MONTHS)
    gaps = gaps.select("doc_id", "section", F.col("raw").alias("first"), F.col("next_raw").alias("second"), F.col("e").alias("from"), F.col("next_s").alias("to"))
    own = ranges.groupBy("doc_id", "section").agg(F.collect_set("raw").alias("own"))
    others = ranges.select("doc_id", F.col("raw").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"))
    clipped = (
        gaps.join(own, ["doc_id", "section"]).join(others, "doc_id").where("os < `to` AND oe > `from` AND NOT array_contains(own, other)")
        .select("doc_id", "section", "first", "second", F.greatest("from", "os").alias("cs"), F.least("to", "oe").alias("ce"))
    )
    ends = [gaps.select("doc_id", "section", "first", "second", F.col(c).alias("cs"), F.col(c).alias("ce")) for c in ("from", "to")]
    window = Window.partitionBy("doc_id", "section", "first", "second").orderBy("cs", "ce").rowsBetween(Window.unboundedPreceding, -1)
    held = clipped.unionByName(ends[0]).unionByName(ends[1]).withColumn("before", F.max("ce").over(window))
    runs = held.groupBy("doc_id", "section", "first", "second").agg(F.max(F.col("cs") - F.col("before")).alias("unexplained"))
    return runs.where(F.col("unexplained") >= GAP_MONTHS)


def merge_ranges(ranges: DataFrame, extra: DataFrame) -> DataFrame:
    """doc_id, merged: found ranges, then each extra one that neither holds nor is held by one accepted before.

    Acceptance depends on what was accepted, so it is a fold over each document's candidates.
    """
    held = lambda name: F.array_sort(F.collect_list(F.struct("s", "e", "raw"))).alias(name)
    both = ranges.groupBy("doc_id").agg(held("found")).join(extra.groupBy("doc_id").agg(held("candidates")), "doc_id", "full")
    empty = F.array().cast("array<struct<s:int,e:int,raw:string>>")
    fold = F.aggregate(
        F.coalesce("candidates", empty), F.coalesce("found", empty),
        lambda kept, c: F.when(F.exists(kept, lambda k: k["raw"].contains(c["raw"]) | c["raw"].contains(k["raw"])), kept).otherwise(F.array_append(kept, c)),
    )
    return both.select("doc_id", F.array_sort(fold).alias("merged"))


def chronology_breaks(entries: DataFrame) -> DataFrame:
    """doc_id, section, earlier, later: the first pair of entries whose lower one is newer at both ends."""
    window = Window.partitionBy("doc_id", "section").orderBy("entry_no")
    rows = entries.select("*", F.lead("s").over(window).alias("ns"), F.lead("e").over(window).alias("ne"), F.lead("raw").over(window).alias("nraw"))
    broken = rows.where((F.col("ne") - F.col("e") >= CHRONOLOGY_MARGIN_MONTHS) & (F.col("ns") - F.col("s") >= CHRONOLOGY_MARGIN_MONTHS))
    return broken.groupBy("doc_id", "section").agg(F.min_by("raw", "entry_no").alias("earlier"), F.min_by("nraw", "entry_no").alias("later"))


def event_gaps(events: DataFrame, hours: int) -> DataFrame:
    """The gap operator on event times: user_id, gaps longer than ``hours``, longest gap in seconds."""
    window = Window.partitionBy("user_id").orderBy("ts", "event_id")
    waited = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(window))
    return events.withColumn("waited", waited).groupBy("user_id").agg(F.count_if(F.col("waited") > hours * 3600).alias("gaps"), F.max("waited").alias("longest_seconds"))
