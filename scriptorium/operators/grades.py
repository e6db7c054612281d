"""Grades on a CV: numbers on lines with a grade word, the scale they can be on, and repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.patterns import every, has, java, swap, worked
from scriptorium.functions.vocabulary import ABITUR_AVERAGE, ABITUR_POINTS, PLACES, SCALES, SWISS_CONVENTION, SWISS_FLOOR


def number(token: Column) -> Column:
    return F.replace(token, F.lit(","), F.lit(".")).cast("double")


def country_of(*texts: Column) -> Column:
    """The first country with a place in the first text that has any."""
    tests = []
    for text in texts:
        low = F.lower(text)
        for code, needles in PLACES:
            tests.append(F.when(low.rlike("|".join(n.replace(".", "[.]") for n in needles)), code))
    return F.coalesce(*tests)


def _scale(name: str, low: float, high: float, best_is_low: bool) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(best_is_low).alias("best_is_low"))


def candidate_scales(country: Column, line: Column, context: Column, value: Column) -> Column:
    """Scales that a grade could be on, the likeliest first."""
    german = has(line, P.GERMAN_SCHOOL) | has(context, P.GERMAN_SCHOOL)
    points = has(F.concat_ws(" ", line, context), r"\bpunkte?\b|\bpoints?\b")
    own = F.coalesce(*[F.when(country == code, F.array(_scale(*s))) for code, s in SCALES.items()])
    return (
        F.when(german & points, F.array(_scale(*ABITUR_AVERAGE), _scale(*ABITUR_POINTS)))
        .when(german, F.array(_scale(*ABITUR_AVERAGE)))
        .when((country == "CH") & (value >= 1.0) & (value < SWISS_FLOOR), F.array(_scale(*ABITUR_AVERAGE), _scale(*SCALES["CH"])))
        .otherwise(F.coalesce(own, F.array(*[_scale(*s) for s in SCALES.values()])))
    )


def plausible(value: Column, scales: Column) -> Column:
    return F.exists(scales, lambda s: value.between(s["lo"], s["hi"]))


def repaired(value: Column, scales: Column) -> Column:
    """The value with its decimal point put back, if exactly one place makes it possible."""
    hits = F.filter(F.array(value / 10, value / 100), lambda v: F.exists(scales, lambda s: v.between(s["lo"], s["hi"])))
    return F.when(F.size(hits) == 1, F.bround(F.get(hits, F.lit(0)), 2))


def find_grades(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, pos, raw, value, maximum, country, scale, plausible, suggestion, missing_maximum, reference (the number to print beside it)."""
    words = F.col("line").rlike(r"\p{Nd}") & has(F.col("line"), P.GRADE_STEMS) & has(F.col("line"), P.GRADE_WORDS)
    told = lines.where(words).select("doc_id").distinct()
    asked = worked(lines.join(told, "doc_id"), "_marked", words)  # a semi join would be pushed into the parts of a union
    whole = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]))
    window = Window.partitionBy("doc_id").orderBy("line_no")
    context = F.concat_ws("\n", F.lag("line").over(window), F.col("line"))
    marked = asked.select("doc_id", "line_no", "line", context.alias("context"), "_marked").where("_marked").drop("_marked")
    home = asked.groupBy("doc_id").agg(whole.alias("whole")).select("doc_id", country_of(F.col("whole")).alias("home"))
    rows = marked.join(home, "doc_id")
    scanned = F.regexp_replace(swap(swap(F.col("line"), P.RANGE, " "), P.DATE_IN_LINE, " "), r"\b(?:19|20)\d{2}\b", " ")
    rows = rows.select("*", F.posexplode(every(scanned, P.GRADE_NUMBER, False)).alias("pos", "raw"))
    part = lambda k: F.regexp_extract("raw", java(P.GRADE_NUMBER), k)
    rows = rows.withColumn("value", number(part(1))).withColumn("maximum", F.when(part(2) != "", number(part(2))))
    rows = rows.withColumn("country", F.coalesce(country_of(F.col("line"), F.col("context")), F.col("home")))
    rows = rows.withColumn("scales", candidate_scales(F.col("country"), F.col("line"), F.col("context"), F.col("value")))
    own = F.coalesce(*[F.when(F.col("country") == code, F.lit(low if best_is_low else high)) for code, (_, low, high, best_is_low) in SCALES.items()])
    fits = F.filter("scales", lambda s: F.col("value").between(s["lo"], s["hi"]))
    return rows.select(
        "doc_id", "line_no", "pos", F.trim("raw").alias("raw"), "value", "maximum", "country", F.get(fits, F.lit(0))["name"].alias("scale"),
        (F.size(fits) > 0).alias("plausible"), F.when(F.size(fits) == 0, repaired(F.col("value"), F.col("scales"))).alias("suggestion"), F.col("maximum").isNull().alias("missing_maximum"),
        F.when(has(F.col("line"), P.GERMAN_SCHOOL) | (F.get(fits, F.lit(0))["name"] == ABITUR_AVERAGE[0]), ABITUR_AVERAGE[1]).otherwise(own).alias("reference"),
    )


def pair(value: Column, reference: Column) -> Column:
    """Both numbers with as many decimals as the value has, two at least."""
    decimals = F.greatest(F.lit(2), F.char_length(F.split_part(value.cast("string"), F.lit("."), F.lit(2)))).cast("string")
    form = F.concat(F.lit("%."), decimals, F.lit("f / %."), decimals, F.lit("f"))
    return F.call_function("format_string", form, value, reference)


def notes(grades: DataFrame) -> DataFrame:
    """doc_id, line_no, pos, raw, kind, written_as of grades that need a word.

    ``decimal_lost``: not possible on the scale, possible with its decimal point put back. ``no_scale``: on
    no known scale. ``no_maximum``: possible, but written without what it is out of. ``written_as`` pairs
    the grade with the best one where low ones are best, else with the highest; null where none is known.
    """
    kind = F.when(~F.col("plausible"), F.when(F.col("suggestion").isNotNull(), "decimal_lost").otherwise("no_scale")).when(F.col("missing_maximum"), "no_maximum")
    shown = F.coalesce("suggestion", "value")
    written = F.when(F.col("reference").isNotNull() & (kind != "no_scale"), pair(shown, F.col("reference")))
    return grades.select("doc_id", "line_no", "pos", "raw", kind.alias("kind"), written.alias("written_as")).where("kind IS NOT NULL")


def convention_notes(grades: DataFrame) -> DataFrame:
    """doc_id, value: the first plausible Swiss grade below the one that is customarily shown."""
    low = grades.where("plausible AND country = 'CH'").where((F.col("value") < SWISS_CONVENTION) & (F.col("scale") == SCALES["CH"][0]))
    return low.groupBy("doc_id").agg(F.min_by("value", F.struct("line_no", "pos")).alias("value"))


def consistency_notes(entries: DataFrame) -> DataFrame:
    """doc_id, entries, graded of documents where some but not all of two or more entries have a grade."""
    counted = entries.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if("has_grade").alias("graded"))
    return counted.where("entries >= 2 AND graded > 0 AND graded < entries")
