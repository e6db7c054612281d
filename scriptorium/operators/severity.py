"""Rules over a document's facts, ranked by tier; status of sections; the few areas named first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.vocabulary import MAX_KEY_AREAS

#: Key, tier and condition over the facts, in order of emission. Fixed values.
RULES = [
    ("unlabelled_entries", 1, "size(unlabelled_entries) > 0"),
    ("no_sections", 1, "no_sections_found"),
    ("education_thin", 1, "size(education_thin_entries) > 0"),
    ("no_bullets_anywhere", 1, "total_bullets = 0"),
    ("entries_no_detail", 1, "entries_no_detail_section IS NOT NULL"),
    ("entries_no_title", 1, "entries_no_title_section IS NOT NULL"),
    ("bare_section", 1, "size(bare_sections) = 1"),
    ("bare_sections", 1, "size(bare_sections) > 1"),
    ("too_short", 1, "page_count = 1 AND char_count < 1200"),
    ("duty_bullets", 2, "weak_bullets > 0"),
    ("no_outcomes", 2, "experience_bullets >= 4 AND with_outcome < 0.4 * experience_bullets"),
    ("not_tailored", 2, "untailored"),
    ("unlabelled_intro", 3, "unlabelled_intro IS NOT NULL"),
    ("soft_skills_only", 3, "soft_skills_only_section IS NOT NULL"),
    ("typos", 3, "typos > 0"),
    ("year_only_dates", 3, "year_only_ranges >= 2"),
    ("spelling_variant", 3, "mixed_spelling"),
    ("bullet_punctuation", 3, "punctuation_mixed"),
    ("entry_chronology", 3, "chronology_section IS NOT NULL"),
    ("mixed_tense", 3, "mixed_tense_section IS NOT NULL"),
    ("education_order", 3, "education_after_experience"),
    ("date_overlap", 3, "date_overlaps > 0"),
    ("date_gap", 3, "date_gaps > 0"),
    ("tables", 3, "table_count > 0"),
    ("missing_sections", 4, "size(missing_sections) > 0"),
    ("too_long", 4, "page_count > 2"),
    ("grades", 5, "grade_notes > 0"),
    ("grade_convention", 5, "grade_convention"),
    ("grade_consistency", 5, "grade_consistency"),
    ("language_no_level", 5, "languages_missing > 0"),
    ("language_plain_only", 5, "languages_missing = 0 AND languages_plain > 0"),
    ("skills_no_level", 5, "skills_without_level >= 3"),
    ("bare_interests", 5, "bare_interests > 0"),
    ("buzzwords", 5, "size(buzzwords) > 0"),
]
#: The column that names an issue's section.
SECTION_OF = {
    "entries_no_detail": "entries_no_detail_section", "entries_no_title": "entries_no_title_section", "soft_skills_only": "soft_skills_only_section",
    "entry_chronology": "chronology_section", "mixed_tense": "mixed_tense_section", "bare_section": "bare_sections[0]", "bare_sections": "bare_sections[0]",
}
DATE_KEYS = ["date_overlap", "date_gap"]
FORMAT_KEYS = ["typos", "spelling_variant", "tables", "too_long", "too_short"]
OPTIONAL_KEYS = ["bare_interests", "grade_convention"]

FACTS = (
    "doc_id long, unlabelled_entries array<string>, no_sections_found boolean, education_thin_entries array<string>, total_bullets int, "
    "entries_no_detail_section string, entries_no_title_section string, bare_sections array<string>, page_count int, char_count int, weak_bullets int, "
    "experience_bullets int, with_outcome int, untailored boolean, unlabelled_intro string, soft_skills_only_section string, typos int, "
    "year_only_ranges int, mixed_spelling boolean, punctuation_mixed boolean, chronology_section string, mixed_tense_section string, "
    "education_after_experience boolean, date_overlaps int, date_gaps int, table_count int, missing_sections array<string>, grade_notes int, "
    "grade_convention boolean, grade_consistency boolean, languages_missing int, languages_plain int, skills_without_level int, bare_interests int, "
    "buzzwords array<string>, sections array<string>"
)


def _issue(seq: int, tier: int, name: Column, section: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.lit(seq).alias("seq"), name.alias("key"), section.cast("string").alias("section"))


def _missing(seq: int, tier: int) -> Callable[[Column], Column]:
    return lambda name: _issue(seq, tier, F.concat(F.lit("missing_"), name), F.lit(None))


def issues(facts: DataFrame) -> DataFrame:
    """doc_id, rank, tier, key, section: every rule that holds, by tier and then in order of emission.

    A null fact holds no rule. Each missing section is an issue of its own.
    """
    made = []
    for seq, (key, tier, condition) in enumerate(RULES):
        if key == "missing_sections":
            each = F.transform(F.coalesce("missing_sections", F.array().cast("array<string>")), _missing(seq, tier))
            made.append(F.when(F.expr(condition), each))
        else:
            made.append(F.when(F.expr(condition), F.array(_issue(seq, tier, F.lit(key), F.expr(SECTION_OF.get(key, "NULL"))))))
    held = F.flatten(F.filter(F.array(*made), lambda x: x.isNotNull()))
    rows = facts.select("doc_id", F.posexplode(held).alias("pos", "issue")).select("doc_id", "pos", "issue.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("tier", "seq", "pos"))).drop("pos", "seq")


def key_areas(ranked: DataFrame, limit: int = MAX_KEY_AREAS) -> DataFrame:
    """The first issues that aren't of dates or format: doc_id, area, tier, key, section."""
    rows = ranked.where(~F.col("key").isin(DATE_KEYS + FORMAT_KEYS))
    rows = rows.withColumn("area", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank")))
    return rows.where(F.col("area") <= limit).select("doc_id", "area", "tier", "key", "section")


def section_status(facts: DataFrame, ranked: DataFrame) -> DataFrame:
    """doc_id, section, status: ``needs_attention`` for sections of issues that aren't of dates or optional."""
    flagged = ranked.where(F.col("section").isNotNull() & ~F.col("key").isin(DATE_KEYS + OPTIONAL_KEYS)).select("doc_id", "section", F.lit(True).alias("flagged")).distinct()
    rows = facts.select("doc_id", F.explode("sections").alias("section"))
    return rows.join(flagged, ["doc_id", "section"], "left").select("doc_id", "section", F.when(F.col("flagged"), "needs_attention").otherwise("strong").alias("status"))


def strengths(facts: DataFrame) -> DataFrame:
    """doc_id, strengths: measured ones only."""
    outcome = F.when((F.col("experience_bullets") >= 4) & (F.col("with_outcome") >= 0.5 * F.col("experience_bullets")), "outcomes")
    complete = F.when((F.size("sections") > 0) & (F.size("missing_sections") == 0), "complete_sections")
    return facts.select("doc_id", F.filter(F.array(outcome, complete), lambda s: s.isNotNull()).alias("strengths"))
