"""The sections, entries, ranges and facts of whole documents, from their text to what is ranked.

Every step is joined by document, and inside a document by the line of the heading, so that two
sections of one name stay two. Facts that a text alone can't give (pages, tables, a job's terms) are
null, and a null fact holds no rule.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.durable import checkpointed
from scriptorium.functions.patterns import has
from scriptorium.operators import facts, grades, headings, lines, severity, timeline
from scriptorium.operators.entries import entries_of

# --- fixed values ---
DETAIL = ["Experience", "Volunteering & Community", "Projects"]
TITLED = ["Experience", "Extracurricular & Interests", "Volunteering & Community"]
OF_ENTRIES = ["Education", "Experience", "Volunteering & Community", "Projects", "Publications & Research", "Extracurricular & Interests"]
DATED = ["Education", "Experience"]
OVERLAPPING = ["Experience"]
INTEREST_LINE = r"^\s*(?:hobbies|interests|freizeit|interessen)\b"
DEGREE_GRADE = (
    r"\b(?:grade average|average grade|final grade|overall grade|cumulative|gpa|cgpa|notendurchschnitt|gesamtnote|abschlussnote|durchschnitt|"
    r"note[nd]?\s*:|grade\s*:|marks?\s*:|classification)\b"
)
MIN_LINES_WITHOUT_SECTION, BARE_LINES, FULL_INTERESTS, UNLABELLED, MAX_GRADE_LINE = 8, 2, 60, 4, 60


class Profile:
    """Tables of ``docs`` (doc_id, text), those that many others read made once on shared storage when first asked for.

    ``section`` is a heading's line number and text, ``display`` its name. What needs a heading reads only
    the documents that have one.
    """

    def __init__(self, docs: DataFrame, vocabulary: DataFrame, as_of: str) -> None:
        self.docs, self.as_of = docs, as_of
        self.lines = lines.lines_of(docs)
        self.headings = checkpointed(headings.identify(self.lines, vocabulary))
        self._key = F.concat_ws(" ", "line_no", F.trim("line"))
        self.heads = self.headings.select("doc_id", self._key.alias("section"), "line_no", "display", "category")

    @cached_property
    def headed(self) -> DataFrame:
        """The lines of documents with a heading."""
        return checkpointed(lines.lines_of(self.docs.join(self.headings.select("doc_id").distinct(), "doc_id")))

    def _under(self, rows: DataFrame) -> DataFrame:
        return headings.lines_with_section(rows, self.headings.withColumn("display", self._key))

    @cached_property
    def body(self) -> DataFrame:
        """The lines of all documents with the section they stand in."""
        return self._under(self.lines)

    @cached_property
    def _headed_body(self) -> DataFrame:
        return checkpointed(self._under(self.headed))

    @cached_property
    def named(self) -> DataFrame:
        return checkpointed(self._headed_body.join(self.heads.select("doc_id", "section", "display"), ["doc_id", "section"]))

    @cached_property
    def bullets(self) -> DataFrame:
        return checkpointed(facts.bullets_of(self.named))

    @cached_property
    def entries(self) -> DataFrame:
        return checkpointed(self._named(entries_of(self.named)))

    @cached_property
    def above(self) -> DataFrame:
        return entries_of(self._headed_body.where("section IS NULL").withColumn("section", F.lit("")))

    @cached_property
    def ranges(self) -> DataFrame:
        return checkpointed(timeline.ranges_of(self.named, self.as_of))

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.heads.withColumnRenamed("line_no", "heading_line"), ["doc_id", "section"])

    def dated_entries(self) -> DataFrame:
        """The entries with the first range on their dated line."""
        first = self.ranges.where("pos = 0").select("doc_id", "section", "line_no", "raw", "s", "e", "months_explicit")
        return self.entries.join(first, ["doc_id", "section", "line_no"])

    def date_findings(self) -> DataFrame:
        """Gaps and overlaps inside sections of education and experience: overlaps of jobs, and gaps with an unexplained part."""
        rows = self.ranges.where(F.col("category").isin(DATED))
        found = timeline.findings(rows, "doc_id", "section", "category")
        overlap = found.where((F.col("kind") == "overlap") & F.col("category").isin(OVERLAPPING)).drop("category")
        open_ = timeline.uncovered_runs(self.ranges).join(rows.select("doc_id", "section").distinct(), ["doc_id", "section"])
        gap = open_.select("doc_id", "section", F.lit("gap").alias("kind"), "first", "second", F.col("unexplained").cast("int").alias("months"))
        return self._named(overlap.unionByName(gap)).select("doc_id", F.col("heading_line").alias("section_line"), F.col("display").alias("section"), "kind", "first", "second", "months")

    def grades(self) -> DataFrame:
        """Grades of the education sections, of the whole text where there is none."""
        own = self._education()
        rest = self.docs.join(own.select("doc_id").distinct().withColumn("_own", F.lit(True)), "doc_id", "left").where("_own IS NULL")  # an anti join would be pushed into the parts of a union
        return grades.find_grades(own.unionByName(lines.lines_of(rest)))

    def _education(self) -> DataFrame:
        return self.named.where("category = 'Education'").select("doc_id", "line_no", "line")

    def graded_degrees(self) -> DataFrame:
        """doc_id, section, line_no, has_grade of the degrees among the education entries; their documents' grades are those of the education sections."""
        rows = self.entries.where("category = 'Education'")
        upto = F.coalesce(F.lead("line_no").over(Window.partitionBy("doc_id", "section").orderBy("entry_no")), F.lit(1 << 30))
        degree = facts.is_degree(F.concat_ws(" ", "title_line", "line", F.array_join("description", " ")))
        spans = rows.withColumn("stop", upto).where(degree).select("doc_id", "section", "line_no", "stop")
        held = grades.find_grades(self._education()).select("doc_id", F.col("line_no").alias("graded")).distinct().join(self.named.withColumnRenamed("line_no", "graded"), ["doc_id", "graded"])
        held = held.where(has(F.col("line"), DEGREE_GRADE) | (F.char_length(F.trim("line")) < MAX_GRADE_LINE)).select("doc_id", "section", "graded")
        inside = F.coalesce(F.col("graded").between(F.col("line_no"), F.col("stop") - 1), F.lit(False))
        return spans.join(held, ["doc_id", "section"], "left").groupBy("doc_id", "section", "line_no").agg(F.bool_or(inside).alias("has_grade"))

    def facts(self) -> DataFrame:
        """A row for each document with the columns of ``severity.FACTS``."""
        title = F.when(F.col("title_line") != "", F.col("title_line")).otherwise(F.col("line"))
        bare = (F.size("bullets") == 0) & (F.size("description") == 0) & ~F.col("stacked_with_next") & ~facts.is_routine_service(title)
        first = lambda value, at, when: F.min_by(value, F.when(when, F.col(at)))
        listed = lambda value, *at: F.transform(F.array_sort(F.collect_list(F.struct(*at, value.alias("v")))), lambda x: x["v"])
        by_doc = lambda rows, *columns: rows.groupBy("doc_id").agg(*columns)
        detail = self.bullets.where(F.col("category").isin(DETAIL))
        claims = self.named.where((F.col("category") != "Extracurricular & Interests") & ~has(F.col("line"), INTEREST_LINE))
        no_title = F.col("category").isin(TITLED) & ~facts.has_role_title(F.col("line"), F.col("title_line"), F.coalesce(F.get("description", F.lit(0)), F.lit("")))
        skills = self.named.where("category = 'Skills & Languages'")
        levels = facts.language_levels(skills)
        thin = facts.thin_education(self.entries.where("category = 'Education'"))
        sizes = self.named.groupBy("doc_id", "section").agg(F.count_if(F.trim("line") != "").alias("n"), F.sum(F.when(F.trim("line") != "", F.char_length("line")).otherwise(0)).alias("chars"))
        filled = self.entries.select("doc_id", "section").distinct().withColumn("has_entries", F.lit(True))
        empty = self.heads.join(sizes, ["doc_id", "section"], "left").join(filled, ["doc_id", "section"], "left").where(
            (F.coalesce("n", F.lit(0)) <= BARE_LINES) & F.col("has_entries").isNull() & F.col("category").isin(OF_ENTRIES)
            & ~((F.col("category") == "Extracurricular & Interests") & (F.coalesce("chars", F.lit(0)) >= FULL_INTERESTS))
        )
        at = lambda category: F.min(F.when(F.col("category") == category, F.col("line_no")))
        found, graded = self.date_findings(), checkpointed(self.grades())
        degrees = grades.consistency_notes(self.graded_degrees())
        named = lambda rows: self._named(rows).groupBy("doc_id")
        parts = [
            by_doc(self.docs.select("doc_id", F.size(F.filter(lines.split_lines(F.col("text")), lambda x: F.trim(x) != "")).alias("n")), F.sum("n").alias("_filled")),
            by_doc(self.above, F.slice(listed(title, "entry_no"), 1, UNLABELLED).alias("unlabelled_entries")),
            by_doc(thin, listed(F.col("title"), "entry_no").alias("education_thin_entries")),
            by_doc(self.bullets, F.count("*").alias("total_bullets")),
            facts.bullet_facts(self.bullets, "doc_id").select("doc_id", "punctuation_mixed"),
            facts.bullet_facts(detail, "doc_id").select("doc_id", F.col("bullets").alias("experience_bullets"), "weak_bullets", "with_outcome"),
            by_doc(self.entries, first("display", "heading_line", bare & F.col("category").isin(DETAIL)).alias("entries_no_detail_section"),
                   first("display", "heading_line", no_title).alias("entries_no_title_section")),
            by_doc(empty, listed(F.col("display"), "line_no").alias("bare_sections")),
            facts.unlabelled_intro(self.headed, self.headings).withColumnRenamed("intro", "unlabelled_intro"),
            named(facts.soft_skills_only(skills)).agg(F.min_by("display", "heading_line").alias("soft_skills_only_section")),
            by_doc(self.headings, F.count_if(F.expr("damage = 'typo'")).alias("typos"), (at("Education") > at("Experience")).alias("education_after_experience"),
                   listed(F.col("display"), "line_no").alias("sections")),
            by_doc(self.ranges, F.count_if(~F.col("months_explicit")).alias("year_only_ranges")),
            facts.writing_facts(self.docs).select("doc_id", "mixed_spelling"),
            named(timeline.chronology_breaks(self.dated_entries())).agg(F.min_by("display", "heading_line").alias("chronology_section")),
            named(facts.mixed_tense(self.bullets)).agg(F.min_by("display", "heading_line").alias("mixed_tense_section")),
            by_doc(found, F.count_if(F.expr("kind = 'overlap'")).alias("date_overlaps"), F.count_if(F.expr("kind = 'gap'")).alias("date_gaps")),
            by_doc(graded, F.count_if(F.expr("NOT plausible OR missing_maximum")).alias("grade_notes")),
            grades.convention_notes(graded).select("doc_id", F.lit(True).alias("grade_convention")),
            degrees.select("doc_id", F.lit(True).alias("grade_consistency")),
            by_doc(levels, F.count_if(F.expr("level = 'missing'")).alias("languages_missing"), F.count_if(F.expr("level = 'plain'")).alias("languages_plain")),
            named(facts.skills_without_level(skills)).agg(F.sum(F.size("items")).alias("skills_without_level")),
            by_doc(facts.bare_interests(self.named.where("display = 'Interests'")), F.sum(F.size("items")).alias("bare_interests")),
            facts.writing_facts(lines.text_of(claims)).select("doc_id", "buzzwords"),
        ]
        base = self.docs.select("doc_id", F.char_length(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")).alias("char_count"))
        rows = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, base)
        none = F.array().cast("array<string>")
        rows = rows.withColumn("no_sections_found", F.col("sections").isNull() & (F.col("_filled") > MIN_LINES_WITHOUT_SECTION)).withColumn("total_bullets", F.coalesce("total_bullets", F.lit(0)))
        for name, kind in (p.split() for p in severity.FACTS.split(", ")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None))
            rows = rows.withColumn(name, F.coalesce(name, none) if kind == "array<string>" else F.col(name).cast(kind))
        return rows.select(*[p.split()[0] for p in severity.FACTS.split(", ")])


def with_missing(rows: DataFrame, profile: Profile, expected: DataFrame) -> DataFrame:
    """``rows`` of facts with the expected sections (section, category) that a document lacks."""
    lacking = headings.missing_sections(profile.docs, profile.headings, expected)
    names = lacking.groupBy("doc_id").agg(F.array_sort(F.collect_list("section")).alias("_missing"))
    return rows.join(names, "doc_id", "left").withColumn("missing_sections", F.coalesce("_missing", "missing_sections")).drop("_missing")
