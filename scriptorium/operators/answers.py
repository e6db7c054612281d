"""What a hosted model or a reader answered, as rows, beside what was measured.

Answers are tables that a caller passes. They are cleaned, tied to lines and paragraphs that exist, and
overruled where a measurement says otherwise; every step is a join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.patterns import has, worked
from scriptorium.operators import headings
from scriptorium.operators.overlap import content_words, overlap_share, skills_removed

MAX_HEADING = 60
GROUNDED = ["Experience", "Education", "Projects", "Volunteering & Community", "Publications & Research"]
LONG_WORD, STEM_CHARS = "[A-Za-zÄÖÜäöüß]{6,}", 6
ANCHOR_SHARE, LEAST_CLAIMS, MAINLY, MAX_REPETITIONS = 0.5, 2, 0.5, 3
THIN_REMAINDER, CLAIM_SHARE, KNOWN_SHARE = 6, 0.35, 0.6


def proposed_sections(docs: DataFrame, proposed: DataFrame, categories: list[str]) -> DataFrame:
    """doc_id, ord, heading, category of the proposals that are usable.

    ``docs`` (doc_id, text), ``proposed`` (doc_id, ord, heading, category). A heading has two to sixty
    characters and stands in the document, letters of any case; of several alike the first stays. An
    unknown category becomes ``Other``. Nulls are no headings.
    """
    heading = F.trim("heading")
    rows = proposed.where(F.char_length(heading).between(2, MAX_HEADING)).withColumn("heading", heading)
    rows = rows.join(docs.select("doc_id", F.lower("text").alias("_low")), "doc_id").where(F.col("_low").contains(F.lower("heading"))).drop("_low")
    first = F.row_number().over(Window.partitionBy("doc_id", F.lower("heading")).orderBy("ord"))
    named = F.when(F.trim("category").isin(categories), F.trim("category")).otherwise("Other")
    return rows.withColumn("_n", first).where("_n = 1").select("doc_id", "ord", "heading", named.alias("category"))


def merged_sections(lines: DataFrame, found: DataFrame, proposed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, n, line_no, heading, category, damage: headings found in the lines, then proposals that add to them, in the document's order.

    ``found`` is what ``headings.identify`` gives. A proposal that reads as a found heading, as it is or
    repaired, is left out: the lookup wins. One that stands on no line of its own comes last.
    """
    key = headings.normalise(F.col("heading"))
    own = found.select("doc_id", "line_no", F.trim("line").alias("heading"), "display", "category", "damage")
    as_lines = proposed.select("doc_id", F.col("ord").cast("int").alias("line_no"), F.col("heading").alias("line"))
    known = headings.identify(as_lines, vocabulary).select("doc_id", F.col("line_no").alias("ord"), "display")
    rows = proposed.join(known, ["doc_id", "ord"], "left").withColumn("key", key)
    rows = rows.join(own.select("doc_id", "display").distinct(), ["doc_id", "display"], "left_anti").join(own.select("doc_id", key.alias("key")).distinct(), ["doc_id", "key"], "left_anti")
    once = F.row_number().over(Window.partitionBy("doc_id", F.coalesce("display", "key")).orderBy("ord"))
    rows = rows.withColumn("_n", once).where("_n = 1")
    places = lines.select("doc_id", headings.normalise(F.col("line")).alias("key"), "line_no").groupBy("doc_id", "key").agg(F.min("line_no").alias("line_no"))
    added = rows.join(places, ["doc_id", "key"], "left").select("doc_id", "line_no", "heading", "category", F.lit(None).cast("string").alias("damage"))
    both = own.drop("display").unionByName(added)
    return both.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("line_no"), "heading")))


def _long_stems(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LONG_WORD), 0), lambda w: F.substring(F.lower(w), 1, STEM_CHARS)))


def grounding(answers: DataFrame, content: DataFrame, keys: list[str]) -> DataFrame:
    """keys, here, said, shared, ungrounded: whether an answer (``points``) names anything of what it is about (``text``).

    Words of six letters or more compare by their first six. Content without such a word grounds nothing
    and blames nothing.
    """
    both = answers.join(content, keys).select(*keys, _long_stems(F.col("text")).alias("h"), _long_stems(F.col("points")).alias("s"))
    shared = F.size(F.array_intersect("h", "s"))
    return both.select(*keys, F.size("h").cast("long").alias("here"), F.size("s").cast("long").alias("said"), shared.cast("long").alias("shared"), ((F.size("h") > 0) & (shared == 0)).alias("ungrounded"))


def ungrounded_sections(answers: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id, section of sections that need attention and whose points name nothing of them.

    ``answers`` (doc_id, section, status, points), ``sections`` (doc_id, section, category, text).
    """
    asked = answers.where("status = 'needs_attention'").select("doc_id", F.trim("section").alias("section"), "points")
    held = sections.where(F.col("category").isin(GROUNDED)).select("doc_id", F.trim("section").alias("section"), "text")
    return grounding(asked, held, ["doc_id", "section"]).where("ungrounded").select("doc_id", "section")


def _weighed(claims: DataFrame) -> DataFrame:
    """doc_id, n, said: each paragraph's claims with known, stems (c), and whether more than a claim to have grown is left."""
    rows = claims.where("claim IS NOT NULL").withColumn("known", F.coalesce("known", F.lit(False)))
    rows = rows if "c" in rows.columns else worked(rows, "c", content_words(F.col("claim")))
    rows = skills_removed(rows.where(F.size("c") > 0).withColumnRenamed("claim", "text"))
    left = F.when(F.size("removed") == 0, F.lit(True)).otherwise(F.size(content_words(F.col("kept"))) > 0)
    return rows.where(left).groupBy("doc_id", "n").agg(F.collect_list(F.struct("known", "c")).alias("said"))


def _counted(rows: DataFrame, stems: str) -> DataFrame:
    """``rows`` with claims, known_claims of ``said`` whose stems are half in ``stems``; null below two of them."""
    rows = worked(rows, "_missing", F.array_except(F.flatten(F.transform("said", lambda x: x["c"])), F.col(stems)))  # what no claim has in its paragraph, found in one pass
    held = F.filter("said", lambda x: F.size(x["c"]) - F.size(F.array_intersect(x["c"], F.col("_missing"))) >= ANCHOR_SHARE * F.size(x["c"]))
    rows = worked(rows, "_held", F.when(F.size("_missing") == 0, F.col("said")).otherwise(held))
    enough = F.size("_held") >= LEAST_CLAIMS
    known = F.size(F.filter("_held", lambda x: x["known"]))
    return rows.withColumns({"claims": F.when(enough, F.size("_held").cast("long")), "known_claims": F.when(enough, known.cast("long"))}).drop("_held", "_missing", "said")


def claim_counts(body: DataFrame, claims: DataFrame) -> DataFrame:
    """doc_id, n, claims, known_claims of paragraphs with two anchored claims or more.

    ``body`` (doc_id, n, paragraph), ``claims`` (doc_id, n, claim, known, and c if their stems are made
    already). A claim counts if half of its stems are in its paragraph and if more than a claim to have grown
    is left of it.
    """
    rows = worked(body, "p", content_words(F.col("paragraph"))).select("doc_id", "n", "p").join(_weighed(claims), ["doc_id", "n"])
    return _counted(rows, "p").select("doc_id", "n", "claims", "known_claims").where("claims IS NOT NULL")


def measured_paragraphs(body: DataFrame, known: DataFrame, claims: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n, opening, words, skill_claims, words_left, claim_share, known_left, claims, known_claims of paragraphs of ten stems or more.

    ``known`` (doc_id, other) is the other document; without one ``known_left`` is null. Its stems can come
    as k instead, and those of ``claims`` as c.
    """
    rows = worked(skills_removed(body.select("doc_id", "n", F.col("paragraph").alias("text"))), "w", content_words(F.col("text"))).where(F.size("w") >= least)
    rows = worked(rows, "r", F.when(F.size("removed") == 0, F.col("w")).otherwise(content_words(F.col("kept"))))
    known = known if "k" in known.columns else worked(known, "k", content_words(F.col("other")))
    rows = rows.join(known.select("doc_id", "k"), "doc_id", "left").join(_weighed(claims), ["doc_id", "n"], "left")  # stems once a document
    opening = F.substring(F.regexp_replace(F.trim("text"), r"(?U)\s+", " "), 1, 80)
    known_left = F.when(F.size("k") > 0, F.when(F.size("r") == 0, 1.0).otherwise(overlap_share(F.col("r"), F.col("k"))))
    return _counted(rows, "w").select(
        "doc_id", "n", opening.alias("opening"), F.size("w").alias("words"), F.size("removed").alias("skill_claims"), F.size("r").alias("words_left"),
        F.bround(1 - F.size("r") / F.size("w"), 2).alias("claim_share"), known_left.alias("known_left"), "claims", "known_claims",
    )


def repetition_candidates(measured: DataFrame) -> DataFrame:
    """doc_id, n, reason: paragraphs that the measurements say add little; the first reason that holds."""
    reason = (
        F.when(F.col("known_claims") == F.col("claims"), "all_claims_known")
        .when((F.col("skill_claims") > 0) & (F.col("words_left") < THIN_REMAINDER), "nothing_left")
        .when(F.col("claim_share") >= CLAIM_SHARE, "mostly_claims")
        .when(F.col("known_left") >= KNOWN_SHARE, "remainder_known")
    )
    return measured.select("doc_id", "n", reason.alias("reason")).where("reason IS NOT NULL")


def repetitions(flagged: DataFrame, measured: DataFrame) -> DataFrame:
    """doc_id, n, opening, issue: at most three flagged paragraphs a document that stand, in the letter's order.

    ``flagged`` (doc_id, n, issue). A paragraph must have been measured and the issue say something; one
    with half of its claims new is taken out unless a measurement singles it out.
    """
    singled = repetition_candidates(measured).select("doc_id", "n", F.lit(True).alias("singled"))
    rows = flagged.where(F.trim("issue") != "").join(measured, ["doc_id", "n"]).join(singled, ["doc_id", "n"], "left")
    new = F.coalesce(F.col("known_claims") <= MAINLY * F.col("claims"), F.lit(False)) & F.col("singled").isNull()
    rows = rows.where(~new).groupBy("doc_id", "n", "opening").agg(F.min(F.trim("issue")).alias("issue"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).where(F.col("k") <= MAX_REPETITIONS).drop("k")


def unreported(flagged: DataFrame, measured: DataFrame) -> DataFrame:
    """doc_id, n of paragraphs all of whose claims are known and that were not flagged."""
    return measured.where("known_claims = claims").select("doc_id", "n").join(flagged.select("doc_id", "n").distinct(), ["doc_id", "n"], "left_anti")


def points_in_place(answers: DataFrame, wrong_home: str, right_home: str, misplaced: str) -> DataFrame:
    """``answers`` (section, points) whose points of the misplaced kind are taken out of sections that aren't their home."""
    wrong = has(F.col("section"), wrong_home) & ~has(F.col("section"), right_home)
    return answers.withColumn("points", F.when(F.coalesce(wrong, F.lit(False)), F.filter("points", lambda p: ~has(p, misplaced))).otherwise(F.col("points")))
