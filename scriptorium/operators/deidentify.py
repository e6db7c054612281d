"""The removal of personal data as one: personal sections, contact block, names, layers, and the check of what is left.

A document's headings are found first, with the lookup that the caller passes; all else is expressions on
the document's own lines, so its text never leaves its row. Who is a person is a recogniser's answer, a
table of names; without one only the line of the name at the top is known, and the row says ``degraded``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import vocabulary as V
from scriptorium.functions.patterns import has, let, unified_lines
from scriptorium.operators.lines import lines_of
from scriptorium.operators.redaction import is_phone, looks_like_a_name, placeholder, redact
from scriptorium.operators.selection import INSTITUTION, TITLE_BEFORE

PERSONAL, REFERENCES = "Personal Details", "References"
MAX_NAME_CHARS, MAX_NAME_WORDS, MIN_NAME_PART = 60, 5, 3
#: From (doc_id, line_no, line) the lines that are headings, with ``display``.
Lookup = Callable[[DataFrame], DataFrame]


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def _heading_like(line: Column) -> Column:
    """A heading by its shape: a known word alone, or a short line all in capitals that is no contact."""
    text = F.trim(line)
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    capitals = (F.char_length(letters) >= 3) & ~letters.rlike(r"[^\p{Lu}]") & ~has(text, P.CONTACT_LINE)
    return (text != "") & (F.char_length(text) <= 60) & (has(text, P.HEADING_LINE) | capitals)


def _name_line(line: Column, head: Column) -> Column:
    return looks_like_a_name(line, V.ROLE_WORDS) & ~head & ~_heading_like(line)


def plausible_person(name: Column) -> Column:
    """Two to five words on one line, no digit, none that belongs to a firm or school."""
    words = F.filter(F.split(F.trim(name), r"(?U)\s+"), lambda w: w != "")
    plain = F.forall(words, lambda w: ~F.lower(F.trim(w, F.lit(".,"))).isin(V.NOT_A_PERSON))
    return F.char_length(name).between(3, MAX_NAME_CHARS) & ~name.rlike(r"[\n\p{Nd}]") & F.size(words).between(2, MAX_NAME_WORDS) & plain & name.rlike(r"\p{L}")


def name_parts(names: Column) -> Column:
    """Names and their words of three letters or more, the longest first; titles and particles stay out."""
    words = F.transform(F.flatten(F.transform(names, lambda n: F.split(n, r"(?U)[\s,]+"))), lambda w: F.trim(w, F.lit(".")))
    own = F.filter(words, lambda w: (F.char_length(w) >= MIN_NAME_PART) & ~F.lower(w).isin(V.NAME_STOPWORDS))
    return F.array_sort(F.array_distinct(F.concat(names, own)), lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0)))


def without_names(text: Column, names: Column) -> Column:
    """Every part of the names on word boundaries, the longest first."""
    quoted = lambda p: F.concat(F.lit(r"(?U)\b\Q"), p, F.lit(r"\E\b"))
    return F.aggregate(name_parts(names), text, lambda t, p: F.when(t.contains(p), F.regexp_replace(t, quoted(p), F.lit(placeholder("name")))).otherwise(t))


def first_place(items: Column, holds: Callable[[Column], Column]) -> Column:
    """The place, from 0, of the first item for which ``holds``, else null; nothing is asked of the items behind it."""
    step = lambda s, x: F.struct((s["next"] + 1).alias("next"), F.when(s["at"].isNotNull(), s["at"]).when(holds(x), s["next"]).alias("at"))
    return F.aggregate(items, F.struct(F.lit(0).alias("next"), F.lit(None).cast("int").alias("at")), step)["at"]


def with_blocks(docs: DataFrame, lookup: Lookup) -> DataFrame:
    """``docs`` with _lines (line, display, head), personal (whether a section of personal details went) and _cut, the length of the header.

    A section of personal details leaves its mark and its blank lines. The header ends before the first
    heading or date range of fourteen lines, else where a line is neither blank nor contact nor a name.
    """
    heads = lookup(lines_of(docs)).groupBy("doc_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("line_no").cast("int"), "display")))).alias("_heads"))
    rows = docs.join(heads.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    numbers = F.array_sort(F.map_keys("_heads"))
    display = lambda k: F.try_element_at("_heads", k)
    under = lambda k: display(F.try_element_at(F.filter(numbers, lambda n: n <= k), F.lit(-1)))
    rows = rows.withColumn("personal", F.coalesce(F.array_contains(F.map_values("_heads"), PERSONAL), F.lit(False)))
    line = lambda x, k: F.struct(x.alias("line"), display(k).alias("display"))
    split = F.split(unified_lines(F.col("text")), "\n")
    gone = F.struct(F.lit(placeholder("contact_block")).alias("line"), F.lit(None).cast("string").alias("display"))
    cleaned = F.filter(F.transform(split, lambda x, k: F.when(F.coalesce(display(k) == PERSONAL, F.lit(False)), gone).when(F.coalesce(under(k) == PERSONAL, F.lit(False)) & ~_blank(x), F.lit(None)).otherwise(line(x, k))), lambda x: x.isNotNull())
    rows = rows.withColumn("_lines", F.when(F.col("personal"), cleaned).otherwise(F.transform(split, line)))
    top = F.slice("_lines", 1, V.MAX_CONTACT_LINES)
    stops = lambda x: x["display"].isNotNull() | _heading_like(x["line"]) | P.has_range(x["line"])
    ends = lambda x: ~(_blank(x["line"]) | has(x["line"], P.CONTACT_LINE) | _name_line(x["line"], x["display"].isNotNull()))
    cut = F.coalesce(first_place(top, stops), first_place(top, ends), F.size(top))
    return rows.withColumn("_cut", cut.cast("int")).drop("_heads")


def _header() -> Column:
    return F.slice("_lines", F.lit(1), F.col("_cut"))


def _body() -> Column:
    return F.slice("_lines", F.col("_cut") + 1, F.greatest(F.lit(0), F.size("_lines") - F.col("_cut")))


def top_name() -> Column:
    """The first line of the header that isn't blank, if it looks like a name."""
    first = F.get(F.filter(_header(), lambda x: ~_blank(x["line"])), F.lit(0))
    return F.when(_name_line(first["line"], first["display"].isNotNull()), F.trim(first["line"]))


def cleaned_header(names: Column) -> Column:
    """The header's lines without contacts and names; where any went, the mark stands first. Dated lines stay."""
    goes = lambda x: ~_blank(x["line"]) & ~P.has_range(x["line"]) & (has(x["line"], P.CONTACT_LINE) | F.exists(names, lambda n: x["line"].contains(n)))
    kept = F.transform(F.filter(_header(), lambda x: ~goes(x)), lambda x: x["line"])
    return F.when(F.exists(_header(), goes), F.concat(F.array(F.lit(placeholder("contact_block"))), kept)).otherwise(kept)


def _known_names(persons: DataFrame | None, places: DataFrame | None, rows: DataFrame) -> DataFrame:
    """``rows`` with _names: whom the header names, else the name at the top, and those of the body that something confirms."""
    none = F.array().cast("array<string>")
    for column, table in (("_persons", persons), ("_places", places)):
        if table is None:
            rows = rows.withColumn(column, none)
            continue
        told = table.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("name").alias(column))
        rows = rows.join(told, F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id").withColumn(column, F.coalesce(column, none))
    signs = F.lit(" ,.;:|·—-")
    vetoed = F.transform("_places", lambda p: F.lower(F.trim(p, signs)))
    within = lambda lines, n: F.filter(lines, lambda x: x["line"].contains(n))
    everywhere = F.col("_lines")
    schooled = lambda n: F.exists(everywhere, lambda x: x["line"].contains(n)) & F.forall(within(everywhere, n), lambda x: has(x["line"], INSTITUTION))
    able = F.filter("_persons", lambda n: plausible_person(n) & ~F.array_contains(vetoed, F.lower(F.trim(n, signs))) & ~schooled(n))
    rows = rows.withColumn("_able", F.array_sort(able))
    at_top = F.filter("_able", lambda n: F.exists(_header(), lambda x: x["line"].contains(n)))
    rows = rows.withColumn("_top", F.when(F.size(at_top) > 0, at_top).otherwise(F.array_compact(F.array(top_name()))))
    beside = lambda line: line.rlike(r"@|\[EMAIL REDACTED\]|\[PHONE REDACTED\]") | F.exists(P.every(line, P.PHONE), lambda m: is_phone(m, line))
    before = lambda line, n: F.split_part(line, n, F.lit(1))
    # A line under references: its display is carried down once, for bodies that have such a heading.
    heads = F.filter(F.transform(_body(), lambda x, k: F.struct(k.alias("k"), x["display"].alias("d"))), lambda h: h["d"].isNotNull())
    rows = rows.withColumn("_marks", heads).withColumn("_body", _body())
    under = lambda k: F.coalesce(F.try_element_at(F.filter("_marks", lambda h: h["k"] <= k), F.lit(-1))["d"] == REFERENCES, F.lit(False))
    sure = lambda n: F.exists(F.transform("_body", lambda x, k: x["line"].contains(n) & (has(before(x["line"], n), TITLE_BEFORE) | beside(x["line"]) | under(k))), lambda hit: hit)
    body = F.filter("_able", lambda n: ~F.array_contains("_top", n) & sure(n))
    return rows.withColumn("_names", F.when(F.size("_able") > 0, F.concat("_top", body)).otherwise(F.col("_top"))).drop("_persons", "_places", "_able", "_top", "_marks", "_body")


def strip_personal_data(docs: DataFrame, as_of: str, lookup: Lookup, persons: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """``docs`` with redacted, categories, labels, names_found, residual, degraded.

    ``persons`` and ``places`` (doc_id, name) are a recogniser's answers; a name that is a place too, or
    stands only beside institutions, is nobody's. Categories are in the order of the labels. A null text is
    empty. Columns of these names, and those that begin with an underscore, are replaced.
    """
    kept = [c for c in docs.columns if not c.startswith("_") and c not in ("redacted", "categories", "labels", "names_found", "residual", "degraded")]
    rows = _known_names(persons, places, with_blocks(docs.select(*kept), lookup))
    header = cleaned_header(F.col("_names"))
    rows = rows.withColumn("_header", header)
    working = F.array_join(F.concat("_header", F.transform(_body(), lambda x: x["line"])), "\n")
    rows = rows.withColumn("_working", working).withColumn("_blocked", F.col("personal") | (F.size("_header") != F.col("_cut")) | F.coalesce(F.get("_header", F.lit(0)) == placeholder("contact_block"), F.lit(False)))
    rows = rows.withColumn("_unnamed", let(F.col("_working"), lambda t: F.when(F.size("_names") > 0, without_names(t, F.col("_names"))).otherwise(t)))
    named, blocked = F.col("_unnamed") != F.col("_working"), F.col("_blocked")
    rows = rows.withColumns({"_named": named, "_whole": F.col("text"), "text": F.col("_unnamed")}).drop("_lines", "_header", "_working", "_unnamed", "personal", "_cut")
    made = redact(rows, as_of)
    found = F.concat("categories", F.when(F.col("_named"), F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")), F.when(blocked, F.array(F.lit("contact_block"))).otherwise(F.array().cast("array<string>")))
    order = F.array(*map(F.lit, V.REMOVED_LABELS))
    ordered = F.filter(order, lambda c: F.array_contains("_found", c))
    labels = F.create_map(*[F.lit(x) for pair in V.REMOVED_LABELS.items() for x in pair])
    made = made.withColumn("_found", found).withColumn("categories", ordered).withColumn("labels", F.transform("categories", lambda c: F.element_at(labels, c)))
    made = made.withColumns({"names_found": F.size("_names").cast("long"), "degraded": F.lit(persons is None), "text": F.col("_whole")})
    return made.select(*kept, "redacted", "categories", "labels", "names_found", "residual", "degraded")
