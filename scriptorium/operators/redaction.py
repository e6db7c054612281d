"""Removal of personal data, layer by layer, and an independent check of what is left.

Every layer is an expression on the text as the layer before left it; a document never leaves its row.
Layers run in a fixed order, birth dates before telephone numbers and those before addresses. Names
need a recogniser, which is a column that the caller may supply.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.patterns import every, has, let, swap, swap_if, unified_lines
from scriptorium.functions.vocabulary import PLACEHOLDERS
from scriptorium.operators.lines import current, lines_of, text_of


def placeholder(category: str) -> str:
    return PLACEHOLDERS.get(category, PLACEHOLDERS["other"])


def _names_any(text: Column, *words: str) -> Column:
    """Whether a text holds one of some lower-case words, in any case: a cheap look before a costly pattern."""
    return let(F.lower(text), lambda low: reduce(or_, (low.contains(w) for w in words)))


def _if(text: Column, wanted: Callable[[Column], Column], then: Callable[[Column], Column]) -> Column:
    return let(text, lambda t: F.when(wanted(t), then(t)).otherwise(t))


#: What the costly patterns can't do without.
_YEAR, _FOUR, _FIVE, _SEVEN, _CAPITAL_DIGIT = r"(?:19|20)\p{Nd}{2}", r"\p{Nd}{4}", r"\p{Nd}{5}", r"\p{Nd}(?:[^\p{Nd}\p{L}]{0,4}\p{Nd}){6}", r"[A-Z]\p{Nd}"
_BIRTH, _STREETS = ("birth", "d.o.b", "dob", "born", "geb"), ("strasse", "straße", "gasse", "platz")


def emails(text: Column) -> Column:
    return let(text, lambda t: F.when(t.contains("@"), F.regexp_replace(t, P.EMAIL, placeholder("email"))).otherwise(t))


#: Every profile link has this; texts without it aren't searched.
_SITE = r"(?i)\.(?:com|org|net|me)/|scholar\.google\."


def profiles(text: Column) -> Column:
    return let(text, lambda t: F.when(t.rlike(_SITE), swap(t, P.PROFILE, placeholder("profile_url"))).otherwise(t))


def handles(text: Column) -> Column:
    return swap(text, rf"^(\s*(?:{P.HANDLE_KEYS})\s*[:\-–|]\s*)(\S.*)$", "$1" + placeholder("profile_url"), lines=True)


def bank_details(text: Column) -> Column:
    return _if(text, lambda t: t.rlike(r"[A-Z]{2}\p{Nd}{2}"), lambda t: swap(t, P.IBAN, placeholder("bank"), ignore_case=False))


def id_numbers(text: Column) -> Column:
    keys = ("matri", "student", "ahv", "security", "passport", "ausweis", "driver", "personalnummer")
    return _if(text, lambda t: _names_any(t, *keys), lambda t: swap(t, rf"^.*\b(?:{P.ID_KEYS})\b.*$", placeholder("id_number"), lines=True))


def labelled_fields(text: Column) -> Column:
    return swap(text, rf"^(\s*[\W_]{{0,3}}(?:{P.FIELD_KEYS})[^\S\n]*[:：][^\S\n]*)(\S.*)$", "$1" + placeholder("contact_block"), lines=True)


def birth_dates(text: Column, as_of: str) -> Column:
    """Marked birth dates anywhere, dates near a birth word, and bare dates above the first year that is recent."""

    def near(t: Column) -> Column:
        each = F.transform(
            F.split(t, "\n"),
            lambda line: F.when(has(line, P.BIRTH_KEYS), swap(line, P.DATE_NEAR, placeholder("date_of_birth")))
            .when(is_birth_line(line, as_of), placeholder("date_of_birth")).otherwise(line),
        )
        return F.array_join(each, "\n")

    return _if(text, lambda t: t.rlike(_YEAR) | _names_any(t, *_BIRTH), near)


def is_birth_line(line: Column, as_of: str) -> Column:
    """A marked birth date, or a bare date whose year isn't too recent for one."""
    return line.rlike(_YEAR) & (has(line, P.MARKED_BIRTH_LINE) | (has(line, P.BARE_DATE_LINE, False) & (_year(line) <= F.year(F.lit(as_of).cast("date")) - 15)))


def _year(line: Column) -> Column:
    return F.regexp_extract(line, r"((?:19|20)\d{2})", 1).cast("int")


def is_phone(match: Column, line: Column) -> Column:
    """Whether digits of a candidate are a telephone number rather than dates or an identifier."""
    text = F.trim(match)
    digits = F.regexp_replace(text, r"\D", "")
    count = F.char_length(digits)
    bare = text.rlike(r"^\d{7,}$")
    labelled = has(line, P.PHONE_WORDS)
    separators = F.size(F.regexp_extract_all(text, F.lit(r"[\s./\-()]"), 0))
    is_date = has(text, P.YEAR_RANGE) | text.rlike(P.SINGLE_DATE) | P.has_range(text)
    dialled = text.startswith("+") | text.startswith("0")
    return (
        F.when(~count.between(7, 15) | is_date, False)
        .when(bare & text.startswith("0") & count.between(10, 15), True)
        .when(bare & ~labelled, False)
        .otherwise(dialled | labelled | (separators >= 2))
    )


def phones(text: Column) -> Column:
    """Candidates are found over the whole text; the label is looked for on the whole line on which a match begins."""

    def woven(t: Column) -> Column:
        rows = F.split(t, "\n")
        breaks = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit("")))
        pieces = F.zip_with(F.split(t, P.java(P.PHONE, True), -1), every(t, P.PHONE), lambda a, m: F.struct(a.alias("a"), m.alias("m")))

        def step(done: Column, x: Column) -> Column:
            at = done["at"] + breaks(x["a"])
            kept = F.when(x["m"].isNull(), "").when(is_phone(x["m"], F.get(rows, at)), placeholder("phone")).otherwise(x["m"])
            return F.struct((at + F.coalesce(breaks(x["m"]), F.lit(0))).alias("at"), F.array_append(done["out"], F.concat(x["a"], kept)).alias("out"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(pieces, start, step, lambda done: F.array_join(done["out"], ""))

    return _if(text, lambda t: t.rlike(_SEVEN), woven)


def looks_like_a_year(match: Column) -> Column:
    """A year before more than two words, or before a word that isn't a place's, is no postcode."""
    words = F.filter(F.split(F.trim(match), r"(?U)\s+"), lambda w: w != "")
    rest = F.slice(words, 2, 1000)
    place = F.forall(rest, lambda w: w.rlike(P.java(P.PLACE_WORD)))
    return F.get(words, F.lit(0)).rlike(r"^(?:19|20)\d{2}$") & ((F.size(rest) > 2) | ~place)


def welded_tail(match: Column) -> Column:
    """Three or more words in capitals at the end of an address belong to the next column."""
    tail = F.regexp_extract(match, r"(?:^|\s)((?:[A-ZÄÖÜ][A-ZÄÖÜ0-9.\-&]+\s+){2,}[A-ZÄÖÜ][A-ZÄÖÜ0-9.\-&]+)\s*$", 1)
    return F.when(match.rlike(r"\p{Ll}"), tail).otherwise("")


def _address(match: Column) -> Column:
    tail = welded_tail(match)
    return F.when(tail == "", placeholder("address")).otherwise(F.concat(F.lit(placeholder("address") + " "), tail))


def addresses(text: Column) -> Column:
    """Inline addresses, American and British ones, then postcode with city, which alone lets a street go."""
    numbered = r"\d[a-zA-Z]?\s*,\s*(?:[A-Za-z]{2})?[\s\-]?\d{4,5}\s"  # every inline address has this
    text = let(text, lambda t: F.when(t.rlike(P.java(numbered, True)), swap_if(t, P.INLINE_ADDRESS, lambda m, _: _address(m))).otherwise(t))
    text = _if(text, lambda t: t.rlike(_FIVE), lambda t: swap(t, P.US_ADDRESS, placeholder("address"), ignore_case=False))
    text = _if(text, lambda t: t.rlike(_CAPITAL_DIGIT), lambda t: swap(t, P.UK_POSTCODE, placeholder("address"), ignore_case=False))

    def with_city(t: Column) -> Column:
        has_city = _has_city(t)
        cities = swap_if(t, P.POSTCODE_CITY, lambda m, _: F.when(looks_like_a_year(m), m).otherwise(_address(m)), False, True)
        return F.when(has_city, swap(cities, P.STREET, placeholder("address"), lines=True)).otherwise(t)

    return _if(text, lambda t: t.rlike(_FOUR), with_city)


def nationalities(text: Column) -> Column:
    keys = ("nationalit", "staatsangeh", "citizenship", "heimatort", "place of origin")
    return _if(text, lambda t: _names_any(t, *keys), lambda t: swap(t, rf"^.*\b(?:{P.NATIONALITY_KEYS})\b.*$", placeholder("nationality"), lines=True))


def marital_status(text: Column) -> Column:
    line = rf"^.*\b(?:{P.MARITAL_KEYS})\b.*$"
    keys = ("marital", "civil", "familienstand", "zivilstand", "verheiratet", "ledig", "geschieden", "verwitwet")
    words = lambda t: swap(t, P.MARITAL_WORDS, placeholder("marital_status"))
    return _if(text, lambda t: _names_any(t, *keys), lambda t: F.when(has(t, line, lines=True), swap(t, line, placeholder("marital_status"), lines=True)).otherwise(words(t)))


#: Category and layer, in the order in which they run.
def layers(as_of: str) -> list[tuple[str, object]]:
    return [
        ("email", emails), ("profile_url", profiles), ("profile_url", handles), ("bank", bank_details), ("id_number", id_numbers),
        ("contact_block", labelled_fields), ("date_of_birth", lambda t: birth_dates(t, as_of)), ("phone", phones), ("address", addresses),
        ("nationality", nationalities), ("marital_status", marital_status),
    ]


def redact(docs: DataFrame, as_of: str, names: str | None = None) -> DataFrame:
    """``docs`` with redacted, categories (in order of the layers), residual and degraded.

    What the independent patterns still find after the layers is swept away and then looked for again.
    ``names`` is an array column of names to remove, longest first; without it the row is degraded.
    Columns of these four names, and those that begin with ``_redact_``, are replaced.
    """
    rows = docs.withColumn("_redact_0", unified_lines(F.col("text")))
    hits, at = [], "_redact_0"
    for n, (category, layer) in enumerate(layers(as_of), 1):
        rows = rows.withColumn(f"_redact_{n}", layer(F.col(at)))
        hits.append(F.when(F.col(f"_redact_{n}") != F.col(at), category))
        at = f"_redact_{n}"
    text = redact_names(F.col(at), F.col(names)) if names else F.col(at)
    if names:
        hits.append(F.when(text != F.col(at), "name"))
    rows = rows.withColumn("_redact_text", text)
    found = F.array_distinct(F.concat(F.filter(F.array(*hits), lambda c: c.isNotNull()), residual(F.col("_redact_text"), as_of)))
    rows = rows.withColumn("redacted", sweep(F.col("_redact_text"), as_of)).withColumn("categories", found).drop("_redact_text")
    return rows.withColumn("residual", residual(F.col("redacted"), as_of)).withColumn("degraded", F.lit(names is None)).drop(*[f"_redact_{k}" for k in range(n + 1)])


def redact_names(text: Column, names: Column, unless: str = "") -> Column:
    """Every part of every name, longest first, on word boundaries; parts under three letters stay.

    ``unless`` is a pattern that a part must not be followed by.
    """
    parts = F.filter(F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, r"[\s.,]+")))), lambda p: F.char_length(p) >= 3)
    ordered = F.array_sort(parts, lambda a, b: F.char_length(b) - F.char_length(a))
    quoted = lambda p: F.concat(F.lit(r"(?U)\b\Q"), p, F.lit(r"\E\b" + (f"(?!{unless})" if unless else "")))
    return F.aggregate(F.coalesce(ordered, F.array().cast("array<string>")), text, lambda t, p: F.regexp_replace(t, quoted(p), F.lit(placeholder("name"))))


RESIDUAL = [
    ("email", P.EMAIL, False), ("profile_url", P.PROFILE, True), ("bank", P.IBAN, False), ("address", P.US_ADDRESS, False),
    ("address", P.UK_POSTCODE, False), ("phone", r"\+\d{1,3}[\s./\-]?\(?\d{2,4}\)?(?:[\s./\-]?\d{2,4}){2,}", False),
]


#: What every match of a category has.
_QUICK = {"email": "@", "profile_url": _SITE, "bank": r"[A-Z]{2}\d{2}", "address": r"\d", "phone": r"\+\d"}


def _has_city(text: Column) -> Column:
    return F.exists(every(text, P.POSTCODE_CITY, False, True), lambda m: ~looks_like_a_year(m))


def residual(text: Column, as_of: str | None = None) -> Column:
    """Categories that patterns of their own still find; lines of birth dates are looked for where ``as_of`` is given."""

    def found(t: Column) -> Column:
        hits = [F.when(t.rlike(_QUICK[c]) & has(t, p, i), c) for c, p, i in RESIDUAL]
        hits.append(F.when(t.rlike(_QUICK["address"]) & ((_names_any(t, *_STREETS) & has(t, P.STREET_NUMBER)) | (t.rlike(_FOUR) & _has_city(t))), "address"))
        if as_of:
            hits.append(F.when(t.rlike(_YEAR) & F.exists(F.split(t, "\n"), lambda line: is_birth_line(line, as_of)), "date_of_birth"))
        return F.array_distinct(F.filter(F.array(*hits), lambda c: c.isNotNull()))

    return let(text, found)


def sweep(text: Column, as_of: str | None = None) -> Column:
    for category, pattern, fold in RESIDUAL:
        text = let(text, _swept(category, pattern, fold))
    text = _if(text, lambda t: _names_any(t, *_STREETS), lambda t: swap(t, P.STREET_NUMBER, placeholder("address")))
    city = lambda m, _: F.when(looks_like_a_year(m), m).otherwise(placeholder("address"))
    text = _if(text, lambda t: t.rlike(_FOUR), lambda t: swap_if(t, P.POSTCODE_CITY, city, False, True))
    if as_of:
        by_line = lambda line: F.when(is_birth_line(line, as_of), placeholder("date_of_birth")).otherwise(line)
        text = _if(text, lambda t: t.rlike(_YEAR), lambda t: F.array_join(F.transform(F.split(t, "\n"), by_line), "\n"))
    return text


def _swept(category: str, pattern: str, fold: bool) -> Callable[[Column], Column]:
    return lambda t: F.when(t.rlike(_QUICK[category]), swap(t, pattern, placeholder(category), fold)).otherwise(t)


def drop_personal_sections(docs: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, text without what stands under a heading of personal details (headings: doc_id, line_no, display)."""
    marked = lines_of(docs).join(headings.select("doc_id", "line_no", "display"), ["doc_id", "line_no"], "left")
    kept = marked.withColumn("under", current("display")).where("under IS NULL OR under <> 'Personal Details'")
    return docs.select("doc_id").distinct().join(text_of(kept), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def looks_like_a_name(line: Column, role_words: list[str]) -> Column:
    """Two to four capitalised words without digits, signs or the words of roles."""
    text = F.trim(line)
    words = F.filter(F.split(F.replace(text, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")
    plain = F.forall(words, lambda w: ~F.lower(F.regexp_replace(w, r"^\.+|\.+$", "")).isin(role_words) & ~F.substring(w, 1, 1).rlike(r"\p{Ll}"))
    return F.char_length(text).between(3, 60) & ~text.rlike(r"[\d@]") & F.size(words).between(2, 4) & plain & ~has(text, P.SALUTATION_START)
