"""Reports as Markdown columns, and rules that clean the text of a hosted model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.patterns import java


#: Rules in order: what must hold for the answer, pattern, replacement, whether capitals count.
Rule = tuple[str | None, str, str, bool]
# --- fixed values: rules for a hosted model's answers ---
NO_EM_DASH: list[Rule] = [(None, r"\s*[,;:]?\s*—\s*", ", ", False), (None, r",\s*,", ",", False), (None, r",\s*([.!?])", "$1", False)]
_PLACE = r"(?:role|position|job|programme|program)"
NO_ADVERT_CLAIMS: list[Rule] = [
    ("no_advert", r"\b(?:to|with)\s+the\s+(?:skills?|qualities|competenc(?:e|ies)|attributes|requirements?)(?:\s+and\s+\w+)?\s+(?:relevan(?:t|ce)|needed|required|necessary|expected|sought|looked\s+for|asked\s+for)\s+(?:to|for|in|by|of)?\s*(?:the\s+)?(?:\w+\s+)?" + _PLACE + r"\b", "to the desired role", True),
    ("no_advert", r"\bwhat\s+the\s+(?:role|position|job|programme|program|advert|employer|company|organisation|organization)\s+(?:requires|needs|is\s+looking\s+for|asks\s+for|demands)\b", "the role you are aiming for", True),
    ("no_advert", r"\b(?:zu|mit)\s+den\s+(?:für\s+die\s+\w*\s*(?:Stelle|Position)\s+)?relevanten\s+(?:Fähigkeiten|Faehigkeiten|Kompetenzen)(?:\s+und\s+\w+)?", "zur angestrebten Stelle", True),
    ("no_advert", r"\b(?:your|the|their)\s+relevant\s+(?:skills|experience|qualities|competenc(?:e|ies))\b", "the skills you describe", True),
    ("no_advert", r"\brelevant\s+(?:skills|experience|qualities|competenc(?:e|ies))\b", "the skills you describe", True),
    ("no_advert", r"\brelevante[nrs]?\s+(?:Fähigkeiten|Faehigkeiten|Kompetenzen|Erfahrungen?)\b", "die von dir beschriebenen Fähigkeiten", True),
    ("no_advert", r"\brelevan(?:t|ce)\s+(?:to|for)\s+the\s+(?:advertised\s+|target\s+|trainee\s+|specific\s+)?(?:position|role|job|programme|program)\b", "connected to the role you are aiming for", True),
    ("no_advert", r"\b(?:match(?:es|ing)?|fit(?:s|ting)?)\s+(?:the\s+)?(?:role'?s?\s+|position'?s?\s+)?requirements\b", "connects to the role you are aiming for", True),
    ("no_advert", r"\brelevant\s+für\s+die\s+(?:angestrebte\s+|ausgeschriebene\s+)?(?:Stelle|Position)\b", "mit Bezug auf die angestrebte Stelle", True),
    ("no_advert", r"\bpassend\s+(?:für|zu)\s+(?:die|der)\s+(?:Stelle|Position)\b", "mit Bezug auf die angestrebte Stelle", True),
    ("no_advert", r"\bentspricht\s+den\s+Anforderungen\b", "hat Bezug auf die angestrebte Stelle", True),
]
NO_CV_CLAIMS: list[Rule] = [
    ("no_cv", r"\b(?:on|in)\s+your\s+CV\b", "on a CV", True), ("no_cv", r"\byour\s+CV\s+already\b", "a CV would already", True), ("no_cv", r"\byour\s+CV\b", "a CV", True), ("no_cv", r"\byour\s+r[eé]sum[eé]\b", "a CV", True),
    ("no_cv", r"\b(?:in|auf)\s+deinem\s+Lebenslauf\b", "in einem Lebenslauf", True), ("no_cv", r"\bdeinen\s+Lebenslauf\b", "einen Lebenslauf", True), ("no_cv", r"\bdeines\s+Lebenslaufs\b", "eines Lebenslaufs", True),
    ("no_cv", r"\bdeinem\s+Lebenslauf\b", "einem Lebenslauf", True), ("no_cv", r"\bdein\s+Lebenslauf\b", "ein Lebenslauf", True),
]
THIRD_PERSON = (
    r"\b(?:the\s+(?:candidate|applicant|author|student|writer)(?:'s|s')?|der\s+(?:Kandidat|Bewerber|Verfasser|Studierende)\w*|"
    r"die\s+(?:Kandidatin|Bewerberin|Verfasserin|Studierende)\w*|des\s+(?:Kandidaten|Bewerbers|Verfassers)|dem\s+(?:Kandidaten|Bewerber|Verfasser))\b"
)
SECOND_PERSON: list[Rule] = [
    ("third_person", rf"\b{the} {who}{verb}\b", f"{You}{new}", False)
    for who, verbs in (("candidate", ("'s", " has", " is", " does", " was")), ("applicant", ("'s", " has", " is")))
    for verb in verbs
    for the, You in (("The", "You"), ("the", "you"))
    for new in ({"'s": "r", " has": " have", " is": " are", " does": " do", " was": " were"}[verb],)
]
ANSWER_RULES = [*SECOND_PERSON, *NO_EM_DASH, *NO_ADVERT_CLAIMS, *NO_CV_CLAIMS]


def written_text(overall: str = "overall", essentials: str = "essentials", repetitive: str = "repetitive") -> Column:
    """Everything in an answer that a reader will read; what it quotes is not part of it."""
    none = F.array().cast("array<string>")
    values = F.coalesce(F.map_values(essentials), none)
    issues = F.coalesce(F.transform(repetitive, lambda p: p["issue"]), none)
    return F.array_join(F.concat(F.array(F.coalesce(overall, F.lit(""))), F.transform(values, lambda v: F.coalesce(v, F.lit(""))), F.transform(issues, lambda v: F.coalesce(v, F.lit("")))), " ")


def rewritten(answers: DataFrame, rules: list[Rule] = ANSWER_RULES) -> DataFrame:
    """``answers`` (overall, essentials, repetitive, facts) with every rule whose condition holds applied in order.

    essentials is a map of texts, repetitive an array of structs with issue and quote, facts the names of
    what holds for the answer; ``third_person`` holds where its own text speaks of the student. Each rule
    works on what the ones before it left. Quotes stay as they are; null texts stay null.
    """
    facts = F.coalesce("facts", F.array().cast("array<string>"))
    third = F.when(written_text().rlike(java(THIRD_PERSON, True)), F.array(F.lit("third_person"))).otherwise(F.array().cast("array<string>"))
    rows = answers.withColumn("_facts", F.concat(facts, third))
    table = F.array(*[F.struct(F.lit(c).alias("only_if"), F.lit(java(p, ignore)).alias("pattern"), F.lit(by).alias("by")) for c, p, by, ignore in rules]) if rules else None

    def clean(value: Column) -> Column:
        if table is None:
            return value
        holding = F.filter(table, lambda r: r["only_if"].isNull() | F.array_contains("_facts", r["only_if"]))
        return F.aggregate(holding, value, lambda text, r: F.regexp_replace(text, r["pattern"], r["by"]))

    issues = F.transform("repetitive", lambda p: p.withField("issue", clean(p["issue"])))
    return rows.withColumns({"overall": clean(F.col("overall")), "essentials": F.transform_values("essentials", lambda _, v: clean(v)), "repetitive": issues}).drop("_facts")


def escaped(value: Column) -> Column:
    """A table cell: bars escaped, line ends as spaces."""
    return F.regexp_replace(F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*\n\s*", " ")


def without_em_dashes(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\s*—\s*", ", "), r",\s*,", ",")


def without_bullet_counts(value: Column) -> Column:
    return F.regexp_replace(value, java(r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?=bullets?\b)", True), "")


def without_placeholders(value: Column) -> Column:
    """Quotations without the marks of redaction."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"\[[A-Z /]+ (?:REDACTED|REMOVED)\]", ""), r"[ \t]{2,}", " "))


def without_inline_urls(value: Column) -> Column:
    """Bracketed addresses that aren't the target of a link."""
    return F.regexp_replace(value, r"(?<!\])\s*\(https?://[^)\s]+\)", "")


def unwrapped(value: Column) -> Column:
    """Brackets that aren't a link's are taken off."""
    return F.regexp_replace(value, r"\[([^\]\n]+)\](?!\()", "$1")


def status_applied(sections: DataFrame, measured: DataFrame) -> DataFrame:
    """A worded section's status is the measured one where there is one; names compare without case."""
    own = measured.select("doc_id", F.lower("section").alias("name"), F.col("status").alias("measured"))
    return sections.withColumn("name", F.lower("section")).join(own, ["doc_id", "name"], "left").withColumn("status", F.coalesce("measured", "status")).drop("name", "measured")


def without_duplicate_points(points: Column, areas: Column, share: float = 0.7) -> Column:
    """Points less than ``share`` of whose words an area has."""
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(java(r"\w{3,}")), 0))
    overlap = lambda p, a: F.size(F.array_intersect(words(p), words(a))) / F.greatest(F.size(words(p)), F.lit(1))
    return F.filter(points, lambda p: ~F.exists(areas, lambda a: overlap(p, a) >= share))


def report(areas: DataFrame, statuses: DataFrame) -> DataFrame:
    """doc_id, markdown: the named areas, then a table of sections."""
    listed = areas.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("area", "key"))), lambda x: F.concat(F.lit("1. "), x["key"])), "\n").alias("areas"))
    row = F.concat(F.lit("| "), escaped(F.col("section")), F.lit(" | "), F.col("status"), F.lit(" |"))
    table = statuses.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("table"))
    both = listed.join(table, "doc_id", "full")
    return both.select("doc_id", F.concat_ws("\n", F.lit("## Key areas\n"), "areas", F.lit("\n## Sections\n\n| Section | Status |\n| --- | --- |"), "table").alias("markdown"))


def write_markdown(reports: DataFrame, path: str) -> None:
    reports.select("markdown").write.text(path)
