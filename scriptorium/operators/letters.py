"""Cover letters: the recipient and the author are removed, and what a letter has is listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.patterns import has, java, let, swap
from scriptorium.functions.vocabulary import PLACEHOLDERS
from scriptorium.operators.lines import by_line, lines_of
from scriptorium.operators.redaction import redact_names

MAX_ADDRESS_LINES = 18
# --- fixed values ---
ATTENTION = (
    r"^(\s*(?:z\.?\s*hd\.?(?:\s+von)?|zu\s+h[äa]nden(?:\s+von)?|attn\.?|attention|for the attention of|f\.?\s*a\.?\s*o\.?)\s*[:.]?\s*)(\S.*)$"
)
SALUTATION = r"^(\s*(?:dear|sehr\s+geehrte[rn]?|liebe[rs]?|guten\s+tag)\b[\s,]*)(.*)$"
HONORIFIC = r"^(?:mr|mrs|ms|miss|dr|prof(?:essor)?|herr|frau)\b\.?\s+"
GENERIC_TAIL = (
    r"^(?:sir|sirs|madam|madams|sir or madam|sir/madam|hiring\s+(?:manager|team|committee)|recruit(?:ment|ing)\s+team|recruiter|"
    r"ladies\s+and\s+gentlemen|damen\s+und\s+herren|damen|herren|team|colleagues|all)\b[\s,.:;!-]*$"
)
COMPANY_SUFFIX = (
    r"\b(?:ag|gmbh|sa|sarl|ltd|limited|llp|llc|inc|plc|kg|se|ohg|gbr|co|corp|holding|group|gruppe|bank|universit[äay]t?|university|"
    r"hochschule|spital|klinik|stiftung|verein|kanton|stadt|gemeinde)\b\.?\s*$"
)
CLOSING = (
    r"^(\s*(?:yours?\s+(?:sincerely|faithfully|truly)|kind(?:est)?\s+regards|best\s+(?:regards|wishes)|sincerely(?:\s+yours)?|warm\s+regards|"
    r"regards|mit\s+freundlichen\s+gr[üu]e?(?:ss|ß)en|freundliche\s+gr[üu]e?(?:ss|ß)e|mit\s+besten\s+gr[üu]e?(?:ss|ß)en|"
    r"beste\s+gr[üu]e?(?:ss|ß)e|herzliche\s+gr[üu]e?(?:ss|ß)e|hochachtungsvoll)\s*[,.]?\s*)(.*)$"
)
COMPANY_FOLLOWS = (
    r"[\s\-]+(?:AG|GmbH|SA|SARL|Ltd|Limited|LLP|LLC|Inc|PLC|KG|SE|OHG|GbR|Co|Corp|Holding|Group|Gruppe|Bank|Stiftung|Verein|Institut|Institute|"
    r"University|Universit[äa]t|Hochschule)\b"
)
LEFTOVER_HONORIFIC = r"\b(?:mr|mrs|ms|miss|dr|prof(?:essor)?|herr|frau)\b\.?\s+(?=\[[A-Z ]+\])"
CHECKS = {
    "salutation": r"(?m)^\s*(?:dear|sehr\s+geehrte|liebe|guten\s+tag)\b", "closing": r"(?m)" + CLOSING,
    "reference": r"(?m)^\s*(?:re|ref|reference|betreff|subject|application)\b\s*[:\-]", "availability": r"\b(?:available|availability|start(?:ing)? (?:date|in|on|from)|verfügbar|ab sofort)\b",
}


def _tail(line: Column, pattern: str) -> Column:
    text = F.trim(F.regexp_extract(line, java(pattern, True), 2), F.lit(" ,.:;"))
    return F.trim(swap(text, HONORIFIC, ""), F.lit(" ,.:;"))


def capitalised(line: Column) -> Column:
    """Two to four words with a capital, no digit, sign or colon."""
    words = F.filter(F.split(F.replace(F.trim(line), F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda w: w != "")
    return F.size(words).between(2, 4) & ~line.rlike(r"[\d@:]") & F.forall(words, lambda w: ~w.rlike(r"^\p{Ll}")) & F.char_length(F.trim(line)).between(3, 60)


def letter_lines(letters: DataFrame) -> DataFrame:
    """Lines with kind (attention, salutation, closing), the named tail and whether they stand above the salutation."""
    rows = lines_of(letters)
    kind = F.when(has(F.col("line"), ATTENTION), "attention").when(has(F.col("line"), SALUTATION), "salutation").when(has(F.col("line"), CLOSING), "closing")
    tail = F.when(F.col("kind") == "attention", _tail(F.col("line"), ATTENTION)).when(F.col("kind") == "salutation", _tail(F.col("line"), SALUTATION))
    rows = rows.withColumn("kind", kind).withColumn("tail", tail)
    rows = rows.withColumn("tail", F.when((F.col("tail") != "") & ~has(F.col("tail"), GENERIC_TAIL), F.col("tail")))
    cut = F.min(F.when(F.col("kind") == "salutation", F.col("line_no"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("above", F.col("line_no") < F.coalesce(cut, F.lit(MAX_ADDRESS_LINES)))


def signers(rows: DataFrame) -> DataFrame:
    """doc_id, author: the name-shaped text on the closing line or the first of the three lines below it."""
    window = by_line()
    below = [F.trim(F.lead("line", k).over(window), F.lit(" ,.")) for k in (1, 2, 3)]
    own = F.trim(F.regexp_extract("line", java(CLOSING, True), 2), F.lit(" ,."))
    said = F.filter(F.array(own, *below), lambda t: t.isNotNull() & (t != ""))
    first = F.get(said, F.lit(0))
    found = rows.withColumn("candidate", F.when((F.col("kind") == "closing") & capitalised(first) & ~first.rlike(r"\[[A-Z ]+\]"), first))
    return found.where("candidate IS NOT NULL").groupBy("doc_id").agg(F.min_by("candidate", "line_no").alias("author"))


def strip_letter(letters: DataFrame) -> DataFrame:
    """``letters`` (doc_id, text, already redacted) with redacted: tails, address block, recipient and author replaced.

    A recipient's parts go everywhere in the letter; lines above the salutation that are a few capitalised
    words go unless they name a company.
    """
    rows = letter_lines(letters)
    mark = PLACEHOLDERS["recipient"]
    opener = F.when(F.col("kind") == "attention", F.regexp_extract("line", java(ATTENTION, True), 1)).otherwise(F.regexp_extract("line", java(SALUTATION, True), 1))
    person = F.col("above") & F.col("kind").isNull() & capitalised(F.col("line")) & ~has(F.trim("line"), COMPANY_SUFFIX) & ~F.col("line").rlike(r"\[[A-Z ]+\]")
    shown = F.when(F.col("tail").isNotNull(), F.concat(F.rtrim(opener), F.lit(" " + mark))).when(person, mark).otherwise(F.col("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", shown.alias("line")))), lambda x: x["line"])
    made = rows.groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("redacted"), F.collect_set("tail").alias("recipients"))
    made = made.join(signers(rows), "doc_id", "left").withColumn("redacted", F.replace(redact_names(F.col("redacted"), F.col("recipients"), COMPANY_FOLLOWS), F.lit(PLACEHOLDERS["name"]), F.lit(mark)))
    signed = redact_names(F.col("redacted"), F.when(F.col("author").isNotNull(), F.array("author")), COMPANY_FOLLOWS)
    return made.select("doc_id", let(signed, lambda t: swap(t, LEFTOVER_HONORIFIC, "")).alias("redacted"), (F.size("recipients") > 0).alias("had_recipient"), F.col("author").isNotNull().alias("had_author"))


def checklist(letters: DataFrame) -> DataFrame:
    """doc_id, item, present of the measured items; null texts have none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = F.array(*[F.struct(F.lit(k).alias("item"), has(text, p).alias("present")) for k, p in CHECKS.items()])
    return letters.select("doc_id", F.explode(items).alias("i")).select("doc_id", "i.item", "i.present")
