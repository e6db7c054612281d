"""Measured facts about the writing of a CV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.patterns import has, java, let, worked
from scriptorium.functions.vocabulary import BUZZWORDS, GERUND_NOUNS, SPELLING_PAIRS, WEAK_OPENERS
from scriptorium.operators.entries import bullet_text, is_bullet
from scriptorium.operators.guardrails import language_of

MIN_OUTCOME_BULLETS, OUTCOME_SHARE = 4, 0.4


def words_in(text: Column, words: list[str]) -> Column:
    """The listed words that stand in a text as whole words, in the list's order."""
    stands = lambda low, w: low.contains(w) & low.rlike(rf"(?U)\b\Q{w}\E\b")
    return let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(stands(low, w), F.lit(w)) for w in words])))


def writing_facts(docs: DataFrame) -> DataFrame:
    """doc_id, buzzwords, spelling_pairs (British forms whose American one is there too), mixed_spelling."""
    docs = worked(docs.select("doc_id", "text"), "low", F.lower(F.coalesce(F.col("text"), F.lit(""))))
    text = F.col("low")
    word = lambda w: text.contains(w) & text.rlike(rf"(?U)\b{w}\b")
    british = F.coalesce(*[F.when(word(b), True) for b, _ in SPELLING_PAIRS], F.lit(False))
    american = F.coalesce(*[F.when(word(a), True) for _, a in SPELLING_PAIRS], F.lit(False))
    pairs = F.filter(F.array(*[F.when(word(b) & word(a), F.lit(b)) for b, a in SPELLING_PAIRS]), lambda p: p.isNotNull())
    return docs.select("doc_id", words_in(text, BUZZWORDS).alias("buzzwords"), pairs.alias("spelling_pairs"), (british & american).alias("mixed_spelling"))


def bullets_of(lines: DataFrame) -> DataFrame:
    """``lines`` that are bullets, with their text, whether they open weakly and whether they name an outcome."""
    text = F.lower("bullet")
    weak = F.exists(F.array(*[F.lit(w) for w in WEAK_OPENERS]), lambda w: text.startswith(w))
    rows = lines.where(is_bullet(F.col("line"))).withColumn("bullet", bullet_text(F.col("line")))
    return rows.withColumn("weak", weak).withColumn("outcome", has(F.col("bullet"), P.IMPACT))


def bullet_facts(bullets: DataFrame, *keys: str) -> DataFrame:
    """Per key: bullets, weak ones without an outcome, outcome share, mixed closing punctuation."""
    longer = F.char_length("bullet") > 12
    stops = F.count_if(longer & F.col("bullet").endswith("."))
    return bullets.groupBy(*keys).agg(
        F.count("*").alias("bullets"), F.count_if(F.col("weak") & ~F.col("outcome")).alias("weak_bullets"), F.count_if("outcome").alias("with_outcome"),
        ((F.count("*") >= MIN_OUTCOME_BULLETS) & (F.count_if("outcome") / F.count("*") < OUTCOME_SHARE)).alias("no_outcomes"),
        ((F.count_if(longer) >= 4) & (stops > 0) & (stops < F.count_if(longer))).alias("punctuation_mixed"),
    )


def mixed_tense(bullets: DataFrame) -> DataFrame:
    """doc_id, section, past, gerund: sections of three bullets or more that open in both forms."""
    past = F.col("bullet").rlike(java(r"^\w{3,}ed\b"))
    ing = F.regexp_extract("bullet", java(r"^(\w{4,}ing)\b"), 1)
    gerund = ~past & (ing != "") & ~F.lower(ing).isin(GERUND_NOUNS)
    found = bullets.groupBy("doc_id", "section").agg(
        F.count("*").alias("n"), F.min_by("bullet", F.when(past, F.col("line_no"))).alias("past"), F.min_by("bullet", F.when(gerund, F.col("line_no"))).alias("gerund")
    )
    return found.where("n >= 3 AND past IS NOT NULL AND gerund IS NOT NULL").drop("n")


def language_levels(lines: DataFrame) -> DataFrame:
    """doc_id, language, value, level of language lines: ``missing``, ``plain`` or ``cefr``; native ones are left out."""
    line = F.trim("line")
    name, value = (F.regexp_extract(line, java(P.LANGUAGE_LINE), k) for k in (1, 2))
    level = F.when(has(value, P.CEFR, False), "cefr").when(has(value, P.PLAIN_LEVEL), "plain").otherwise("missing")
    rows = lines.select("doc_id", "line_no", name.alias("language"), F.trim(value).alias("value"), level.alias("level"))
    return rows.where("language <> ''").where(~has(F.col("value"), P.NATIVE_LEVEL))


def bare_interests(lines: DataFrame) -> DataFrame:
    """doc_id, section, items: one or two words without a digit, of the first section of interests that has any."""
    item = F.trim(F.trim(F.trim("line"), F.lit("•-–—*· ")))
    words = F.size(F.filter(F.split(F.replace(item, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda w: w != ""))
    rows = lines.withColumn("item", item).where((F.col("item") != "") & ~F.col("item").rlike(r"\d") & words.between(1, 2) & (F.char_length("item") <= 28))
    found = rows.groupBy("doc_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "item"))), lambda x: x["item"]).alias("items"), F.min("line_no").alias("at"))
    return found.groupBy("doc_id").agg(F.min_by(F.struct("section", "items"), F.struct("at", "section")).alias("first")).select("doc_id", "first.*")


def unusual_bullets(lines: DataFrame, safe: str = "-•·*–—o") -> DataFrame:
    """doc_id, marks: signs that open lines and aren't among the safe ones."""
    mark = F.regexp_extract("line", r"(?U)^\s*([^\w\s\(\[\"'+#@&/<])\s+\S", 1)
    return lines.select("doc_id", mark.alias("mark")).where("mark <> ''").where(~F.instr(F.lit(safe), F.col("mark")).cast("boolean")).groupBy("doc_id").agg(F.array_sort(F.collect_set("mark")).alias("marks"))


def page_row(rows: DataFrame) -> DataFrame:
    """``rows`` (page_count, char_count) with pages (estimated where unknown) and status."""
    pages = F.coalesce("page_count", F.greatest(F.lit(1), F.bround(F.col("char_count") / 2800).cast("int")))
    return rows.withColumn("pages", pages).withColumn("status", F.when(F.col("pages") <= 2, "good").otherwise("attention"))


# --- fixed values ---
SERVICE_ROLE = (
    r"\b(?:kellner(?:in)?|serviceangestellte[rn]?|servicekraft|servicemitarbeiter(?:in)?|barista|barkeeper|küchenhilfe|koch|köchin|gastronomie|"
    r"hotellerie|waiter|waitress|server|bartender|bar\s?staff|host(?:ess)?|kitchen\s+(?:assistant|help|hand|porter|staff)|dishwasher|line\s+cook|"
    r"catering\s+(?:assistant|staff|crew)|food\s+service|wait\s?staff|runner)\b"
)
SUPERVISORY = (
    r"\b(?:manager|management|leiter(?:in)?|leitung|supervisor|supervising|head|chef(?:in)?|geschäftsführ\w*|inhaber(?:in)?|direktor|director|"
    r"owner|founder|gründer|teamlead|team\s?lead|shift\s?lead)\b"
)
HARD_SKILL = (
    r"\b(?:excel|word|powerpoint|office|python|r|sql|sap|matlab|stata|spss|tableau|power ?bi|bloomberg|photoshop|figma|java|javascript|html|css|git|"
    r"latex|access|vba|salesforce|erp|canva|deutsch|german|englisch|english|französisch|french|spanisch|spanish|italienisch|italian|chinese|"
    r"[ABC][12]|muttersprache|native|fluent|fliessend|verhandlungssicher|advanced|intermediate|basic|grundkenntnisse|proficient|beginner)\b"
)
SKILL_LEVEL = (
    r"\b(?:native|fluent|advanced|intermediate|basic|proficient|beginner|expert|conversational|working knowledge|[ABC][12]|grundkenntnisse|grundlagen|"
    r"fortgeschritten|verhandlungssicher|sehr gut|gut|sicher|erfahren|kenntnisse)\b"
)
TECHNICAL = (
    r"\b(?:it|edv|ikt|technical|technisch\w*|computer|software|hardware|digital\w*|tool\w*|programmier\w*|programming|coding|anwendung\w*|application\w*|"
    r"system\w*|data|daten|analytic\w*|office)\b"
)
ONLY_A_GRADE = (
    r"^[\W_]*(?:(?:grade|grades|note|noten|notendurchschnitt|gesamtnote|abschlussnote|gpa|cgpa|average|durchschnitt|final|overall|cumulative|mark|marks|"
    r"score|of|out|von|mit)\b[\W_]*){1,4}[\d.,/\s]*$"
)
ROLE_TITLE = (
    r"\b(?:analyst|manager|consultant|intern|internship|assistant|associate|advisor|engineer|developer|designer|researcher|scientist|coordinator|director|"
    r"officer|specialist|trainee|tutor|teacher|lead|head|founder|freelance|volunteer|president|treasurer|secretary|chair|ambassador|representative|"
    r"supervisor|administrator|controller|auditor|praktikant\w*|werkstudent\w*|assistent\w*|berater\w*|mitarbeiter\w*|leiter\w*|leitung|vorstand)\b"
)
DEGREE = (
    r"bachelor|master|diplom|magister|licence|laurea|staatsexamen|lizentiat|abitur|matura|baccalaureate|bakkalaureat|\b(?:ba|bsc|b\.sc|ma|msc|m\.sc|mba|llb|llm)\b"
)
DOCTORATE = r"phd|ph\.d|doctorate|doktor|promotion|dr\.rer|d\.phil"
SENTENCE = r"[a-zäöüß]{3,}\s+[a-zäöüß]{3,}\s+[a-zäöüß]{3,}"


def is_routine_service(title: Column) -> Column:
    return has(title, SERVICE_ROLE) & ~has(title, SUPERVISORY)


def is_degree(value: Column) -> Column:
    return has(value, DEGREE) & ~has(value, DOCTORATE)


def has_role_title(entry_line: Column, title_line: Column, detail: Column) -> Column:
    """Two parts of some length around a separator, or one part with a role's word."""
    combined = F.concat_ws(" | ", *[F.when(F.trim(c) != "", c) for c in (title_line, entry_line, detail)])
    parts = F.filter(F.transform(F.split(F.regexp_replace(combined, java(P.RANGE, True), ""), r"[|,–—]|\s-\s"), lambda x: F.trim(x)), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return F.coalesce((F.size(parts) >= 2) & (F.char_length(first) > 2) & (F.char_length(second) > 2), F.lit(False)) | ((F.size(parts) == 1) & has(first, ROLE_TITLE))


def thin_education(entries: DataFrame) -> DataFrame:
    """doc_id, entry_no, title of education entries under which nothing but a grade stands."""
    kept = F.filter(F.concat("bullets", "description"), lambda t: (F.trim(t) != "") & ~has(F.trim(t), ONLY_A_GRADE))
    title = F.when(F.col("title_line") != "", F.col("title_line")).otherwise(F.col("line"))
    return entries.where(F.size(kept) == 0).select("doc_id", "entry_no", F.substring(title, 1, 70).alias("title"))


def unlabelled_intro(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, intro: prose of eighty characters or more above the first heading, its first two hundred."""
    first = headings.groupBy("doc_id").agg(F.min("line_no").alias("first"))
    prose = lines.join(first, "doc_id").where("line_no < first").where((F.char_length(F.trim("line")) > 40) & F.lower("line").rlike(SENTENCE) & ~is_bullet(F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))), lambda x: x["line"]), " ")
    return prose.groupBy("doc_id").agg(joined.alias("intro")).where(F.char_length("intro") >= 80).select("doc_id", F.substring("intro", 1, 200).alias("intro"))


def soft_skills_only(lines: DataFrame) -> DataFrame:
    """doc_id, section, traits of skills sections of fourteen lines at most with two traits and no checkable skill."""
    line = F.trim(F.trim("line"), F.lit(" -–—•*·\t"))
    rows = lines.withColumn("content", line).where("content <> ''")
    found = rows.groupBy("doc_id", "section").agg(F.count("*").alias("n"), F.bool_or(has(F.col("content"), HARD_SKILL)).alias("hard"), F.array_join(F.collect_list("content"), " ").alias("all"))
    found = found.withColumn("traits", words_in(F.col("all"), BUZZWORDS)).where("n <= 14 AND NOT hard AND size(traits) >= 2")
    return found.select("doc_id", "section", F.slice("traits", 1, 6).alias("traits"))


def skills_without_level(lines: DataFrame) -> DataFrame:
    """doc_id, section, items: three or more technical items without a level, where a heading or label says they are technical."""
    text = bullet_text(F.col("line"))
    label, rest = F.trim(F.split_part(text, F.lit(":"), F.lit(1))), F.trim(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    labelled = (rest != "") & has(label, TECHNICAL)
    rows = lines.where((F.trim("line") != "") & ~has(text, SKILL_LEVEL)).where(labelled | has(F.col("section"), TECHNICAL))
    items = F.transform(F.split(F.when(labelled, rest).otherwise(text), r"\s*[,;/()\x{2022}\x{B7}|]\s*|\s+(?:and|und)\s+"), lambda i: F.trim(i, F.lit(" .-–—()")))
    kept = F.filter(items, lambda i: F.char_length(i).between(2, 28) & (F.size(F.split(i, r"\s+")) <= 3) & i.rlike(r"\p{L}") & ~i.rlike(r"(?:19|20)\d{2}") & ~F.lower(i).isin(BUZZWORDS))
    rows = rows.select("doc_id", "section", "line_no", F.posexplode(kept).alias("k", "item"))
    found = rows.groupBy("doc_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "k", "item"))), lambda x: x["item"]).alias("items"))
    return found.where(F.size("items") >= 3)


def ats_row(docs: DataFrame, headings: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs`` (doc_id, table_count) with problems and status: icons at headings, odd bullets, tables.

    ``headings`` (doc_id, damage), ``marks`` (doc_id, marks).
    """
    damaged = headings.where("damage = 'icon'").groupBy("doc_id").agg(F.count("*").alias("icons"))
    rows = docs.join(damaged, "doc_id", "left").join(marks, "doc_id", "left")
    problems = F.filter(F.array(F.when(F.col("icons") > 0, "icon_headings"), F.when(F.size("marks") > 0, "bullets"), F.when(F.col("table_count") > 0, "tables")), lambda p: p.isNotNull())
    return rows.select("doc_id", problems.alias("problems"), F.when(F.size(problems) > 0, "attention").otherwise("good").alias("status"))


def writing_row(docs: DataFrame, headings: DataFrame, months: DataFrame) -> DataFrame:
    """doc_id, problems (written, meant), spelling, status: repaired headings, then mistyped months, and the spelling.

    ``headings`` (doc_id, line_no, line, display, damage), ``months`` (doc_id, pos, written, meant). The
    spelling is null in a German text, else ``mixed`` or ``consistent``, reported either way.
    """
    typos = headings.where("damage = 'typo'").select("doc_id", F.lit(0).alias("kind"), F.col("line_no").alias("at"), F.trim("line").alias("written"), F.col("display").alias("meant"))
    both = typos.unionByName(months.select("doc_id", F.lit(1).alias("kind"), F.col("pos").alias("at"), "written", "meant"))
    listed = both.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "at", "written", "meant"))), lambda x: F.struct(x["written"].alias("written"), x["meant"].alias("meant"))).alias("problems"))
    mixed = writing_facts(docs).select("doc_id", "mixed_spelling")
    spelling = F.when(language_of(F.col("text")) == "de", None).otherwise(F.when(F.col("mixed_spelling"), "mixed").otherwise("consistent"))
    rows = docs.join(mixed, "doc_id", "left").join(listed, "doc_id", "left").withColumn("spelling", spelling)
    good = F.col("problems").isNull() & ~F.coalesce(F.col("mixed_spelling"), F.lit(False))
    return rows.select("doc_id", F.coalesce("problems", F.array().cast("array<struct<written:string,meant:string>>")).alias("problems"), "spelling", F.when(good, "good").otherwise("attention").alias("status"))
