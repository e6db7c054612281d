"""Regular expressions in Java's dialect, and the expressions that apply them.

``(?U)`` gives word, digit, space and boundary classes their Unicode meaning and ``(?iu)`` folds case
beyond ASCII. Line ends are normalised before ``(?m)`` is used. The patterns are fixed values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def java(pattern: str, ignore_case: bool = False, lines: bool = False) -> str:
    return f"(?U{'iu' if ignore_case else ''}{'m' if lines else ''}){pattern}"


# --- fixed values: personal data ---
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PROFILE = (
    r"(?:https?://)?(?:www\.)?(?:linkedin\.com/(?:in|pub)/[\w\-%.]+|xing\.com/profile/[\w\-%.]+|github\.com/[\w\-]+|gitlab\.com/[\w\-]+"
    r"|orcid\.org/[\dX\-]+|scholar\.google\.[a-z.]+/citations\?[^\s]+|researchgate\.net/profile/[\w\-%.]+|behance\.net/[\w\-]+"
    r"|dribbble\.com/[\w\-]+|medium\.com/@[\w\-.]+|(?:twitter|x)\.com/[\w]+|instagram\.com/[\w\-.]+|facebook\.com/[\w\-.]+|t\.me/[\w\-]+)/?"
)
HANDLE_KEYS = "linkedin|xing|github|gitlab|orcid|twitter|instagram|portfolio|website|homepage|blog"
IBAN = r"\b[A-Z]{2}\d{2}[\s]?(?:[A-Z0-9]{4}[\s]?){2,7}[A-Z0-9]{1,4}\b"
ID_KEYS = (
    r"matriculation(?: number| no\.?)?|matrikelnummer|student (?:id|number)|ahv|social security|passport (?:no\.?|number)|ausweisnummer|"
    r"driver'?s licen[cs]e|führerausweis|personalnummer"
)
FIELD_KEYS = (
    r"geburtsort|geburtsdatum|geburtstag|geboren|place of birth|date of birth|staatsangeh[öo]rigkeit\w*|nationalit[äa]t\w*|nationality|"
    r"citizenship|zivilstand|familienstand|marital status|civil status|adresse|anschrift|wohnhaft|address|telefon\w*|mobil\w*|handy|natel|"
    r"phone|mobile|tel|e-?mail|mail|alter|age|geschlecht|gender|sex|religion|konfession|ahv|sozialversicherung|social security|passnummer|"
    r"passport|matrikelnummer|student number|name|vorname|nachname|familienname|surname|first name|last name|full name"
)
_DAY = r"(?:\d{1,2}[.\s/-]\s*(?:\d{1,2}|[A-Za-zÄÖÜäöü]{3,10})[.\s/-]\s*(?:19|20)\d{2}|(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2})\s*\.?\s*$"
MARKED_BIRTH_LINE = r"^\s*(?:geb\.?|\*)\s*" + _DAY
BARE_DATE_LINE = r"^\s*(?:geb\.?|\*)?\s*" + _DAY
BIRTH_KEYS = r"(?:date of birth|d\.o\.b\.?|\bdob\b|born on|born in|geburtsdatum|geboren am|geb\.)"
DATE_NEAR = (
    r"(?:\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}|\d{4}[./\-]\d{1,2}[./\-]\d{1,2}|\d{1,2}\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|"
    r"januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember)[a-z]*\.?\s+\d{4})"
)
NATIONALITY_KEYS = "nationality|staatsangehörigkeit|citizenship|nationalität|heimatort|place of origin"
MARITAL_KEYS = "marital status|civil status|familienstand|zivilstand"
MARITAL_WORDS = r"\b(?:verheiratet|ledig|geschieden|verwitwet)\b"
FIELD_START, FIELD_END = r"(?:^|(?<=\s\s))", r"(?=$|\s\s)"
POSTCODE_CITY = (
    FIELD_START + r"[^\S\n]*(?:(?:CH|DE|AT|FR|IT|LI|LU|BE|NL)[^\S\n\-]*-?[^\S\n]*)?\d{4,5}[^\S\n]+[A-ZÄÖÜ][\w.\-äöüß]+"
    r"(?:[^\S\n]+[\w.\-äöüß]+)*?[^\S\n]*" + FIELD_END
)
PLACE_WORD = r"^(?:[A-ZÄÖÜ][\w.\-äöüß]*|an|am|bei|der|des|ob|im|in|auf|sur|sous|les|le|la|aux|près|pres|di|al|sul)$"
US_ADDRESS = r"\b[A-Z][\w.\-]+(?:[^\S\n]+[A-Z][\w.\-]+){0,2},[^\S\n]*[A-Z]{2}[^\S\n]+\d{5}(?:-\d{4})?\b"
UK_POSTCODE = r"\b[A-Z]{1,2}\d[A-Z\d]?[^\S\n]*\d[A-Z]{2}\b"
_STREETS = "straße|strasse|str\\.|gasse|weg|platz|allee|ring|steig|avenue|street|road|lane"
STREET = FIELD_START + rf"[^\S\n]*[A-ZÄÖÜ][\w.\-äöüß]*[^\S\n]?(?:{_STREETS})[[\w.\-][^\S\n]]*?[^\S\n]\d+[a-zA-Z]?[^\S\n]*" + FIELD_END
INLINE_ADDRESS = (
    rf"[A-ZÄÖÜ][\w.\-äöüß]*\s?(?:{_STREETS})[\w\s.\-]*\s+\d+[a-zA-Z]?\s*,\s*(?:CH|DE|AT|FR|IT|LI)?[\s\-]?\d{{4,5}}\s+"
    r"[A-ZÄÖÜ][\w.\-äöüß]+(?:[\s,]+[A-ZÄÖÜ][\w.\-äöüß]+)*"
)
STREET_NUMBER = r"\b\w*(?:strasse|straße|gasse|platz)\s*\d{1,4}\b"
PHONE_WORDS = r"\b(?:tel|telephone|phone|mobile|mobil|handy|cell|fon|natel|whatsapp)\b"
PHONE = r"(?<![\w])(?:\+\d{1,3}[\s./\-]?)?(?:\(?\d{2,4}\)?[\s./\-]?){2,6}\d{2,4}(?![\w])"
YEAR_RANGE = r"^(?:19|20)\d{2}\s*[-–—/.]\s*(?:19|20)\d{2}$"
SINGLE_DATE = r"^(?:[0-3]?\d[./\-][01]?\d[./\-](?:19|20)?\d{2}|(?:19|20)\d{2}[./\-][01]?\d[./\-][0-3]?\d)$"
CONTACT_LINE = (
    r"(?:@|\bhttps?://|\bwww\.|linkedin|xing|github|gitlab|orcid|\btel\b|\bmobile\b|\bmobil\b|\bphone\b|\bhandy\b|\bnatel\b|"
    r"\+\d{1,3}[\s\-./]?\d|strasse|straße|str\.|gasse|weg\b|platz\b|avenue|street|road\b|date of birth|geburtsdatum|geboren|born|"
    r"nationality|staatsangehörigkeit|citizenship|marital|familienstand|zivilstand|\b(?:CH|DE|AT)?[\s\-]?\d{4,5}\s+[A-ZÄÖÜ])"
)
HEADING_LINE = (
    r"^\s*[\W_]*(?:education|ausbildung|studium|akademisch\w*|experience|berufserfahrung|praktische erfahrung|praktika|work history|employment|"
    r"profile|summary|profil|kurzprofil|about me|über mich|objective|skills|kenntnisse|fähigkeiten|competenc\w*|it[- ]skills|edv|tools|"
    r"languages|sprachen|publications|publikationen|research|forschung|papers|projects|projekte|certificat\w*|zertifikate|weiterbildung|courses|kurse|training|"
    r"awards|honou?rs|auszeichnungen|stipendien|scholarships|preise|extracurricular\w*|ausserschulisch\w*|außerschulisch\w*|engagement|"
    r"interests|hobbies|interessen|freizeit|volunteer\w*|ehrenamt\w*|freiwilligenarbeit|references|referenzen|military|zivildienst|militärdienst)\b[\s\W_]*$"
)
SALUTATION_START = r"^\s*(?:dear\b|sehr\s+geehrte|liebe[rs]?\s|guten\s+tag|to\s+whom\b)"

# --- fixed values: dates ---
ENDPOINT = (
    r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]{3,9}\.?[,/-]?[ \t]{0,2}(?:19|20)\d{2}|[A-Za-z0-9]{3,4}\.?[ \t]{1,2}(?:19|20)\d{2}"
    r"|(?:0?[1-9]|1[0-2])\s*[./]\s*(?:19|20)\d{2}|(?:19|20)\d{2})"
)
PRESENT = "present|current|currently|now|today|ongoing|date|heute|aktuell|laufend|jetzt|bis heute"
SEPARATOR = r"\s*(?:[-–—]{1,2}|\bto\b|\bbis\b|\buntil\b)\s*"
END_QUALIFIER = r"(?:expected|anticipated|planned|estimated|est\.?|exp\.?|voraussichtlich|geplant|erwartet)\s+"
OPEN_PREFIX = r"(?:seit|since|ab|from|desde|depuis)\s+"
RANGE = rf"(?:{OPEN_PREFIX}({ENDPOINT})(?!{SEPARATOR})|({ENDPOINT}){SEPARATOR}(?:{END_QUALIFIER})?({ENDPOINT}|(?:{PRESENT})))"
#: What a line ends with if SINGLE_DATE_END stands in it; what that has before the year may be absent.
DATE_END = r"(?:19|20)\d{2}\s*[.,;)\]]?\s*$"
SINGLE_DATE_END = r"(?:[A-Za-zÀ-ÖØ-öø-ÿ]{3,9}\.?,?[ \t]{0,2}|(?:0?[1-9]|1[0-2])\s*[./]\s*)?(?:19|20)\d{2}\s*[.,;)\]]?\s*$"

# --- fixed values: lines of a CV ---
BULLETS = "-–—•·*▪■◦‣→▸▹►⁃∙"
BULLET_LINE = r"^\s*[\-–—•·*▪■◦‣→▸▹►⁃∙]\s+\S|^\s*o\s+(?=[A-ZÄÖÜ])"
GLYPHS = "-–—•·*▪■●○◦‣→▸▹►⁃∙◆❖➢✓»«"
FIELD_DATE = (
    r"^(?:(?:19|20)\d{2}|(?:0?[1-9]|1[0-2])[./](?:19|20)\d{2}|(?:Jan|Feb|M[aä]r|Apr|Mai|May|Jun|Jul|Aug|Sep|O[ck]t|Nov|De[cz])[a-z]*\.?\s*(?:19|20)\d{2})$"
)
INLINE_BULLET = r"\s[•·▪◦‣→▸▹►∙]\s+\S"
INDENTED_LINE = r"^(?:\t| {2,})\S"
IMPACT = (
    r"(?:\d+\s*%|\bby \d|\b\d[\d.,]*\s*(?:k|m|mn|bn|million|billion|chf|eur|usd|€|\$)|\breduc|\bincreas|\bimprov|\bgrew\b|\bgrowth\b|"
    r"\bsav(?:ed|ing)|\bresult(?:ing|ed)|\bleading to\b|\bachiev|\bdeliver(?:ed|ing)\b|\bwinning\b|\bsecured\b)"
)
CEFR = r"\b[ABC][12]\b"
PLAIN_LEVEL = (
    r"\b(?:native|fluent|advanced|intermediate|basic|proficient|beginner|conversational|mother ?tongue|muttersprache|fliessend|"
    r"verhandlungssicher|grundkenntnisse)\b"
)
NATIVE_LEVEL = r"\b(?:native|mother ?tongue|muttersprache)\b"
LANGUAGE_LINE = r"^\s*([A-Za-zÄÖÜäöü]{3,20})\s*[:\-–]\s*(\S.*)$"
GRADE_WORDS = (
    r"\b(?:grade|grades|grade average|gpa|cgpa|note|notendurchschnitt|durchschnitt|abitur|matura|final grade|overall grade|classification|"
    r"graded|mark|marks|\w*note|\w*schnitt|gesamtnote|abschlussnote|endnote|maturanote)\b"
)
#: One of these stands in every word of GRADE_WORDS.
GRADE_STEMS = "grade|gpa|note|schnitt|abitur|matura|classification|mark"
GRADE_NUMBER = r"(?<![\w.,])(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:/\s*(\d{1,3}(?:[.,]\d{1,2})?))?(?![\d])"
MONTH_WORD = (
    r"jan(?:uar|uary)?|feb(?:ruar|ruary)?|m[äa]r(?:z|ch)?|apr(?:il)?|mai|may|jun[ie]?|jul[iy]?|aug(?:ust)?|sep(?:t|tember)?|"
    r"o[ck]t(?:ober)?|nov(?:ember)?|de[zc](?:ember)?"
)
DATE_IN_LINE = rf"\b[0-3]?\d\.\s*(?:{MONTH_WORD})\b|\b(?:{MONTH_WORD})\s+[0-3]?\d\b|\b[0-3]?\d[./][01]?\d[./](?:19|20)?\d{{2}}\b"
GERMAN_SCHOOL = r"\b(?:abitur|gymnasium|realschule|gesamtschule|oberstufe|fachhochschulreife|allgemeine hochschulreife|deutschland|germany)\b"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]"

# --- fixed values: conversations ---
CONFIDENTIAL = (
    r"\b(?:nda|non-disclosure|non disclosure|confidential|embargo|salary|compensation|signing bonus|base salary|total comp|offer letter|"
    r"verbal offer|return offer|chf\s?\d|eur\s?\d|usd\s?\d|€\s?\d|\$\s?\d|vertraulich|geheimhaltung|gehalt|jahresgehalt)\b"
)
SCORES = (
    r"(?:(?<![\d.])\d{1,3}\s*/\s*(?:10|100)\b|\bout of (?:10|100)\b|\bscore of\b|\brating of\b|\bi'?d rate\b|\brate it\b|"
    r"\b\d{1,3}\s?%\s?(?:complete|strong|ready)\b|\bgrade:\s?\w)"
)
REWRITE_ASKED = (
    r"(?:write it for me|rewrite (?:it|this|that)|just give me the (?:wording|words|bullet)|can you word it|do it for me|"
    r"give me an example bullet|just this once|give me a draft)"
)
REWRITE_GIVEN = r"(?:here'?s a (?:rewritten|revised|new) (?:version|bullet|line)|you could (?:write|say|put)\s*[:\-]|try this\s*[:\-]|suggested wording\s*[:\-])"
AFFIRMATIVE = r"^\s*(?:yes|y|yeah|yep|sure|please|ok|okay|ja|jep|klar|gerne|bitte)\b"

# --- fixed values: letters; umlauts in either spelling ---
OPENING_WORDS = r"\b(?:dear\b|sehr geehrte[rn]?\b|guten tag\b|liebe[rs]?\s+(?:frau|herr|team)\b|to whom it may concern\b)"
CLOSING_WORDS = (
    r"\b(?:yours sincerely|yours faithfully|kind regards|best regards|sincerely\b|mit freundlichen Gr(?:ü|ue|u)(?:ß|ss|s)en|"
    r"freundliche Gr(?:ü|ue|u)(?:ß|ss|s)e|herzliche Gr(?:ü|ue|u)(?:ß|ss|s)e|liebe Gr(?:ü|ue|u)(?:ß|ss|s)e|beste Gr(?:ü|ue|u)(?:ß|ss|s)e|"
    r"mit besten Gr(?:ü|ue|u)(?:ß|ss|s)en|freundlicher Gru(?:ß|ss|s)|viele Gr(?:ü|ue|u)(?:ß|ss|s)e)"
)
WRITTEN_WORD = r"[\p{L}\p{N}_'’\-]*[\p{L}\p{N}_][\p{L}\p{N}_'’\-]*"


def has(column: Column, pattern: str, ignore_case: bool = True, lines: bool = False) -> Column:
    return column.rlike(java(pattern, ignore_case, lines))


def has_range(column: Column) -> Column:
    """Whether a text holds a date range; texts without a year aren't searched."""
    return column.rlike(r"(?:19|20)\d{2}") & has(column, RANGE)


def every(column: Column, pattern: str, ignore_case: bool = True, lines: bool = False, group: int = 0) -> Column:
    return F.regexp_extract_all(column, F.lit(java(pattern, ignore_case, lines)), group)


def swap(column: Column, pattern: str, by: str | Column, ignore_case: bool = True, lines: bool = False) -> Column:
    return F.regexp_replace(column, java(pattern, ignore_case, lines), by)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def worked(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is computed once a row, however many filters and columns read it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def swap_if(column: Column, pattern: str, keep: Callable[[Column, Column], Column], ignore_case: bool = True, lines: bool = False) -> Column:
    """Each match becomes ``keep(match, text before it in its piece)``: the text is split and woven again."""

    def woven(text: Column) -> Column:
        parts, found = F.split(text, java(pattern, ignore_case, lines), -1), every(text, pattern, ignore_case, lines)
        return F.array_join(F.zip_with(parts, found, lambda a, m: F.concat(a, F.when(m.isNull(), "").otherwise(keep(m, a)))), "")

    return let(column, woven)


def unified_lines(column: Column) -> Column:
    """Every kind of line end as a line feed, one at the very end dropped; a null text is empty."""
    text = F.regexp_replace(F.coalesce(column, F.lit("")), r"\r\n|[\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]", "\n")
    return F.regexp_replace(text, r"\n\z", "")
