"""Invented rows for rules that the synthetic tables don't trigger, as DataFrames and as SQL relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return repr(value)


class Relation:
    """Rows with named, typed columns; ``sql`` reads them in a FROM clause."""

    def __init__(self, schema: str, rows: Sequence[tuple]) -> None:
        self.schema, self.rows = schema, list(rows)
        self.names = [part.split()[0] for part in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in self.rows)
        return f"(VALUES {values}) AS fixture({', '.join(self.names)})"


CONTACT = Relation(
    "doc_id long, text string",
    [
        (-1, "Ada Muster\nada.muster@example.org\nLinkedIn: ada-muster-12\nhttps://www.linkedin.com/in/ada-muster/ and github.com/adam"),
        (-2, "IBAN CH93 0076 2011 6238 5295 7 for refunds\nMatrikelnummer 12-345-678\nnothing here"),
        (-3, "Geburtsort: Beispielstadt\nNationality: Swiss\nName: Ada Muster\nProject: Name of the game"),
        (-4, "Tel 079 000 00 00 und 2019-2022\n07/2018-01/2019\nFulda, 02.11.2019\n+41 44 000 00 00\n0791234567\nID 1234567"),
        (-5, "Musterweg 12, 8001 Zürich\n2021 Pflege der Boote\nCH-7999 St. Exempel\nSpringfield, IL 62799\nKW17 9ZZ"),
        (-6, "geb. 09.06.2001\nZivilstand: ledig\nverheiratet\n\n08. Juli 2025\nborn on 1 May 1999 in Bern"),
        (-7, ""),
        (-8, None),
    ],
)
ICONS = Relation("doc_id long, text string", [(-1, " Education\nplain\n\n ab"), (-2, "no icons"), (-3, None)])
CV = Relation(
    "doc_id long, text string",
    [
        (
            -1,
            "Education\nExample University Aug 2014 - Mai 2017\nBachelor in Geology\n- Grade: 4.9\n\nWork Experience\nMuster AG\nMapmaker 02/2018 - present\n"
            "- Reduced waste by 31% in the mill.\n- Responsible for rock samples\n- Supporting the drill crew\n- Prepared maps for guests\n"
            "Other AG\nIntern 03/2016 - 09/2016\nInterests\nKites\nOld maps of small islands\nSkills & Languages\nEnglish: C1\nGerman: native\nFrench - fluent\nItalian: a bit",
        ),
        (-2, "Selected Projects\n• Built a kite\n• Wrote a poem\n> odd mark\n> odd mark\n> odd mark\n£ once\nQ PRAKTIKA\nMuster GmbH 2011 - 2013\nnothing else"),
        (-3, None),
    ],
)
DAMAGED = Relation("doc_id long, text string", [(-1, "Educaxion\nPR0F1LE\nWork Experience\nIT & Languages\nEducation and a very long sentence about it.\nExperiemce\nH0BB1ES\nSK1L15\nArbeits- und Führungserfahrung\nPr0j3c70001")])
RANGE_LINES = Relation(
    "doc_id long, line_no int, line string",
    [
        (-1, 0, "Okt 2011 - Mai 2013 Bern"), (-1, 1, "03/2018 – 11/2019"), (-1, 2, "2004 - 2006 and 2007 - 2008"), (-1, 3, "04.2016 bis heute"), (-1, 4, "no dates"),
        (-2, 0, "abr/2007 - dez/2008"), (-2, 1, "08/2015 - 02/2015"), (-2, 2, "Mar,2004-Oct,2004"), (-2, 3, "Foo 2001 to Dec 2001"), (-2, 4, "5/2009 - expected 07/2027"),
    ],
)
SPLIT_LINES = Relation(
    "doc_id long, line_no int, line string",
    [(-1, 0, "02/2006"), (-1, 1, "05/2008"), (-1, 2, "Muster"), (-1, 3, "2001"), (-1, 4, "2002"), (-1, 5, "2003"), (-1, 6, "x"), (-2, 0, "2002"), (-2, 1, "y 2003")],
)
RANGES = Relation(
    "doc_id long, section string, entry_no int, raw string, s int, e int, months_explicit boolean",
    [
        (1, "EDU", 0, "a", 100, 110, True), (1, "EDU", 1, "b", 114, 134, True), (1, "EXP", 0, "c", 90, 104, True), (1, "EXP", 1, "d", 130, 140, True),
        (2, "EXP", 0, "e", 200, 220, True), (2, "EXP", 1, "f", 215, 240, True), (2, "EXP", 2, "g", 249, 260, False), (2, "EDU", 0, "h", 241, 247, True),
        (3, "EXP", 0, "i", 10, 20, True), (3, "EXP", 1, "j", 40, 50, True), (3, "EDU", 0, "k", 15, 22, False), (3, "EDU", 1, "l", 16, 18, True),
    ],
)
EXTRA_RANGES = Relation("doc_id long, raw string, s int, e int", [(1, "xa", 1, 2), (1, "x", 2, 3), (1, "zz", 3, 4), (9, "new", 5, 6), (9, "ne", 6, 7)])
GRADE_LINES = Relation(
    "doc_id long, line_no int, line string",
    [
        (-1, 0, "Oberstufe Mannheim, Aug 2001 - Mai 2009"), (-1, 1, "Endnote: 2,4"), (-1, 2, "Universität Basel"), (-1, 3, "Overall grade: 476"),
        (-2, 0, "MSc, Lausanne, grade 4.6/6"), (-2, 1, "GPA 4.3, Bern"), (-2, 2, "Matura 5. Mai 2008"), (-3, 0, "no marks"), (-4, 0, "Final grade 24/30, Bologna"),
    ],
)
ENTRIES = Relation("doc_id long, entry_no int, has_grade boolean", [(1, 0, True), (1, 1, False), (2, 0, True), (2, 1, True), (3, 0, True), (4, 0, False), (4, 1, False)])
HEADINGS_FOUND = Relation(
    "doc_id long, line_no int, display string, category string",
    [(1, 0, "Education", "Education"), (1, 5, "Work Experience", "Experience"), (2, 3, "Interests", "Extracurricular & Interests"), (2, 9, "Skills & Languages", "Skills & Languages")],
)
PLAIN_LINES = Relation("doc_id long, line_no int, line string", [(d, k, f"line {k}") for d in (1, 2, 3) for k in range(8 + 4 * d)])
BULLET_LINES = Relation(
    "doc_id long, section string, line_no int, line string",
    [
        (1, "EXP", 0, "- Responsible for the weekly report."), (1, "EXP", 1, "- Increased sales by 12%"), (1, "EXP", 2, "- Presenting results to clients"),
        (1, "EXP", 3, "- Managed a team of three people."), (1, "EXP", 4, "- Helped with events"), (1, "EXP", 5, "Not a bullet"), (2, "EXP", 0, "- Marketing of products here"),
        (2, "EXP", 1, "- Reviewed contracts daily"), (2, "EXP", 2, "- Saved 3k CHF"), (2, "EDU", 0, "• Betreuung von Kunden"), (3, "EXP", 0, ""),
    ],
)
SKILL_LINES = Relation(
    "doc_id long, section string, line_no int, line string",
    [
        (1, "Languages", 0, "English: C1"), (1, "Languages", 1, "German: native"), (1, "Languages", 2, "French - fluent"), (1, "Languages", 3, "Italian: a bit"),
        (2, "Interests", 0, "• Chess"), (2, "Interests", 1, "Long walks in the hills"), (2, "Interests", 2, "Tennis, Golf"), (2, "Interests", 3, "Run 10k"), (3, "Interests", 0, ""),
    ],
)
LETTERS = Relation(
    "doc_id long, text string, other string",
    [
        (
            -1,
            "Dear Ms. Muster,\n\nDuring my internship at Muster AG I prepared valuation models for three acquisitions and presented findings to partners. "
            "This strengthened my analytical skills.\n\nI would bring e.g. curiosity. It improved my communication abilities and more.\n\nKind regards\nAda",
            "Intern at Muster AG. Prepared valuation models for acquisitions. Presented findings to partners. Built dashboards, audited ledgers, "
            "negotiated contracts, coached juniors, organised conferences, published research, programmed simulations, translated manuals.",
        ),
        (-2, "Short.", "Nothing."),
        (-3, None, None),
    ],
)
MESSAGES = Relation(
    "conv_id long, turn long, role string, text string",
    [
        (-1, 0, "user", "My salary offer is CHF 9 and under NDA"), (-1, 1, "assistant", "Shall I hand over?"), (-1, 2, "user", "Yes"), (-1, 3, "user", "thanks"),
        (-2, 0, "user", "Please rewrite this for me, I aim at consulting"), (-2, 1, "assistant", "I'd rate it 7/10. Try this: a draft"), (-2, 2, "user", "it is confidential"), (-2, 3, "user", "no"),
        (-3, 0, "user", "Ich habe die Arbeit nicht und das ist mit der Gruppe"), (-3, 1, "user", "ok"), (-3, 2, "user", "the work is not that of the team and it was for you"), (-3, 3, "user", None),
    ],
)
FACT_ROWS = [
    {"doc_id": 1, "unlabelled_entries": ["x"], "no_sections_found": False, "education_thin_entries": [], "total_bullets": 5, "bare_sections": ["Education"], "page_count": 1,
     "char_count": 900, "weak_bullets": 2, "experience_bullets": 5, "with_outcome": 1, "untailored": True, "typos": 1, "year_only_ranges": 2, "mixed_spelling": True,
     "punctuation_mixed": False, "education_after_experience": True, "date_overlaps": 1, "date_gaps": 0, "table_count": 1, "missing_sections": ["Skills", "Interests"], "grade_notes": 1,
     "grade_convention": False, "grade_consistency": True, "languages_missing": 0, "languages_plain": 2, "skills_without_level": 3, "bare_interests": 1, "buzzwords": ["dynamic"],
     "sections": ["Education", "Experience"], "entries_no_detail_section": "Experience"},
    {"doc_id": 2, "unlabelled_entries": [], "no_sections_found": False, "education_thin_entries": [], "total_bullets": 8, "bare_sections": [], "page_count": 3, "char_count": 9000,
     "weak_bullets": 0, "experience_bullets": 6, "with_outcome": 4, "untailored": False, "typos": 0, "year_only_ranges": 1, "mixed_spelling": False, "punctuation_mixed": True,
     "education_after_experience": False, "date_overlaps": 0, "date_gaps": 2, "table_count": 0, "missing_sections": [], "grade_notes": 0, "grade_convention": True, "grade_consistency": False,
     "languages_missing": 1, "languages_plain": 1, "skills_without_level": 0, "bare_interests": 0, "buzzwords": [], "sections": ["Education"], "mixed_tense_section": "Education"},
    {"doc_id": 3},
]
CATALOGUE = Relation(
    "name string, kind string, topic string, ord int",
    [
        ("Quiz Circle", "section", "Extracurricular", 0), ("Singers (mixed)", "section", "Extracurricular", 1), ("Quiz Circle", "section", "Education", 0), ("Reading Hour", "section", "Education", 1),
        ("Riddle Contest", "role", "Consulting", 0), ("Singers (mixed)", "role", "Consulting", 1),
        ("Budget Lab", "role", "Finance", 0), ("Talk Pairs", "general", "any", 0), ("Elder Visits", "general", "any", 1), ("Gym", "general", "any", 2), ("Stagecraft", "general", "any", 3),
    ],
)
PICK_DOCS = Relation("doc_id long, text string, role string", [(1, "one of the singers, went to the gym", "Consulting"), (2, "nothing", None), (3, None, "Finance")])
WEAK = Relation("doc_id long, section string, rank int", [(1, "Extracurricular", 0), (3, "Education", 0), (3, "Extracurricular", 1)])
WHOLE_LETTERS = Relation(
    "doc_id long, text string",
    [
        (-1, "Muster AG\nMs Anika Beispiel\nz.Hd. Frau Anika Beispiel\nMusterweg 1\n\nDear Ms Beispiel,\n\nI met Anika at a fair. I am available from May.\n\nKind regards,\nAda Muster"),
        (-2, "Subject: role\nDear Hiring Team,\nI apply.\nYours sincerely\nEnclosure: CV"),
        (-3, None),
    ],
)
CONTENT = Relation(
    "doc_id long, text string",
    [
        (-1, "Ada Muster\nMusterweg 1\nEducation\nBSc 2019 - 2021\nThesis\nInterests\nChess"),
        (-2, "Ada Muster\nI am a person who writes a long line of prose above everything else here\nEducation\nx\nInterests\ny"),
        (-3, "only text"),
    ],
)
NAMES = Relation("doc_id long, name string", [(-1, "Berta Test"), (-1, "Exempel"), (-2, "Carl Ohne")])
NAME_TEXTS = Relation("doc_id long, text string", [(-1, "Worked with Dr. Berta Test\nUniversity of Exempel"), (-2, "met Carl Ohne once")])
PIECES = Relation("doc_id long, text string", [(-1, "EDUCATION\n\nExample University     2019 - 2021\n  - detail of the work\n\nWORK HISTORY\n\nMuster AG     2021 - 2022\n  - more detail there\n\nOTHER THINGS\n\nplain words")])
TRAITS = Relation(
    "doc_id long, section string, line_no int, line string",
    [(1, "Skills", 0, "- team player, motivated"), (1, "Skills", 1, "flexible"), (2, "IT Skills", 0, "Docker, Kafka and Spark"), (2, "IT Skills", 1, "Excel: advanced"), (3, "Skills", 0, "Tools: Git, Figma; Canva")],
)
#: Whole documents whose facts, ranges and sections are known.
WHOLE = Relation(
    "doc_id long, text string",
    [
        (
            -101,
            "Ada Muster\nWork Experience\nMuster AG, Analyst 01/2016 - 03/2017\n- Responsible for weekly reports.\n- Managed a team of three people\n- Presenting results to clients\n"
            "- Prepared slides for the board\nOther AG, Intern 01/2019 - 12/2019\n- Helped with the yearly events.\nThird AG, Trainee 06/2019 - 06/2020\n- Saved 3k CHF in a year\n"
            "Education\nUniversity of Basel, BSc 2012 - 2015\nGrade: 4.8\nUniversity of Bern, MSc 2010 - 2012\n09/2008\n06/2009\nInterests\nChess\nTennis\n"
            "IT Skills\nteam player, motivated\nDocker, Kafka, Spark\nLanguages\nEnglish: a bit\nFrench: fluent",
        ),
        (-102, "Skills\nteam player, motivated\nflexible"),
        (-103, "\ue000 line with an icon\nGeburtsort: Beispielstadt\nDear Ms Beispiel,\nI worked with Dr. Berta Test for long\nBerta Test\nKind regards"),
    ],
)


MONTH_TEXTS = Relation(
    "doc_id long, text string",
    [(-1, "Mapmaker 3un 2025 - Gun 2026\nOkt 2019, Dez. 2020\n1234 2019, OKI\n2019"), (-2, "from 2019, nothing 2020"), (-3, ""), (-4, None), (-5, "Work Experiense\nMuster AG Mae 2018\nThe colour of the center")],
)
PROPOSED = Relation(
    "doc_id long, ord long, heading string, category string",
    [
        (-1, 0, "Work Experience", "Experience"), (-1, 1, "Old maps of small islands", "Cartography"), (-1, 2, "old maps of small islands", "Projects"),
        (-1, 3, "Invented heading", "Projects"), (-1, 4, "x", "Projects"), (-1, 5, None, None), (-1, 6, "Kites", "Extracurricular & Interests"), (-1, 7, "drill", "Projects"), (-9, 0, "Nowhere", "Other"),
    ],
)
FLAGGED = Relation(
    "doc_id long, n int, issue string",
    [(-1, 2, "says what the other says"), (-1, 9, "no such paragraph"), (-1, 2, ""), (-3, 1, None)],
)
TREES = Relation(
    "doc_id long, text string",
    [
        (
            -301,
            "Mira Beispiel\nmira@example.org\n\nWORK\n\nKiln and Sons                    Lausanne\nPotter            04/2015 - 09/2017\n- Glazed four hundred bowls,\n  all of them blue\n- Fired the kiln at night\n\n"
            "Harbour Museum\nGuide             2011 - 2014\nled visitors through the old ships\n\nSTUDIES\n\nBA, Academy of Clay      2008 - 2011\nThesis on the glazes of the north, written over two long winters in a\nsmall hut by the sea\n                                              Geneva\n\n"
            "PROJECTS\n\nA WHEEL FOR CHILDREN\n- built of beech\n- shown at two fairs\nTHE QUIET KILN\n- burns no wood\n\nSPRACHEN\n\nEnglish: fluent\nGerman: basic",
        ),
        (-302, "Training\nCollege of Maps 2003 - 2005\nPosts\nAtlas House 2006 - 2009\n- drew coasts\n- drew rivers\nMap Room, 2010 - heute\nnothing said\nHobbies\nrowing"),
        (-303, "first block\nof two rows\n\n\n\nsecond block 2001 - 2002\nwhat was done there\n\n\n\nthird block\n"),
        (-304, "SEA\n\nquiet water\n\nSAND\n\nloud wind\n\nSALT\n\nold rope\nHarbour (1999 - 2001)\nHarbour (1999 - 2001), then away\nMay 2004   Ferry\n   deeper than its title\n\nSTONE\n\nend"),
        (-305, "Ship (2001 -\n2003), Port\n> mark one\n> mark two\n> mark three\n* Some Thing 2001 - 2002\no Outer ring\n-\n2005 - 2006   Crew\n   rows of oars\nand sails"),
        (-306, ""), (-307, None), (-308, "   \n\t\n"),
    ],
)
LONG_LETTERS = Relation(
    "doc_id long, text string",
    [
        (
            -401,
            "Orla Muster\nHarbour Lane, Port\n1 May 2031\nDear Ms Beispiel,\n"
            "I am writing because your museum keeps the only collection of rope knots that I know of, and since\nmy first year at the school of boats I have tied, drawn and named more of them than my teachers wanted to see.\n"
            "Last winter I sorted the knots of a closed yard, four hundred of them, by the hands that had made them and the\nropes they were made of; the list now hangs in the hall.\n"
            "With you I would like to do the same for the knots that came by sea, and to learn from those who already do it\nhow a collection is kept dry, complete and open to children who want to touch it. I can begin in any month of\n"
            "the year and would gladly show you a few of my drawings, the ones with the errors in them too.\nKind regards\nOrla Muster",
        ),
        (-402, "Dear team, all in one block with nothing to part it, kind regards Orla"), (-403, "Hello\n\nno salutation here\n\nFreundliche Gruesse\n\nOrla"), (-404, None), (-405, " \n \n"),
        (-406, "Bern\n\nDear Sir, this first paragraph goes on in the same block for well over a dozen words.\n\nSecond one.\n\nAnd I close here with many more words than twelve in this block, kind regards, Orla\n\nPS"),
    ],
)
ANSWERS = Relation(
    "doc_id long, overall string, tone string, close string, issue string, quote string, facts string",
    [
        (-1, "The candidate's letter — short, and the candidate has relevant skills —.", "matches the role's requirements", "already on your CV", "The applicant is close to the skills needed for the trainee role", "a dash — stays", "no_advert,no_cv"),
        (-2, "Your relevant experience mirrors your CV already; your résumé too", "what the company is looking for", None, "passend zu der Stelle, in deinem Lebenslauf", "your CV", "no_cv"),
        (-3, "der Kandidat has nothing, the candidate was here", None, "entspricht den Anforderungen", None, None, "no_advert"), (-4, None, None, None, None, None, ""),
    ],
)
PERSONS = Relation(
    "doc_id long, text string",
    [
        (-501, "Orla Kettle\norla@example.org\nHarbour Lane 4\n\nEducation\nCollege of Maps 2003 - 2005\nwritten by Orla Kettle and Dr. Tom Sailor\nKettle drums"),
        (-502, "Ben Anker\nMapmaker and rower\n+41 44 000 00 00\nsomething that is no contact\nDr. Ina Lotse, ina@example.org"),
        (-503, "Personal Details\nborn on 1 May 1999\nunmarried\n\nEducation\nCollege of Maps 2003 - 2005\nReferences\nIna Lotse\nMs. Eva Rahe"),
        (-504, "2003 Gymnasium am See 2001 - 2003\nDear Hiring Team\nnothing else"), (-505, "Muster University\nEva Lund\nschool of Eva Lund\nMuster University of Eva Lund"),
        (-506, None), (-507, "\n\n"), (-508, "MAPS AND ROPES\nBen Anker"), (-509, "Ben Anker\nMilo Reed\nAda Ley Orr\n\nTel 044 000 00 00"),
    ],
)
