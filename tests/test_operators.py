"""Rules both ways: what must fire and what must stay quiet."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import vocabulary as V
from scriptorium.operators import answers, entries, extraction, facts, grades, guardrails, headings, lines, overlap, picks, profile, redaction, rendering, sessions, severity, timeline
from scriptorium.plans import catalogue
from scriptorium.plans import fixtures as X
from tests.conftest import SF

AS_OF = "2026-11-01"


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("layer", "text", "expected"),
    [
        (redaction.emails, "a.b@c.org x", "[EMAIL REDACTED] x"),
        (redaction.profiles, "see https://www.linkedin.com/in/ab-c/ ok", "see [PROFILE LINK REDACTED] ok"),
        (redaction.profiles, "linkedin is a site", "linkedin is a site"),
        (redaction.handles, "LinkedIn: ab", "LinkedIn: [PROFILE LINK REDACTED]"),
        (redaction.bank_details, "CH93 0076 2011 6238 5295 7", "[BANK DETAILS REDACTED]"),
        (redaction.id_numbers, "a\nMatrikelnummer 12\nb", "a\n[ID NUMBER REDACTED]\nb"),
        (redaction.labelled_fields, "Geburtsort: X\nProject: Name of", "Geburtsort: [CONTACT DETAILS REMOVED]\nProject: Name of"),
        (redaction.phones, "Tel 079 000 00 00 und 2019-2022", "Tel [PHONE REDACTED] und 2019-2022"),
        (redaction.phones, "07/2018-01/2019", "07/2018-01/2019"),
        (redaction.phones, "Ort, 01.10.2020", "Ort, 01.10.2020"),
        (redaction.phones, "0791234567", "[PHONE REDACTED]"),
        (redaction.phones, "ID 1234567", "ID 1234567"),
        (redaction.phones, "mobile 1234567", "mobile [PHONE REDACTED]"),
        (redaction.addresses, "Musterweg 12, 8001 Zürich", "[ADDRESS REDACTED]"),
        (redaction.addresses, "2021 Pflege der Boote", "2021 Pflege der Boote"),
        (redaction.addresses, "CH-7999 St. Exempel", "[ADDRESS REDACTED]"),
        (redaction.addresses, "Springfield, IL 62799", "[ADDRESS REDACTED]"),
        (redaction.addresses, "Lindenstrasse 7", "Lindenstrasse 7"),
        (redaction.marital_status, "x\nZivilstand: ledig", "x\n[CIVIL STATUS REDACTED]"),
        (redaction.marital_status, "verheiratet seit", "[CIVIL STATUS REDACTED] seit"),
        (redaction.nationalities, "Nationality: Swiss\ny", "[NATIONALITY REDACTED]\ny"),
        (lambda t: redaction.birth_dates(t, AS_OF), "geb. 09.06.2001", "geb. [DATE OF BIRTH REDACTED]"),
        (lambda t: redaction.birth_dates(t, AS_OF), "* 09.06.2001", "[DATE OF BIRTH REDACTED]"),
        (lambda t: redaction.birth_dates(t, AS_OF), "12. August 1990", "[DATE OF BIRTH REDACTED]"),
        (lambda t: redaction.birth_dates(t, AS_OF), "08. Juli 2025", "08. Juli 2025"),
        (lambda t: redaction.birth_dates(t, AS_OF), "born on 1 May 1999 in B", "born on [DATE OF BIRTH REDACTED] in B"),
    ],
)
def test_redaction_layers(spark, layer, text, expected):
    assert one(spark, layer, text) == expected


def test_redaction_leaves_nothing_and_keeps_ranges(spark):
    rows = redaction.redact(X.CONTACT.frame(spark), AS_OF).collect()
    assert len(rows) == len(X.CONTACT.rows) and all(r["residual"] == [] and r["degraded"] for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[-1]["categories"] == ["email", "profile_url"] and by_id[-7]["redacted"] == "" and by_id[-8]["categories"] == []
    assert "2019-2022" in by_id[-4]["redacted"] and "07/2018-01/2019" in by_id[-4]["redacted"]
    named = spark.createDataFrame([(1, "Ada Muster wrote; Adamant", ["Ada Muster"])], "doc_id long, text string, names array<string>")
    assert redaction.redact(named, AS_OF, "names").first()["redacted"] == "[NAME REDACTED] [NAME REDACTED] wrote; Adamant"


@pytest.mark.parametrize(
    ("layer", "text", "expected"),
    [
        (redaction.addresses, "Musterweg a b c d e f g h i 12\n8001 Zürich", "[ADDRESS REDACTED]\n[ADDRESS REDACTED]"),
        (redaction.addresses, "Musterweg " + "hinten im " * 20 + "Hof 12, 8001 Zürich", "[ADDRESS REDACTED]"),
        (redaction.addresses, "Musterweg 12, 8001\u00a0Zürich", "[ADDRESS REDACTED]"),
        (redaction.phones, "1234567 mobile", "[PHONE REDACTED] mobile"),
        (redaction.phones, "Tel: 1234567; 7654321\nNr. 2345678", "Tel: [PHONE REDACTED]; [PHONE REDACTED]\nNr. 2345678"),
    ],
)
def test_redaction_has_no_bounds(spark, layer, text, expected):
    assert one(spark, layer, text) == expected


@pytest.mark.parametrize("text", ["Lindenstrasse 7", "x\n8001 Zürich", "12. August 1990"])
def test_sweep_of_addresses_and_birth_dates(spark, text):
    left = spark.createDataFrame([(text,)], "t string").select(redaction.residual(F.col("t"), AS_OF).alias("r"), redaction.sweep(F.col("t"), AS_OF).alias("s")).first()
    assert len(left["r"]) == 1 and "REDACTED" in left["s"]
    row = redaction.redact(spark.createDataFrame([(1, "2021 Pflege der Boote\n08. Juli 2025\n" + text)], "doc_id long, text string"), AS_OF).first()
    assert row["residual"] == [] and row["redacted"].startswith("2021 Pflege der Boote\n08. Juli 2025\n") and text.split("\n")[-1] not in row["redacted"]


def test_names_and_personal_sections(spark):
    shaped = lambda t: one(spark, lambda c: redaction.looks_like_a_name(c, V.ROLE_WORDS), t)
    assert shaped("Ada Muster") and not shaped("Data Analyst") and not shaped("Dear Hiring Team") and not shaped("Ada") and not shaped("Ada M4")
    docs = spark.createDataFrame([(1, "Personal Details\nAda\nEducation\nBSc"), (2, "Personal Details\nx")], "doc_id long, text string")
    found = headings.identify(lines.lines_of(docs), V.heading_table(spark))
    kept = {r["doc_id"]: r["text"] for r in redaction.drop_personal_sections(docs, found).collect()}
    assert kept == {1: "Education\nBSc", 2: ""}


@pytest.mark.parametrize(
    ("line", "display", "damage"),
    [
        ("Education", "Education", None), ("EDUCATION:", "Education", None), ("Selected Projects", "Projects", None), ("IT & Languages", "Skills & Languages", None),
        ("Q PRAKTIKA", "Work Experience", "icon"), ("Educaxion", "Education", "typo"), ("PR0F1LE", "Profile", "typo"), ("SK1L15", "Skills & Languages", "typo"), ("Further H0BB1ES", "Interests", "typo"),
        ("Arbeits- und Führungserfahrung", "Work Experience", None), ("Arbeits- und Banane", None, None), ("Pr0j3c70001", None, None), ("S IT & Languages", "Skills & Languages", "icon"),
        ("Education is what I want to talk about here", None, None), ("- Education", None, None), ("Education 2020", None, None), ("Banana", None, None),
    ],
)
def test_headings(spark, line, display, damage):
    found = headings.identify(lines.lines_of(spark.createDataFrame([(1, line)], "doc_id long, text string")), V.heading_table(spark)).collect()
    assert [(r["display"], r["damage"]) for r in found] == ([(display, damage)] if display else [])


def test_digit_readings(spark):
    read = lambda value: one(spark, headings._readings, value)
    assert read("a11") == ["aii", "ail", "ali", "all"] and read("plain") == [] and read("0000") == [] and read("x9") == []


def test_contact_block_and_sections(spark):
    docs = spark.createDataFrame([(1, "Ada Muster\nada@example.org\nEducation\nBSc 2019 - 2021"), (2, "just text\nmore")], "doc_id long, text string")
    body = lines.lines_of(docs)
    found = headings.identify(body, V.heading_table(spark))
    header = headings.contact_block(body, found, V.MAX_CONTACT_LINES).where("in_header").collect()
    assert sorted((r["doc_id"], r["line"]) for r in header) == [(1, "Ada Muster"), (1, "ada@example.org")]
    assert [(r["display"], r["body_from"], r["body_to"]) for r in headings.sections(found, body).collect()] == [("Education", 3, 4)]


def test_lines_and_markers(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\x0bc d\n"), (2, "> x\n> y\n> z\n£ q"), (3, None)], "doc_id long, text string")
    found = lines.lines_of(docs)
    assert [r["line"] for r in found.where("doc_id = 1").orderBy("line_no").collect()] == ["a", "b", "c", "d"] and found.where("doc_id = 3").count() == 1
    assert [(r["doc_id"], r["marker"], r["uses"]) for r in lines.learned_markers(found).collect()] == [(2, ">", 3)]
    plain = {r["doc_id"]: r["text"] for r in lines.text_of(lines.with_plain_bullets(found)).collect()}
    assert plain[2] == "- x\n- y\n- z\n£ q"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Okt 2011 - Mai 2013", [(24142, 24161, True)]), ("03/2018 – Present", [(24219, 24323, True)]), ("2004 - 2006", [(24049, 24084, False)]), ("seit Juni 2015", [(24186, 24323, True)]),
        ("Xyz 2001 - 2002", [(24013, 24036, False)]), ("2006 - 2004", []), ("in 2003 only", []), ("5/2009 - expected 07/2027", [(24113, 24331, True)]),
    ],
)
def test_ranges(spark, text, expected):
    found = timeline.ranges_of(spark.createDataFrame([(1, text)], "doc_id long, line string"), AS_OF)
    assert [(r["s"], r["e"], r["months_explicit"]) for r in found.orderBy("pos").collect()] == expected


def test_month_labels(spark):
    assert one(spark, lambda t: timeline.month_label(t.cast("int"), "de"), "24276") == "Dezember 2022" and one(spark, lambda t: timeline.month_label(t.cast("int")), "24277") == "January 2023"


def test_gaps_are_covered_by_other_sections(spark):
    found = timeline.uncovered_runs(X.RANGES.frame(spark)).collect()
    assert [(r["doc_id"], r["first"], r["unexplained"]) for r in found] == [(3, "i", 18)]
    merged = {r["doc_id"]: [m["raw"] for m in r["merged"]] for r in timeline.merge_ranges(X.RANGES.frame(spark).where("doc_id = 1"), X.EXTRA_RANGES.frame(spark)).collect()}
    assert merged[9] == ["new"] and "zz" in merged[1] and "xa" not in merged[1]


def test_grades(spark):
    found = {(r["doc_id"], r["line_no"]): r for r in grades.find_grades(X.GRADE_LINES.frame(spark)).collect()}
    assert set(found) == {(-1, 1), (-1, 3), (-2, 0), (-2, 1), (-4, 0)}
    assert found[-1, 1]["scale"] == V.ABITUR_AVERAGE[0] and found[-1, 1]["value"] == 2.4
    assert not found[-1, 3]["plausible"] and found[-1, 3]["suggestion"] == 4.76 and found[-1, 3]["country"] == "CH"
    assert (found[-2, 0]["maximum"], found[-2, 0]["missing_maximum"]) == (6.0, False) and found[-4, 0]["country"] == "IT"
    assert [(r["doc_id"], r["value"]) for r in grades.convention_notes(grades.find_grades(X.GRADE_LINES.frame(spark))).collect()] == [(-2, 4.6)]


def test_entries(spark):
    text = "Muster AG\nAnalyst 02/2018 - present\n- Reduced waste by 31%\nplain words\nOther AG\nIntern 03/2016 - 09/2016\n2019 - 2020\nThird AG"
    body = lines.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("section", F.lit("Experience"))
    found = entries.entries_of(body).orderBy("entry_no").collect()
    assert [(r["line"], r["title_line"], r["stacked_with_next"]) for r in found] == [
        ("Analyst 02/2018 - present", "Muster AG", False), ("Intern 03/2016 - 09/2016", "Other AG", True), ("2019 - 2020", "Third AG", False),
    ]
    assert found[0]["bullets"] == ["Reduced waste by 31%"] and found[0]["description"] == ["plain words", "Other AG"]


def test_bullets(spark):
    bullet = lambda t: one(spark, entries.is_bullet, t)
    assert bullet("- x") and bullet("text • y") and bullet("o Did") and bullet("   an indented line that is long enough") and not bullet("o did") and not bullet("- 2019 - 2021") and not bullet("x - y")
    assert one(spark, entries.bullet_text, "  •  Built it") == "Built it"
    marks = facts.unusual_bullets(spark.createDataFrame([(1, "♥ x"), (1, "- y")], "doc_id long, line string")).collect()
    assert [r["marks"] for r in marks] == [["♥"]]


def test_ranking_order_and_caps(spark):
    names = [p.split()[0] for p in severity.FACTS.split(", ")]
    rows = spark.createDataFrame([tuple(r.get(n) for n in names) for r in X.FACT_ROWS], severity.FACTS)
    ranked = severity.issues(rows)
    tiers = [r["tier"] for r in ranked.where("doc_id = 1").orderBy("rank").collect()]
    assert tiers == sorted(tiers) and ranked.where("doc_id = 3").count() == 0
    areas = severity.key_areas(ranked).where("doc_id = 1").orderBy("area").collect()
    assert [r["area"] for r in areas] == [1, 2, 3, 4, 5] and not {r["key"] for r in areas} & {*severity.DATE_KEYS, *severity.FORMAT_KEYS}
    assert {r["doc_id"]: r["strengths"] for r in severity.strengths(rows).collect()}[2] == ["outcomes", "complete_sections"]
    assert severity.section_status(rows, ranked).where("status = 'needs_attention'").count() == 3


@pytest.mark.parametrize(("word", "stem"), [("arbeiten", "arbeit"), ("internship", "inter"), ("intern", "inter"), ("cat", "cat"), ("organisations", "organi"), ("", "")])
def test_stems(spark, word, stem):
    assert one(spark, overlap.stem, word) == stem


def test_overlaps_and_claims(spark):
    letters = X.LETTERS.frame(spark)
    assert [(r["doc_id"], r["n"]) for r in overlap.echoes(letters).collect()] == [(-1, 1)]
    cut = {r["doc_id"]: r for r in overlap.skills_removed(letters).collect()}
    assert cut[-1]["removed"] == ["strengthened my analytical skills.", "improved my communication abilities and more."] and "e.g. curiosity. It " in cut[-1]["kept"] and cut[-3]["kept"] == ""
    more = ["This role taught me the importance of rest, e.g. on Mondays. Then no claim.\n\nWe gained valuable insights", "Dort konnte ich meine Karten verbessern. Ende", "no claim. none\n\n\nhere"]
    got = overlap.skills_removed(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [" Then no claim.\n\nWe ", "Dort  Ende", more[2]] and got[0]["removed"][0] == "This role taught me the importance of rest, e.g. on Mondays."
    terms = overlap.top_terms(overlap.terms(spark.createDataFrame([(1, "SAP ledgers ledgers audit. audit; reconciliations")], "item_id long, text string"), []))
    assert [(r["term"], r["weight"]) for r in terms.orderBy("rank").collect()] == [("sap", 3), ("ledgers", 2), ("audit", 2), ("reconciliations", 1)]


def test_extraction_gates(spark):
    rows = extraction.extract_gate(spark.createDataFrame([(1, "x" * 120), (2, " " * 200 + "x"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["ok"] for r in rows] == [True, False, False] and rows[2]["space_share"] == 1.0
    files = extraction.file_gate(spark.createDataFrame([("a.pdf", 1), ("b.exe", 1), ("c.docx", 11 * 1024 * 1024)], "path string, length long")).collect()
    assert [r["error"] for r in files] == [None, "unsupported", "too_large"]
    words = spark.createDataFrame([("a b c d e f g h i j", "a b c d e f g h i"), ("a b", "a")], "flat string, tree string")
    assert [r["reading"] for r in extraction.word_gate(words, "flat", "tree").collect()] == ["a b c d e f g h i", "a b"]


def test_word_files(spark, tmp_path):
    from scriptorium.sources.documents import read_files

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(made.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("plain")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "Title\n- item\ncell" and got["a.docx"]["table_count"] == 1
    assert (got["b.docx"]["error"], got["c.txt"]["text"], got["d.pdf"]["error"]) == ("unreadable", "plain", "unsupported")


def test_guardrails(spark):
    check = lambda f, t: one(spark, f, t)
    assert check(guardrails.triggers, "NDA and salary, NDA") == ["nda", "salary"] and check(guardrails.triggers, "agenda") == []
    assert check(guardrails.scores_something, "7/10") and not check(guardrails.scores_something, "CGPA 9.34/10.00")
    assert check(guardrails.asks_rewrite, "Please rewrite this") and check(guardrails.gives_rewrite, "Try this: x") and not check(guardrails.gives_rewrite, "what did you do?")
    assert check(guardrails.is_affirmative, " Ja gerne") and not check(guardrails.is_affirmative, "yesterday")
    assert check(guardrails.role_of, "I like audit and consulting") == "Consulting"
    assert check(guardrails.language_of, "ok") is None


def test_sessions_and_stream_agree(spark, tmp_path):
    from scriptorium.streaming.handover import handover_stream

    messages = X.MESSAGES.frame(spark)
    batch = {(r["conv_id"], r["turn"]): (r["state"], r["reason"]) for r in sessions.handover_states(messages).collect()}
    assert batch[-1, 0] == ("pending", "chf 9, nda, salary") and batch[-1, 3][0] == "handed_over" and batch[-2, 3] == ("cleared", "")
    messages.write.parquet(f"{tmp_path}/in")
    stream = handover_stream(spark.readStream.schema(messages.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("memory").queryName("handover").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    run.processAllAvailable()
    run.stop()
    assert {(r["conv_id"], r["turn"]): (r["state"], r["reason"]) for r in spark.table("handover").collect()} == batch
    modes = {(r["conv_id"], r["turn"]): r["structure_only"] for r in sessions.structure_mode(messages).collect()}
    assert modes[-1, 2] and not modes[-1, 0] and not modes[-2, 3]


def test_picks_and_rendering(spark):
    got = picks.picks(X.PICK_DOCS.frame(spark), X.WEAK.frame(spark), X.CATALOGUE.frame(spark)).orderBy("doc_id", "n").collect()
    assert [r["name"] for r in got if r["doc_id"] == 1] == ["Quiz Circle", "Riddle Contest", "Talk Pairs", "Elder Visits", "Gym"]
    assert [r["name"] for r in got if r["doc_id"] == 3][:3] == ["Quiz Circle", "Reading Hour", "Singers (mixed)"]
    clean = lambda f, t: one(spark, f, t)
    assert clean(rendering.escaped, "a|b\nc") == "a\\|b c" and clean(rendering.without_em_dashes, "a — b") == "a, b"
    assert clean(rendering.without_inline_urls, "x (https://a.b) [l](https://c.d)") == "x [l](https://c.d)" and clean(rendering.unwrapped, "[x] [l](u)") == "x [l](u)"
    assert clean(rendering.without_bullet_counts, "add three bullets") == "add bullets" and clean(rendering.without_placeholders, "by [NAME REDACTED] here") == "by here"
    points = spark.createDataFrame([(["more detail on role", "other"], ["detail on the role more"])], "p array<string>, a array<string>")
    assert points.select(rendering.without_duplicate_points(F.col("p"), F.col("a")).alias("x")).first()["x"] == ["other"]


def test_letters(spark):
    from scriptorium.operators import letters

    got = {r["doc_id"]: r for r in letters.strip_letter(X.WHOLE_LETTERS.frame(spark)).collect()}
    text = got[-1]["redacted"]
    assert "Anika" not in text and "Beispiel" not in text and "Ada Muster" not in text and text.startswith("Muster AG\n") and "Dear [RECIPIENT REDACTED]" in text
    assert "Dear Hiring Team," in got[-2]["redacted"] and "Enclosure: CV" in got[-2]["redacted"] and not got[-2]["had_author"] and got[-3]["redacted"] == ""
    items = {(r["doc_id"], r["item"]): r["present"] for r in letters.checklist(X.WHOLE_LETTERS.frame(spark)).collect()}
    assert items[-1, "availability"] and items[-1, "salutation"] and not items[-1, "reference"] and items[-2, "reference"] and not items[-3, "closing"]


def test_content_selection_and_names(spark):
    from scriptorium.operators import selection

    body = lines.lines_of(X.CONTENT.frame(spark))
    got = {r["doc_id"]: r for r in selection.select_content(body, headings.identify(body, V.heading_table(spark))).collect()}
    assert (got[-1]["applied"], got[-1]["dropped_lines"], got[-1]["text"].split("\n")[0]) == (True, 2, "Education")
    assert not got[-2]["applied"] and got[-2]["text"].startswith("Ada") and not got[-3]["applied"] and got[-3]["sections"] == 0
    texts = lines.lines_of(X.NAME_TEXTS.frame(spark))
    named = {r["name"]: (r["person"], r["institution_only"]) for r in selection.corroborated(X.NAMES.frame(spark), texts, headings.identify(texts, V.heading_table(spark))).collect()}
    assert named == {"Berta Test": (True, False), "Exempel": (False, True), "Carl Ohne": (False, False)}


def test_layout(spark):
    from scriptorium.operators import layout

    pieces = layout.pieces_of_text(X.PIECES.frame(spark))
    assert [r["body"] for r in layout.body_size(pieces).collect()] == [10.0]
    styles = layout.heading_style(layout.rows_of(pieces), layout.body_size(pieces)).collect()
    assert [(r["caps"], r["score"] >= 2.5) for r in styles] == [(True, True)]
    two = spark.createDataFrame([(1, 1, float(x)) for x in [10, 10, 11, 300, 301, 302, 10, 299]], "doc_id long, page int, x0 double")
    assert [(r["column"], r["left"], r["right"]) for r in layout.columns_of(two, 50.0).orderBy("column").collect()] == [(0, 10.0, 299.0), (1, 299.0, 600.0)]
    modes = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, "a", 2), (1, "b", 3)], "k int, v string, o int")
    assert [r["v"] for r in layout.commonest(modes, "k", "v", "o").collect()] == ["b"]


def test_section_facts(spark):
    rows = X.TRAITS.frame(spark)
    assert [(r["doc_id"], r["traits"]) for r in facts.soft_skills_only(rows).collect()] == [(1, ["team player", "motivated", "flexible"])]
    assert {r["doc_id"]: r["items"] for r in facts.skills_without_level(rows).collect()} == {2: ["Docker", "Kafka", "Spark"], 3: ["Git", "Figma", "Canva"]}
    check = lambda f, t: one(spark, f, t)
    assert check(facts.is_routine_service, "Barista") and not check(facts.is_routine_service, "Restaurant manager, barista") and check(facts.is_degree, "MSc Finance") and not check(facts.is_degree, "PhD after Master")
    role = lambda line, title: spark.createDataFrame([(line, title)], "l string, t string").select(facts.has_role_title(F.col("l"), F.col("t"), F.lit("")).alias("x")).first()["x"]
    assert role("Analyst 09/2019 - 12/2021", "Muster AG") and not role("2019 - 2021", "Muster AG") and role("2019 - 2021", "Analyst")
    docs = spark.createDataFrame([(1, "I am someone who writes long sentences about many things.\nAnd another line that continues in the very same manner.\nEducation\nx")], "doc_id long, text string")
    body = lines.lines_of(docs)
    intro = facts.unlabelled_intro(body, headings.identify(body, V.heading_table(spark))).collect()
    assert len(intro) == 1 and intro[0]["intro"].startswith("I am someone")


def test_facts_of_whole_documents(spark):
    made = profile.Profile(X.WHOLE.frame(spark), V.heading_table(spark), AS_OF)
    got = {r["doc_id"]: r for r in made.facts().collect()}
    assert set(got) == {-101, -102, -103}
    full, skills, plain = got[-101], got[-102], got[-103]
    assert full["sections"] == ["Work Experience", "Education", "Interests", "Skills & Languages", "Skills & Languages"]
    assert (full["total_bullets"], full["experience_bullets"], full["weak_bullets"], full["with_outcome"]) == (6, 6, 2, 1)
    assert full["date_overlaps"] == 1 and full["date_gaps"] == 1 and full["year_only_ranges"] == 2 and full["education_after_experience"]
    assert (full["languages_missing"], full["languages_plain"], full["bare_interests"], full["skills_without_level"]) == (1, 1, 2, 3)
    assert full["grade_consistency"] and full["chronology_section"] == "Work Experience" and full["mixed_tense_section"] == "Work Experience"
    assert skills["soft_skills_only_section"] == "Skills & Languages" and skills["total_bullets"] == 0
    assert plain["sections"] == [] and plain["untailored"] is None and plain["page_count"] is None
    ranked = severity.issues(made.facts()).where("doc_id = -101")
    assert {"date_gap", "date_overlap", "entry_chronology", "grade_consistency", "bare_interests"} <= {r["key"] for r in ranked.collect()}


@pytest.mark.parametrize("name", ["birth_date_redaction", "document_labelled_fields", "letter_redaction", "skills_removed"])
def test_queries_keep_every_document(spark, name):
    asked = catalogue.queries()[name](spark, SF).select("doc_id").distinct()
    assert spark.read.parquet(f"{SF}/documents.parquet").join(asked, "doc_id", "left_anti").count() == 0


# --- answers ---


def test_month_typos(spark):
    got = {(r["doc_id"], r["written"], r["meant"]) for r in timeline.month_typos(X.MONTH_TEXTS.frame(spark)).collect()}
    assert got == {(-1, "3un 2025", "Jun 2025"), (-1, "Gun 2026", "Jun 2026"), (-1, "OKI\n2019", "Okt 2019"), (-5, "Mae 2018", "Mar 2018")}


def test_grade_notes(spark):
    found = {(r["doc_id"], r["line_no"]): (r["kind"], r["written_as"]) for r in grades.notes(grades.find_grades(X.GRADE_LINES.frame(spark))).collect()}
    assert found[-1, 1] == ("no_maximum", "2.40 / 1.00") and found[-1, 3] == ("decimal_lost", "4.76 / 6.00") and (-2, 0) not in found
    shown = spark.createDataFrame([(4.756, 6.0), (5.0, 6.0), (None, 6.0)], "v double, r double").select(grades.pair(F.col("v"), F.col("r"))).collect()
    assert [r[0] for r in shown][:2] == ["4.756 / 6.000", "5.00 / 6.00"]


def test_writing_row(spark):
    docs = X.MONTH_TEXTS.frame(spark)
    found = headings.identify(lines.lines_of(docs), V.heading_table(spark))
    got = {r["doc_id"]: r for r in facts.writing_row(docs, found, timeline.month_typos(docs)).collect()}
    assert len(got) == 5 and got[-2]["status"] == "good" and got[-2]["problems"] == [] and got[-1]["status"] == "attention"
    assert [tuple(p) for p in got[-5]["problems"]] == [("Work Experiense", "Work Experience"), ("Mae 2018", "Mar 2018")] and got[-5]["spelling"] in ("mixed", "consistent")


def test_proposed_sections(spark):
    docs, vocabulary = X.CV.frame(spark), V.heading_table(spark)
    usable = answers.proposed_sections(docs, X.PROPOSED.frame(spark), ["Experience", "Projects", "Extracurricular & Interests"])
    assert sorted((r["ord"], r["category"]) for r in usable.collect()) == [(0, "Experience"), (1, "Other"), (6, "Extracurricular & Interests"), (7, "Projects")]
    body = lines.lines_of(docs)
    found = headings.identify(body, vocabulary)
    got = [r for r in answers.merged_sections(body, found, usable, vocabulary).orderBy("doc_id", "n").collect() if r["doc_id"] == -1]
    assert [r["heading"] for r in got if r["heading"] in ("Work Experience", "Old maps of small islands", "Kites", "drill")] == ["Work Experience", "Kites", "Old maps of small islands", "drill"]
    assert got[-1]["line_no"] is None and [r["n"] for r in got] == list(range(1, len(got) + 1))


def test_repetitions(spark):
    body = spark.createDataFrame(
        [(1, n, "Prepared valuation models for acquisitions, presented findings to partners, negotiated contracts with suppliers in Basel this spring.") for n in (1, 2, 3)]
        + [(1, 4, "This strengthened my analytical skills and my communication skills and my presentation skills and my negotiation skills and my leadership skills further.")],
        "doc_id long, n int, paragraph string",
    )
    claims = [(1, 1, "prepared valuation models", True), (1, 1, "negotiated contracts", True), (1, 1, "cooked dinner yesterday evening", False), (1, 1, "strengthened my analytical skills", False)]
    claims += [(1, 2, "presented findings", True), (1, 2, "contracts with suppliers", False), (1, 3, "presented findings", True), (1, 3, None, None)]
    made = spark.createDataFrame(claims, "doc_id long, n int, claim string, known boolean")
    assert sorted(map(tuple, answers.claim_counts(body, made).collect())) == [(1, 1, 2, 2), (1, 2, 2, 1)]
    other = spark.createDataFrame([(1, None)], "doc_id long, other string")
    measured = answers.measured_paragraphs(body, other, made, least=3)
    assert {r["n"]: r["reason"] for r in answers.repetition_candidates(measured).collect()} == {1: "all_claims_known", 4: "nothing_left"}
    flagged = spark.createDataFrame([(1, 2, "x"), (1, 3, " why "), (1, 4, "y"), (1, 4, ""), (1, 8, "z"), (2, 1, "z"), (None, None, None)], "doc_id long, n int, issue string")
    assert sorted((r["n"], r["issue"]) for r in answers.repetitions(flagged, measured).collect()) == [(3, "why"), (4, "y")]
    assert [r["n"] for r in answers.unreported(flagged, measured).collect()] == [1]


def test_ungrounded_sections(spark):
    sections = spark.createDataFrame([(1, "Experience", "Experience", "Mapmaker at Muster AG"), (1, "Languages", "Skills & Languages", "English, German"), (2, "Projects", "Projects", None)], "doc_id long, section string, category string, text string")
    said = [(1, " Experience", "needs_attention", "be more concrete"), (1, "Languages", "needs_attention", "anything"), (2, "Projects", "needs_attention", "nothing"), (1, "Experience", "strong", "words")]
    asked = spark.createDataFrame(said, "doc_id long, section string, status string, points string")
    assert [tuple(r) for r in answers.ungrounded_sections(asked, sections).collect()] == [(1, "Experience")]
    named = spark.createDataFrame([(1, "Experience", "needs_attention", "say what a MAPMAKER does")], asked.schema)
    assert answers.ungrounded_sections(named, sections).isEmpty()


def test_points_in_place(spark):
    rows = spark.createDataFrame([("Interests", ["join a club", "say more"]), ("Extracurricular interests", ["join a club"]), (None, ["join a club"])], "section string, points array<string>")
    got = answers.points_in_place(rows, "interest|skill", "extracurricular|volunteer", "club")
    assert [r["points"] for r in got.collect()] == [["say more"], ["join a club"], ["join a club"]]
