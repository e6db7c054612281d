"""Steps that grew too fast or differed from their SQL, held to what they cost and give."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions import vocabulary as V
from scriptorium.functions.durable import checkpointed
from scriptorium.functions.spreading import dealt
from scriptorium.functions.vocabulary import ENDINGS
from scriptorium.operators import answers, deidentify, facts, geometry, grades, headings, lines, overlap, profile, timeline, tree
from scriptorium.plans import trees


def plan_of(rows, capsys):
    capsys.readouterr()
    rows.explain()
    return capsys.readouterr().out


def test_acronyms_end_where_plain_letters_end(spark):
    texts = spark.createDataFrame([(1, "ßSS undÄVW, SAP. R&D"), (2, None)], "item_id long, text string")
    found = {r["term"]: (r["weight"], r["first"]) for r in overlap.terms(texts, []).where("first >= 1000000").collect()}
    assert found == {"ss": (3, 1000000), "vw": (3, 1000001), "sap": (3, 1000002), "r&d": (3, 1000003)}


def test_words_are_stripped_in_one_pass(spark, capsys):
    def plain(word):
        for _ in range(overlap.MAX_ENDINGS):
            cut = next((e for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= overlap.MIN_STEM), "")
            word = word[: len(word) - len(cut)]
        return word

    draw = random.Random(3)
    words = ["".join(draw.choice("abäst") for _ in range(draw.randint(1, 5))) + "".join(draw.choices(ENDINGS, k=draw.randint(0, 6))) for _ in range(3000)]
    words = [w for w in words if len(w) >= 4] + ["a" * 5 + "s" * 30]
    noise = set(overlap.noise_stems())
    rows = spark.createDataFrame([(" ".join(words),), (None,), ("",), ("a b c",)], "text string")
    made = [r[0] for r in rows.select(overlap.content_words(F.col("text"))).collect()]
    assert made == [[w for w in dict.fromkeys(map(plain, words)) if w not in noise], [], [], []]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(overlap.stem(F.col("w"))).collect()] == [plain(w) for w in words]
    assert "aggregate(" not in plan_of(rows.select(overlap.content_words(F.col("text"))), capsys)


def test_words_of_a_sentence_are_found_once(spark, capsys):
    letters = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, other string")
    asked = [line for line in plan_of(overlap.echoes(letters), capsys).split("\n") if "regexp_extract_all(" in line]
    assert asked and all("Generate" in line for line in asked)


def test_characters_of_many_lines_keep_their_order(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(300)))], "doc_id long, text string")
    rows = geometry.reading_order(geometry.icons_dropped(geometry.pieces_of(trees.characters(docs)))).orderBy("n").collect()
    assert [r["pieces"][0]["text"] for r in rows] == [f"line {k}" for k in range(300)]


def test_heights_begin_rows_as_a_plain_fold_says(spark):
    draw = random.Random(5)
    tops = sorted({round(draw.uniform(0, 300), 1) for _ in range(400)} | {1000.0, 1002.9, 1003.0, 1003.1, 1006.2})
    want, anchor, row = {}, float("-inf"), -1
    for top in tops:
        if top - anchor > geometry.ROW_TOLERANCE:
            anchor, row = top, row + 1
        want[top] = row
    rows = spark.createDataFrame([(1, 1, t) for t in tops], "doc_id long, page int, top double")
    assert {r["top"]: r["row_no"] for r in geometry.by_height(rows).collect()} == want


def test_rows_of_larger_tables_are_dealt_into_more_parts(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a line\n   "), 10_000).alias("text"))
    assert tree.text_rows(docs).rdd.getNumPartitions() == 5
    assert tree.text_rows(docs.limit(2)).rdd.getNumPartitions() == 4


def test_nothing_is_asked_behind_the_first_place(spark):
    holds = lambda x: F.when(x == 0, F.raise_error(F.lit("asked")).cast("boolean")).otherwise(x == 2)
    rows = spark.createDataFrame([([1, None, 2, 0],), ([1, 3],), ([],)], "v array<int>")
    assert [r[0] for r in rows.select(deidentify.first_place(F.col("v"), holds)).collect()] == [2, None, None]


def test_wrapped_headings_are_asked_before_features_and_once(spark, capsys):
    lines = ["Work", "Experience", "2020 - 2021 Clerk", "", "Selected", "Case", "Studies", "a  b", "one two three four five"]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "no pair\nhere at all"), (3, None)], "doc_id long, text string")
    asked = []

    def lookup(rows):
        asked.append(sorted((r["doc_id"], r["line"]) for r in rows.collect()))
        return rows.where("line IN ('Work Experience', 'Case Studies')").select("doc_id", "line_no", F.lit("x").alias("category"))

    joined = tree.wrapped_headings_joined(tree.text_rows(docs), lookup)
    got = [(r["doc_id"], [p["text"] for p in r["pieces"]]) for r in joined.orderBy("doc_id", "n").collect()]
    assert got == [
        (1, ["Work Experience"]), (1, ["2020 - 2021 Clerk"]), (1, ["Selected"]), (1, ["Case Studies"]), (1, ["a", "b"]), (1, ["one two three four five"]), (2, ["no pair"]), (2, ["here at all"]),
    ]
    assert len(asked) == 1 and not any("Clerk" in line or "four" in line for _, line in asked[0])
    vocabulary = spark.createDataFrame([("work", "Work", "Experience", 0)], "variant string, display string, category string, ord int")
    texts = headings.identify(docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")), vocabulary)
    assert [r["line"] for r in texts.collect()] == ["Work"] and "posexplode(split(text" not in plan_of(texts, capsys)


def test_words_before_years_are_found_in_one_pass(spark, capsys):
    docs = spark.createDataFrame([(1, "Jqn 2020, Mar 2021; xyz.  1999 x"), (2, None), (3, "Jqn"), (4, "jum 2020 maj 20201")], "doc_id long, text string")
    made = timeline.month_typos(docs)
    assert sorted((r["doc_id"], r["pos"], r["written"], r["meant"]) for r in made.collect()) == [(1, 0, "Jqn 2020", "Jan 2020"), (4, 0, "jum 2020", "Jun 2020")]
    assert all(line.count("regexp_extract_all(") < 2 for line in plan_of(made, capsys).split("\n"))
    written = facts.writing_facts(docs)
    assert all(line.count("lower(") < 2 for line in plan_of(written.select("doc_id", "mixed_spelling"), capsys).split("\n"))


def test_dates_at_the_end_are_told_without_what_stands_before_the_year(spark):
    draw = random.Random(7)
    rows = [("".join(draw.choice(["2020", "19", "99", "Mai", " ", ".", ",", ")", "x", "1", "/", " "]) for _ in range(draw.randint(0, 7))),) for _ in range(3000)]
    made = spark.createDataFrame(rows, "line string").select(P.has(F.col("line"), P.SINGLE_DATE_END, False).alias("a"), P.has(F.col("line"), P.DATE_END, False).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in made) and {r["a"] for r in made} == {True, False}


def test_a_profile_makes_what_is_asked_and_reads_documents_with_headings(spark):
    docs = spark.createDataFrame([(1, "Education\nBachelor of Arts 2019 - 2020\nGrade: 5.5"), (2, "plain words\nGrade: 1.7"), (3, None)], "doc_id long, text string")
    made = profile.Profile(docs, V.heading_table(spark), "2026-11-01")
    assert not {"headed", "body", "named", "bullets", "entries", "ranges"} & set(vars(made))
    assert {r["doc_id"] for r in made.headed.select("doc_id").collect()} == {1}
    assert [(r["doc_id"], r["has_grade"]) for r in made.graded_degrees().collect()] == [(1, True)] and "bullets" not in vars(made)
    assert {r["doc_id"] for r in made.grades().collect()} == {1, 2} and made.body.count() == 5


def test_grades_of_united_lines_are_joined_behind_the_union(spark, capsys):
    docs = spark.createDataFrame([(1, "Oberstufe Mannheim\n\nEndnote: 2,4"), (2, "plain"), (None, "Grade: 5.1"), (4, "Lugano\nGrade: 5.1, 3.9")], "doc_id long, text string")
    more = spark.createDataFrame([(-1, 0, "Universität Basel"), (-1, 1, "note 4.6/6")], "doc_id long, line_no int, line string")
    made = grades.find_grades(lines.lines_of(docs).unionByName(more))
    got = sorted((r["doc_id"], r["pos"], r["value"], r["country"]) for r in made.collect())
    assert got == [(-1, 0, 4.6, "CH"), (1, 0, 2.4, "DE"), (4, 0, 5.1, "CH"), (4, 1, 3.9, "CH")]
    assert "LeftSemi" not in plan_of(made, capsys)  # below the union its parts differ in number once the plan adapts
    joined = profile.Profile(docs.unionByName(docs.where("doc_id = 2")), V.heading_table(spark), "2026-11-01")
    plan = plan_of(joined.grades(), capsys)
    assert "LeftSemi" not in plan and "LeftAnti" not in plan


def test_characters_are_dealt_once_as_texts(spark, capsys):
    docs = spark.createDataFrame([(1, "a b\n\n  cd      e"), (None, "x"), (3, None)], "doc_id long, text string")
    made = geometry.reading_order(geometry.icons_dropped(geometry.pieces_of(trees.characters(dealt(docs)))))
    assert [(r["doc_id"], r["n"], [p["text"] for p in r["pieces"]]) for r in made.orderBy("doc_id", "n").collect()] == [(None, 0, ["x"]), (1, 0, ["a b"]), (1, 1, ["cd", "e"])]
    plan = plan_of(made, capsys)
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_a_piece_has_the_median_size_and_the_font_of_most_characters(spark):
    row = lambda k, text, size, font, top=0.0: (1, 1, k, text, 5.0 * k, 5.0 * k + 5.0, top, 8.0, size, font)
    rows = [row(0, "a", 10.0, None), row(1, "b", 12.0, "X-Bold"), row(2, "c", 13.0, "Y"), row(3, "d", None, "X-Bold"), row(4, "e", 9.0, None), row(5, "\u2003", 50.0, "Z"), row(6, "f", 1.0, "Y", None)]
    chars = spark.createDataFrame(rows, "doc_id long, page int, char_no long, text string, x0 double, x1 double, top double, bottom double, size double, font string")
    for bold, font in ((False, ""), (True, "X-Bold")):
        made = geometry.pieces_of(chars if not bold else chars.withColumn("font", F.when(F.col("char_no") > 0, "X-Bold"))).collect()
        assert [(r["text"], r["size"], r["bold"], r["font"], r["x0"], r["x1"]) for r in made] == [("abcde", 11.0, bold, font, 0.0, 25.0)]


def test_a_kept_tree_is_written_out_where_it_lies(spark, capsys):
    docs = spark.createDataFrame([(1, "EDUCATION\nBern 2019 - 2020\n- sang\n\n\n\nWORK\nClerk 2020 - 2021\nfiled"), (2, "no heading"), (None, "x\ny"), (4, None)], "doc_id long, text string")
    nothing = lambda lines: lines.where("false").select("doc_id", "line_no", F.lit("x").alias("category"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    made = checkpointed(tree.tree_of(tree.text_rows(docs), nothing, rejoin=False), stays_dealt=True)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    nodes = tree.forest(made)
    assert "Exchange" not in plan_of(tree.rendered(made, nodes), capsys) and "Exchange" not in plan_of(nodes, capsys)
    texts = {r["doc_id"]: r["text"] for r in tree.rendered(made, nodes).collect()}
    assert texts[1].split() == "EDUCATION Bern 2019 - 2020 - sang WORK Clerk 2020 - 2021 filed".split() and texts[2].split()[-2:] == ["no", "heading"]


def test_a_section_above_its_sub_sections_is_a_node(spark):
    rows = [(1, 1, 1, 3, None, "subheading", "Later"), (1, 1, 1, 4, 0, "title", "a"), (1, 1, 2, 5, None, "subheading", "Last"), (1, 2, 0, 6, None, "heading", "Own"), (1, 2, 0, 7, None, "item", "b")]
    made = spark.createDataFrame([(*r, "", None) for r in rows], "doc_id long, sec long, sub long, n long, entry_no int, kind string, text string, dates string, category string")
    got = [(r["sec"], r["sub"], r["heading"], r["entries"], r["all_entries"], r["items"], r["bare"], r["place"]) for r in tree.forest(made).orderBy("place").collect()]
    assert got == [(1, 0, None, 0, 1, 0, 0, 0), (1, 1, "Later", 1, 1, 0, 1, 1), (1, 2, "Last", 0, 0, 0, 0, 2), (2, 0, "Own", 0, 0, 1, 0, 3)]


def test_a_claim_without_its_stems_is_no_claim(spark):
    draw = random.Random(11)
    words = (
        "strengthen improved my the communication team-work skills skill set abilities competence Strengths mindset qualities taught me the importance value how important I learned learnt allowed enabled me helped to "
        "further hone this experience has taught shaped honed sharpened developed broadened deepened gave me given project gained valuable first-hand insights stärkt verbesserte entwickelt ich meine Fähigkeiten "
        "Faehigkeit Kompetenzen Kenntnisse Staerken Teamgeist konnte ausbauen hat mich gelehrt haben mir gezeigt, wie wichtig lehrte gestärkt wertvolle Einblicke gewonnen St. Dr. ſkills ABILITIES \u0130nsights gaınıng SKİLLS \n"
    ).split(" ")
    phrases = [
        "improved my team skills", "taught me the importance", "I learnt how important", "enabled me to hone", "this project has shaped", "the role gave me", "gained first-hand insights", "stärkt meine Faehigkeiten", "konnte ich meine Noten verbessern",
        "haben mir gezeigt, wie wichtig", "lehrte mich", "hat meine Sicht geschärft", "wertvolle Einblicke gewonnen", "honed ſkılls", "gained \u0130nsights", "built S\u212Aills",
    ]
    texts = [f"Well {p} here. And more." for p in phrases] + [" ".join(draw.choice([*words, ". And", "! "]) for _ in range(draw.randint(3, 25))) for _ in range(3000)] + [None, ""]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    made = [(r["k"], r["kept"], r["removed"]) for r in overlap.skills_removed(rows).orderBy("k").collect()]
    asked = [(r["k"], r["kept"], r["removed"]) for r in overlap.skills_removed(rows, f"(?:{overlap.CLAIM})").orderBy("k").collect()]  # another pattern, so asked of every text
    assert made == asked and all(r[2] for r in made[: len(phrases)]) and sum(not r[2] for r in made) > 50


def test_stems_of_a_paragraph_are_made_once(spark, capsys):
    text = "Grain prices moved quickly through several harbours and stranded ships carried copper cables northward. I sold ropes. Copper cables carried grain."
    body = spark.createDataFrame([(1, 1, text), (1, 2, text), (2, 1, "too short")], "doc_id long, n int, paragraph string")
    said = [(1, 1, "Grain prices moved", True), (1, 1, "copper cables northward", None), (1, 1, "wholly other matters", True), (1, 2, "stranded ships", True), (1, 1, None, True)]
    claims = spark.createDataFrame(said, "doc_id long, n int, claim string, known boolean")
    known = spark.createDataFrame([(1, "grain prices"), (2, None)], "doc_id long, other string")
    measured = answers.measured_paragraphs(body, known, claims)
    assert [(r["doc_id"], r["n"], r["claims"], r["known_claims"]) for r in measured.orderBy("n").collect()] == [(1, 1, 2, 1), (1, 2, None, None)]
    given = claims.where("claim IS NOT NULL").withColumn("c", overlap.content_words(F.col("claim")))
    stems = known.withColumn("k", overlap.content_words(F.col("other"))).drop("other")
    again = answers.measured_paragraphs(body, stems, checkpointed(given))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, measured.collect()))
    assert plan_of(measured.select("*"), capsys).count("Scan ExistingRDD[doc_id#") == 3  # body, known, claims: each once
