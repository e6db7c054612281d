"""The document tree: the fold against one with entries as objects, every rung of the ladder, and that nothing is lost."""

import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import vocabulary as V
from scriptorium.operators import headings, tree

PIECE = "array<struct<x0:double,x1:double,text:string,size:double,bold:boolean,font:string>>"


def page(spark, rows, body=9.0):
    """rows: (text or list of (x0, text), size, bold, top, page)."""
    made = []
    for n, (said, size, bold, top, number) in enumerate(rows):
        pieces = [(float(x), x + 5.0 * len(t), t, size, bold, "ABC+Sans-Bold" if bold else "ABC+Sans") for x, t in ([(40, said)] if isinstance(said, str) else said)]
        made.append((1, n, number, float(top), top + size, body, pieces))
    return spark.createDataFrame(made, f"doc_id long, n long, page int, top double, bottom double, body double, pieces {PIECE}")


@pytest.fixture(scope="module")
def lookup(spark):
    known = V.heading_table(spark)
    return lambda lines: partial(headings.identify, vocabulary=known)(lines).select("doc_id", "line_no", "category")


def told(frame):
    return [(r["kind"], r["text"]) for r in frame.orderBy("doc_id", "sec", "sub", "n").collect()]


def with_objects(rows, base):
    """Entries as lists of lists: the same rules with rows held back until their title is known."""
    entries, current, held, begins = [], None, [], base

    def release():
        nonlocal current, held
        if held:
            current = {"title": [held[0][0]], "bullet": [], "line": [[*h] for h in held[1:]], "aside": []}
            current["title"] = list(held[0])
            entries.append(current)
            held = []

    for k, (flag, indent, text_indent) in enumerate(rows):
        has = lambda bit: bool(flag & bit)  # noqa: B023, E731
        deeper = indent > begins + tree.SUBORDINATE
        bullet = has(tree.PRINTED) or (deeper and not has(tree.MARKED))
        if has(tree.WRAPPED) and (current or held):
            if held:
                held[-1].append(k)
            elif current["bullet"]:
                current["bullet"][-1].append(k)
            elif current["line"]:
                current["line"][-1].append(k)
            else:
                current["title"].append(k)
        elif has(tree.ANCHOR) and not deeper and not has(tree.PRINTED):
            if held:
                first = rows[held[0][0]][2]
                release()
                current["title"].append(k)
                begins = min(first, text_indent)
            else:
                current = {"title": [k], "bullet": [], "line": [], "aside": []}
                entries.append(current)
                begins = text_indent
        elif bullet or has(tree.WIDE_GAP):
            release()
            if current is None:
                current = {"title": [k], "bullet": [], "line": [], "aside": []}
                entries.append(current)
            else:
                current["bullet" if bullet else "aside" if has(tree.ASIDE) else "line"].append([k])
        elif held or has(tree.BOLD) or current is None:
            held.append([k])
        else:
            current["aside" if has(tree.ASIDE) else "line"].append([k])
    release()
    return entries


def test_fold_equals_one_with_objects():
    chance = random.Random(7)
    for _ in range(3000):
        marked = chance.choice([0, tree.MARKED])
        rows = [
            (marked | sum(chance.choice([0, 0, bit]) for bit in (tree.WRAPPED, tree.ANCHOR, tree.PRINTED, tree.BOLD, tree.WIDE_GAP, tree.ASIDE)), x := chance.choice([0.0, 3.0, 10.0, 15.0, 30.0]), max(x, chance.choice([0.0, 20.0])))
            for _ in range(chance.randint(1, 14))
        ]
        got = tree.fold([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], 0.0)
        entries = []
        for k, (entry, kind, part, _) in enumerate(got):
            if entry == len(entries):
                entries.append({"title": [], "bullet": {}, "line": {}, "aside": {}})
            if kind == 0:
                entries[entry]["title"].append(k)
            else:
                entries[entry][tree.KINDS[kind]].setdefault(part, []).append(k)
        plain = [{name: v if name == "title" else list(v.values()) for name, v in e.items()} for e in entries]
        assert plain == with_objects(rows, 0.0), rows


def test_nothing_is_lost(spark, lookup):
    chance = random.Random(11)
    lines = ["EDUCATION", "Muster AG      Bern", "2010 - 2012", "- did this,", "and that", "  deeper", "", "", "Aug 2011 - Sep 2012   Guide", "o Outer", "(1999 - 2001)", "SKILLS", "English: fluent", "> x y z", "PERSÖNLICHE", "DATEN"]
    texts = ["\n".join(chance.choice(lines) for _ in range(chance.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in tree.tree_of(tree.text_rows(docs), lookup).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("text")).collect()}
    bare = lambda text: sorted(c for c in text if c.isalnum())
    for doc_id, text in enumerate(texts):
        lost = len(bare(text)) - len(bare(kept.get(doc_id, "")))
        marks = sum(line.startswith("o ") for line in text.split("\n"))
        assert 0 <= lost <= marks, text


def test_headings_over_two_rows_are_rejoined(spark, lookup):
    docs = spark.createDataFrame([(1, "PERSÖNLICHE\nDATEN\nBern\nEDUCATION\nPROJECTS\nWORK\nEXPERIENCE\nEXPERIENCE\n\nWORK\n\n\nEXPERIENCE"), (2, None)], "doc_id long, text string")
    featured = tree.with_features(tree.text_rows(docs))
    joined = tree.with_features(tree.wrapped_headings_joined(featured, lookup))
    assert [r["text"] for r in joined.orderBy("n").collect()] == ["PERSÖNLICHE DATEN", "Bern", "EDUCATION", "PROJECTS", "WORK EXPERIENCE", "EXPERIENCE", "WORK", "EXPERIENCE"]


def test_a_style_that_is_larger_than_the_body_makes_headings(spark, lookup):
    rows = [
        ("Ada Example", 9.0, False, 0, 1), ("Posts", 13.0, False, 40, 1), ([(40, "Kiln and Sons"), (400, "2010 - 2012")], 9.0, True, 60, 1), ("Built kilns", 9.0, False, 70, 1),
        ("Learning", 13.0, False, 110, 1), ([(40, "College"), (400, "2007 - 2010")], 9.0, True, 130, 1), ("Read maps all day", 9.0, False, 140, 1),
        ("Tongues", 13.0, False, 10, 2), ("Latin", 9.0, False, 30, 2),
    ]
    made = tree.with_headings(tree.with_features(page(spark, rows)))
    assert {r["strategy"] for r in made.collect()} == {"style"}
    assert [r["text"] for r in made.where("heading").orderBy("n").collect()] == ["Posts", "Learning", "Tongues"]
    assert told(tree.tree_of(page(spark, rows), lookup, rejoin=False)) == [
        ("preamble", "Ada Example"), ("heading", "Posts"), ("title", "Kiln and Sons   2010 - 2012"), ("line", "Built kilns"),
        ("heading", "Learning"), ("title", "College   2007 - 2010"), ("line", "Read maps all day"), ("heading", "Tongues"), ("item", "Latin"),
    ]


def test_a_style_of_employers_divides_no_section_but_a_style_of_groups_does(spark, lookup):
    def rows(dated):
        out = [("WORK", 12.0, True, 0, 1)]
        for k, name in enumerate(("Kiln and Sons", "Harbour Ltd", "Museum")):
            out += [(name, 9.0, True, 40 + 60 * k, 1), ([(40, "Potter"), (400, f"{2010 + k} - {2011 + k}" if dated else "Bern")], 9.0, False, 52 + 60 * k, 1), ("and more of the same work there", 9.0, False, 64 + 60 * k, 1)]
        return [*out, ("STUDIES", 12.0, True, 260, 1), ("read maps", 9.0, False, 280, 1)]

    subs = lambda made: tree.with_sections(tree.with_headings(tree.with_features(page(spark, made)))).where("subheading").count()
    assert subs(rows(True)) == 0 and subs(rows(False)) == 3
    made = tree.tree_of(page(spark, rows(False)), lookup, rejoin=False)
    forest = {(r["heading"]): (r["level"], r["parent_sec"], r["place"]) for r in tree.forest(made).collect()}
    assert forest == {"WORK": (0, None, 0), "Kiln and Sons": (1, 1, 1), "Harbour Ltd": (1, 1, 2), "Museum": (1, 1, 3), "STUDIES": (0, None, 4)}


def test_other_rungs(spark):
    strategy = lambda rows: {r["strategy"] for r in tree.with_headings(tree.with_features(page(spark, rows))).collect()}
    dated = lambda k: ([(40, f"Place {k}"), (400, f"{2000 + k} - {2001 + k}")], 9.0, False, 20 + 40 * k, 1)
    assert strategy([("Posts", 9.0, False, 0, 1), dated(0), ("Schools", 9.0, False, 40, 1), dated(1)]) == {"position"}
    assert strategy([("ONE ALONE", 13.0, True, 0, 1), ("some words of the body that go on for a while", 9.0, False, 20, 1)]) == {"size"}
    assert strategy([("some words of the body that go on for a while", 9.0, False, 0, 1), ("and more words of the body that go on for a while", 9.0, False, 12, 1)]) == {"spacing"}


def test_sections_that_the_vocabulary_knows_are_lifted_out_and_parents_inherit(spark, lookup):
    rows = [("PAST", 12.0, True, 0, 1)]
    for k, name in enumerate(("Guild of Potters", "Education", "Boat Yard")):
        rows += [(name, 9.0, True, 40 + 80 * k, 1), ("a row of words that is no title and has no date", 9.0, False, 52 + 80 * k, 1), ([(40, "Master"), (400, f"{2010 + k} - {2011 + k}")], 9.0, False, 64 + 80 * k, 1), ("what was done", 9.0, False, 76 + 80 * k, 1)]
    rows += [("TONGUES", 12.0, True, 300, 1), ("Latin", 9.0, False, 320, 1)]
    made = tree.tree_of(page(spark, rows), lookup, rejoin=False)
    forest = tree.forest(made)
    assert [(r["heading"], r["level"], r["entries"], r["all_entries"]) for r in forest.orderBy("place").collect()] == [
        ("PAST", 0, 0, 2), ("Guild of Potters", 1, 1, 1), ("Boat Yard", 1, 1, 1), ("Education", 0, 1, 1), ("TONGUES", 0, 0, 0),
    ]
    text = tree.rendered(made, forest).first()["text"]
    assert text.startswith("PAST\n  Guild of Potters\n    a row of words") and text.index("Boat Yard") < text.index("\nEducation\n") and text.endswith("TONGUES\n  Latin\n")


def test_rows_of_nothing(spark, lookup):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "null has rows too")], "doc_id long, text string")
    assert [(r["doc_id"], r["kind"]) for r in tree.tree_of(tree.text_rows(docs), lookup).collect()] == [(None, "item")]
    assert tree.tree_of(tree.text_rows(docs.limit(0)), lookup).count() == 0
