"""The whole removal of personal data on invented pages, case by case."""

from functools import partial

import pytest

from scriptorium.functions import vocabulary as V
from scriptorium.operators import deidentify, extraction, headings, overlap, rendering
from scriptorium.plans import fixtures as X

AS_OF = "2026-11-01"


@pytest.fixture(scope="module")
def stripped(spark):
    lookup = partial(headings.identify, vocabulary=V.heading_table(spark))
    persons = spark.createDataFrame(
        [(-501, "Orla Kettle"), (-501, "Tom Sailor"), (-502, "Ina Lotse"), (-503, "Ina Lotse"), (-503, "Eva Rahe"), (-505, "Eva Lund"), (-505, "Muster University"), (-509, "Milo Reed"), (-509, "Bern 3"), (None, "x")], "doc_id long, name string"
    )
    places = spark.createDataFrame([(-509, "milo reed, ")], "doc_id long, name string")
    docs = X.PERSONS.frame(spark)
    return {r["doc_id"]: r for r in deidentify.strip_personal_data(docs, AS_OF, lookup, persons, places).collect()}, {r["doc_id"]: r for r in deidentify.strip_personal_data(docs, AS_OF, lookup).collect()}


def test_names_are_removed_where_something_confirms_them(stripped):
    made, _ = stripped
    text = lambda k: made[k]["redacted"]
    assert text(-501) == "[CONTACT DETAILS REMOVED]\nHarbour Lane 4\n\nEducation\nCollege of Maps 2003 - 2005\nwritten by [NAME REDACTED] and Dr. [NAME REDACTED]\n[NAME REDACTED] drums"
    assert text(-503) == "[CONTACT DETAILS REMOVED]\n\nEducation\nCollege of Maps 2003 - 2005\nReferences\n[NAME REDACTED]\nMs. [NAME REDACTED]"
    assert "Dr. [NAME REDACTED], [EMAIL REDACTED]" in text(-502) and "Ben Anker" not in text(-502) and "Mapmaker and rower" in text(-502)
    assert text(-505) == "[CONTACT DETAILS REMOVED]\nMuster University\nschool of [NAME REDACTED]\nMuster University of [NAME REDACTED]"
    assert text(-504) == X.PERSONS.rows[3][1] and text(-506) == "" and text(-508) == "MAPS AND ROPES\nBen Anker"
    assert text(-509) == "[CONTACT DETAILS REMOVED]\nMilo Reed\nAda Ley Orr"  # a place too: nobody; the name at the top goes
    assert made[-501]["labels"] == ["name", "contact block (name, address, links)"] and made[-501]["names_found"] == 2 and not made[-501]["degraded"]


def test_without_a_recogniser_the_top_name_goes_and_the_row_says_so(stripped):
    _, made = stripped
    assert all(r["degraded"] for r in made.values())
    assert "Orla Kettle" not in made[-501]["redacted"] and "Tom Sailor" in made[-501]["redacted"] and made[-503]["names_found"] == 0


def test_readings_are_arbitrated_by_their_words(spark):
    flat = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b"), (3, None), (4, "x")], "doc_id long, text string")
    made = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a"), (3, ""), (5, "no")], "doc_id long, text string")
    got = {r["doc_id"]: (r["reader"], r["share"], r["note"] is None) for r in extraction.arbitrated(flat, made).collect()}
    assert got == {1: ("tree", 0.9, True), 2: ("flat", 0.5, False), 3: ("tree", None, True), 4: ("flat", 0.0, False)}


def test_rules_work_on_what_the_ones_before_left(spark):
    rows = spark.createDataFrame([(1, "a b", {"k": None, "l": "b"}, [("b a", "b")], ["f"]), (2, "a b", None, None, None)], "doc_id long, overall string, essentials map<string,string>, repetitive array<struct<issue:string,quote:string>>, facts array<string>")
    rules = [(None, "a", "b", False), ("f", "B", "c", True), ("g", "c", "d", False)]
    got = {r["doc_id"]: r for r in rendering.rewritten(rows, rules).collect()}
    assert got[1]["overall"] == "c c" and got[1]["essentials"] == {"k": None, "l": "c"} and (got[1]["repetitive"][0]["issue"], got[1]["repetitive"][0]["quote"]) == ("c c", "b")
    assert got[2]["overall"] == "b b" and got[2]["essentials"] is None
    assert rendering.rewritten(rows, []).count() == 2


def test_long_blocks_are_parted_by_the_width_of_their_lines(spark):
    found = overlap.paragraphs_by_width(X.LONG_LETTERS.frame(spark))
    first = [r["paragraph"].split("\n")[0][:20] for r in found.where("doc_id = -401").orderBy("n").collect()]
    assert first == ["Orla Muster", "Harbour Lane, Port", "1 May 2031", "Dear Ms Beispiel,", "I am writing because", "With you I would lik", "Kind regards", "Orla Muster"]
    body = overlap.letter_body(found)
    assert [r["n"] for r in body.where("doc_id = -401").orderBy("n").collect()] == [5, 6]
    assert body.where("doc_id = -402").count() == 0 and [r["n"] for r in body.where("doc_id = -406").orderBy("n").collect()] == [2, 3, 4]
