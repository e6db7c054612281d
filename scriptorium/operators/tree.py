"""Rows of a document as a tree: headings by a ladder of strategies, sections, entries and what stands under them.

All steps are windows per document, so a document's rows are dealt once and stay together. Nothing is
lost: every row ends as a heading, a title, a bullet, a line, an aside, an item or preamble, or as the rest
of one of these. One step is no window: which row begins an entry depends on where the last entry's
title begins and on rows that wait for their title. That state is carried by a short fold over numbers,
section by section; what the rows say never passes through it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.functions.durable import checkpointed
from scriptorium.functions.patterns import let
from scriptorium.functions.spreading import dealt
from scriptorium.operators.headings import normalise
from scriptorium.operators.layout import BODY_SIZE, CHAR_WIDTH, LARGER_THAN_BODY, LINE_HEIGHT, MAX_HEADING_WORDS, STYLE_FLOOR
from scriptorium.operators.lines import lines_of

#: Air above a row, in body sizes, that begins something new; indent beyond a title that makes a row subordinate.
BLOCK_GAP, SUBORDINATE = 1.6, 4.0
#: A line this close to the measure ran out of room; a field beyond this share of the width is an aside.
MEASURE_SLACK, ASIDE_SHARE = 0.06, 0.5
SUB_STYLE_FLOOR, EMPLOYER_SHARE, MARKER_USES, WRAPPED_WORDS = 2.0, 0.5, 3, 3
#: Categories whose entries have titles and no dates.
TITLED_UNDATED = ("Publications & Research", "Projects")
KINDS = ("title", "bullet", "line", "aside")
WRAPPED, ANCHOR, PRINTED, BOLD, WIDE_GAP, ASIDE, MARKED = (1 << k for k in range(7))
Lookup = Callable[[DataFrame], DataFrame]
_LINES = "array<struct<a:bigint,b:bigint,c:bigint,d:bigint,t:string>>"


def _doc() -> Window:
    return Window.partitionBy("doc_id")


def _order() -> Window:
    return _doc().orderBy("n")


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n, page, top, bottom, body, pieces of the non-blank lines: fields apart by two blanks or more, with a nominal geometry."""
    rows = lines_of(dealt(docs.select("doc_id", "text"))).where(F.col("line").rlike(r"(?U)\S"))
    fields = F.filter(F.split(F.regexp_replace("line", r"^[ \t]+|[ \t]+$", ""), r"[ \t]{2,}"), lambda f: f != "")
    lead = F.char_length("line") - F.char_length(F.regexp_replace("line", r"^[ \t]+", ""))
    before = lambda k: F.when(k == 0, 0).otherwise(F.char_length(F.array_join(F.slice("fields", F.lit(1), k), "   ")) + 3)
    rows = rows.withColumn("fields", fields).withColumn("lead", lead)
    placed = F.transform("fields", lambda f, k: F.struct(f.alias("text"), ((F.col("lead") + before(k)) * CHAR_WIDTH).alias("x0")))
    pieces = F.transform(placed, lambda p: F.struct(p["x0"].alias("x0"), (p["x0"] + F.char_length(p["text"]) * CHAR_WIDTH).alias("x1"), p["text"].alias("text"), F.lit(BODY_SIZE).alias("size"), F.lit(False).alias("bold"), F.lit("").alias("font")))
    top = F.col("line_no") * LINE_HEIGHT
    return rows.select("doc_id", F.col("line_no").cast("long").alias("n"), F.lit(1).alias("page"), top.alias("top"), (top + 0.8 * LINE_HEIGHT).alias("bottom"), F.lit(BODY_SIZE).alias("body"), pieces.alias("pieces"))


def _sum(pieces: str, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(pieces, F.lit(0), lambda s, p: s + value(p))


def _only_a_date(text: Column) -> Column:
    size = F.char_length(F.trim(text))
    span = F.char_length(F.regexp_extract(F.when(size.between(1, 32), text), P.java(P.RANGE, True), 0))  # long texts aren't searched
    return size.between(1, 32) & (P.has(F.trim(text), P.FIELD_DATE) | F.coalesce((span > 0) & (span >= 0.7 * size), F.lit(False)))


def _dated_outside_brackets(text: Column) -> Column:
    """A range beside brackets, or in the bracket that closes the text."""
    return P.has_range(F.regexp_replace(text, r"\([^()]*\)", " ")) | P.has_range(F.regexp_extract(text, r"(\([^()]*\)).?\s*$", 1))


def _words_at_most(text: Column, most: int) -> Column:
    """Whether a text has ``most`` words or fewer; a longer one isn't split to its end."""
    return F.size(F.filter(F.split(text, r"(?U)\s+", most + 3), lambda w: w != "")) <= most


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` with what a row says of itself and of its document: text, style, indent, gap, marks, whether it is dated.

    A column ``flow`` parts pages whose columns are read one after the other; indents count from a flow's own edge.
    """
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "   ")
    rows = rows if "flow" in rows.columns else rows.withColumn("flow", F.lit(0))
    rows = rows.withColumns({
        "text": text, "count": F.size("pieces"), "size": F.array_max(F.transform("pieces", lambda p: p["size"])), "x0": F.array_min(F.transform("pieces", lambda p: p["x0"])), "x1": F.array_max(F.transform("pieces", lambda p: p["x1"])),
        "bold": _sum("pieces", lambda p: F.when(p["bold"], F.char_length(p["text"])).otherwise(0)) > 0.6 * F.greatest(F.lit(1), _sum("pieces", lambda p: F.char_length(p["text"]))),
        "first": F.get("pieces", F.lit(0))["text"], "last": F.element_at("pieces", -1)["text"], "family": F.regexp_extract(F.get("pieces", F.lit(0))["font"], r"(?:.*\+)?([^,\-+]*)", 1),
    })
    left = F.min("x0").over(Window.partitionBy("doc_id", "page", "flow"))
    text_x = F.when((F.col("count") > 1) & _only_a_date(F.col("first")), F.get("pieces", F.lit(1))["x0"]).otherwise(F.col("x0"))
    gap = F.when(F.lag("page").over(_order()) != F.col("page"), BLOCK_GAP * F.col("body")).otherwise(F.col("top") - F.lag("bottom").over(_order()))
    sign = F.substring("text", 1, 1)
    counted = (F.char_length("text") >= 3) & F.col("spaced") & ~F.col("sign").rlike(r"""[\p{L}\p{N}"'(]""")
    letters = F.regexp_replace("text", r"[^\p{L}]+", "")
    rows = rows.withColumns({"indent": F.col("x0") - left, "text_indent": text_x - left, "gap": F.coalesce(gap, F.lit(0.0)), "sign": sign, "spaced": F.substring("text", 2, 1).isin("", " ", "\t")})
    rows = rows.withColumn("glyph", F.col("spaced") & (F.col("sign").isin(*P.GLYPHS) | (F.sum(counted.cast("int")).over(Window.partitionBy("doc_id", "sign")) >= MARKER_USES)))
    rows = rows.withColumn("printed", F.col("glyph") | F.col("text").rlike(r"^[oO] \p{Lu}"))
    two = F.col("count") > 1
    rows = rows.withColumns({
        "anchor": _dated_outside_brackets(F.col("text")) | (two & (P.has(F.trim("first"), P.FIELD_DATE) | P.has(F.trim("last"), P.FIELD_DATE))),
        "able": _words_at_most(F.col("text"), MAX_HEADING_WORDS) & ~F.col("printed") & (F.col("count") == 1) & ~P.has_range(F.col("text")),
        "caps": (F.char_length(letters) >= 3) & (F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]+", "")) > 0.8 * F.char_length(letters)),
    })
    return rows.withColumns({
        "style": F.struct((F.bround(F.col("size") * 4) / 4).alias("size"), "bold", "caps", "family"), "marked": F.sum(F.col("printed").cast("int")).over(_doc()) >= MARKER_USES,
        "typical": F.greatest(F.lit(0.5), F.coalesce(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).over(_doc()), F.lit(1.0))),
        "bold_body": F.sum(F.when(F.col("bold"), F.char_length("text")).otherwise(0)).over(_doc()) > 0.6 * F.sum(F.char_length("text")).over(_doc()),
    }).drop("sign", "spaced")


def _style_and_gap(rows: DataFrame) -> DataFrame:
    """``rows`` with text, size, bold of the whole row and the gap above it."""
    rows = rows.withColumns({
        "text": F.array_join(F.transform("pieces", lambda p: p["text"]), "   "), "size": F.array_max(F.transform("pieces", lambda p: p["size"])),
        "bold": _sum("pieces", lambda p: F.when(p["bold"], F.char_length(p["text"])).otherwise(0)) > 0.6 * F.greatest(F.lit(1), _sum("pieces", lambda p: F.char_length(p["text"]))),
    })
    gap = F.when(F.lag("page").over(_order()) != F.col("page"), BLOCK_GAP * F.col("body")).otherwise(F.col("top") - F.lag("bottom").over(_order()))
    return rows.withColumn("gap", F.coalesce(gap, F.lit(0.0)))


def wrapped_headings_joined(rows: DataFrame, lookup: Lookup) -> DataFrame:
    """Two neighbouring rows that mean nothing apart and a heading together become one row.

    ``lookup`` takes (doc_id, line_no, line) and returns those that are headings. Pairs are taken from the
    top: a row that ended a pair begins none. What decides is asked of narrow rows with short texts only,
    before any other feature; the whole rows are then joined in one pass over their document's order, to
    which the pairs come as one value a document.
    """
    rows = rows if "flow" in rows.columns else rows.withColumn("flow", F.lit(0))
    rows = rows.select("doc_id", "n", "page", "flow", "top", "bottom", "body", "pieces")
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "   ")
    pair = F.coalesce(F.array_contains("_pairs", F.col("n")), F.lit(False))

    narrow = _style_and_gap(rows).drop("pieces", "flow", "top", "bottom", "page", "body")
    narrow = narrow.withColumn("text", F.when(_words_at_most(F.col("text"), WRAPPED_WORDS), F.trim("text")))
    follows = lambda c: F.lead(c).over(_order())
    near = (follows("bold") == F.col("bold")) & (F.abs(follows("size") - F.col("size")) <= 0.6) & (follows("gap") <= 1.3 * F.greatest("size", follows("size")))
    asked = narrow.withColumns({"near": F.coalesce(near, F.lit(False)), "next": follows("text")}).where("near AND text IS NOT NULL AND next IS NOT NULL")
    both = F.array(F.struct((F.col("n") * 2).alias("line_no"), F.col("text").alias("line")), F.struct((F.col("n") * 2 + 1).alias("line_no"), F.concat_ws(" ", "text", "next").alias("line")))
    known = lookup(checkpointed(asked.select("doc_id", F.explode(both).alias("a")).select("doc_id", "a.*")))
    known = known.groupBy("doc_id", F.floor(F.col("line_no") / 2).cast("long").alias("n")).agg(F.min(F.pmod("line_no", F.lit(2))).alias("least"))
    pairs = checkpointed(known.where("least = 1").groupBy("doc_id").agg(F.collect_list("n").alias("_pairs")))

    rows = rows.join(pairs, "doc_id", "left").withColumns({"able_pair": pair, "place": F.row_number().over(_order())})
    before = F.last(F.when(~F.col("able_pair"), F.col("place")), ignorenulls=True).over(_order())
    rows = rows.withColumn("begins", F.col("able_pair") & ((F.col("place") - F.coalesce(before, F.lit(0))) % 2 == 1))
    after = F.col("begins") & F.lead("n").over(_order()).isNotNull()
    whole = F.concat_ws(" ", F.trim(text), F.trim(F.lead(text).over(_order())))
    more = F.coalesce(F.lead("pieces").over(_order()), F.array().cast(rows.schema["pieces"].dataType))
    rows = rows.withColumns({
        "merged": F.coalesce(F.lag("begins").over(_order()), F.lit(False)), "whole": F.when(after, whole),
        "pieces": F.when(after, F.concat("pieces", more)).otherwise(F.col("pieces")), "bottom": F.when(after, F.lead("bottom").over(_order())).otherwise(F.col("bottom")),
    }).where("NOT merged")
    one = F.struct(*[(F.col("whole") if f == "text" else F.array_max(F.transform("pieces", lambda p: p[f])) if f == "x1" else F.get("pieces", F.lit(0))[f]).alias(f) for f in ("x0", "x1", "text", "size", "bold", "font")])  # noqa: B023
    return rows.select("doc_id", "n", "page", "flow", "top", "bottom", "body", F.when(F.col("begins"), F.array(one)).otherwise(F.col("pieces")).alias("pieces"))


def with_headings(rows: DataFrame) -> DataFrame:
    """``rows`` (with features) with strategy, heading, sub_style: the first rung of the ladder that finds headings decides.

    ``style``: the style that scores most, 2.5 at least, for what sets headings apart. ``position``: short
    undated rows at the margin that dated ones follow, two at least. ``size``: rows that are larger by
    themselves. ``spacing``: none; blocks are read from the air between them. A style of lower score makes
    sub-headings, unless at least half of its rows are followed by a dated one: then it names employers.
    """
    own = Window.partitionBy("doc_id", "style", "able")
    following = lambda k: F.coalesce(F.lead("anchor", k).over(_order()), F.lit(False))
    rows = rows.withColumns({"place": F.row_number().over(_order()) - 1, "rows": F.count("*").over(_doc()), "next_anchor": following(1), "second_anchor": following(2)})
    rows = rows.withColumns({"uses": F.count("*").over(own), "air": F.avg("gap").over(own), "begin": F.min("place").over(own), "end": F.max("place").over(own), "followed": F.avg(F.col("next_anchor").cast("int")).over(own)})
    score = (
        F.when(F.col("size") >= F.col("body") + LARGER_THAN_BODY, 2.5).otherwise(0.0) + F.when(F.col("bold") & ~F.col("bold_body"), 1.5).otherwise(0.0) + F.when(F.col("caps"), 1.5).otherwise(0.0)
        + F.when(F.col("air") >= 2 * F.col("typical"), 1.5).when(F.col("air") >= 1.4 * F.col("typical"), 0.75).otherwise(0.0)
        + F.when((F.col("end") - F.col("begin")) / F.greatest(F.lit(1), F.col("rows") - 1) > 0.45, 1.0).otherwise(0.0) + F.when(F.col("uses").between(3, 9), 0.5).otherwise(0.0)
    )
    rows = rows.withColumn("score", F.when(F.col("able") & F.col("uses").between(2, 15), score))
    ranked = F.struct("score", (-F.col("begin")).alias("first"), "style", "followed")
    rows = rows.withColumn("best", F.max(F.when(F.col("score") >= STYLE_FLOOR, ranked)).over(_doc())["style"])
    second = F.max(F.when((F.col("score") >= SUB_STYLE_FLOOR) & (F.col("style") != F.col("best")), ranked)).over(_doc())
    base = F.min("indent").over(_doc())
    opens = (F.col("place") == 0) | F.lag("glyph").over(_order()) | (F.lag("indent").over(_order()) > base + SUBORDINATE) | (F.col("gap") >= F.col("typical"))
    introduces = F.col("able") & (F.col("indent") <= base + SUBORDINATE) & (F.col("next_anchor") | F.col("second_anchor")) & opens
    larger = F.col("able") & (F.col("size") >= F.col("body") + LARGER_THAN_BODY) & (F.col("bold") | F.col("caps"))
    rows = rows.withColumns({"second": second, "introduces": introduces, "larger": larger})
    strategy = (
        F.when(F.col("best").isNotNull(), "style").when(F.sum(F.col("introduces").cast("int")).over(_doc()) >= 2, "position")
        .when(F.max("larger").over(_doc()), "size").otherwise("spacing")
    )
    rows = rows.withColumn("strategy", strategy)
    heading = (
        F.when(F.col("strategy") == "style", F.col("able") & (F.col("style") == F.col("best"))).when(F.col("strategy") == "position", F.col("introduces"))
        .when(F.col("strategy") == "size", F.col("larger")).otherwise(F.lit(False))
    )
    sub = F.when(F.col("second.followed") < EMPLOYER_SHARE, F.col("second.style"))
    return rows.withColumns({"heading": heading, "sub_style": sub}).drop("uses", "air", "begin", "end", "followed", "score", "best", "second", "introduces", "larger", "next_anchor", "second_anchor", "rows", "place")


def with_sections(rows: DataFrame) -> DataFrame:
    """``rows`` with sec and sub: numbers of the section and of the sub-section, 0 for what stands above the first.

    Rows above the first heading are section 0: preamble, unless two of them are dated. Without headings a
    section begins after air of 3.2 body sizes. Two sub-headings at least divide a section.
    """
    breaks = (F.col("strategy") == "spacing") & (F.col("gap") >= 2 * BLOCK_GAP * F.col("body")) & F.lag("n").over(_order()).isNotNull()
    rows = rows.withColumn("sec", F.sum((F.col("heading") | breaks).cast("int")).over(_order()) + (F.col("strategy") == "spacing").cast("int"))
    section = Window.partitionBy("doc_id", "sec")
    sub = F.col("able") & ~F.col("heading") & F.coalesce(F.col("style") == F.col("sub_style"), F.lit(False)) & (F.col("strategy") == "style")
    dated = F.sum((F.col("anchor") & ~F.col("heading")).cast("int")).over(section)
    rows = rows.withColumns({"preamble": (F.col("sec") == 0) & (dated < 2), "subheading": sub})
    rows = rows.withColumn("subheading", F.col("subheading") & ~F.col("preamble") & (F.sum(F.col("subheading").cast("int")).over(section) >= 2))
    return rows.withColumn("sub", F.sum(F.col("subheading").cast("int")).over(section.orderBy("n")))


def _continues(text: Column, before: Column) -> Column:
    opened = F.regexp_count(before, F.lit(r"\(")) > F.regexp_count(before, F.lit(r"\)"))
    return text.rlike(r"^[\p{Ll})\]},;]") | (opened & text.contains(")")) | before.rlike(r"(?U)(?:[,\-/&]|und|and)\s*$")


def fold(flags: list[int], indents: list[float], text_indents: list[float], base: float) -> list[tuple[int, int, int, str]]:
    """Entry, kind, the row that it is part of and what joins it to that, for each row of a dated section.

    The state: where the last title begins, whether rows wait for their title, and which rows were the last
    bullet and the last line of the open entry.
    """
    entry, begins, waiting, waiting_at = -1, base, False, base
    title = bullet = line = -1
    out: list[tuple[int, int, int, str]] = []
    for k, (flag, indent, text_indent) in enumerate(zip(flags, indents, text_indents, strict=True)):
        deeper = indent > begins + SUBORDINATE
        marked = bool(flag & PRINTED or (deeper and not flag & MARKED))
        kind, part, glue = 2, k, ""
        if flag & WRAPPED and entry >= 0:
            part = (line if line >= 0 else title) if waiting else bullet if bullet >= 0 else line if line >= 0 else title
            kind, glue = (0 if part == title else out[part][1]), "   " if waiting else " "
        elif flag & ANCHOR and not (deeper or flag & PRINTED):
            if waiting:
                part, glue, begins = title, "   ", min(waiting_at, text_indent)
            else:
                entry, title, bullet, line, begins = entry + 1, k, -1, -1, text_indent
            kind, waiting = 0, False
        elif marked or flag & WIDE_GAP:
            waiting = False
            if entry < 0:
                entry, title, kind = 0, k, 0
            else:
                kind = 1 if marked else 3 if flag & ASIDE else 2
        elif waiting or flag & BOLD or entry < 0:
            if not waiting:
                entry, title, bullet, line, kind, waiting_at = entry + 1, k, -1, -1, 0, text_indent
            waiting = True
        else:
            kind = 3 if flag & ASIDE else 2
        if part == k and kind == 1:
            bullet = k
        if part == k and kind == 2:
            line = k
        out.append((entry, kind, part, glue))
    return out


def _folded(*columns: Column) -> Column:
    @F.pandas_udf("array<struct<entry:int,kind:int,part:int,glue:string>>")
    def run(flags: pd.Series, indents: pd.Series, text_indents: pd.Series, base: pd.Series) -> pd.Series:
        made = [fold(list(f), list(i), list(t), b) for f, i, t, b in zip(flags, indents, text_indents, base, strict=True)]
        return pd.Series([[dict(zip(("entry", "kind", "part", "glue"), x, strict=True)) for x in rows] for rows in made])

    return run(*columns)


def _flat(rows: DataFrame) -> DataFrame:
    """Rows of leaf sections that have no dates: entries of titled categories, else items."""
    leaf = Window.partitionBy("doc_id", "sec", "sub")
    plain, printed = ~F.col("printed"), F.col("printed").cast("int")
    ordinary = F.collect_set(F.when(F.col("printed"), F.col("style"))).over(leaf)
    ahead = F.max(F.when(F.col("printed"), F.col("n"))).over(leaf)
    able = F.coalesce(F.col("category").isin(*TITLED_UNDATED), F.lit(False)) & plain & (F.sum(printed).over(leaf) >= 2) & ~F.array_contains(ordinary, F.col("style")) & (F.col("n") < ahead)
    rows = rows.withColumn("candidate", able).withColumn("run", F.sum((~F.col("candidate")).cast("int")).over(leaf.orderBy("n")))
    starts = F.col("candidate") & (F.row_number().over(Window.partitionBy("doc_id", "sec", "sub", "run", "candidate").orderBy("n")) % 2 == 1)
    rows = rows.withColumn("starts", starts)
    rows = rows.withColumn("starts", F.col("starts") & (F.sum(F.col("starts").cast("int")).over(leaf) >= 2))
    rows = rows.withColumn("entry_no", F.sum(F.col("starts").cast("int")).over(leaf.orderBy("n")) - 1)
    entry = Window.partitionBy("doc_id", "sec", "sub", "entry_no").orderBy("n")
    rows = rows.withColumns({"first_style": F.first("style").over(entry), "first_n": F.first("n").over(entry)})
    broken = F.sum((F.col("printed") | (F.col("style") != F.col("first_style"))).cast("int")).over(entry)
    title = (F.col("entry_no") >= 0) & (broken == 0)
    kind = F.when(F.col("entry_no") < 0, "item").when(title, "title").when(F.col("printed"), "bullet").when(F.col("aside"), "aside").otherwise("line")
    rows = rows.withColumn("kind", kind)
    part = F.when((F.col("kind") == "title"), F.col("first_n")).otherwise(F.col("n"))
    glue = F.when((F.col("kind") == "title") & (F.col("n") != F.col("first_n")), "   ").otherwise("")
    return rows.select("doc_id", "sec", "sub", "n", F.when(F.col("entry_no") >= 0, F.col("entry_no")).cast("int").alias("entry_no"), "kind", part.alias("part"), glue.alias("glue"), "printed", "text", "category")


def filled(rows: DataFrame, lookup: Lookup) -> DataFrame:
    """doc_id, sec, sub, n, entry_no, kind, text, dates, category: one row for each thing that the tree holds.

    ``rows`` have sections. Kinds: preamble, heading, subheading, title, bullet, line, aside, item. Rows that
    were wrapped are part of what they continue; n is the first row. category is that of the leaf's heading.
    """
    leaf = Window.partitionBy("doc_id", "sec", "sub")
    is_head = F.col("heading") | F.col("subheading")
    heads = rows.where(is_head).select("doc_id", F.col("n").alias("line_no"), F.trim("text").alias("line"))
    known = lookup(heads).groupBy("doc_id", F.col("line_no").cast("long").alias("n")).agg(F.min("category").alias("own"))
    known = known.where("own IS NOT NULL").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "own"))).alias("_known"))  # by document, so that its rows stay where they are
    own = F.when(is_head, F.try_element_at("_known", F.col("n")))
    rows = rows.join(known, "doc_id", "left").withColumn("category", F.max(own).over(leaf)).drop("_known")
    still = rows.where(is_head | F.col("preamble"))
    kind = F.when(F.col("heading"), "heading").when(F.col("subheading"), "subheading").otherwise("preamble")
    none = F.lit(None).cast("int")
    out = still.select("doc_id", "sec", "sub", "n", none.alias("entry_no"), kind.alias("kind"), F.col("n").alias("part"), F.lit("").alias("glue"), F.lit(False).alias("printed"), "text", "category")

    body = rows.where(~is_head & ~F.col("preamble"))
    prose = F.col("count") == 1
    body = body.withColumns({
        "base": F.min("indent").over(leaf), "left": F.min("x0").over(leaf), "right": F.max("x1").over(leaf), "dated": F.max("anchor").over(leaf),
        "measure": F.when(F.sum(prose.cast("int")).over(leaf) >= 3, F.max(F.when(prose, F.col("x1"))).over(leaf)).otherwise(0.0),
    })
    above = lambda c: F.lag(c).over(leaf.orderBy("n"))
    full = (above("count") == 1) & (F.col("measure") > 0) & (above("x1") >= F.col("measure") * (1 - MEASURE_SLACK))
    fresh = (F.col("bold") & ~above("bold")) | (F.col("size") > above("size") + MEASURE_SLACK)
    wrapped = ~F.col("printed") & (F.abs(F.col("indent") - above("indent")) <= SUBORDINATE) & ~F.col("anchor") & ~fresh & (_continues(F.col("text"), above("text")) | full)
    body = body.withColumns({"wrapped": F.coalesce(wrapped, F.lit(False)), "aside": F.coalesce((F.col("right") > F.col("left")) & ((F.col("x0") - F.col("left")) / (F.col("right") - F.col("left")) > ASIDE_SHARE), F.lit(False))})
    flags = [(WRAPPED, "wrapped"), (ANCHOR, "anchor"), (PRINTED, "printed"), (BOLD, "bold"), (ASIDE, "aside"), (MARKED, "marked")]
    flag = F.when(F.col("gap") >= BLOCK_GAP * F.col("body"), WIDE_GAP).otherwise(0)
    for bit, name in flags:
        flag = flag + F.when(F.col(name), bit).otherwise(0)
    dated = body.where("dated").withColumn("flag", flag)
    packed = dated.groupBy("doc_id", "sec", "sub").agg(F.array_sort(F.collect_list(F.struct("n", "flag", "indent", "text_indent", "text"))).alias("r"), F.first("base").alias("base"), F.first("category").alias("category"))
    packed = packed.withColumn("f", _folded(F.col("r.flag"), F.col("r.indent"), F.col("r.text_indent"), F.col("base")))
    both = F.transform(F.sequence(F.lit(1), F.size("r")), lambda k: F.struct(F.element_at("r", k).alias("r"), F.element_at("f", k).alias("f"), F.element_at("r", F.element_at("f", k)["part"] + 1)["n"].alias("part")))
    folded = packed.select("doc_id", "sec", "sub", "category", F.explode(both).alias("b"))
    names = F.array(*map(F.lit, KINDS))
    folded = folded.select("doc_id", "sec", "sub", F.col("b.r.n").alias("n"), F.col("b.f.entry").alias("entry_no"), F.element_at(names, F.col("b.f.kind") + 1).alias("kind"), F.col("b.part").alias("part"), F.col("b.f.glue").alias("glue"), F.col("b.r.flag").bitwiseAND(F.lit(PRINTED)).cast("boolean").alias("printed"), F.col("b.r.text").alias("text"), "category")
    out = out.unionByName(folded).unionByName(_flat(body.where("NOT dated")))

    mark = F.regexp_replace("text", r"(?U)^(?:[oO] (?=\p{Lu})|.)\s*", "")
    clean = F.when((F.col("kind") == "bullet") & (F.col("n") == F.col("part")) & F.col("printed"), mark).otherwise(F.col("text"))
    dates = F.when(F.col("kind") == "title", F.regexp_extract("text", P.java(P.RANGE, True), 0))
    parts = out.withColumns({"text": F.concat("glue", clean), "dates": dates}).repartition(max(1, rows.rdd.getNumPartitions()), "doc_id")  # dealt as the rows were, for whatever reads the tree by document
    ordered = F.array_sort(F.collect_list(F.struct("n", "text")))
    seen = F.min_by("dates", F.when(F.col("dates") != "", F.col("n")))
    return parts.groupBy("doc_id", "sec", "sub", "part", "entry_no", "kind").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"), F.coalesce(seen, F.lit("")).alias("dates"), F.min("category").alias("category")).withColumnRenamed("part", "n")


def tree_of(rows: DataFrame, lookup: Lookup, rejoin: bool = True) -> DataFrame:
    """``filled`` rows of documents given as rows with pieces: every rung from features to entries."""
    featured = with_features(wrapped_headings_joined(rows, lookup) if rejoin else rows).drop("pieces", "first", "last")  # the sorts to come carry what is asked later
    return filled(checkpointed(with_sections(with_headings(featured)), stays_dealt=not rejoin), lookup)


def forest(tree: DataFrame) -> DataFrame:
    """doc_id, sec, sub, parent_sec, parent_sub, level, place, heading, entries, all_entries, items, bare, thin, kind, status.

    A row for each section, in the order of reading; ``place`` counts from 0. A sub-section that the
    vocabulary knows is a section of its own and follows the one it stood in. ``all_entries`` are the
    section's own or, where it has none, those below it. A bare entry has neither bullet nor line, a thin
    one has one of them. Entries that say nothing want attention; items never do.
    """
    count = lambda kind: F.sum((F.col("kind") == kind).cast("int"))
    head = F.col("kind").isin("heading", "subheading")
    told = tree.where("kind <> 'preamble'").groupBy("doc_id", "sec", "sub", "entry_no").agg((count("bullet") + count("line")).alias("said"), F.max(F.when(head, F.col("text"))).alias("heading"), F.max("category").alias("category"), count("item").alias("items"))
    of_entries = lambda said: F.sum((F.col("entry_no").isNotNull() & (F.col("said") == said)).cast("int"))
    made = told.groupBy("doc_id", "sec", "sub").agg(
        F.max("heading").alias("heading"), F.max("category").alias("category"), F.sum("items").alias("items"), F.count("entry_no").alias("entries"), of_entries(0).alias("bare"), of_entries(1).alias("thin"),
    ).withColumn("sub", F.col("sub").cast("long"))
    owner = F.struct(*[(F.lit(0) if c in ("sub", "items", "entries", "bare", "thin") else F.lit(None)).cast(made.schema[c].dataType).alias(c) for c in made.columns[2:]])
    own, orphan = F.struct(*made.columns[2:]), (F.col("sub") > 0) & (F.col("sub") == F.min("sub").over(Window.partitionBy("doc_id", "sec")))
    made = made.withColumn("both", F.when(orphan, F.array(owner, own)).otherwise(F.array(own))).select("doc_id", "sec", F.explode("both").alias("r")).select("doc_id", "sec", "r.*")
    section = Window.partitionBy("doc_id", "sec")
    lifted = (F.col("sub") > 0) & F.col("category").isNotNull()
    made = made.withColumn("lifted", lifted)
    below = F.sum(F.when(~F.col("lifted"), F.col("entries")).otherwise(0)).over(section)
    child = (F.col("sub") > 0) & ~F.col("lifted")
    order = Window.partitionBy("doc_id").orderBy("sec", F.when(F.col("lifted"), F.col("sub")).otherwise(0), "sub")
    kind = F.when(F.col("entries") > 0, "entries").otherwise("items")
    return made.select(
        "doc_id", F.col("sec").cast("long").alias("sec"), F.col("sub").cast("long").alias("sub"), F.when(child, F.col("sec")).cast("long").alias("parent_sec"), F.when(child, F.lit(0)).cast("long").alias("parent_sub"), child.cast("int").alias("level"),
        (F.row_number().over(order) - 1).cast("long").alias("place"), "heading", "entries", F.when((F.col("entries") > 0) | (F.col("sub") > 0), F.col("entries")).otherwise(below).alias("all_entries"), "items", "bare", "thin",
        kind.alias("kind"), F.when(F.col("bare") > 0, "needs_attention").otherwise("strong").alias("status"),
    )


def entries_by_heading(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, key, offset, title, bullets, description: entries under each heading's name in small letters, in the order of reading.

    A heading without entries of its own has those below it; one that appears twice keeps both sets.
    """
    own = nodes.where("heading IS NOT NULL").select("doc_id", normalise(F.col("heading")).alias("key"), "place", "sec", "sub", "entries", "all_entries")
    child = nodes.where("parent_sec IS NOT NULL").select("doc_id", "sec", "sub")
    inherited = own.where("entries = 0 AND all_entries > 0").select("doc_id", "key", "place", "sec").join(child, ["doc_id", "sec"])
    source = own.where("entries > 0").select("doc_id", "key", "place", "sec", "sub").unionByName(inherited.select("doc_id", "key", "place", "sec", "sub"))
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "text")))), lambda x: x["text"])
    told = tree.where("entry_no IS NOT NULL").groupBy("doc_id", "sec", "sub", "entry_no").agg(F.min("n").alias("n"), F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"), ordered("bullet").alias("bullets"), ordered("line").alias("description"))
    offset = F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("place", "n")) - 1
    return source.join(told, ["doc_id", "sec", "sub"]).select("doc_id", "key", offset.cast("long").alias("offset"), "title", "bullets", "description")


def rendered(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, text: the forest written out in the order of reading, children under their parents, bullets behind hyphens."""
    row = lambda k1, k2, k3, k4, t: F.struct(k1.cast("long").alias("a"), k2.cast("long").alias("b"), k3.cast("long").alias("c"), k4.cast("long").alias("d"), t.alias("t"))
    zero, pad = F.lit(0), lambda level, steps: F.repeat(F.lit("  "), level + steps)
    closing = F.max(F.when(F.col("parent_sec").isNotNull() | (F.col("sub") == 0), F.col("place"))).over(Window.partitionBy("doc_id", "sec"))
    closes = F.when(F.col("sub") == 0, closing).otherwise(F.col("place"))
    title = F.concat(pad(F.col("level"), 0), F.coalesce("heading", F.lit("(section with no readable heading)")))
    marks = F.array(row(F.col("place"), zero, zero, zero, title), row(F.col("closes"), F.lit(3), -F.col("level"), F.col("place"), F.lit("")))
    at = F.struct(F.struct("sec", "sub").alias("at"), F.struct("place", "level").alias("to"))
    placed = nodes.where("doc_id IS NOT NULL").withColumn("closes", closes).groupBy("doc_id").agg(F.flatten(F.collect_list(marks)).alias("marks"), F.map_from_entries(F.collect_list(at)).alias("places"))

    def line(x: Column, to: Column) -> Column:
        item = x["entry_no"].isNull()
        said = F.when((x["kind"] == "title") | item, F.concat(pad(to["level"], 1), x["text"])).when(x["kind"] == "bullet", F.concat(pad(to["level"], 2), F.lit("- "), x["text"])).otherwise(F.concat(pad(to["level"], 2), x["text"]))
        body = F.when(~x["kind"].isin("heading", "subheading") & to.isNotNull(), row(to["place"], F.lit(1) + item.cast("int"), F.coalesce(x["entry_no"], zero), x["n"], said))
        return F.when(x["kind"] == "preamble", row(F.lit(-1), zero, zero, x["n"], x["text"])).otherwise(body)

    # A document's tree is one row where it lies, and so are its places: nothing of the text is moved.
    whole = tree.groupBy("doc_id").agg(F.collect_list(F.struct("sec", "sub", "n", "entry_no", "kind", "text")).alias("said")).join(placed, "doc_id", "left")
    lines = F.filter(F.transform("said", lambda x: let(F.try_element_at("places", F.struct(x["sec"].alias("sec"), x["sub"].alias("sub"))), lambda to: line(x, to))), lambda r: r.isNotNull())
    after = F.when(F.exists("said", lambda x: x["kind"] == "preamble"), F.array(row(F.lit(-1), F.lit(1), zero, zero, F.lit(""))))
    everything = F.concat(lines, *(F.coalesce(c, F.array().cast(_LINES)) for c in (F.col("marks"), after)))
    text = F.array_join(F.transform(F.array_sort(everything), lambda r: r["t"]), "\n")
    return whole.select("doc_id", F.concat(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit("\n")).alias("text"))
