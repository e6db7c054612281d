"""Layout-aware text of HTML pages.

A tokenizer feeds a small tree builder that implies missing end tags; a renderer walks the tree with
visibility rules and writes blocks on lines of their own, list items behind their marks, preformatted
text as it is, and tables with aligned cells. An end tag only reaches as far as its element's scope, so
one that is out of place neither opens what is hidden nor breaks a table. Alignment stops at a bounded
width and lists at a bounded indent: time and output stay in proportion to the page, however broken, and
no text is cut for it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.runtime import bounded_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style template noscript iframe object svg math canvas audio video datalist select noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks with an empty line before and after them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr".split())
#: A start tag ends these open elements, up to the named boundary.
IMPLIED_END = {
    **dict.fromkeys("li".split(), (frozenset({"li"}), frozenset("ul ol menu dir".split()))),
    **dict.fromkeys("dt dd".split(), (frozenset({"dt", "dd"}), frozenset({"dl"}))),
    **dict.fromkeys("option optgroup".split(), (frozenset({"option"}), frozenset({"select"}))),
    **dict.fromkeys("td th".split(), (frozenset({"td", "th"}), frozenset({"tr", "table"}))),
    "tr": (frozenset({"td", "th", "tr", "caption", "colgroup"}), frozenset({"table"})),
    **dict.fromkeys("thead tbody tfoot".split(), (frozenset("td th tr thead tbody tfoot caption colgroup".split()), frozenset({"table"}))),
}
#: End tags don't reach beyond these; those of table parts only stop at a table.
FENCES = frozenset("td th table caption button object template".split())
TABLE_PARTS = frozenset("tr td th thead tbody tfoot caption table".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an inline element's end tag doesn't close.
SOLID = BLOCK | FENCES | {"select"}
#: Hidden elements whose end tag closes whatever was left open inside.
SHUT = HIDDEN - BLOCK - RAW
#: Elements of text style: their end tag takes effect within blocks too.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
FOREIGN, INTEGRATED = frozenset({"svg", "math"}), frozenset({"foreignobject", "desc", "title", "annotation-xml"})
#: Start tags that end a drawing or formula.
BREAKS_OUT = (BLOCK | frozenset("b big br code em embed i img nobr ruby s small span strong strike sub sup tt u var".split())) - {"html", "legend", "summary", "fieldset", "form"}
IN_SELECT = frozenset("option optgroup hr script template".split())
ENDS_PARAGRAPH = BLOCK - frozenset("td th tr tbody thead tfoot body html".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


class _Stack:
    """The open elements below the root, and where those of each name stand, so that deep pages stay linear."""

    def __init__(self, root: Node) -> None:
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.solid: list[int] = []
        self.again = 0

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        if node.tag in SOLID:
            self.solid.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
        while self.solid and self.solid[-1] >= at:
            self.solid.pop()

    def highest(self, tags: frozenset[str]) -> int:
        return max(map(self.last, tags))

    def end(self, tag: str, most: int) -> bool:
        """Close the innermost open element of a name that the end tag reaches; false if there is none.

        An element of text style that is hidden and has open blocks inside ends there all the same: those
        blocks are begun again behind it. That is done for ``most`` blocks of a page at most.
        """
        at = self.last(tag)
        if not at:
            return False
        if tag in TABLE_PARTS:
            if tag != "table" and at < self.last("table"):
                return False
        elif tag in BLOCK or tag in SHUT or tag in FENCES:
            if at < self.highest(FENCES - {tag}) or (tag == "li" and at < self.highest(LISTS)):
                return False
        elif self.solid and self.solid[-1] > at:
            inside = self.nodes[at + 1 :]
            if tag not in FORMATTING or not hidden(self.nodes[at]) or at < self.highest(FENCES) or self.again + len(inside) > most:
                return False
            self.again += len(inside)
            self.cut(at)
            for node in inside:
                if node.tag in BLOCK:
                    fresh = Node(node.tag, node.attributes)
                    self.nodes[-1].children.append(fresh)
                    self.push(fresh)
            return True
        self.cut(at)
        return True

    def out_of_drawing(self, tag: str) -> None:
        """A start tag of text ends a drawing or formula that it stands in."""
        at = self.highest(FOREIGN)
        if at and tag in BREAKS_OUT and at > self.highest(INTEGRATED) and at > self.highest(FENCES):
            self.cut(min(p for t in FOREIGN for p in self.places.get(t, ()) if p > max(self.highest(INTEGRATED), self.highest(FENCES))))

    def in_select(self, tag: str) -> bool:
        """Whether a start tag is lost because a selection is open; what can't stand in one ends it."""
        at = self.last("select")
        if not at or at < self.highest(FENCES) or tag in IN_SELECT:
            return False
        if tag in ("input", "textarea", "select") or (tag in TABLE_PARTS and self.last("table")):
            self.cut(at)
            return tag == "select"
        return True

    def last(self, tag: str) -> int:
        """Where the innermost open element of a name stands, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, ends: frozenset[str], bound: frozenset[str]) -> None:
        """Pop up to the outermost open element of ``ends`` above the boundary."""
        floor = max(map(self.last, bound))
        above = [places[k] for tag in ends if (places := self.places.get(tag)) and (k := bisect_right(places, floor)) < len(places)]
        if above:
            self.cut(min(above))


class _Scanner:
    """Reads tags from left to right; no place is read more often than a fixed number of times."""

    def __init__(self, source: str) -> None:
        self.source, self.at = source, 0
        self.last = {quote: source.rfind(quote) for quote in "\"'"}

    def text(self) -> str:
        """What stands before the next tag, comment or end of the page; a < that begins none of them is text."""
        source, begin, look = self.source, self.at, self.at
        while True:
            look = source.find("<", look)
            if look < 0:
                self.at = len(source)
                break
            follows = source[look + 1 : look + 2]
            if follows.isascii() and follows.isalpha() or follows in ("!", "?") or (follows == "/" and look + 2 < len(source)):
                self.at = look
                break
            look += 1
        return source[begin : self.at]

    def past(self, mark: str, at: int) -> None:
        found = self.source.find(mark, at)
        self.at = len(self.source) if found < 0 else found + len(mark)

    def attributes(self) -> dict[str, str] | None:
        """A tag's attributes, the first of each name; None if the page ends within the tag.

        A quoted value without its closing quote is read as a bare one.
        """
        source, size, found = self.source, len(self.source), {}
        while True:
            self.at = _GAP.match(source, self.at).end()
            if self.at >= size:
                return None
            if source[self.at] == ">":
                self.at += 1
                return found
            key = _KEY.match(source, self.at)
            self.at, value = key.end(), ""
            if equals := _EQUALS.match(source, self.at):
                self.at = equals.end()
                quote = source[self.at : self.at + 1]
                if quote in self.last and self.last[quote] > self.at:
                    end = source.index(quote, self.at + 1)
                    value, self.at = source[self.at + 1 : end], end + 1
                else:
                    value = _BARE.match(source, self.at)[0]
                    self.at += len(value)
            found.setdefault(key[0].lower(), html.unescape(value))


def parse(source: str) -> Node:
    """The tree of a page; text and unknown elements anywhere, end tags without a start are dropped.

    A page that ends within a tag loses that tag alone.
    """
    root = Node("html")
    stack, scan, size = _Stack(root), _Scanner(source), len(source)
    while scan.at < size:
        if text := scan.text():
            stack.nodes[-1].children.append(html.unescape(text))
        at = scan.at
        if at >= size:
            break
        if source.startswith("<!--", at):
            scan.past("-->", at + 2 if source[at + 4 : at + 5] == ">" else at + 4)
            continue
        if source.startswith("<![CDATA[", at):
            scan.past("]]>", at)
            continue
        closing = source[at + 1] == "/"
        name = _NAME.match(source, at + 1 + closing)
        if not name:  # declarations, processing instructions and ends without a name
            scan.past(">", at)
            continue
        scan.at, tag = name.end(), name[0].lower()
        if (attributes := scan.attributes()) is None:
            break
        if closing:
            if tag in HEADINGS and not stack.last(tag):
                tag = max(HEADINGS, key=stack.last)
            if not stack.end(tag, size) and tag in ("p", "br"):
                stack.nodes[-1].children.append(Node(tag))
            continue
        if tag in ("html", "body") or stack.in_select(tag):
            continue
        stack.out_of_drawing(tag)
        if tag in ENDS_PARAGRAPH:
            stack.close(frozenset({"p"}), frozenset({"td", "th", "table", "button", "li", "dd", "dt"}))
        if tag in IMPLIED_END:
            stack.close(*IMPLIED_END[tag])
        if tag in ("td", "th") and stack.nodes[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack.nodes[-1].children.append(row)
            stack.push(row)
        node = Node(tag, attributes)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            begin = scan.at
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, begin)
            inner = source[begin : end.start() if end else size]
            node.children.append(html.unescape(inner) if tag in ("title", "textarea") else inner)
            scan.at = end.end() if end else size
        elif tag == "form" and stack.nodes[-2:] and stack.nodes[-1].tag in ("table", "thead", "tbody", "tfoot", "tr"):
            pass  # a form between the parts of a table holds nothing
        elif tag not in VOID and not ((stack.highest(FOREIGN) or tag in FOREIGN) and source[scan.at - 2] == "/"):
            stack.push(node)
    return root


def hidden(node: Node) -> bool:
    attributes = node.attributes
    return (
        node.tag in HIDDEN
        or "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or (node.tag == "input" and attributes.get("type", "").lower() == "hidden")
        or bool(_UNSEEN.search(attributes.get("style", "")))
    )


class _Lines:
    """Text as lines; spaces collapse and empty lines are put between spaced blocks, never doubled."""

    def __init__(self, tables: int = 0) -> None:
        self.tables = tables  # how many aligned tables these lines stand in
        self.lines: list[str] = []
        self.open: list[str] = []
        self.space = self.gap = False
        self.mark = ""

    def text(self, value: str, pre: bool) -> None:
        if pre:
            first, *more = value.split("\n")
            self._put(first)
            for line in more:
                self.lines.append("".join(self.open))
                self.open = []
                self._put(line)
            return
        words = _SPACES.sub(" ", value)
        if not words.strip(" "):
            self.space = self.space or bool(words)
            return
        if (self.space or words[0] == " ") and self.open and not self.open[-1].endswith(" "):
            self._put(" ")
        self._put(words.strip(" "))
        self.space = words[-1] == " "

    def _put(self, value: str) -> None:
        if value and not self.open:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            if self.mark:
                self.open.append(self.mark)
            self.mark = ""
        if value:
            self.open.append(value)

    def end(self, gap: bool = False) -> None:
        if self.open:
            self.lines.append("".join(self.open).rstrip(" "))
        self.open, self.space = [], False
        self.gap = self.gap or gap

    def done(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


@dataclass
class _Open:
    """An element whose children are being written, what to do after the last of them, and its own state."""

    node: Node
    out: _Lines
    pre: bool
    depth: int
    then: Callable[[], None] | None = None
    at: int = 0
    number: int = 0
    step: int = 1

    def __post_init__(self) -> None:
        if self.node.tag == "ol":
            given = self.node.attributes
            if "reversed" in given:
                self.step = -1
            first = sum(isinstance(c, Node) and c.tag == "li" for c in self.node.children) if self.step < 0 else 1
            self.number = _number(given.get("start"), first) - self.step

    def next(self, item: Node) -> int:
        self.number = _number(item.attributes.get("value"), self.number + self.step)
        return self.number


#: Lists deeper than this aren't indented further; tables within so many others are blocks, not aligned.
DEEPEST_INDENT, ALIGNED_TABLES = 24, 6


def _number(value: str | None, default: int) -> int:
    found = re.match(r"\s*([+-]?[0-9]{1,9})", value or "")
    return int(found[1]) if found else default


def render(node: Node) -> str:
    """The text of a tree; an explicit stack stands in for recursion, so that no depth is too deep."""
    top = _Lines()
    stack = [_Open(node, top, False, 0)]
    while stack:
        frame = stack[-1]
        if frame.at == len(frame.node.children):
            stack.pop()
            if frame.then:
                frame.then()
            continue
        child = frame.node.children[frame.at]
        frame.at += 1
        out, pre, depth = frame.out, frame.pre, frame.depth
        if isinstance(child, str):
            out.text(child, pre)
            continue
        tag = child.tag
        if hidden(child):
            continue
        if tag == "br":
            if not out.open:
                out.lines.append("")
            out.end()
        elif tag == "img":
            if child.attributes.get("alt", "").strip():
                out.text(f" {child.attributes['alt']} ", False)
        elif tag == "table" and out.tables < ALIGNED_TABLES:
            out.end(True)
            _open_table(child, out, stack)
        elif tag == "li":
            number = frame.next(child)
            out.end()
            out.mark = "  " * min(max(0, depth - 1), DEEPEST_INDENT) + (f"{number}. " if frame.node.tag == "ol" else "- ")
            stack.append(_Open(child, out, pre, depth, partial(_end_item, out)))
        elif tag in BLOCK:
            nested = tag in ("ul", "ol", "menu", "dir")
            gap = tag in SPACED and not (nested and depth)
            out.end(gap)
            stack.append(_Open(child, out, pre or tag == "pre", depth + nested, partial(out.end, gap)))
        else:
            stack.append(_Open(child, out, pre or tag == "textarea", depth))
    return top.done()


def _end_item(out: _Lines) -> None:
    out.end()
    out.mark = ""


def _rows(table: Node) -> Iterator[Node]:
    waiting = [table]
    while waiting:
        node = waiting.pop()
        if node.tag == "tr" and node is not table:
            yield node
            continue
        waiting += [c for c in reversed(node.children) if isinstance(c, Node) and not hidden(c) and c.tag in ("tr", "thead", "tbody", "tfoot")]


#: Cells up to this length set a column's width; lines are aligned up to this place, in so many columns.
ALIGNED_CELL, ALIGNED_LINE, ALIGNED_COLUMNS = 48, 200, 64
Cell = tuple[Node, _Lines]


def _stray(node: Node) -> Iterator[Node | str]:
    """What stands in a table, its groups and rows outside of cells, in order."""
    waiting = list(reversed(node.children))
    while waiting:
        child = waiting.pop()
        if isinstance(child, Node) and (child.tag in ("td", "th", "colgroup", "col") or hidden(child)):
            continue
        if isinstance(child, Node) and child.tag in ("tr", "thead", "tbody", "tfoot"):
            waiting += reversed(child.children)
        else:
            yield child


def _open_table(table: Node, out: _Lines, stack: list[_Open]) -> None:
    """Put the table's cells and its stray content on the stack, each with lines of its own, and lay them out after the last."""
    rest = Node("div", {}, list(_stray(table)))
    rows = [[(c, _Lines(out.tables + 1)) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th") and not hidden(c)] for r in _rows(table)]
    stray = _Lines(out.tables + 1)

    def laid_out() -> None:
        for line in _aligned(stray, rows):
            out.text(line, True)
            out.end()
        out.end(True)

    stack.append(_Open(rest, stray, False, 0, laid_out))
    stack.extend(_Open(c, cell, False, 0) for row in reversed(rows) for c, cell in reversed(row))


def _placed(rows: list[list[Cell]]) -> list[list[tuple[int, int, list[str]]]]:
    """First column, column after the last, and lines of every cell; cells of earlier rows that reach down take their columns.

    Columns beyond the last that is aligned are all the same one.
    """
    out, until = [], [0] * ALIGNED_COLUMNS
    for k, row in enumerate(rows):
        at, here = 0, []
        for node, cell in row:
            while at < ALIGNED_COLUMNS and until[at] > k:
                at += 1
            stop = min(at + min(max(_number(node.attributes.get("colspan"), 1), 1), 1000), ALIGNED_COLUMNS)
            down = _number(node.attributes.get("rowspan"), 1)
            down = len(rows) - k if down == 0 else max(down, 1)
            here.append((at, stop, [line for line in cell.done().split("\n") if line]))
            for c in range(at, stop if down > 1 else at):
                until[c] = max(until[c], k + down)
            at = max(at, stop)
        out.append(here)
    return out


def _aligned(stray: _Lines, rows: list[list[Cell]]) -> list[str]:
    """Caption and stray content first, then rows whose cells stand in columns, two spaces apart.

    A cell over several columns begins where the first of them does; the last is widened if it needs more.
    A cell of several lines takes as many below each other. A longer cell than the aligned ones pushes what
    follows it on its line to the right; no line is filled up beyond a fixed place.
    """
    lines = [line for line in stray.done().split("\n") if line]
    placed = _placed(rows)
    starts = sorted({a for row in placed for a, _, _ in row if a < ALIGNED_COLUMNS})
    number = {a: k for k, a in enumerate(starts)}
    width = [0] * len(starts)
    cells = [(number[a], bisect_left(starts, b), max(len(t) for t in said)) for row in placed for a, b, said in row if a in number and said]
    for a, b, size in sorted(cells, key=lambda c: c[1] - c[0]):
        if size <= ALIGNED_CELL * (b - a):
            width[b - 1] += max(0, size - sum(width[a:b]) - 2 * (b - a - 1))
    begin = [0, *accumulate(w + 2 for w in width)]
    for row in placed:
        said = [(begin[number[a]] if a in number else ALIGNED_LINE + 1, own) for a, _, own in row if own]
        for k in range(max((len(own) for _, own in said), default=0)):
            parts, size = [], 0
            for at, own in said:
                if k < len(own):
                    gap = max(at - size if at <= ALIGNED_LINE else 0, 2 if size else 0)
                    parts += (" " * gap, own[k])
                    size += gap + len(own[k])
            lines.append("".join(parts).rstrip())
    return lines


def visible_text(source: str | None) -> str:
    """Everything a reader sees on the page; of a null or empty page nothing."""
    return render(parse(source)) if source else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``visible`` added, a row for each row; pages never leave their partition.

    A column named visible is replaced.
    """
    bounded_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def run(sources: pd.Series) -> pd.Series:
        return sources.map(visible_text, na_action=None)

    return pages.withColumn("visible", run(column))
