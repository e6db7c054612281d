"""Pages that are broken: nothing visible is lost, nothing hidden is shown, and time and output stay in proportion."""

import random
import re
import time

import pytest

pytest.importorskip("pandas")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<table><tr>stray<td>x</td></tr></table>", "stray\nx"),
        ("<table><tr><div>lost</div><td>x</td></tr></table>", "lost\nx"),
        ("<table><tbody>inner text<tr><td>x</td></tr></tbody></table>", "inner text\nx"),
        ("<span hidden><div></span>secret</div></span>after", "after"),
        ("<div hidden><table><tr><td></div>secret</td></tr></table></div>after", "after"),
        ("<table><tr><td>a</div><td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><form><tr><td>a<td>b<tr><td>cc<td>d</form></table>", "a   b\ncc  d"),
        ("<table><tr><td><ul><li>a<li>b</ul><td>x</table>", "- a  x\n- b"),
        ("<table><tr><td><table><tr><td>1<td>2<tr><td>10<td>3</table><td>out</table>", "1   2  out\n10  3"),
        ("<a hidden><div>x</a>y</div>z", "y\nz"),
        ("<svg><text>no<div>yes</div>", "yes"),
        ("<svg><path d='x'/><g>q</g></svg>ok", "ok"),
        ("<select><option>no<div>no</div></select>yes", "yes"),
        ("<video><p>no</video>yes", "yes"),
        ("<h1>a</h2>b", "a\n\nb"),
        ("x</br>y", "x\ny"),
        ("<ul><li>a<ul><li>b</li></li><li>c</ul></ul>d", "- a\n  - b\n  - c\n\nd"),
        ("<table><tr><td hidden>no<td>yes<tr hidden><td>no</table>", "yes"),
        ("<table><caption>C</div><tr><td>a</table>", "C\na"),
        ("<table><tr><td>" + "long " * 20 + "<td>b<tr><td>a<td>b</table>", ("long " * 20).strip() + "  b\na  b"),
    ],
)
def test_broken_pages(page, text):
    from scriptorium.llm.html_text import visible_text

    assert visible_text(page) == text


def test_no_text_is_lost_or_said_twice():
    from scriptorium.llm.html_text import visible_text

    chance = random.Random(5)
    names = "div p span b a ul li ol table tr td th tbody caption form h2 blockquote dl dt dd button font pre".split()
    for _ in range(4000):
        page, words = "", []
        for k in range(chance.randint(1, 25)):
            kind = chance.random()
            if kind < 0.4:
                words.append(f"w{k}x")
                page += f" {words[-1]} "
            elif kind < 0.75:
                page += f"<{chance.choice(names)}>"
            else:
                page += f"</{chance.choice(names)}>"
        assert sorted(re.findall(r"w\d+x", visible_text(page))) == sorted(words), page


BLOCKS = {"div", "p", "ul", "li", "table", "tr", "td"}


def plain_tree(tokens):
    """The same rules on a plain stack, looked through from the top for every tag."""
    root = ("html", [])
    stack = [root]

    def find(names, stops):
        for at in range(len(stack) - 1, 0, -1):
            if stack[at][0] in names:
                return at
            if stack[at][0] in stops:
                return 0
        return 0

    for kind, name in tokens:
        if kind == "text":
            stack[-1][1].append(name)
        elif kind == "start":
            if name in BLOCKS - {"td", "tr"} and (at := find({"p"}, {"td", "table", "li"})):
                del stack[at:]
            ends, stops = {"li": ({"li"}, {"ul"}), "td": ({"td"}, {"tr", "table"}), "tr": ({"td", "tr"}, {"table"})}.get(name, (set(), set()))
            while at := find(ends, stops):
                del stack[at:]
            if name == "td" and stack[-1][0] == "table":
                stack[-1][1].append(row := ("tr", []))
                stack.append(row)
            stack[-1][1].append(node := (name, []))
            stack.append(node)
        else:
            stops = {"table"} if name in {"tr", "td", "table"} else {"td", "table"} | ({"ul"} if name == "li" else set()) if name in BLOCKS else BLOCKS
            if at := find({name}, stops - {name}):
                del stack[at:]
            elif name == "p":
                stack[-1][1].append(("p", []))
    return root


def test_trees_equal_plain_ones():
    from scriptorium.llm.html_text import Node, parse

    chance = random.Random(9)
    shape = lambda node: (node.tag, [shape(c) if isinstance(c, Node) else c for c in node.children])
    for _ in range(5000):
        tokens = [(chance.choice(["start", "start", "end", "text"]), chance.choice(["div", "p", "ul", "li", "table", "tr", "td", "span", "i"])) for _ in range(chance.randint(1, 20))]
        tokens = [(kind, f"t{k}" if kind == "text" else name) for k, (kind, name) in enumerate(tokens)]
        merged = []
        for kind, name in tokens:
            if kind == "text" and merged and merged[-1][0] == "text":
                merged[-1] = ("text", merged[-1][1] + name)
            else:
                merged.append((kind, name))
        page = "".join({"text": "{}", "start": "<{}>", "end": "</{}>"}[kind].format(name) for kind, name in merged)
        assert shape(parse(page)) == plain_tree(merged), page


@pytest.mark.parametrize(
    ("page", "most"),
    [
        ("<table>" + "<tr><td rowspan=0>x" * 8000, 2), ("<table><tr><td>" + "w" * 32_000 + "<td>b" + "<tr><td>a<td>b" * 8000, 2), ("<ul><li>x" * 8000, 8), ("<table><tr>" + "<td rowspan=0>y" * 3000 + "<tr><td>z" * 3000, 2),
        ("<b hidden>" * 2000 + "<div>" * 2000 + "</b>" * 2000, 1), ("<span hidden><div>" * 10_000 + "</span>" * 10_000, 1), ("<table><tr><td>x" * 3000, 2), ("<svg><g>" * 10_000 + "<p>x" * 10_000, 2), ("<select><option>" * 10_000, 1),
        ("<table><tr>" + "<td>" * 30_000 + "x", 2), ("<table><tr><td colspan=1000 rowspan=1000>x" * 3000, 2), ("<ol><li>" * 4000 + "x", 2), ("<table><tr><td>" + "<br>x" * 10_000 + "<td>" * 60 + "y" + "<br>y" * 10_000, 30),
    ],
)
def test_time_and_output_in_proportion(page, most):
    from scriptorium.llm.html_text import visible_text

    began = time.process_time()
    assert len(visible_text(page)) <= most * len(page) + 1000
    assert time.process_time() - began < 5
