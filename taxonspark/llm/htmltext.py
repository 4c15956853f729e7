"""HTML extraction by layout: a small tree builder (implied end tags, void elements, visibility) and
a renderer that keeps block spacing, list markers and aligned table cells.

Everything visible is kept, navigation and footers included. Spark reads, partitions and writes; a page
is parsed and rendered on its own, so memory is bounded by the longest page.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Generator, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("""head title script style template noscript iframe object canvas audio video datalist dialog rp
    desc metadata defs symbol clippath mask marker annotation annotation-xml""".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split())
BLOCK = MARGIN | frozenset("""html body address article aside center dd details dir div dt figcaption footer form header
    hgroup legend li main menu nav optgroup option search section summary tr caption tbody thead tfoot td th""".split())
#: a start tag -> open elements that it ends, and those where the search for them stops
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
ENDS_P = BLOCK - frozenset("li dt dd option optgroup tr td th tbody thead tfoot caption html body legend summary".split())
SCOPE = frozenset("table td th caption button html".split())
#: bounds of the layout alone (all text stays): columns of indentation, tables in one another with aligned cells, the widest cell that
#: sets its column's width, and the blanks that aligning may add to a page, as a multiple of its length
MAX_INDENT, MAX_TABLES, MAX_CELL, MAX_BLANKS = 40, 50, 60, 2
_GONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible|inherit)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "shown")

    def __init__(self, tag: str, attrs: dict, shown: bool = True):
        self.tag, self.attrs, self.kids = tag, attrs, []
        stated = _VISIBILITY.findall(attrs.get("style") or "")
        self.shown = stated[-1].lower() == "visible" if stated and stated[-1].lower() != "inherit" else shown


class TreeBuilder(HTMLParser):
    """Builds the tree to any depth; the places of open elements are kept by tag, so none is searched for."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}

    def _last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _close(self, place: int) -> None:
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()

    def _end(self, names, stop) -> None:
        """Close the outermost open element of ``names`` above the innermost one of ``stop``."""
        low, found = self._last(stop), len(self.open)
        for name in names:
            places = self.at.get(name)
            if places and places[-1] > low:
                found = min(found, places[bisect_right(places, low)])
        self._close(found)

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        elif tag in ENDS_P:
            self._end({"p"}, SCOPE)
            if tag[0] == "h" and tag[1:].isdigit() and self.open[-1].tag[0] == "h" and self.open[-1].tag[1:].isdigit():
                self._close(len(self.open) - 1)
        node = Node(tag, dict(attrs), self.open[-1].shown)
        self.open[-1].kids.append(node)
        if tag == "textarea":  # its content is text, whatever it looks like
            self.set_cdata_mode(tag)
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (self.at.get("svg") or self.at.get("math")) and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)  # in HTML itself a slash closes nothing

    def handle_endtag(self, tag):
        if tag == "br":
            return self.handle_starttag("br", [])
        place = self._last((tag,))
        stop = () if tag == "table" else ("table",) if tag in ("tr", "tbody", "thead", "tfoot") else ("table", "td", "th")
        if place and place >= self._last(stop):
            self._close(place)

    def handle_data(self, data):
        if self.open[-1].shown:  # visibility is inherited, and can be given back within a hidden element
            self.open[-1].kids.append(unescape(data) if self.cdata_elem == "textarea" else data)

    def unknown_decl(self, data):  # <![CDATA[ ... is a comment in HTML
        pass


def tree(html: str) -> Node:
    b = TreeBuilder()
    b.feed(html)
    b.close()
    return b.root


def hidden(node: Node) -> bool:
    a = node.attrs
    return (node.tag in HIDDEN and not (node.tag == "dialog" and "open" in a) or "hidden" in a
            or node.tag == "input" or bool(a.get("style") and _GONE.search(a["style"])))


class Lines:
    """Finished lines and the one being written; white space collapses, margins become one blank line."""

    def __init__(self):
        self.done: list[str] = []
        self.now, self.gap, self.prefix, self.marker = "", False, "", None

    def text(self, s: str, pre: bool) -> None:
        if pre:
            head, *rest = s.split("\n")
            self._add(head)
            for line in rest:
                self.line(force=True)
                self._add(line)
            return
        words = s.split()
        if not words:
            if s and self.now and not self.now.endswith(" "):
                self.now += " "
            return
        if s[0].isspace() and self.now and not self.now.endswith(" "):
            self.now += " "
        self._add(" ".join(words) + (" " if s[-1].isspace() else ""))

    def _add(self, s: str) -> None:
        self.now += s

    def line(self, force: bool = False) -> None:
        if self.now.strip() or force:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            head = self.prefix
            if self.marker is not None:
                head, self.marker = self.prefix[:len(self.prefix) - len(self.marker)] + self.marker, None
            self.done.append((head + self.now).rstrip())
        self.now = ""

    def space(self) -> None:
        self.line()
        self.gap = True


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def unwound(call: Generator):
    """The result of ``call``, a generator that yields the calls it waits for: they are kept in a list, so
    that no depth of a page meets Python's bound of recursion."""
    calls, value = [call], None
    while calls:
        try:
            calls.append(calls[-1].send(value))
            value = None
        except StopIteration as done:
            calls.pop()
            value = done.value
    return value


def render(node: Node, out: Lines, pre: bool, tables: int, blanks: list[int]) -> Generator:
    """``tables``: those that ``node`` stands in; ``blanks``: what aligning may still add to the page."""
    number = 0
    if node.tag == "ol":
        start = node.attrs.get("start") or ""
        number = int(start) - 1 if start.lstrip("-").isdigit() and len(start) < 10 else 0
    shut = node.tag == "details" and "open" not in node.attrs
    for kid in node.kids:
        if isinstance(kid, str):
            if not shut:
                out.text(kid, pre)
            continue
        if hidden(kid) or shut and kid.tag != "summary":
            continue
        tag = kid.tag
        if tag == "br":
            out.line(force=True)
        elif tag == "hr":
            out.space()
        elif tag == "table" and tables < MAX_TABLES:
            out.space()
            for row in (yield table(kid, tables + 1, blanks)):
                out.now = row
                out.line(force=True)
            out.space()
        elif tag == "li":
            number += 1
            out.line()
            mark = f"{number}. " if node.tag == "ol" else "- "
            old, was = out.prefix, out.marker
            out.prefix, out.marker = old + " " * len(mark) if len(old) < MAX_INDENT else old, mark
            yield render(kid, out, pre, tables, blanks)
            out.line()
            out.prefix, out.marker = old, was if out.marker is not None else None
        elif tag in BLOCK:
            nested = tag in ("ul", "ol") and node.tag == "li"  # no blank line around a list within an item
            (out.space if tag in MARGIN and not nested else out.line)()
            old = out.prefix
            if tag in ("blockquote", "dd") and len(old) < MAX_INDENT:
                out.prefix += "  "
            yield render(kid, out, pre or tag == "pre", tables, blanks)
            (out.space if tag in MARGIN and not nested else out.line)()
            out.prefix = old
        else:
            yield render(kid, out, pre, tables, blanks)


def table(node: Node, tables: int, blanks: list[int]) -> Generator:
    """The caption's lines, then the rows: cells padded to their columns, several lines where a cell has them. A text wider than
    ``MAX_CELL`` sets no column's width, and once the page's blanks are used up the cells of a row follow each other unaligned."""
    lines: list[str] = []
    rows: list[list[list[str]]] = []
    wide: set[tuple[int, int]] = set()  # cells over several columns, which set no column's width

    def visit(part: Node) -> Generator:
        for kid in part.kids:
            if isinstance(kid, str):
                if kid.strip():
                    lines.append(" ".join(kid.split()))  # text outside cells is shown before the table
            elif not hidden(kid):
                if kid.tag == "tr":
                    row: list[list[str]] = []
                    for cell in kid.kids:
                        if isinstance(cell, str):
                            if cell.strip():
                                lines.append(" ".join(cell.split()))
                        elif not hidden(cell):
                            row.append((yield block_lines(cell, tables, blanks)))
                            span = cell.attrs.get("colspan") or "1"
                            if span.isdigit() and len(span) < 5 and int(span) > 1:
                                wide.add((len(rows), len(row) - 1))
                                row += [[] for _ in range(min(int(span), 100) - 1)]
                    rows.append(row)
                elif kid.tag in ("thead", "tbody", "tfoot", "colgroup", "form"):
                    yield visit(kid)
                else:
                    lines.extend((yield block_lines(kid, tables, blanks)))
    yield visit(node)
    widths: dict[int, int] = {}
    for i, row in enumerate(rows):
        for k, cell in enumerate(row):
            widths[k] = max([widths.get(k, 0), *(w for w in map(width, cell) if w <= MAX_CELL and (i, k) not in wide)])
    for row in rows:
        for i in range(max(map(len, row), default=0)):
            texts = [cell[i] if i < len(cell) else "" for cell in row]
            while texts and not texts[-1]:
                texts.pop()
            gaps = [max(0, widths[k] - width(t)) + 2 for k, t in enumerate(texts[:-1])]
            if sum(gaps) > blanks[0]:
                texts = [t for t in texts if t]
                gaps = [1] * (len(texts) - 1)
            else:
                blanks[0] -= sum(gaps)
            lines.append("".join(t + " " * n for t, n in zip(texts, [*gaps, 0], strict=False)).rstrip())
    return lines


def block_lines(node: Node, tables: int, blanks: list[int]) -> Generator:
    out = Lines()
    yield render(node, out, node.tag == "pre", tables, blanks)
    out.line()
    return out.done


def extract(html: str | None) -> str | None:
    """All visible text of a page; null for null, empty for a page without any."""
    return None if html is None else "\n".join(unwound(block_lines(tree(html), 0, [MAX_BLANKS * len(html)]))).strip("\n")


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 500):
            part = b.slice(lo, 500)
            texts = [extract(h) for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def visible_text(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, text, n_lines, n_chars (long).

    A null page has null text and counts 0; an empty one, and one without visible text, is empty with 0
    lines; broken markup is mended like a browser would, as far as the rules above go; repeated rows
    each get their row; an empty table gives no rows; other columns are not read."""
    workers(pages)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, text string").select(
        "page_id", "text", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
