"""Layout-aware text of HTML pages.

A tree builder with implied end tags and void and raw-text elements, a pass that
takes out what a browser would not show, and a renderer that lays out blocks,
lists and tables.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tessella.llm import common

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset("head script style title template noscript iframe object embed audio video canvas datalist area base link meta param source track noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary ul table caption thead tbody tfoot tr".split())
#: Hidden inside these only: what a drawing refers to or says about itself, and a formula's other notations.
FOREIGN = {
    "svg": frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
FOREIGN_HIDDEN = FOREIGN["svg"] | FOREIGN["math"]
#: Labels of a drawing and cells of a formula's table, which stand apart.
APART = frozenset("text foreignobject mtr mtd".split())
#: Blocks with an empty line around them.
SPACED = frozenset("article blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre section table ul".split())
#: Start tags that end an open element, and the elements beyond which they do not look.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ol", "ul", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th", "caption", "colgroup"}), frozenset({"table", "thead", "tbody", "tfoot"})),
    "td": (frozenset({"td", "th", "caption", "colgroup"}), frozenset({"table", "tr"})),
    "th": (frozenset({"td", "th", "caption", "colgroup"}), frozenset({"table", "tr"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup", "datalist"})),
    "body": (frozenset({"head"}), frozenset()),
}
#: Formatting elements stay inside these when an end tag is looked up.
SCOPE = frozenset("table td th caption html template".split())

#: Elements deeper than this are siblings of those above, as in browsers.
DEEPEST = 512
# The most columns and rows that a cell spans, by the HTML standard, and the types of input fields that show no text.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SILENT_INPUTS = frozenset("hidden password checkbox radio file image color range".split())
#: Blanks that alignment and indentation may add: so many a character of the page, and some for small pages.  A table or list beyond that is not aligned.
PADDING, LEAST_PADDING = 8, 4096

# An attribute's value is quoted, to the page's end if its mark is not closed, or reaches to a blank, whatever marks are in it.
_VALUE = r"\s*=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?"
TOKEN = re.compile(rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*+(?:[\s/]++|[^\s/>][^\s/>=]*+(?:{_VALUE})?+)*+>?", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "depth")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []

    def attributes(self) -> dict[str, str]:
        return {k.lower(): unescape(v[1:-1] if v[:1] in "\"'" and v else v) for k, v in ATTRIBUTE.findall(self.attrs)}


def build(html: str) -> Node:
    """The page's tree.  Unknown end tags are left out; open elements end with their parents."""
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    root = node = Node("#root")
    at, end = 0, len(html)
    find = TOKEN.search
    while at < end:
        m = find(html, at)
        if m is None:
            node.children.append(unescape(html[at:]))
            break
        if m.start() > at:
            node.children.append(unescape(html[at : m.start()]))
        at, token = m.end(), m[0]
        if token[1] in "!?":
            continue
        tag = NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag == "br":
                node.children.append(Node("br", "", node))
                continue
            open_ = node
            while open_ is not root and open_.tag != tag:
                if open_.tag in SCOPE and tag not in SCOPE and tag not in ("tr", "thead", "tbody", "tfoot"):
                    open_ = root
                else:
                    open_ = open_.parent
            if open_ is not root:
                node = open_.parent
            continue
        if tag in ENDS_P:
            up = node
            while up is not root and up.tag != "p" and up.tag not in SCOPE and up.tag not in BLOCK:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in IMPLIED:
            ended, limit = IMPLIED[tag]
            up, last = node, None
            while up is not root and up.tag not in limit:
                if up.tag in ended:
                    last = up
                up = up.parent
            if last is not None:
                node = last.parent
        if tag in ("td", "th") and node.tag in ("table", "thead", "tbody", "tfoot"):
            # Cells imply their row.
            node.children.append(Node("tr", "", node))
            node = node.children[-1]
        if node.depth >= DEEPEST:
            node = node.parent
        new = Node(tag, token[len(tag) + 1 :].rstrip(">"), node)
        node.children.append(new)
        if tag in VOID or token.endswith("/>") and (tag in ("svg", "math", "path", "use", "circle", "rect") or foreign(node)):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            stop = close.start() if close else end
            body = html[at:stop]
            new.children.append(unescape(body.removeprefix("\n")) if tag == "textarea" else body)
            at = close.end() if close else end
            continue
        if tag == "pre" and html.startswith("\n", at):
            at += 1  # the line that the start tag is on
        node = new
    return root


def foreign(node: Node | None) -> str | None:
    """svg or math where a node is part of one, else None."""
    while node is not None and node.tag != "foreignobject":
        if node.tag in FOREIGN:
            return node.tag
        node = node.parent
    return None


def declared(style: str) -> dict[str, str]:
    """The declarations of a style attribute: of one property the last, but that an important one stays."""
    out: dict[str, str] = {}
    fixed = set()
    for part in style.lower().split(";"):
        name, colon, value = part.partition(":")
        name, value, important = name.strip(), value.strip(), False
        if value.endswith("important") and value[:-9].rstrip().endswith("!"):
            value, important = value[:-9].rstrip()[:-1].rstrip(), True
        if colon and value and (important or name not in fixed):
            out[name] = value
            if important:
                fixed.add(name)
    return out


def gone(node: Node, a: dict[str, str]) -> bool:
    """Whether an element takes no place at all, with what it holds."""
    if node.tag in HIDDEN:
        return True
    if node.tag in FOREIGN_HIDDEN and (kind := foreign(node.parent)) and node.tag in FOREIGN[kind]:
        return True
    style = declared(a["style"]) if "style" in a else {}
    return "hidden" in a or style.get("display") == "none" or style.get("content-visibility") == "hidden" or node.tag == "dialog" and "open" not in a


def _field(node: Node, a: dict[str, str]) -> str:
    """What an input field shows: its value, or else its placeholder."""
    kind = a.get("type", "text").strip().lower()
    if kind in SILENT_INPUTS:
        return ""
    return a.get("value", "") or ("" if kind in ("submit", "button", "reset") else a.get("placeholder", ""))


def _chosen(node: Node, a: dict[str, str]) -> list[Node | str]:
    """The options that a list shows: all of an open one, else the selected or first one."""
    if "multiple" in a or a.get("size", "1").strip() not in ("", "0", "1"):
        return node.children
    options, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.tag == "option":
                options.append(x)
            elif x.tag == "optgroup":
                stack += reversed(x.children)
    marked = [x for x in options if "selected" in x.attributes()]
    return marked[-1:] or options[:1]


def prune(root: Node) -> None:
    """Takes out of the tree what is not shown; visibility is inherited until an element sets it anew."""
    stack = [(root, True)]
    while stack:
        node, shown = stack.pop()
        left: list[Node | str] = []
        for x in node.children:
            if isinstance(x, str):
                if shown:
                    left.append(x)
                continue
            a = x.attributes() if x.attrs and not x.attrs.isspace() else {}
            if gone(x, a):
                continue
            said = declared(a["style"]).get("visibility") if "style" in a else None
            seen = said == "visible" if said in ("visible", "hidden", "collapse") else shown
            if x.tag == "details" and "open" not in a:
                x.children = [c for c in x.children if isinstance(c, Node) and c.tag == "summary"][:1]
            elif x.tag == "select":
                x.children = _chosen(x, a)
            elif x.tag == "input":
                x.children = [_field(x, a)]
            left.append(x)
            stack.append((x, seen))
        node.children = left


class _Blanks:
    """What is left of a page's padding."""

    def __init__(self, n: int):
        self.left = n

    def take(self, n: int) -> bool:
        if n > self.left:
            return False
        self.left -= n
        return True


class _Layout:
    """Lines of one block context; a line is broken once however many blocks end there."""

    def __init__(self, blanks: _Blanks):
        self.blanks = blanks
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s == " ":
            self.space = self.space or bool(self.now)
            return
        if not s:
            return
        self._open()
        if self.now and (self.space or s[0] == " "):
            self.now.append(" ")
        self.space = s[-1] == " "
        self.now.append(s.strip(" "))

    def raw(self, s: str) -> None:
        if self.now and self.space:
            self.now.append(" ")
        self.space = False
        for i, line in enumerate(s.split("\n")):
            if i:
                self.line(True)
            if line:
                self._open()
                self.now.append(line)

    def _open(self) -> None:
        if not self.now:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0

    def line(self, always: bool = False) -> None:
        """Ends the line; always: also an empty one."""
        if self.now or always:
            self._open()
            self.lines.append("".join(self.now).rstrip(" "))
            self.now, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap = max(self.gap, int(spaced))

    def lay(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.line()
        if not self.blanks.take(len(rest) * len(lines)):
            rest = ""
        for i, line in enumerate(lines):
            self.now = [(first if i == 0 else rest) + line]
            line_ = self.now
            self.now = []
            self._open()
            self.now = line_
            self.line()

    def end(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _flow(root: Node, out: _Layout, pre: bool = False) -> None:
    """Lays out a node's content; a stack stands for recursion but for lists, tables and their parts."""
    stack: list[tuple] = [("in", c, pre) for c in reversed(root.children)]
    while stack:
        act, x, pre = stack.pop()
        if act == "out":
            out.block(x)
        elif isinstance(x, str):
            out.raw(x) if pre else out.text(x)
        elif x.tag == "br":
            out.line(True)
        elif x.tag == "table":
            out.block(True)
            out.lay(_table(x, out.blanks))
            out.block(True)
        elif x.tag in ("ul", "ol", "menu"):
            spaced = x.parent is None or x.parent.tag != "li"
            out.block(spaced)
            _list(x, out)
            out.block(spaced)
        elif x.tag in BLOCK or x.tag in APART and foreign(x.parent):
            spaced = x.tag in SPACED
            out.block(spaced)
            stack.append(("out", spaced, pre))
            inner = pre or x.tag == "pre"
            stack += [("in", c, inner) for c in reversed(x.children)]
        elif x.tag in FIELDS:
            # Fields, buttons and options stand apart from the words around them.
            out.text(" ")
            stack.append(("in", " ", False))
            stack += [("in", c, x.tag == "textarea") for c in reversed(x.children)]
        else:
            stack += [("in", c, pre) for c in reversed(x.children)]


#: Elements of forms whose text stands apart.
FIELDS = frozenset("input textarea select option optgroup button".split())


def _inner(node: Node, blanks: _Blanks) -> list[str]:
    out = _Layout(blanks)
    _flow(node, out)
    return out.end()


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\s*[-+]?\d{1,9}", text) else default


def _list(node: Node, out: _Layout) -> None:
    attributes = node.attributes() if node.attrs.strip() else {}
    step = -1 if "reversed" in attributes else 1
    first = sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if step < 0 else 1
    number = _number(attributes.get("start"), first)
    for child in node.children:
        if isinstance(child, str):
            out.text(child)
        elif child.tag != "li":
            holder = Node("div", "", node)
            holder.children = [child]
            out.lay(_inner(holder, out.blanks), "  ", "  ")
        else:
            if node.tag == "ol" and "value" in child.attrs.lower():
                number = _number(child.attributes().get("value"), number)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += step
            lines = _inner(child, out.blanks)
            if lines:
                out.lay(lines, mark, " " * len(mark))


def _rows(table: Node) -> Iterator[tuple[str, Node | str]]:
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                yield "text", " ".join(child.split())
        elif child.tag in ("thead", "tbody", "tfoot"):
            yield from _rows(child)
        else:
            yield ("row" if child.tag == "tr" else "other"), child


def _span(a: dict[str, str], name: str, most: int) -> int:
    value = a.get(name, "1").strip()
    return min(max(1, int(value)), most) if value.isascii() and value.isdigit() and len(value) < 10 else 1


def _grid(rows: list[Node], blanks: _Blanks) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns spanned, lines) of every row's cells; a cell that reaches down keeps the later rows' cells out of its columns."""
    grid, down = [], {}  # down: column -> rows that a cell above still takes
    for row in rows:
        cells, column = [], 0
        taken = {c for c, n in down.items() if n > 0}
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip():
                continue
            a = cell.attributes() if isinstance(cell, Node) and cell.tag in ("td", "th") and cell.attrs.strip() else {}
            wide, high = _span(a, "colspan", MOST_COLUMNS), _span(a, "rowspan", MOST_ROWS)
            while column in taken:
                column += 1
            cells.append((column, wide, [" ".join(cell.split())] if isinstance(cell, str) else _inner(cell, blanks)))
            if high > 1:
                down.update((c, high) for c in range(column, column + wide))
            column += wide
        down = {c: n - 1 for c, n in down.items() if n > 1}
        grid.append(cells)
    return grid


def _table(table: Node, blanks: _Blanks) -> list[str]:
    """Caption and stray content as lines, rows with their cells in columns of equal width.

    Columns in which no cell begins have no width.  Where alignment would take
    more blanks than the page has left, cells stand side by side unaligned.
    """
    stray, before, rows = [], [], []
    for kind, node in _rows(table):
        if kind == "text":
            stray.append(node)
        elif kind == "row":
            rows.append(node)
        else:
            before += _inner(node, blanks)
    before = stray + before
    grid = [cells for cells in _grid(rows, blanks) if any(lines for _, _, lines in cells)]
    if not grid:
        return before
    if max(len(cells) for cells in grid) == 1:
        return before + [line for cells in grid for line in cells[0][2]]
    # Only columns in which a cell begins count.
    place = {c: i for i, c in enumerate(sorted({c for cells in grid for c, _, _ in cells}))}
    starts = sorted(place)
    width = [0] * len(starts)
    for cells in grid:
        for c, wide, lines in cells:
            if place[c] + 1 == len(starts) or starts[place[c] + 1] >= c + wide:
                width[place[c]] = max(width[place[c]], max(map(len, lines), default=0))
    reach = [0]  # the places at which columns begin
    for w in width:
        reach.append(reach[-1] + w + 3)
    high = [max(len(lines) for _, _, lines in cells) for cells in grid]
    added = sum(h * max(reach[place[c]] for c, _, lines in cells if lines) for h, cells in zip(high, grid))
    if not blanks.take(added):
        return before + [" | ".join(line for line in (lines[k] if k < len(lines) else "" for _, _, lines in cells) if line) for h, cells in zip(high, grid) for k in range(h)]
    out = []
    for h, cells in zip(high, grid):
        begins = {place[c]: lines for c, _, lines in cells}
        last = max(begins)
        covered = {i for c, wide, _ in cells for i in range(place[c] + 1, len(starts)) if starts[i] < c + wide}
        for k in range(h):
            line = ""
            for i in range(last + 1):
                if i in covered:
                    continue
                lines = begins.get(i, [])
                if i:
                    line = line.ljust(reach[i] - 3) + " | "
                line += lines[k] if k < len(lines) else ""
            out.append(line.rstrip(" |") if not line.replace("|", "").strip() else line.rstrip(" "))
    return before + out


#: Python frames a level of nested lists or tables takes, with room to spare.
FRAMES = 8


def render(html: str) -> str:
    """All text that a page shows.

    >>> render("<p>a<p>b<ul><li>c<li>d</ul>")
    'a\\n\\nb\\n\\n- c\\n- d'
    """
    root = build(html)
    prune(root)
    out = _Layout(_Blanks(PADDING * len(html) + LEAST_PADDING))
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, FRAMES * DEEPEST + 1000))
    try:
        _flow(root, out)
    finally:
        sys.setrecursionlimit(limit)
    return "\n".join(out.end()).strip("\n").replace("\xa0", " ")


def extract(df: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and text of every page: null or empty html gives an empty text; repeated rows are rows; an empty table gives none; other columns are ignored.

    A page of any length is rendered whole; its text is at most some ten times as
    long, as padding is bounded by the page's length.
    """
    common.small_batches(df.sparkSession)
    out = common.schema_of(common.field(df, id_col), ("text", T.StringType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in common.text_slices(whole, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([render(x) if x else "" for x in part.column(1).to_pylist()], pa.string())], names=out.names)

    return common.spread(df.select(id_col, html_col)).mapInArrow(common.releasing(work), out)
