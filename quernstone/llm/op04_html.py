"""Layout-aware rendering of HTML to text.

A tokenizer, a tree builder that closes and opens implied elements, and a renderer that emits all visible text
in document order: blocks on lines of their own, a blank line around those with a margin, list items behind their
marker and indented by depth, quotations behind "> ", preformatted text as it is, and the cells of a table's
columns aligned.

Not visible: head, script, style, template, noscript and the like; comments; elements with the hidden attribute or an
inline style of display:none or visibility:hidden; closed dialogs; closed details but for their summary; the text of
replaced elements (object, video, iframe, ...). Style sheets and scripts are not evaluated. White space collapses as on a
page; a no-break space becomes a space.

Time and memory grow in proportion to the page, whatever its markup: tags are found through the places of quotes and of ">", open elements
through the places of their names on the stack, and the tree is walked without recursion, to any depth. Three rules keep
the output in proportion as well, and none of them leaves out text: indents grow up to 32 levels; in a cell, rows and
cells of a further table are separated by a space; a cell of over 200 characters does not widen its columns, and a table
that would be wider than 1,000 has two spaces between cells.

Defined results: NULL or empty HTML gives an empty text and a NULL title; broken markup never fails: unknown end tags
are ignored, open elements end with their parent, a "<" that starts no tag is text; a NULL page_id or url is
carried; repeated rows are rendered each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame

# Element names by role: fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript noembed noframes iframe object video audio canvas svg annotation annotation-xml datalist param source track area title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section summary table textarea ul caption tr thead tbody tfoot".split()
)
MARGIN = frozenset("article blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: A start tag ends open elements of these names, up to one of the barriers.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl", "table"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("thead tbody tfoot table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
P_BARRIER = frozenset("table td th caption button object html".split())
CELL_BARRIER = frozenset(["table"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta title script style template noscript".split())
#: Levels of indent; characters of a cell that can widen a column; width of a table that is aligned.
MOST_INDENT, WIDE_CELL, WIDE_TABLE = 32, 200, 1_000

_OPEN = re.compile(r"<(?=[a-zA-Z!?/])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        """The attribute's value, empty if it has none; None if it is absent."""
        if name not in self.attributes.lower():
            return None
        for k, a, b, c in _ATTRIBUTE.findall(self.attributes):
            if k.lower() == name:
                return html.unescape(a or b or c)
        return None


class _Ends:
    """Where tags end: the first ">" that stands in no quotes; if the quotes don't close, the first one at all."""

    def __init__(self, page: str):
        self.page = page
        self.at = [m.start() for m in re.finditer("[>\"']", page)]
        # From the last mark to the first: the end of a tag whose first mark this one is.
        self.end = [-1] * (len(self.at) + 1)
        following: dict[str, int] = {}
        for i in range(len(self.at) - 1, -1, -1):
            mark = page[self.at[i]]
            if mark == ">":
                self.end[i] = self.at[i]
            else:
                self.end[i] = self.end[following[mark] + 1] if mark in following else -1
                following[mark] = i
        self.last = page.rfind(">")

    def after(self, place: int) -> int:
        """The place of the ">" that ends a tag whose attributes begin here; -1 if none does."""
        if place > self.last:
            return -1
        end = self.end[bisect_left(self.at, place)]
        return end if end >= 0 else self.page.find(">", place)


class _Stack:
    """Open elements, and the places of each name among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.top.children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def innermost(self, names: frozenset) -> int:
        return max((places[-1] for n in names if (places := self.places.get(n))), default=0)

    def close(self, names: frozenset, barriers: frozenset) -> None:
        """Ends the innermost element of these names, and what is in it, unless a barrier stands in it; of several names, all such elements."""
        while (i := self.innermost(names)) and i > self.innermost(barriers - names):
            while len(self.nodes) > i:
                self.pop()
            if len(names) == 1:
                break


_P = frozenset(["p"])
_OF_TABLES = frozenset("tr td th tbody thead tfoot".split())
_CELLS = frozenset("td th table".split())


def parse(page: str) -> Node:
    """The tree of a page; text is a str among the children."""
    root = Node("#root")
    open_, ends = _Stack(root), _Ends(page)

    def start(tag: str, attributes: str) -> None:
        if open_.top.tag == "head" and tag not in IN_HEAD:
            open_.pop()  # the head ends where something visible begins
        if tag in CLOSES_P:
            open_.close(_P, P_BARRIER)
        if tag in ENDS:
            open_.close(*ENDS[tag])
        if tag in HEADINGS and open_.top.tag in HEADINGS:
            open_.pop()
        top = open_.top.tag
        if tag == "tr" and top == "table":
            open_.push(Node("tbody"))
        elif tag in ("td", "th") and top in ("table", "tbody", "thead", "tfoot"):
            if top == "table":
                open_.push(Node("tbody"))
            open_.push(Node("tr"))
        if tag in VOID:
            open_.top.children.append(Node(tag, attributes))
        else:
            open_.push(Node(tag, attributes))

    def text(begin: int, end: int) -> None:
        said = page[begin:end]
        if said:
            if open_.top.tag == "head" and said.strip():
                open_.pop()
            open_.top.children.append(html.unescape(said) if "&" in said else said)

    at = seen = 0  # text from `at` on is not taken yet; tags are looked for from `seen` on
    while m := _OPEN.search(page, seen):
        begin = m.start()
        if page.startswith("<!--", begin):
            text(at, begin)
            end = _COMMENT_END.search(page, begin + 4)
            at = seen = end.end() if end else len(page)
            continue
        name = _NAME.match(page, begin + 1 + (page[begin + 1] == "/"))
        end = ends.after(name.end()) if name else page.find(">", begin) if begin < ends.last else -1
        if end < 0 or not name and end == begin + 1:
            if begin > ends.last:
                break  # no tag ends from here on
            seen = begin + 1
            continue
        text(at, begin)
        at = seen = end + 1
        if not name:
            continue
        tag = name[0].lower()
        if page[begin + 1] == "/":
            if tag == "p":
                open_.close(_P, P_BARRIER)
            elif tag in HEADINGS:
                open_.close(HEADINGS, P_BARRIER)
            else:
                open_.close(frozenset([tag]), frozenset() if tag in ("table", "body", "html") else CELL_BARRIER if tag in _OF_TABLES else _CELLS)
            continue
        start(tag, page[name.end() : end])
        if tag in RAW or tag in RCDATA:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = m.start() if m else len(page)
            inside = page[at:stop]
            if inside:
                open_.top.children.append(html.unescape(inside) if tag in RCDATA else inside)
            open_.pop()
            end = page.find(">", m.end()) if m else -1
            at = seen = end + 1 if end >= 0 else len(page)
    text(at, len(page))
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    if not node.attributes:
        return node.tag != "dialog"
    if node.get("hidden") is not None or node.tag == "input" and (node.get("type") or "").lower() == "hidden":
        return False
    style = node.get("style")
    if style and _INVISIBLE.search(style):
        return False
    return node.tag != "dialog" or node.get("open") is not None


class _Page:
    """Lines under construction. In a cell (flat) tables have no grid."""

    def __init__(self, flat: bool = False):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indents = [""]
        self.marker = ""
        self.gap: str | None = None  # the indent of a blank line that is due
        self.flat = flat

    @property
    def indent(self) -> str:
        return self.indents[-1]

    def deeper(self, by: str) -> None:
        self.indents.append(self.indent + by if len(self.indents) <= MOST_INDENT else self.indent)

    def back(self) -> None:
        self.indents.pop()

    def line(self, text: str) -> None:
        if self.gap is not None:
            self.lines.append(self.gap.rstrip())
        self.gap = None
        self.lines.append((self.indent[: max(0, len(self.indent) - len(self.marker))] + self.marker if self.marker else self.indent) + text)
        self.marker = ""

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.inline)).strip(" ")
        self.inline.clear()
        if text:
            self.line(text.replace("\xa0", " "))

    def margin(self) -> None:
        self.flush()
        if self.gap is None and self.lines and not self.marker:
            self.gap = self.indent


def _number(node: Node, name: str) -> int:
    value = (node.get(name) or "").strip()
    return max(1, min(int(value), 1000)) if value.isdecimal() and len(value) < 6 else 1


# The walk: each function is a generator of the (node, page) to be rendered before it goes on; run() keeps the stack.


def run(node: Node, page: _Page) -> None:
    """Renders what is in the node."""
    waiting = [_children(node, page)]
    while waiting:
        task = next(waiting[-1], None)
        if task is None:
            waiting.pop()
            continue
        item, to = task
        if isinstance(item, str):
            to.inline.append(item)
        elif (tag := item.tag) in VOID:
            _void(item, to)
        elif visible(item):
            waiting.append(_block(item, to) if tag in BLOCK else _apart(item, to) if to.flat and tag in ("td", "th") else _children(item, to))


def _children(node: Node, page: _Page):
    for child in node.children:
        yield child, page


def _apart(node: Node, page: _Page):
    """A cell of a table that has no grid: its words touch no neighbour's."""
    page.inline.append(" ")
    yield from _children(node, page)
    page.inline.append(" ")


def _void(node: Node, page: _Page) -> None:
    if visible(node):
        if node.tag == "br" and _SPACES.sub("", "".join(page.inline)):
            page.flush()
        elif node.tag == "hr":
            page.margin()


def _block(node: Node, page: _Page):
    tag = node.tag
    margin = tag in MARGIN and not (tag in ("ul", "ol", "menu", "dir") and "  " in page.indent)
    page.margin() if margin else page.flush()
    if tag == "pre" or tag == "textarea":
        text = _plain(node).replace("\r\n", "\n").replace("\xa0", " ")
        for line in text.removeprefix("\n").rstrip("\n").split("\n"):
            page.line(line.rstrip()) if line.strip() else page.lines.append("")
    elif tag == "table" and not page.flat:
        for child in node.children:
            if isinstance(child, Node) and child.tag == "caption":
                yield child, page
        page.flush()
        yield from _table(node, page)
    elif tag in ("ul", "ol", "menu", "dir"):
        yield from _list(node, page)
    elif tag in ("blockquote", "dd"):
        page.deeper("> " if tag == "blockquote" else "  ")
        yield from _children(node, page)
        page.flush()
        page.back()
    elif tag == "details" and node.get("open") is None:
        for child in node.children:
            if isinstance(child, Node) and child.tag == "summary":
                yield child, page
    else:
        yield from _children(node, page)
    page.margin() if margin else page.flush()


def _cell(node: Node):
    """Renders the cell's children on a page of their own; returns its words on one line."""
    inner = _Page(flat=True)
    yield from _children(node, inner)
    inner.flush()
    return " ".join(x.strip() for x in inner.lines if x.strip())


def _table(node: Node, page: _Page):
    """Rows with their cells in columns; a cell spans colspan columns and rowspan rows."""
    parts = {"thead": [], "tbody": [], "tfoot": []}
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                page.inline.append(child)
        elif child.tag in parts and visible(child):
            for row in child.children:
                if isinstance(row, Node) and row.tag == "tr":
                    parts[child.tag].append(row)
                else:
                    yield row, page
        elif child.tag == "tr":
            parts["tbody"].append(child)
        elif child.tag not in parts and child.tag != "caption":
            yield child, page
    page.flush()
    grid: list[dict[int, tuple[str, int]]] = []  # column: text and the columns that it spans
    taken: dict[int, int] = {}  # column: the row from which on it is free
    for at, row in enumerate(r for r in parts["thead"] + parts["tbody"] + parts["tfoot"] if visible(r)):
        line: dict[int, tuple[str, int]] = {}
        column = 0
        for cell in row.children:
            if isinstance(cell, str):
                if cell.strip():
                    line[column] = (f"{line.get(column, ('', 1))[0]} {_SPACES.sub(' ', cell).strip()}".strip(), 1)
                continue
            if not visible(cell):
                continue
            while taken.get(column, 0) > at:
                column += 1
            wide, deep = _number(cell, "colspan"), _number(cell, "rowspan")
            said = yield from _cell(cell)
            line[column] = ((f"{line[column][0]} {said}".strip() if column in line else said), wide)
            if deep > 1:
                for c in range(column, column + wide):
                    taken[c] = at + deep
            column += wide
        grid.append(line)
    for text in _aligned(grid):
        page.line(text)


def _aligned(grid: list[dict[int, tuple[str, int]]]):
    """The lines of a grid, each column as wide as its widest cell; columns without text take no room."""
    width: dict[int, int] = {}
    for line in grid:
        for c, (text, wide) in line.items():
            if text:
                width[c] = max(width.get(c, 0), len(text) if wide == 1 and len(text) <= WIDE_CELL else 0)
    columns = sorted(width)
    begin = dict(zip(columns, accumulate((width[c] + 2 for c in columns), initial=0)))
    apart = sum(width.values()) + 2 * len(columns) > WIDE_TABLE
    for line in grid:
        out, at = [], 0
        for c, (text, _) in sorted(line.items()):
            if not text:
                continue
            if out:
                gap = 2 if apart else max(2, begin[c] - at)
            else:
                gap = 0 if apart else begin[c]
            out += [" " * gap, text]
            at += gap + len(text)
        if out:
            yield "".join(out).replace("\xa0", " ").rstrip()


def _plain(node: Node) -> str:
    """The visible text as it is."""
    out, waiting = [], [iter(node.children)]
    while waiting:
        child = next(waiting[-1], None)
        if child is None:
            waiting.pop()
        elif isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif visible(child):
            waiting.append(iter(child.children))
    return "".join(out)


def _list(node: Node, page: _Page):
    first = (node.get("start") or "").strip() if node.tag == "ol" else ""
    number = int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li" and visible(child):
            page.flush()
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            page.deeper(" " * len(marker))
            page.marker = marker
            yield from _children(child, page)
            page.flush()
            page.back()
            page.marker = ""
        else:
            yield child, page
    page.flush()


def title_of(root: Node) -> str | None:
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if node.tag == "title":
            return _SPACES.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip() or None
        waiting += [c for c in reversed(node.children) if isinstance(c, Node) and c.tag != "svg"]
    return None


def render(page: str | None) -> tuple[str | None, str]:
    """(title, visible text) of a page."""
    if not page:
        return None, ""
    root = parse(page)
    out = _Page()
    run(root, out)
    out.flush()
    return title_of(root), re.sub(r"\n{3,}", "\n\n", "\n".join(out.lines)).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text) of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [render(x.as_py()) for x in batch.column(2)]
            clean = lambda x: x if x is None else x.encode("utf-8", "replace").decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([clean(t) for t, _ in found], pa.string()), pa.array([clean(x) for _, x in found], pa.string())], names=["page_id", "url", "title", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, title string, text string")
