"""Layout-aware rendering of HTML to text.

A tree builder opens and closes elements with the implied tags of the HTML rules; elements that a
browser does not show are skipped; the rest is laid out: blocks on lines of their own with blank
lines where margins are, lists with marks and indents, table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.llm.common import arrow_map

# Fixed values of the HTML rules: element names by how they are treated.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(
    "script style template noscript head title meta link base svg math iframe object audio video canvas datalist noembed noframes".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl dir menu blockquote pre figure table fieldset hr".split())
#: An opening tag closes open elements of these names, up to the nearest boundary.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th", "caption", "colgroup"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"),
    "option": ("option",),
    "optgroup": ("option", "optgroup"),
}
BOUNDARY = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
TABLE_BOUNDARY = ("table",)
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
IMPLIED = " implied"  # no attribute of a page has a space in its name
#: What stands in a table outside its cells, or shows nothing there. Other elements get a cell.
CELLESS = HIDDEN | frozenset("caption colgroup col tbody thead tfoot tr td th input br wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: A head stays open for these only; its end tag may be left out.
HEAD_CONTENT = frozenset("title meta link base basefont bgsound style script noscript noframes template".split())
#: Elements nested deeper are taken as siblings, as browsers do; their text stays.
DEPTH = 256
#: An attribute. Quotes delimit a value only right behind its equals sign.
_ONE = r"(?:=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$)|[^\s>]*))?"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<([a-zA-Z][^\s/>]*)((?:[\s/]|" + _ONE + r")*+)>?"
    r"|([^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"(=[^\s/>=]*|[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|$)|'([^']*)(?:'|$)|([^\s>]*)))?", re.S)
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)  # nodes and texts


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTR.findall(text):
        found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def parse(source: str) -> Node:
    """Tree of the page, with implied opening and closing tags."""
    root = Node("html")
    stack = [root]

    def close(names, until) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in until:
                return
            if stack[i].name in names:
                del stack[i:]
                return

    def close_all(names, until) -> None:
        size = 0
        while size != len(stack):
            size = len(stack)
            close(names, until)

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        end, start, rest, text = m.groups()
        if stack[-1].name == "head" and _ends_head(start, end, text):
            stack.pop()
        if text is not None:
            if stack[-1].name in TABLE_PARTS and text.strip():
                _cell(stack)
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        elif start is not None:
            name = start.lower()
            if name == "body":
                close(("head",), ("template",))
            if name in ("html", "body") or name == "head" and len(stack) > 1:
                continue
            if name in CLOSES_P:
                close(("p",), ("table", "td", "th", "button", "caption"))
            if name in CLOSES:
                close_all(CLOSES[name], BOUNDARY.get(name, TABLE_BOUNDARY))
            if name[0] == "h" and name[1:].isdigit():
                close(("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section", "article", "td", "th", "li"))
            if name == "tr" and stack[-1].name == "table":
                _open(stack, Node("tbody"))
            if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
                if stack[-1].name == "table":
                    _open(stack, Node("tbody"))
                _open(stack, Node("tr"))
            node = Node(name, attributes(rest) if rest.strip() else {})
            if stack[-1].name in TABLE_PARTS:
                if name == "form":  # shows nothing there and holds nothing
                    continue
                if name == "table":
                    close(("table",), ())
                elif name not in CELLESS:
                    _cell(stack)
            stack[-1].children.append(node)
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(source, at)
                body = source[at : stop.start()] if stop else source[at:]
                node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
                at = n if not stop else (source.find(">", stop.end()) + 1 or n)
            elif name not in VOID and not rest.rstrip().endswith("/") or name not in VOID and name in BLOCK:
                if len(stack) < DEPTH:
                    stack.append(node)
        elif end is not None:
            name = end.lower()
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            elif name in ("td", "th", "tr", "li", "dd", "dt") or name in BLOCK:
                close((name,), ("table",) if name not in ("table",) else ())
            else:
                close((name,), ("td", "th", "table", "body"))
    return root


def _ends_head(start: str | None, end: str | None, text: str | None) -> bool:
    """Whether a token cannot stand in a head. Comments can."""
    if text is not None:
        return bool(html.unescape(text).strip(" \t\n\r\f"))
    if start is not None:
        return start.lower() not in HEAD_CONTENT and start.lower() not in ("html", "head")
    return end is not None and end.lower() in ("body", "html", "br")


def _open(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    if len(stack) < DEPTH:
        stack.append(node)


def _cell(stack: list[Node]) -> None:
    """What stands in a table outside a cell gets one."""
    if stack[-1].name == "table":
        _open(stack, Node("tbody"))
    if stack[-1].name != "tr":
        _open(stack, Node("tr"))
    _open(stack, Node("td", {IMPLIED: ""}))


def visible(node: Node) -> bool:
    if node.name in HIDDEN or "hidden" in node.attrs:
        return False
    if node.name == "input":
        return False
    style = node.attrs.get("style")
    return not (style and _GONE.search(style))


class _Lines:
    """Lines of text; blank lines are asked for by blocks and never doubled."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def text(self, text: str) -> None:
        if not text.strip(" \t\n\r\f"):
            self.space = self.space or bool(text)
            return
        joined = _SPACE.sub(" ", text)
        if self.now and (self.space or joined[0] == " "):
            self.now.append(" ")
        self.now.append(joined.strip(" "))
        self.space = joined[-1] == " "

    def end(self) -> None:
        if self.now:
            self.put(["".join(self.now)])
        self.now, self.space = [], False

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or spaced


def _lines(node: Node) -> list[str]:
    """Lines of an element's content. An explicit stack walks the tree, so depth is no limit."""
    out = _Lines()
    todo: list = [iter(node.children)]
    closing: list = [None]
    while todo:
        child = next(todo[-1], None)
        if child is None:
            todo.pop()
            name = closing.pop()
            if name in BLOCK:
                out.block(name in SPACED)
            continue
        if isinstance(child, str):
            out.text(child)
        elif not visible(child):
            continue
        elif child.name == "br":
            if out.now:
                out.end()
            else:
                out.put([""] if out.lines and out.lines[-1] else [])
        elif child.name == "hr":
            out.block(True)
            out.put(["---"])
            out.gap = True
        elif child.name == "img":
            out.text(child.attrs.get("alt", ""))
        elif child.name == "option" and child.attrs.get("label"):  # shown in place of its content
            out.block(False)
            out.text(child.attrs["label"])
            out.block(False)
        elif child.name == "textarea":
            out.text("".join(x for x in child.children if isinstance(x, str)))
        elif child.name in ("ul", "ol", "menu", "dir"):
            out.block(True)
            out.put(_list(child))
            out.gap = True
        elif child.name == "table":
            out.block(True)
            out.put(_table(child))
            out.gap = True
        elif child.name == "pre":
            out.block(True)
            out.put(_plain(child).strip("\n").split("\n"))
            out.gap = True
        elif child.name == "blockquote":
            out.block(True)
            out.put([f"> {x}".rstrip() for x in _lines(child)])
            out.gap = True
        elif child.name == "dd":
            out.block(False)
            out.put([f"    {x}".rstrip() for x in _lines(child)])
        else:
            if child.name in BLOCK:
                out.block(child.name in SPACED)
            if child.name == "optgroup" and child.attrs.get("label"):
                out.text(child.attrs["label"])
            todo.append(iter(child.children))
            closing.append(child.name)
    out.end()
    return out.lines


def _plain(node: Node) -> str:
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.name == "br":
            parts.append("\n")
        elif visible(x):
            todo += reversed(x.children)
    return "".join(parts)


def _list(node: Node) -> list[str]:
    start = node.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    out: list[str] = []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                out.append(_SPACE.sub(" ", child).strip())
            continue
        if not visible(child):
            continue
        if child.name == "li":
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
        elif child.name in ("ul", "ol"):
            out += [f"  {x}".rstrip() for x in _list(child)]
            continue
        else:
            mark = ""
        lines = [x for x in _lines(child) if x] or ([""] if mark else [])
        out += [(mark if i == 0 else " " * len(mark)) + x for i, x in enumerate(lines)]
    return [x.rstrip() for x in out]


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "1")
    return min(1000, max(1, int(value))) if re.fullmatch(r"[0-9]{1,4}", value) else 1


def _cells(row: Node) -> list[tuple[Node, list[str]]]:
    """Cells of a row with their lines, each rendered once; what stands beside cells counts as one if it shows."""
    out = []
    for c in row.children:
        if isinstance(c, str):
            if c.strip():
                cell = Node("td", {}, [c])
                out.append((cell, _lines(cell)))
        elif visible(c):
            cell = c if c.name in ("td", "th") else Node("td", {}, [c])
            lines = _lines(cell)
            if any(lines) or cell is c and IMPLIED not in c.attrs:
                out.append((cell, lines))
    return out


def _table(node: Node) -> list[str]:
    """Caption, then rows with columns padded to equal width and parted by bars."""
    head: list[str] = []
    rows: list[list[list[str]]] = []
    heading = -1
    held: dict[int, int] = {}  # columns that a cell above still covers
    todo = [x for x in reversed(node.children)]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip():
                rows.append([_lines(Node("td", {}, [child]))])
        elif not visible(child):
            continue
        elif child.name == "caption":
            head += _lines(child)
        elif child.name in ("tbody", "thead", "tfoot", "colgroup"):
            todo += reversed(child.children)
        elif child.name != "tr":
            if any(lines := [x for x in _lines(child) if x]):
                rows.append([lines])
        else:
            row: list[list[str]] = []
            cells = _cells(child)
            for cell, lines in cells:
                while held.get(len(row), 0):
                    held[len(row)] -= 1
                    row.append([])
                span = _span(cell, "colspan")
                if (down := _span(cell, "rowspan") - 1) > 0:
                    for c in range(len(row), len(row) + span):
                        held[c] = down
                row.append([x for x in lines if x])
                row += [[]] * (span - 1)
            if cells and not rows and all(c.name == "th" for c, _ in cells):
                heading = 0
            if any(row):
                rows.append(row)
    if not rows:
        return head
    columns = max(map(len, rows))
    rows = [r + [[]] * (columns - len(r)) for r in rows]
    widths = [max((len(x) for r in rows for x in r[c]), default=0) for c in range(columns)]
    if columns == 1:
        return head + [x for r in rows for x in r[0]]
    for i, row in enumerate(rows):
        for k in range(max(map(len, row))):
            head.append(" | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(row, widths, strict=True)).rstrip())
        if i == heading:
            head.append("-+-".join("-" * w for w in widths))
    return head


def render(source: str) -> str:
    """All visible text of a page, laid out."""
    return "\n".join(_lines(parse(source))).strip("\n")


def _renderer():
    def of_batch(batch):
        texts = [render(s or "") for s in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return of_batch


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row. A null or empty page, or one without visible text, has an empty text.

    Pages are rendered one by one, repeated or not; a null id is carried along. Columns other than
    the two named are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(arrow_map(_renderer), f"page_id {dict(rows.dtypes)['page_id']}, text string")
