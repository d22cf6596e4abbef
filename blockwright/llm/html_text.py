"""Layout-aware text of HTML pages.

A tree builder supplies the tags that HTML lets authors leave out (paragraphs, list items, table
parts and cells end by what follows them), visibility rules drop what a browser doesn't show, and the
renderer writes the rest: block elements start lines, blocks with margins leave one blank line, list
items get markers and indents, table cells are aligned in columns, pre keeps its spacing. Formulas are
written as their running text without annotations, drawings as the labels of their text elements.

Defined cases: null or empty html gives ''; unclosed tags, stray end tags, unclosed comments and
unclosed raw-text elements end with the page; extra columns are not read; repeated rows are rendered
each. No text is ever cut. Any page takes time and memory in proportion to its size, which three rules
for hostile pages see to: indents end at MAX_INDENT columns; tables below MAX_TABLES levels are written
as plain blocks; a table whose padding would come to more than PAD_SHARE times its text and a megabyte
has its widest columns left ragged. After BROKEN tags whose quotes never close, tags end at the next >.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_arrow_batches

MAX_INDENT = 400
MAX_TABLES = 32
PAD_SHARE = 32
BROKEN = 16

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist".split())
#: Parts of drawings and formulas that aren't shown.
UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
MARGIN = frozenset("blockquote center dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
LINES = frozenset("address article aside body caption dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section select summary tbody td tfoot th thead tr".split()) | MARGIN
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag -> (open elements it ends, elements beyond which it doesn't look).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("table td th caption html template".split())
BUTTON_SCOPE = SCOPE | {"button"}
ROW_PARTS = frozenset("tr thead tbody tfoot".split())
#: End tags that reach beyond the cell that they stand in.
TABLE_ENDS = frozenset("td th tr table tbody thead tfoot body html".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_BLANK = re.compile(r"[ \t\n\f\r]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class _Open(list):
    """The open elements, with the places of each tag among them, so no search walks the stack."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.top, self.places = root, {}

    def put(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self))
        self.append(node)
        self.top = node

    def cut(self, k: int) -> None:
        """Close the elements from place k on."""
        for node in self[k:]:
            self.places[node.tag].pop()
        del self[k:]
        self.top = self[-1]

    def last(self, tags) -> int:
        """The place of the innermost open element with one of the tags, 0 for none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def first_beyond(self, tags, k: int) -> int:
        """The place of the outermost open element with one of the tags behind place k, 0 for none."""
        found = [p[at] for t in tags if (p := self.places.get(t)) and (at := bisect.bisect_right(p, k)) < len(p)]
        return min(found, default=0)


def parse(page: str) -> Node:
    """The tree of a page; text children are str."""
    root = Node("#root", {})
    stack, at, end = _Open(root), 0, len(page)
    last, broken = page.rfind(">"), 0
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            stack.top.children.append(html.unescape(page[at:lt]))
        if lt == end:
            break
        m = None
        if lt < last:
            m = _TAG.match(page, lt) if broken < BROKEN else None
            if m is None and (m := _LOOSE.match(page, lt)):
                broken += 1
        if m:
            at = m.end()
            tag = m[2].lower()
            if m[1]:
                _close(stack, tag)
                continue
            attributes = {}
            if m[3] and m[3] != "/":
                for a in _ATTRIBUTE.finditer(m[3]):
                    attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
            _open(stack, tag, attributes)
            if tag in RAW:
                stop = _raw_end(page, tag, at)
                if tag not in UNSEEN:
                    stack.top.children.append(html.unescape(page[at:stop]))
                at = stop
        elif page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4 - 2 * page.startswith("<!-->", lt))
            at = end if stop < 0 else stop + 3
        elif page[lt + 1 : lt + 2] in ("!", "?") or (page[lt + 1 : lt + 2] == "/" and lt + 2 < end and not page[lt + 2].isspace()):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
        else:
            stack.top.children.append("<")
            at = lt + 1
    return root


def _raw_end(page: str, tag: str, at: int) -> int:
    m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
    return m.start() if m else len(page)


def _open(stack: _Open, tag: str, attributes: dict[str, str]) -> None:
    if tag in ENDS_P:
        k = stack.last(("p",))
        if k > stack.last(BUTTON_SCOPE):
            stack.cut(k)
        if tag in HEADINGS and stack.top.tag in HEADINGS:
            stack.cut(len(stack) - 1)
    if rule := IMPLIED.get(tag):
        ends, borders = rule
        border = stack.last(borders)
        if tag in ("li", "dt", "dd"):
            border = max(border, stack.last(SCOPE))
        k = stack.first_beyond(ends, border) if tag in ROW_PARTS else stack.last(ends)
        if k > border:
            stack.cut(k)
    if stack.top.tag == "head" and tag in LINES and tag != "head":
        stack.cut(len(stack) - 1)
    node = Node(tag, attributes)
    stack.top.children.append(node)
    if tag not in VOID:
        stack.put(node)


def _close(stack: _Open, tag: str) -> None:
    if tag == "br":
        stack.top.children.append(Node("br", {}))
        return
    k = stack.last((tag,))
    if k and (tag in TABLE_ENDS or k > stack.last(("td", "th", "table"))):
        stack.cut(k)
    elif tag == "p":
        stack.top.children.append(Node("p", {}))


class _Page:
    """Lines in the making."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.indent, self.marker, self.space, self.gap = "", "", False, False

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for k, line in enumerate(s.split("\n")):
                if k:
                    self.end_line(True)
                if line:
                    self.parts.append(line)
            return
        body = _BLANK.sub(" ", s)
        if body.strip(" ") == "":
            self.space = self.space or (bool(body) and bool(self.parts))
            return
        if self.parts and (self.space or body[0] == " ") and not self.parts[-1].endswith("\n"):
            self.parts.append(" ")
        self.space = body[-1] == " "
        self.parts.append(body.strip(" "))

    def end_line(self, forced: bool = False) -> None:
        if self.parts or forced:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            line = "".join(self.parts)
            self.lines.append((self.indent + self.marker + line).rstrip() if line else "")
            if self.marker and line:
                self.deepen(len(self.marker))
                self.marker = ""
        self.parts, self.space = [], False

    def deepen(self, n: int) -> None:
        self.indent = (self.indent + " " * n)[:MAX_INDENT]

    def block(self, margin: bool) -> None:
        self.end_line()
        self.gap = self.gap or margin

    def done(self) -> list[str]:
        self.end_line()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a]:
            a += 1
        while b > a and not self.lines[b - 1]:
            b -= 1
        return self.lines[a:b]


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """(is the subtree rendered at all, is its own text visible)."""
    a = node.attributes
    if node.tag in UNSEEN or (a and ("hidden" in a and a["hidden"].lower() != "until-found" or (node.tag == "input"))):
        return False, False
    style = a.get("style", "")
    if style:
        if _NONE.search(style):
            return False, False
        if m := _VISIBILITY.search(style):
            visible = m[1].lower() == "visible"
    return True, visible


def _drawn(node: Node, visible: bool) -> Node:
    """A formula without its annotations, or the labels of a drawing, as an element of running text."""
    out = Node("span", {})
    stack = [(node, visible, node.tag == "math")]
    while stack:
        top, seen, inside = stack.pop()
        if isinstance(top, str):
            if seen and inside:
                out.children.append(top)
            continue
        there, seen = _shown(top, seen)
        if not there or top.tag in UNDRAWN or top.attributes.get("display", "").strip().lower() == "none":
            continue
        if top.tag == "foreignobject":
            holder = Node("div", {"style": "visibility:visible" if seen else "visibility:hidden"})
            holder.children = top.children
            out.children.append(holder)
            continue
        if top.tag == "text" and not inside:
            inside = True
            out.children.append(" ")
            stack.append((" ", True, True))
        stack += [(c, seen, inside) for c in reversed(top.children)]
    return out


def _number(text: str, default: int) -> int:
    try:
        return int(text)
    except ValueError:
        return default


def render(root: Node, tables: int = 0) -> list[str]:
    page = _Page()
    stack: list[list] = [[root, 0, True, False, None, None, 0]]  # node, next child, visible, pre, outer indent, list counter, lists
    while stack:
        top = stack[-1]
        node, k, visible, pre = top[:4]
        if k == len(node.children):
            stack.pop()
            if node is not root:
                _leave(page, node, top)
            continue
        top[1] += 1
        child = node.children[k]
        if isinstance(child, str):
            if node.tag == "details" and "open" not in node.attributes:
                continue
            if visible and node.tag not in ("table", "tbody", "thead", "tfoot", "tr", "ul", "ol", "select") or visible and child.strip():
                page.text(child, pre)
            continue
        tag = child.tag
        if node.tag == "details" and tag != "summary" and "open" not in node.attributes:
            continue
        there, seen = _shown(child, visible)
        if not there:
            continue
        if tag in ("svg", "math"):
            child, seen = _drawn(child, visible), True
            tag = child.tag
        if tag == "br":
            page.end_line(True)
            continue
        if tag == "wbr":
            continue
        if tag == "table" and tables < MAX_TABLES:
            page.block(True)
            for line in _table(child, seen, tables + 1):
                page.parts = [line] if line else []
                page.end_line(True)
            page.gap = True
            continue
        outer = page.indent
        nested = top[6]
        if tag in LINES:
            page.block(tag in MARGIN and not (tag in ("ul", "ol", "menu") and nested))
        entry = [child, 0, seen, pre or tag in ("pre", "textarea"), outer, None, nested]
        if tag in ("ul", "ol", "menu"):
            entry[5] = _number(child.attributes.get("start", ""), 1) if tag == "ol" else None
            entry[6] += 1
            if nested and page.marker:
                page.deepen(len(page.marker))
                page.marker = ""
        elif tag == "li":
            if node.tag == "ol":
                top[5] = _number(child.attributes.get("value", ""), top[5])
                page.marker = f"{top[5]}. "
                top[5] += 1
            else:
                page.marker = "- "
        elif tag == "dd" or tag == "blockquote":
            page.deepen(2)
        elif tag in ("td", "th") and page.parts:
            page.space = True
        stack.append(entry)
    return page.done()


def _leave(page: _Page, node: Node, entry: list) -> None:
    if node.tag in LINES:
        page.block(node.tag in MARGIN and not (node.tag in ("ul", "ol", "menu") and entry[6] > 1))
        if node.tag == "li":
            page.marker = ""
        page.indent = entry[4]


def _table(table: Node, visible: bool, depth: int) -> list[str]:
    """Caption lines, then rows with cells aligned by column; a row is as high as its highest cell."""
    before, grid, busy = [], [], {}
    queue = [(table, visible)]
    rows: list[tuple[Node, bool]] = []
    while queue:
        node, vis = queue.pop(0)
        for c in node.children:
            if isinstance(c, str):
                if vis and c.strip():
                    before.append(_BLANK.sub(" ", c).strip(" "))
                continue
            there, seen = _shown(c, vis)
            if not there:
                continue
            if c.tag == "tr":
                rows.append((c, seen))
            elif c.tag in ("tbody", "thead", "tfoot"):
                rows += [(r, s) for r, s in _rows(c, seen, before)]
            elif c.tag in ("td", "th"):
                row = Node("tr", {})
                row.children.append(c)
                rows.append((row, seen))
            elif c.tag not in ("colgroup", "col"):
                before += render(_holder(c, seen), depth)
    for r, (row, vis) in enumerate(rows):
        line: dict[int, list[str]] = {}
        at = 0
        for c in row.children:
            if isinstance(c, str):
                if vis and c.strip():
                    before.append(_BLANK.sub(" ", c).strip(" "))
                continue
            there, seen = _shown(c, vis)
            if not there:
                continue
            if c.tag not in ("td", "th"):
                before += render(_holder(c, seen), depth)
                continue
            while busy.get(at, 0) > r:
                at += 1
            line[at] = render(_holder(c, seen), depth)
            wide, high = (max(1, min(most, _number(c.attributes.get(x, ""), 1))) for x, most in (("colspan", 1000), ("rowspan", 65534)))
            for x in range(at, at + wide) if high > 1 else ():
                busy[x] = r + high
            at += wide
        grid.append(line)
    width: dict[int, int] = {}
    height, text = 0, 0
    for line in grid:
        for c, cell in line.items():
            width[c] = max(width.get(c, 0), max(map(len, cell), default=0))
            text += sum(map(len, cell))
        height += max(map(len, line.values()), default=0)
    most = max(width.values(), default=0)
    while most > 1 and height * sum(min(w, most) for w in width.values()) > PAD_SHARE * text + (1 << 20):
        most //= 2
    width = {c: min(w, most) for c, w in width.items()}
    out = before
    order = sorted(width)
    for line in grid:
        for y in range(max(map(len, line.values()), default=0)):
            cells = [(line[c][y] if c in line and y < len(line[c]) else "").ljust(width[c]) for c in order if width[c]]
            out.append("  ".join(cells).rstrip())
    return out


def _rows(part: Node, visible: bool, before: list[str]) -> Iterator[tuple[Node, bool]]:
    for c in part.children:
        if isinstance(c, str):
            if visible and c.strip():
                before.append(_BLANK.sub(" ", c).strip(" "))
            continue
        there, seen = _shown(c, visible)
        if there:
            if c.tag in ("td", "th"):
                row = Node("tr", {})
                row.children.append(c)
                c = row
            yield c, seen


def _holder(node: Node, visible: bool) -> Node:
    """A root that renders the node's content alone, under the visibility it inherits."""
    if visible:
        holder = Node("#root", {})
        holder.children = node.children
        return holder
    holder, inner = Node("#root", {}), Node("span", {"style": "visibility:hidden"})
    inner.children = node.children
    holder.children.append(inner)
    return holder


def page_text(page: str | None) -> str:
    return "\n".join(render(parse(page))) if page else ""


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text and n_lines of every page."""
    small_arrow_batches(pages.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [page_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([x.count("\n") + 1 if x else 0 for x in out], pa.int32())], ["page_id", "text", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(texts, "page_id long, text string, n_lines int")
