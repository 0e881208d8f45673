"""HTML extraction: the visible text of a page, laid out as plain text.

A tree builder reads tags and adds those that HTML implies (ends of paragraphs, items, cells and rows; rows and cells that
a table lacks; ends of what is still open), and a renderer writes what its open elements make visible: blocks on lines of
their own, a blank line around paragraphs, headings, lists and tables, list items with markers and indents, preformatted
text as it stands, and table cells padded so that columns align. ``Limits`` keep padding in proportion to the page: a line of more than
``widest`` characters in a cell moves only what follows it in its own row, columns that begin beyond ``widest_table`` aren't
padded, and items and quotes are indented by ``deepest`` characters at most; with ``EXACT`` limits all padding is
drawn, however much that is. Both work on explicit stacks, so depth is no limit.

Invisible: head, title, script, style, template, noscript, comments, elements with ``hidden``, ``display: none``, and,
unless something inside is ``visible``, ``visibility: hidden``. Style sheets aren't applied. No visible text is dropped.

Defined results: a null page has a null text, an empty one an empty text; text that isn't HTML is a paragraph; broken
tags are read as browsers do where that is cheap, else as text; repeated and null ids each keep their rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote figure form fieldset hr menu dir".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main address center details summary dialog figcaption hgroup legend li dt dd tr caption option optgroup search textarea".split()
)
LISTS = frozenset("ol ul menu dir".split())
#: What an open p doesn't outlast.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
#: A start tag (first) ends an open element (second), if none of the third is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "table", "td", "th"}),
    "optgroup": ({"option", "optgroup"}, {"select", "table", "td", "th"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
#: An end tag doesn't reach past these.
BARRIERS = frozenset("table td th caption".split())
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534

_SPACES = re.compile(r"[ \t\n\r\f]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_STOP = re.compile("[\"'>]")
_DISPLAY = re.compile(r"display\s*:\s*([a-z-]+)")
_VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)")
_PRE = re.compile(r"white-space\s*:\s*(pre|pre-wrap|break-spaces|pre-line)\b")


@dataclass(frozen=True)
class Limits:
    """Characters of a cell's line, and of the columns before a cell, for which others are padded; and of an indent. None: no limit."""

    widest: int | None = 100
    widest_table: int | None = 400
    deepest: int | None = 40


EXACT = Limits(None, None, None)


@dataclass
class Group:
    """Lines and groups behind a marker, which stands before the first line; the others are indented by its width."""

    marker: str
    items: list[str | Group]


def flat(items: list[str | Group], deepest: int | None) -> list[str]:
    """The lines of all groups; each line is put together once, however deep it lies."""
    out: list[str] = []
    # What is left at each depth, its indent, and what stands before its first line (None once that was written).
    stack: list[list] = [[iter(items), 0, None]]
    while stack:
        top = stack[-1]
        x = next(top[0], None)
        if x is None:
            stack.pop()
            continue
        before, top[2] = top[2], None
        if isinstance(x, str):
            out.append(("".join(before) if before is not None else " " * top[1]) + x if x else "")
            continue
        indent = top[1] + len(x.marker)
        indent = indent if deepest is None else min(indent, deepest)
        before = before if before is not None else [" " * top[1]]
        if len(before) == 1 and not x.marker.strip():
            before = [" " * indent]
        else:
            before.append(x.marker)
        stack.append([iter(x.items), indent, before])
    return out


class Canvas:
    """Lines of text that grow downwards; blank lines and spaces are only written before what follows them."""

    def __init__(self) -> None:
        self.lines: list[str | Group] = []
        self.now: list[str] = []
        self.space = False
        self.blank = False

    def _begin(self) -> None:
        if self.blank and self.lines and not self.now:
            self.lines.append("")
        self.blank = False

    def flow(self, data: str) -> None:
        """Inline text: runs of white space are one space, none at the ends of lines."""
        body = _SPACES.sub(" ", data)
        if body == " " or not body:
            self.space |= bool(body)
            return
        self._begin()
        if self.now and (self.space or body[0] == " "):
            self.now.append(" ")
        self.space = body[-1] == " "
        self.now.append(body.strip(" "))

    def exact(self, data: str) -> None:
        """Preformatted text."""
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self._begin()
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(first)
        self.space = False
        for line in rest:
            self._begin()
            self.lines.append("".join(self.now))
            self.now = [line] if line else []

    def line(self) -> None:
        """End a line that has begun."""
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False

    def newline(self) -> None:
        self._begin()
        self.lines.append("".join(self.now))
        self.now, self.space = [], False

    def gap(self) -> None:
        self.line()
        self.blank = True

    def put(self, lines: list[str | Group]) -> None:
        """Whole lines and groups of lines."""
        self.line()
        if lines:
            self._begin()
            self.lines += lines

    def done(self) -> list[str | Group]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


@dataclass
class Table:
    """Cells by row and column; a cell is a list of lines."""

    rows: list[dict[int, tuple[int, list[str]]]] = field(default_factory=list)
    taken: dict[int, int] = field(default_factory=dict)  # column -> rows that a cell above still takes
    pending: dict[int, int] = field(default_factory=dict)  # the same from this row's cells, which hold from the next row on
    above: list[str] = field(default_factory=list)
    free: int = 0  # the column after this row's last cell

    def row(self) -> None:
        if self.rows:
            self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.rows.append({})
        self.free = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        at = self.free
        while at in self.taken:
            at += 1
        self.rows[-1][at] = (across, lines)
        self.free = at + across
        if down > 1:
            for c in range(at, at + across):
                self.pending[c] = down

    def end_row(self) -> None:
        self.taken.update(self.pending)
        self.pending = {}

    def lines(self, limits: Limits) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for c, (across, lines) in row.items():
                if across == 1:
                    width[c] = max(width.get(c, 0), max((len(x) for x in lines if limits.widest is None or len(x) <= limits.widest), default=0))
                else:
                    width.setdefault(c, 0)
        start, at = {}, 0
        for c in sorted(width):
            start[c] = at if limits.widest_table is None or at <= limits.widest_table else 0
            at += width[c] + 2 if width[c] else 0
        out = list(self.above)
        for row in self.rows:
            left = [(start[c], row[c][1]) for c in sorted(row) if row[c][1]]
            k = 0
            while left:
                parts, size = [], 0
                for begin, lines in left:
                    if lines[k]:
                        pad = max(begin - size, 2 if size else 0)
                        parts += [" " * pad, lines[k]]
                        size += pad + len(lines[k])
                out.append("".join(parts).rstrip())
                k += 1
                left = [x for x in left if len(x[1]) > k]
        return out


@dataclass
class Element:
    name: str
    shown: bool
    exists: bool
    pre: bool
    canvas: Canvas | None = None  # one of its own, for items, quotes and cells
    table: Table | None = None
    marker: str = ""
    number: int = 1
    step: int = 1
    span: tuple[int, int] = (1, 1)
    paragraphs: int = 0  # open outside this cell, where they don't count


def _number(value: str | None, least: int, most: int, otherwise: int) -> int:
    m = re.match(r"\s*([-+]?\d{1,9})", value or "")
    return min(max(int(m[1]), least), most) if m else otherwise


class Page:
    """Open elements, and what they have written."""

    def __init__(self, limits: Limits = Limits()) -> None:
        self.limits = limits
        self.root = Canvas()
        self.lists: list[Element] = []  # open ones
        self.open = [Element("", True, True, False)]
        self.canvases = [self.root]
        self.tables: list[Table] = []
        self.held: dict[str, int] = {}

    # -- tree ---------------------------------------------------------------------------------------------------
    def start(self, name: str, attributes: dict[str, str | None]) -> None:
        if name in ("html", "body", "head") and self.held.get(name):
            return
        if name in ENDS_P and self.held.get("p"):
            self._end_near({"p"}, BARRIERS | {"button"})
        if name in IMPLIED:
            self._end_near(*IMPLIED[name])
        if name in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup", "col") and not self.tables:
            return  # without a table these tags mean nothing
        if name in ("tr", "thead", "tbody", "tfoot") and self.open[-1].name != "table":
            self._end_near({"td", "th"}, {"table"})
            if name == "tr":
                self._end_near({"tr"}, {"table"})
        if name in ("td", "th") and not self._near("tr", "table"):
            self.start("tr", {})
        if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", self.open[-1].name):
            self._pop()
        self._push(name, attributes)
        if name in VOID:
            self._pop()

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {})
        elif name == "p" and not self.held.get("p"):
            self.start("p", {})
            self._pop()
        elif self.held.get(name):
            stop = BARRIERS - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else ({"table"} - {name})
            self._end_near({name}, stop if name not in ("body", "html") else set())

    def close(self) -> str:
        while len(self.open) > 1:
            self._pop()
        return "\n".join(flat(self.root.done(), self.limits.deepest))

    def _near(self, name: str, stop: str) -> bool:
        for e in reversed(self.open):
            if e.name == name:
                return True
            if e.name == stop:
                return False
        return False

    def _end_near(self, names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        """Close up to the nearest element of these names, unless one of ``stops`` is nearer."""
        if not any(self.held.get(x) for x in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].name
            if name in names:
                while len(self.open) > k:
                    self._pop()
                return
            if name in stops:
                return

    # -- layout -------------------------------------------------------------------------------------------------
    def _push(self, name: str, attributes: dict[str, str | None]) -> None:
        up = self.open[-1]
        style = (attributes.get("style") or "").lower()
        display, visibility = _DISPLAY.search(style), _VISIBILITY.search(style)
        exists = up.exists and name not in UNSEEN and "hidden" not in attributes and not (display and display[1] == "none")
        shown = visibility[1] == "visible" if visibility else up.shown
        e = Element(name, shown, exists, up.pre or name in ("pre", "textarea", "xmp") or bool(_PRE.search(style)))
        self.open.append(e)
        self.held[name] = self.held.get(name, 0) + 1
        around = self.lists[-1] if self.lists else None
        if name in LISTS:
            self.lists.append(e)
        if name in BARRIERS:
            e.paragraphs, self.held["p"] = self.held.get("p", 0), 0
        if not exists:
            return
        canvas = self.canvases[-1]
        if name == "br":
            canvas.newline()
        elif name in SPACED and not (name in LISTS and self.held.get("li")):
            canvas.gap()
        elif name in BLOCK or (display and display[1] in ("block", "list-item", "flex", "grid", "table")):
            canvas.line()
        if name in LISTS:
            e.step = -1 if "reversed" in attributes else 1
            e.number = _number(attributes.get("start"), -(10**9), 10**9, 1)
        elif name == "li":
            if around is not None and around.name == "ol":
                around.number = _number(attributes.get("value"), -(10**9), 10**9, around.number)
                e.marker = f"{around.number}. "
                around.number += around.step
            else:
                e.marker = "- "
        elif name in ("blockquote", "dd"):
            e.marker = "  "
        elif name == "table":
            e.table = Table()
            self.tables.append(e.table)
        elif name == "tr":
            self.tables[-1].row()
        elif name in ("td", "th"):
            e.span = (_number(attributes.get("colspan"), 1, MOST_COLSPAN, 1), _number(attributes.get("rowspan"), 1, MOST_ROWSPAN, 1))
        if e.marker or name in ("td", "th", "caption"):
            e.canvas = Canvas()
            self.canvases.append(e.canvas)

    def _pop(self) -> None:
        e = self.open.pop()
        self.held[e.name] -= 1
        if e.name in LISTS:
            self.lists.pop()
        if e.name in BARRIERS:
            self.held["p"] = e.paragraphs
        if not e.exists:
            return
        if e.canvas is not None:
            lines = self.canvases.pop().done()
            canvas = self.canvases[-1]
            if e.name in ("td", "th"):
                self.tables[-1].cell(flat(lines, self.limits.deepest), *e.span)
            elif e.name == "caption":
                self.tables[-1].above += flat(lines, self.limits.deepest)
            elif lines:
                canvas.put([Group(e.marker, lines)])
        canvas = self.canvases[-1]
        if e.name == "tr" and self.tables:
            self.tables[-1].end_row()
        if e.table is not None:
            self.tables.pop()
            canvas.put(e.table.lines(self.limits))
        if e.name in SPACED and not (e.name in LISTS and self.held.get("li")):
            canvas.gap()
        elif e.name in BLOCK:
            canvas.line()

    def text(self, data: str) -> None:
        e = self.open[-1]
        if not (e.exists and e.shown):
            return
        data = html.unescape(data) if "&" in data else data
        if e.pre:
            self.canvases[-1].exact(data)
        else:
            self.canvases[-1].flow(data)


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the tag that begins at ``at`` has its >, outside quotes where these are closed; -1 if nowhere."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[0] not in missing:
            end = page.find(m[0], at)
            if end < 0:
                missing.add(m[0])
            elif page[m.start() - 1 : m.start()] in "= \t\n":
                at = end + 1
    return -1


def render(page: str, limits: Limits = Limits()) -> str:
    """The visible text of a page."""
    out, at, size, missing = Page(limits), 0, len(page), set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            out.text(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt in "!?" and nxt:
            if lt > at:
                out.text(page[at:lt])
            end = page.find("-->", lt + 4) + 3 if page.startswith("<!--", lt) else page.find(">", lt) + 1
            at = end if end > 2 and end > lt else size
            continue
        closing = nxt == "/"
        m = _NAME.match(page, lt + 1 + closing)
        end = _tag_end(page, m.end(), missing) if m else -1
        if end < 0:
            # No tag: the sign itself; a tag that never ends makes what is left plain text.
            out.text(page[at : lt + 1] if m is None else page[at:])
            at = lt + 1 if m is None else size
            continue
        if lt > at:
            out.text(page[at:lt])
        name = m[0].lower()
        at = end + 1
        if closing:
            out.end(name)
            continue
        attributes: dict[str, str | None] = {}
        if m.end() < end:
            for k, a, b, c in _ATTRIBUTE.findall(page, m.end(), end):
                attributes.setdefault(k.lower(), html.unescape(a or b or c))
        out.start(name, attributes)
        if name in RAW:
            stop = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            body = page[at : stop.start() if stop else size]
            if name == "textarea":
                out.text(body)
            out.end(name)
            gt = page.find(">", stop.end()) if stop else -1
            at = gt + 1 if gt >= 0 else size
    return out.close()


def extract(pages: DataFrame, page_id: str = "page_id", body: str = "html", limits: Limits = Limits()) -> DataFrame:
    """page_id, text: the layout of each page's visible text."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [None if x is None else render(x, limits) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(body).cast("string").alias("html")).mapInArrow(run, "page_id bigint, text string")
