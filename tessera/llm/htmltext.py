"""Visible text of HTML pages, laid out as a browser would show it.

A tokenizer feeds a tree builder that knows void elements, implied end tags
(``p`` before blocks, ``li``, ``dt``/``dd``, ``option``, table rows and cells)
and end tags without a start.  The renderer walks the tree, leaves out what is
never shown (scripts, styles, templates, the head, hidden elements), keeps
blocks on lines of their own with blank lines around paragraphs, numbers or
bullets list items, and aligns the cells of each table in columns.

Defined results: null markup gives null text, empty markup gives empty text;
unclosed or misnested markup is closed at the end of the page; a tag without an
end hides what follows; text outside any tag is shown.  Elements nested deeper
than MAX_DEPTH hang on the element at that depth, a table inside a table cell is
shown on the cell's line, lists are indented by MAX_INDENT characters at most and
a table whose padding would be much longer than its text is shown unpadded, so
time and output grow in proportion to the page.  Repeated rows are treated alike
and all columns of the input pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .support import free_name

#: Deepest element of a tree, widest indent, and what padding may add to a table.
MAX_DEPTH, MAX_INDENT, MAX_PADDING = 512, 64, 1 << 16
MAX_SPAN = 1000
#: Name and attributes of a tag; a quote opens a value only after "=", and no part is scanned twice.
_TAG = re.compile(r"</?+(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTR = re.compile(r"([^\s=/\"'<>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
_SPACES = re.compile(r"[ \t\r\n\f]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER_SHOWN = frozenset(
    "script style template noscript head title meta link base iframe object embed noembed noframes "
    "datalist audio video canvas svg param source track area".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
    "table caption tbody thead tfoot tr ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody thead tfoot tr li dt dd legend summary figcaption".split())
#: A start tag ends these open elements, up to the nearest of the second set.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ("html",)),
}
_FENCES = frozenset(("table", "td", "th", "caption", "html", "button", "template"))


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.children = name, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)}

    def hidden(self) -> bool:
        if self.name in NEVER_SHOWN:
            return True
        if not self.attrs:
            return False
        a = self.attributes()
        return "hidden" in a or bool(_HIDING.search(a.get("style", ""))) or (self.name == "dialog" and "open" not in a)


def build_tree(markup: str) -> Node:
    root = Node("#root")
    stack = [root]
    is_open: Counter[str] = Counter()  # names on the stack, so that most tags need not look through it

    def cut_at(i: int) -> None:
        for x in stack[i:]:
            is_open[x.name] -= 1
        del stack[i:]

    skipped: Counter[str] = Counter()  # elements beyond MAX_DEPTH that are still open

    def push(node: Node) -> None:
        if len(stack) < MAX_DEPTH:
            stack.append(node)
            is_open[node.name] += 1
        else:
            skipped[node.name] += 1

    def close(names, fences) -> None:
        """Ends the outermost of ``names`` that is open within the nearest fence."""
        if not any(is_open[x] for x in names):
            return
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in fences:
                break
            if stack[i].name in names:
                cut = i
        if cut:
            cut_at(cut)

    at, shown, size = 0, 0, len(markup)
    while at < size:
        start = markup.find("<", at)
        if start < 0 or start + 1 == size:
            break
        c = markup[start + 1]
        ending = c == "/"
        letter = markup[start + 2 : start + 3] if ending else c
        tag = None
        if "a" <= letter.lower() <= "z" and letter.isascii():
            tag = _TAG.match(markup, start)
            stop = tag.end() if tag else size
        elif markup.startswith("<!--", start):
            stop = markup.find("-->", start + 4) + 3
        elif c in "!?/":
            stop = markup.find(">", start) + 1
        else:  # no markup
            at = start + 1
            continue
        if stop < start + 3 and not tag:
            stop = size
        if start > shown:
            stack[-1].children.append(markup[shown:start])
        at = shown = stop
        if not tag:
            continue
        name, attrs = tag["name"].lower(), tag["attrs"]
        if ending:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif skipped[name]:
                skipped[name] -= 1
            elif is_open[name]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        cut_at(i)
                        skipped.clear()
                        break
                    if stack[i].name in ("table", "td", "th") and name not in ("table", "tbody", "thead", "tfoot", "tr", "html", "body"):
                        break
            elif name == "p":
                stack[-1].children.append(Node("p"))
            continue
        if name in CLOSES_P:
            close(("p",), _FENCES)
        elif stack[-1].name == "head" and name not in NEVER_SHOWN:
            cut_at(len(stack) - 1)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in ("td", "th") and stack[-1].name not in ("tr", "#root"):
            if stack[-1].name in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
        if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].name):
            cut_at(len(stack) - 1)
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(markup, at)
            stop = end.start() if end else size
            node.children.append(markup[at:stop])
            at = shown = (markup.find(">", stop) + 1 or size) if end else size
            continue
        push(node)
    if shown < size:
        stack[-1].children.append(markup[shown:])
    return root


class _Page:
    """Lines of a page; blank lines are pending until text follows."""

    def __init__(self, indent: str = ""):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.space, self.prefix, self.indent = 0, False, "", indent
        self.indents: list[tuple[str, str]] = []

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s.startswith(" "):
            self.space = True
        body = s.strip(" ")
        if not body:
            return
        if not self.line:
            self._open()
        elif self.space and self.line[-1] and not self.line[-1].endswith(" "):
            self.line.append(" ")
        self.line.append(body)
        self.space = s.endswith(" ")

    def _open(self) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.line = [self.indent + self.prefix]
        self.prefix = " " * len(self.prefix) if self.prefix else ""
        self.space = False

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def verbatim(self, lines: list[str]) -> None:
        if not lines:
            return
        self.end_line()
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        for k, x in enumerate(lines):
            self.lines.append((self.indent + self.prefix + x).rstrip())
            if k == 0:
                self.prefix = " " * len(self.prefix)

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def _flat(node: Node) -> str:
    """All below ``node`` on one line."""
    page = _Page()
    _render(node, page, None, flat=True)
    return " ".join(x.strip() for x in page.result() if x.strip())


def _one_line(text: str) -> str:
    return _SPACES.sub(" ", html.unescape(text)).strip()


def _row(node: Node, room: list[int]) -> list[str]:
    """A row's cells; ``room`` is how many empty ones the table's wide cells may still add."""
    row: list[str] = []
    for d in node.children:
        if isinstance(d, str):
            if d.strip():
                row.append(_one_line(d))
        elif not d.hidden():
            row.append(_flat(d))
            span = d.attributes().get("colspan", "1") if d.attrs else "1"
            span = int(span) if re.fullmatch("[0-9]{1,4}", span) else 1
            fill = max(0, min(span - 1, MAX_SPAN - len(row), room[0]))
            room[0] -= fill
            row += [""] * fill
    return row


def _table(node: Node, page: _Page) -> None:
    rows: list[list[str]] = []
    captions: list[str] = []
    room = [MAX_PADDING]
    work = [iter(node.children)]
    while work:
        c = next(work[-1], None)
        if c is None:
            work.pop()
        elif isinstance(c, str):
            captions.append(_one_line(c))
        elif c.hidden():
            continue
        elif c.name == "tr":
            rows.append(_row(c, room))
        elif c.name in ("tbody", "thead", "tfoot", "colgroup"):
            work.append(iter(c.children))
        else:
            captions.append(_flat(c))
    rows = [r for r in rows if any(r)]
    width = [0] * max(map(len, rows), default=0)
    for r in rows:
        for k, x in enumerate(r):
            width[k] = max(width[k], len(x))
    text = sum(len(x) for r in rows for x in r)
    if sum(sum(width[: len(r)]) for r in rows) > 4 * text + MAX_PADDING:
        width = [0] * len(width)
        rows = [[x for x in r if x] for r in rows]
    lines = ["  ".join(x.ljust(width[k]) for k, x in enumerate(r)).rstrip() for r in rows]
    page.verbatim([c for c in captions if c] + lines)


def _render(node: Node, page: _Page, numbers: list | None, flat: bool = False) -> None:
    """Emits what is shown below ``node``; deep nesting is walked with a stack.

    ``flat`` is for text that ends on one line: tables and preformatted text are
    then walked like all else.
    """
    work: list[tuple] = [("walk", node, iter(node.children), numbers)]
    while work:
        kind, n, it, nums = work[-1]
        c = next(it, None)
        if c is None:
            work.pop()
            if kind == "item":
                page.end_line()
                page.indent, page.prefix = page.indents.pop()
                page.block(0)
            elif n.name in BLOCK and n is not node:
                page.block(1 if n.name in SPACED and n.name not in ("ul", "ol") or n.name in SPACED and nums is None else 0)
            continue
        if isinstance(c, str):
            page.text(html.unescape(c))
            continue
        if c.hidden():
            continue
        name = c.name
        if name == "br":
            if not page.line:
                page.gap = min(page.gap + 1, 1)
            page.end_line()
        elif name == "hr":
            page.block(1)
        elif name == "img":
            alt = c.attributes().get("alt", "") if c.attrs else ""
            if alt:
                page.text(alt)
        elif name == "input":
            a = c.attributes()
            if a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email") and a.get("value"):
                page.text(" " + a["value"] + " ")
        elif name == "textarea":
            page.text(html.unescape("".join(x for x in c.children if isinstance(x, str))))
        elif name == "pre" and not flat:
            page.block(1)
            body = "".join(_pre(c)).strip("\n")
            page.verbatim(body.split("\n") if body.strip() else [])
            page.block(1)
        elif name == "table" and not flat:
            page.block(1)
            _table(c, page)
            page.block(1)
        elif name in ("ul", "ol", "menu", "dir"):
            page.block(0 if nums is not None else 1)
            start = c.attributes().get("start", "1") if c.attrs else "1"
            first = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            work.append(("list", c, iter(c.children), [first if name == "ol" else None]))
        elif name == "li":
            page.block(0)
            if nums and nums[0] is not None:
                marker = f"{nums[0]}. "
                nums[0] += 1
            else:
                marker = "- "
            page.indents.append((page.indent, page.prefix))
            page.indent, page.prefix = (page.indent + " " * len(page.prefix))[:MAX_INDENT], marker
            work.append(("item", c, iter(c.children), nums if nums is not None else [None]))
        else:
            if name in BLOCK:
                page.block(1 if name in SPACED else 0)
            elif name in ("td", "th", "option", "button"):
                page.text(" ")
            work.append(("walk", c, iter(c.children), nums))


def _pre(node: Node):
    work = [iter(node.children)]
    while work:
        c = next(work[-1], None)
        if c is None:
            work.pop()
        elif isinstance(c, str):
            yield html.unescape(c)
        elif c.name == "br":
            yield "\n"
        elif not c.hidden():
            work.append(iter(c.children))


def visible_text(markup: str | None) -> str | None:
    """The visible text of one page."""
    if markup is None:
        return None
    page = _Page()
    _render(build_tree(markup), page, None)
    return "\n".join(page.result())


def _extract(at: int, into: str):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = [visible_text(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*part.schema.names, into])

    return run


def extract(pages: DataFrame, html_col: str = "html", into: str = "text", keep_html: bool = False) -> DataFrame:
    """``pages`` with the visible text in ``into`` (replacing a column so named)."""
    made = free_name(pages.columns, "visible")
    schema = StructType([*pages.schema.fields, StructField(made, StringType())])
    done = pages.mapInArrow(_extract(pages.columns.index(html_col), made), schema)
    keep = [F.col(f"`{c}`") for c in pages.columns if c != into and (keep_html or c != html_col)]
    return done.select(*keep, F.col(made).alias(into))
