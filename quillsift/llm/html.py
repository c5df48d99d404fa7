"""HTML extraction by layout-aware rendering.

A tree builder reads tags as browsers do in the main: void elements, raw text (script, style), implied
end tags (p, li, dt, dd, options, table parts), implied table parts, end tags without a start dropped. The renderer
emits all visible text: elements that are never shown, ``hidden`` and inline ``display:none`` are left out, and so is the text under inline
``visibility:hidden`` up to a ``visibility:visible`` inside; white space collapses except in ``pre``; blocks stand on lines of their own, paragraphs and headings between blank lines,
list items behind ``- `` or their number and indented by depth, and the cells of a table in aligned columns, where cells with
``colspan`` and ``rowspan`` keep their columns. Layout has limits, text has none: a line is indented by ``INDENT`` blanks at most, a cell
wider than ``ALIGN`` doesn't widen its column, and spans are those of the standard (1,000 columns, 65,534 rows).

Edge cases: null gives null; an empty page or one without visible text gives ""; markup that breaks off is
read as far as it goes, and a quoted attribute value without its end quote goes on to the page's end, as in browsers; depth is bounded by memory only, and
the work grows with the page, not with its depth; texts are read whole; repeated rows stay; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes iframe noembed".split())
UNSEEN = frozenset("head script style template title noscript noframes iframe object svg math audio video canvas datalist meta link base noembed".split())
#: Blank lines around, then line breaks around.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure article section header footer main fieldset".split())
BLOCK = SPACED | frozenset("html body div li dt dd tr td th caption nav aside address form details summary figcaption legend thead tbody tfoot option optgroup select center hgroup dialog menu search".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag of the key ends an open element of these, unless one of the borders is met first.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: What can stand in head; any other start tag, or text, ends it and begins the body.
IN_HEAD = frozenset("base link meta title style script noscript template html head body".split())
ENDS_P = (BLOCK - {"html", "body", "li", "dt", "dd", "tr", "td", "th", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "select", "legend"}) | {"hr"}
P_BORDER = frozenset("table td th caption button object body html".split())
#: End tags that reach out of a cell.
LEAVES_CELL = frozenset("table tr tbody thead tfoot body html".split())
CELL_BORDER = frozenset("td th table".split())
INDENT, ALIGN = 64, 80

# an attribute's quotes count only behind its equals sign
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+"
_TAG = re.compile(rf"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/([A-Za-z][^\s/>]*){_ATTRS}(?:>|\Z)|/(?:>|[^A-Za-z][^>]*(?:>|\Z))|([A-Za-z][^\s/>]*)({_ATTRS})(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible|initial)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "laid", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.laid: str | None = None  # a table's text, once it is laid out

    def attr(self, name: str) -> str | None:
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def shown(self) -> bool:
        if self.tag in UNSEEN:
            return False
        if self.attrs and ("hidden" in self.attrs.lower() or "style" in self.attrs.lower()):
            low = self.attrs.lower()
            if "hidden" in low and (self.attr("hidden") is not None or self.tag == "input" and (self.attr("type") or "").lower() == "hidden"):
                return False
            if "style" in low and _NOT_SHOWN.search(self.attr("style") or ""):
                return False
        return True

    def visible(self, outside: bool) -> bool:
        """Whether its own text is visible; ``outside``: whether its parent's is."""
        if "visibility" in self.attrs.lower() and (said := _VISIBILITY.findall(self.attr("style") or "")):
            return said[-1].lower() in ("visible", "initial")
        return outside

    def span(self, name: str, most: int) -> int:
        m = re.match(r"\s*0*([0-9]*)", self.attr(name) or "1")
        return most if len(m[1]) > 5 else min(int(m[1] or (0 if "0" in m[0] else 1)), most)


def build(html: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of each tag, the places of its open elements on the stack
    last = lambda tag: places[tag][-1] if places.get(tag) else 0

    def cut(k: int) -> None:
        """End the open elements from place ``k`` on."""
        while len(stack) > k:
            places[stack.pop().tag].pop()

    def text(raw: str) -> None:
        if raw:
            if raw.strip(" \t\n\r\f"):
                leave_head()
            stack[-1].children.append(unescape(raw) if "&" in raw else raw)

    def leave_head() -> None:
        if stack[-1].tag == "head":
            cut(len(stack) - 1)
            start("body")

    def close(names: set | frozenset, borders: set | frozenset) -> None:
        """End open elements up to and with the outermost of ``names`` above a border."""
        border = max(map(last, borders), default=0)
        inner = [p[bisect_left(p, max(1, border))] for n in names if (p := places.get(n)) and p[-1] >= max(1, border)]
        if inner:
            cut(min(inner))

    def start(tag: str, attrs: str = "") -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    while m := _TAG.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if tag not in IN_HEAD:
                leave_head()
            if tag in ENDS_P:
                close({"p"}, P_BORDER)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            if tag in CLOSES:
                close(*CLOSES[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                start("tr")
            start(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if tag in ("textarea", "title"):
                    text(html[at:stop])
                if not end:
                    return root
                at = stop
        elif m[1]:
            tag = m[1].lower()
            if tag in ("br", "p", "body", "html"):
                leave_head()
            if tag == "br":
                start("br")
                continue
            if tag == "p" and not places.get("p"):
                start("p")
            own = last(tag)
            if own and (tag in LEAVES_CELL or own >= max(map(last, CELL_BORDER))):
                cut(own)
    rest = html[at:]
    text(rest)
    return root


class Page:
    """Lines of text as they are laid out."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks, self.space, self.mark, self.indent, self.empty = 0, False, "", "", True

    def line(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def text(self, raw: str, kept: bool) -> None:
        if kept:
            for k, line in enumerate(raw.expandtabs().split("\n")):
                if k:
                    if self.breaks and not self.empty:
                        self._open()
                    self.breaks = max(self.breaks, 1) if self.parts and not self.parts[-1].endswith("\n") else self.breaks + 1
                if line:
                    self._open()
                    self.parts.append(line)
            return
        words = _SPACES.sub(" ", raw)
        if words[0] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        trailing = words[-1] == " "
        opened = self._open()
        self.parts.append((" " if self.space and not opened else "") + (words[:-1] if trailing else words))
        self.space = trailing

    def _open(self) -> bool:
        """Start a new line if one is due."""
        if not (self.breaks or self.empty):
            if self.mark:
                self.parts.append(self.mark)
                self.mark = ""
                return True
            return False
        head = "" if self.empty else "\n" * self.breaks
        self.parts.append(head + self.indent + self.mark)
        self.breaks, self.empty, self.space, self.mark = 0, False, False, ""
        return True

    def done(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.parts).split("\n")).strip("\n")


def deeper(indent: str, n: int) -> str:
    return (indent + " " * n)[:INDENT]


def lay_out(root: Node) -> str:
    """The visible text of a tree. Tables are laid out from the innermost on, so that nesting needs no recursion."""
    tables, work = [], [(root, True)]
    while work:
        node, seen = work.pop()
        if isinstance(node, str) or not node.shown():
            continue
        seen = node.visible(seen)
        if node.tag == "table":
            tables.append((node, seen))
        work += [(c, seen) for c in node.children]
    for node, seen in reversed(tables):
        node.laid = table(node, seen)
    return render(root)


def render(root: Node, seen: bool = True) -> str:
    """The visible text of a tree whose tables are laid out. An own stack holds what is left to do, so depth has no limit."""
    page, lists, pre, indents = Page(), [], 0, []
    work: list = [(root, False, seen)]
    while work:
        node, leave, seen = work.pop()
        if isinstance(node, str):
            if seen:
                page.text(node, pre > 0)
            continue
        tag = node.tag
        gap = 2 if tag in SPACED else 1 if tag in BLOCK else 0
        if leave:
            if tag in ("ul", "ol", "menu") and lists:
                page.indent = lists.pop()[2]
                gap = 1 if lists else 2
            elif tag == "li":
                page.mark = ""
                if lists:
                    page.indent = lists[-1][3]
            elif tag in ("blockquote", "dd"):
                page.indent = indents.pop()
            elif tag == "pre":
                pre -= 1
            elif tag == "q" and seen:
                page.text('"', False)
            if gap:
                page.line(gap)
            continue
        if not node.shown():
            continue
        seen = node.visible(seen)
        if tag == "br":
            page.breaks, page.space = page.breaks + 1, False
            continue
        if tag == "hr":
            page.line(1)
            if seen:
                page.text("---", False)
            page.line(1)
            continue
        if tag == "img":
            if seen and (alt := (node.attr("alt") or "").strip()):
                page.text(alt, False)
            continue
        if tag == "table":
            page.line(2)
            page.text(node.laid or "", True)
            page.line(2)
            continue
        if tag in ("ul", "ol", "menu"):
            gap = 1 if lists else 2
        if gap:
            page.line(gap)
        if tag in ("ul", "ol", "menu"):
            first = node.attr("start") or "1"
            lists.append([tag, int(first) if re.fullmatch(r"-?[0-9]{1,9}", first) else 1, page.indent, page.indent])
        elif tag == "li":
            if lists:
                kind, number, _, base = lists[-1]
                page.mark = (f"{number}. " if kind == "ol" else "- ") if seen else ""
                lists[-1][1] += 1
                # the mark stands at the list's indent, further lines behind it
                work.append((node, True, seen))
                page.line(1)
                children = node.children
                if seen and any(not isinstance(c, str) or c.strip() for c in children):
                    page._open()
                    page.empty = False
                    page.indent = deeper(base, 3 if kind == "ol" else 2)
                    page.space = False
                    work += [(c, False, seen) for c in reversed(_trimmed(children))]
                else:
                    page.mark = ""
                    work += [(c, False, seen) for c in reversed(children)]
                continue
            page.mark = "- " if seen else ""
        elif tag in ("blockquote", "dd"):
            indents.append(page.indent)
            page.indent = deeper(page.indent, 2)
        elif tag == "pre":
            pre += 1
        elif tag == "q" and seen:
            page.text('"', False)
        work.append((node, True, seen))
        work += [(c, False, seen) for c in reversed(node.children)]
    return page.done()


def _trimmed(children: list) -> list:
    """Without white space before the first text or element."""
    if children and isinstance(children[0], str):
        first = children[0].lstrip(" \t\n\r\f")
        return ([first] if first else []) + children[1:]
    return children


def table(node: Node, seen: bool) -> str:
    """Rows of cells in columns as wide as their widest line, two blanks apart; a cell's lines stand below each other. Columns that hold nothing are left out."""
    rows, captions, group = [], [], 0
    work = [(c, seen) for c in reversed(node.children)]
    while work:
        x, vis = work.pop()
        if isinstance(x, str):
            if vis and x.strip(" \t\n\r\f"):
                captions.append(_SPACES.sub(" ", x).strip())
            continue
        if not x.shown():
            continue
        vis = x.visible(vis)
        if x.tag == "tr":
            rows.append((group, vis, [c for c in x.children if not isinstance(c, str) and c.tag in ("td", "th") and c.shown()]))
            work += [(c, vis) for c in reversed(x.children) if (c.strip() if isinstance(c, str) else c.tag not in ("td", "th"))]
        elif x.tag in ("thead", "tbody", "tfoot"):
            group += 1
            work += [(c, vis) for c in reversed(x.children)]
        elif x.tag not in ("col", "colgroup"):
            if said := render(x, vis):
                captions.append(said)
    grid: list[dict[int, list[str]]] = []
    ends = {own: k + 1 for k, (own, *_) in enumerate(rows)}
    held: list[tuple[int, int, int]] = []  # columns from, to, that cells above hold, and the row at which they end
    for k, (own, vis, cells) in enumerate(rows):
        held = [x for x in held if x[2] > k]
        line, column, at, more = {}, 0, 0, []
        for cell in cells:
            while at < len(held) and held[at][0] <= column:
                column, at = max(column, held[at][1]), at + 1
            inner = Node("#cell")
            inner.children = cell.children
            if said := render(inner, cell.visible(vis)):
                line[column] = said.split("\n")
            width, height = max(1, cell.span("colspan", 1000)), cell.span("rowspan", 65534) or 65534
            if (until := min(k + height, ends[own])) > k + 1:
                more.append((column, column + width, until))
            column += width
        if more:
            held = _merged(held + more)
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for column, said in line.items():
            widths[column] = max(widths.get(column, 0), *(len(s) for s in said if len(s) <= ALIGN), 0)
    order = sorted(widths)
    out = captions
    for line in grid:
        last = max(line, default=-1)
        cells = [(line.get(c, ()), widths[c]) for c in order[: bisect_left(order, last) + 1]] if line else []
        for k in range(max(map(len, line.values()), default=0)):
            out.append("  ".join((said[k] if k < len(said) else "").ljust(w) for said, w in cells).rstrip())
    return "\n".join(x for x in out if x)


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """In order, neighbours that end together as one."""
    out: list[tuple[int, int, int]] = []
    for a, b, until in sorted(spans):
        if out and out[-1][2] == until and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), until)
        else:
            out.append((a, b, until))
    return out


def extract(html: str | None) -> str | None:
    return None if html is None else lay_out(build(html))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract(h.as_py()) for h in part.column(1)], pa.string())], names=["id", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id, text`` of each row."""
    source = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(_extracted, "id long, text string")


def op10(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract_pages(pages).select(F.col("id").alias("page_id"), "text", F.length("text").cast("long").alias("n_chars"))
