"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, block spacing, lists and tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object audio video canvas svg math datalist noembed noframes".split())
#: Blocks, and those of them with a blank line around.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul option caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot caption option legend".split())
#: Start tag: open elements that it ends, and where the search for them stops.
_LIST, _TABLE = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
IMPLIED = {
    "li": (frozenset(("li",)), _LIST), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), _TABLE), "th": (frozenset(("td", "th")), _TABLE), "tr": (frozenset(("tr", "caption")), _TABLE),
    "tbody": (frozenset(("tbody", "thead", "tfoot", "caption")), _TABLE), "thead": (frozenset(("tbody", "thead", "tfoot", "caption")), _TABLE), "tfoot": (frozenset(("tbody", "thead", "tfoot", "caption")), _TABLE),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: Elements whose content is text up to their own end tag, and those of them in which character references count.
RAW, REFERENCES = frozenset("script style xmp iframe noembed noframes title textarea".split()), frozenset("title textarea".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NAME, _GAP, _BARE = re.compile(r"[^ \t\n\r\f/>]+"), re.compile(r"[ \t\n\r\f/]*"), re.compile(r"[^ \t\n\r\f>]*")
_ATTRIBUTE = re.compile(r"([^ \t\n\r\f/>][^ \t\n\r\f/>=]*)([ \t\n\r\f]*=[ \t\n\r\f]*)?")
_LETTER = re.compile(r"[A-Za-z]")
_NO_BOX = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)
#: The greatest colspan that the standard allows.
MAX_SPAN = 1000
#: Cells wider than this stand over their column without widening it; tables nested deeper than this are written on one line.
WIDE, NESTED = 80, 16
#: Lists and quotations nested deeper than this are indented no further.
MAX_INDENT = 50
#: A table whose aligned form would be longer than this many times its text, and a constant, is written without padding.
GROWTH, SPARE = 8, 20_000


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def has_box(self) -> bool:
        return self.tag not in HIDDEN and "hidden" not in self.attrs and not _NO_BOX.search(self.attrs.get("style", ""))

    def shown(self, inherited: bool) -> bool:
        """Whether its own text is visible: the last visibility of its style, or else what it inherits."""
        found = _VISIBILITY.findall(self.attrs.get("style", "")) if "style" in self.attrs else ()
        return found[-1].lower() == "visible" if found and found[-1].lower() in ("visible", "hidden", "collapse") else inherited


def _tag(html: str, i: int) -> tuple[int, str, dict[str, str]]:
    """Where the tag whose name begins at i ends (-1: not at all), its name and attributes."""
    name = _NAME.match(html, i)
    i, attrs = name.end(), {}
    while (i := _GAP.match(html, i).end()) < len(html):
        if html[i] == ">":
            return i + 1, name.group().lower(), attrs
        found = _ATTRIBUTE.match(html, i)
        i, value = found.end(), ""
        if found.group(2):
            quote = html[i : i + 1]
            if quote in ('"', "'"):
                end = html.find(quote, i + 1)
                if end < 0:
                    break
                value, i = html[i + 1 : end], end + 1
            else:
                value = _BARE.match(html, i).group()
                i += len(value)
        attrs.setdefault(found.group(1).lower(), unescape(value))
    return -1, "", {}


class _Builder:
    """The tree of a page, read from front to back once. A tag or comment that never ends takes the rest, as in browsers."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # of each tag's open elements in self.open

    def _last(self, tags: frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _close(self, k: int) -> None:
        """Ends the open elements from the k-th on."""
        for node in self.open[k:]:
            self.places[node.tag].pop()
        del self.open[k:]

    def _end(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        k = self._last(tags)
        if k and k >= self._last(stop):
            self._close(k)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end(frozenset(("p",)), frozenset(("td", "th", "table", "button", "object", "caption")))
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if tag in ("html",):
            return
        if self.open[-1].tag == "head" and tag not in HIDDEN and tag != "base":
            self._close(len(self.open) - 1)
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag(tag, {})
        elif tag not in VOID and tag not in ("html", "body"):
            self._end(frozenset((tag,)), frozenset(("td", "th", "table")) if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else (_TABLE if tag != "table" else frozenset()))

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip():
            self._close(len(self.open) - 1)
        self.open[-1].children.append(data)

    def feed(self, html: str) -> None:
        i = 0
        while i < len(html):
            k = html.find("<", i)
            if k != i:
                self.handle_data(unescape(html[i : k if k > 0 else len(html)]))
            if k < 0:
                return
            kind = html[k + 1 : k + 2]
            if _LETTER.match(kind):
                i, tag, attrs = _tag(html, k + 1)
                if i < 0:
                    return
                self.handle_starttag(tag, attrs)
                if tag in RAW:
                    end = re.compile(f"</{tag}(?=[ \\t\\n\\r\\f/>])", re.I).search(html, i)
                    end = end.start() if end else len(html)
                    if end > i:
                        self.handle_data(unescape(html[i:end]) if tag in REFERENCES else html[i:end])
                    i = end
            elif kind == "/" and _LETTER.match(html[k + 2 : k + 3]):
                i, tag, _ = _tag(html, k + 2)
                if i < 0:
                    return
                self.handle_endtag(tag)
            elif html.startswith("<!--", k):
                end = k + 3 if html.startswith("<!-->", k) else html.find("-->", k + 3) + 1
                if not end:
                    return
                i = end + 2
            elif kind in ("!", "?", "/"):
                i = html.find(">", k + 2) + 1
                if not i:
                    return
            else:
                self.handle_data("<")
                i = k + 1


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    return builder.root


class _Lines:
    """Text laid out in lines; blank lines and indents wait until text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank, self.indent, self.mark = False, False, 0, ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" "):
            self.gap = True
        core = s.strip(" ")
        if core:
            if self.line and self.gap:
                self.line.append(" ")
            self.line.append(core)
            self.gap = s.endswith(" ")

    def exact(self, s: str) -> None:
        self.end()
        for x in s.strip("\n").split("\n"):
            self._put(x.rstrip())

    def _put(self, x: str) -> None:
        if self.blank and self.lines and x:
            self.lines.append("")
        self.blank = False
        mark, self.mark = self.mark, ""
        self.lines.append((" " * max(0, self.indent - len(mark)) + mark + x) if x else "")

    def end(self, spaced: bool = False, force: bool = False) -> None:
        if self.line:
            self._put("".join(self.line))
        elif force and self.lines:
            self.lines.append("")
        self.line, self.gap = [], False
        self.blank |= spaced


def _inline(node: Node, shown: bool) -> str:
    """All visible text below a node on one line."""
    out, todo = [], [(node, shown)]
    while todo:
        x, shown = todo.pop()
        if isinstance(x, str):
            out.append(x if shown else "")
        elif x.has_box():
            shown = x.shown(shown)
            if x.tag in BLOCKS or x.tag == "br":
                out.append(" ")
                todo.append((" ", True))
            todo += [(c, shown) for c in reversed(x.children)]
            if x.tag == "img" and shown:
                out.append(x.attrs.get("alt", ""))
    return _SPACE.sub(" ", "".join(out)).strip(" ")


def _number(value: str | None) -> int | None:
    value = (value or "").strip()
    return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else None


def _rows(table: Node, shown: bool, depth: int) -> tuple[list[str], list[list[tuple[list[str], int]]]]:
    """What stands outside the cells, and the rows: for each cell its lines and how many columns it spans."""
    captions, rows, todo = [], [], [(c, shown) for c in reversed(table.children)]
    while todo:
        x, shown = todo.pop()
        if isinstance(x, str):
            if x.strip() and shown:
                captions.append(_SPACE.sub(" ", x).strip())
        elif x.has_box():
            shown = x.shown(shown)
            if x.tag == "tr":
                row = []
                for c in x.children:
                    if isinstance(c, Node) and c.has_box():
                        lines = [y for y in _layout(c.children, c.shown(shown), depth + 1).split("\n") if y] if depth < NESTED else [_inline(c, shown)]
                        row.append((lines or [""], min(max(_number(c.attrs.get("colspan")) or 1, 1), MAX_SPAN)))
                    elif isinstance(c, str) and c.strip() and shown:
                        captions.append(_SPACE.sub(" ", c).strip())
                rows.append(row)
            elif x.tag in ("tbody", "thead", "tfoot"):
                todo += [(c, shown) for c in reversed(x.children)]
            elif text := _inline(x, shown):
                captions.append(text)
    return captions, rows


def _aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """The rows' lines with cells under each other; without padding where that would be out of proportion to the text."""
    widths: dict[int, int] = {}
    text = cost = 0
    for row in rows:
        at = 0
        for lines, span in row:
            text += sum(map(len, lines)) + 4
            widths[at] = max(widths.get(at, 0), *(len(y) if len(y) <= WIDE else 0 for y in lines))
            at += span
    for row in rows:
        # ends: how long a line gets whose last text is in this cell; each of the row's lines ends in its furthest text
        ends, at, total = [], 0, 0
        for lines, span in row:
            total += max(widths[at], max(map(len, lines))) + sum(widths.get(at + j, 0) for j in range(1, span)) + 3 * span
            ends.append(total)
            at += span
        height = 0
        for (lines, _), end in zip(reversed(row), reversed(ends), strict=True):
            cost += max(0, len(lines) - height) * end
            height = max(height, len(lines))
        if cost > GROWTH * text + SPARE:
            return [x for x in (" | ".join(" ".join(lines) for lines, _ in row if lines != [""]) for row in rows) if x]
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            cells, at, used = [], 0, 0
            for lines, span in row:
                cell = lines[k] if k < len(lines) else ""
                cells += [cell.ljust(widths[at]), *(" " * widths.get(at + j, 0) for j in range(1, span))]
                used = len(cells) - span + 1 if cell else used
                at += span
            out.append(" | ".join(cells[:used]).rstrip(" "))
    return [x for x in out if x]


def _layout(children: list, shown: bool, depth: int) -> str:
    lines = _Lines()
    lists: list[list[int]] = []
    todo: list = [(c, shown) for c in reversed(children)]
    while todo:
        x, shown = todo.pop()
        if callable(x):
            x()
            continue
        if isinstance(x, str):
            if shown:
                lines.text(x)
            continue
        if not x.has_box():
            continue
        tag, shown = x.tag, x.shown(shown)
        if tag == "br":
            lines.end(force=True)
        elif tag == "hr":
            lines.end(spaced=True)
        elif tag == "img":
            if shown:
                lines.text(x.attrs.get("alt", ""))
        elif tag == "table":
            lines.end(spaced=True)
            captions, rows = _rows(x, shown, depth)
            for c in captions:
                lines.text(c)
                lines.end()
            for line in _aligned(rows):
                lines.exact(line)
            lines.end(spaced=True)
        elif tag == "pre":
            lines.end(spaced=True)
            out, inner = [], [(x, shown)]
            while inner:
                y, seen = inner.pop()
                if isinstance(y, str):
                    out.append(y if seen else "")
                elif y.has_box():
                    seen = y.shown(seen)
                    out.append("\n" if y.tag == "br" else "")
                    inner += [(c, seen) for c in reversed(y.children)]
            lines.exact("".join(out))
            lines.end(spaced=True)
        elif tag in BLOCKS:
            nested = tag in _LIST and bool(lists)
            lines.end(spaced=tag in SPACED and not nested)
            if tag in _LIST:
                start = _number(x.attrs.get("start")) if tag == "ol" else None
                lists.append([0 if start is None else start - 1, int(tag == "ol")])
            before = lines.indent
            if tag == "li":
                if lists:
                    value = _number(x.attrs.get("value"))
                    lists[-1][0] = lists[-1][0] + 1 if value is None else value
                lines.mark = f"{lists[-1][0]}. " if lists and lists[-1][1] else "- "
                lines.indent = 2 * max(0, min(len(lists), MAX_INDENT) - 1) + len(lines.mark)
            elif tag in ("blockquote", "dd"):
                lines.indent = min(lines.indent + 2, 2 * MAX_INDENT)

            def close(tag: str = tag, nested: bool = nested, before: int = before) -> None:
                lines.end(spaced=tag in SPACED and not nested)
                lines.indent = before
                lines.mark = "" if tag == "li" else lines.mark
                if tag in _LIST:
                    lists.pop()

            todo.append((close, shown))
            todo += [(c, shown) for c in reversed(x.children)]
        else:
            todo += [(c, shown) for c in reversed(x.children)]
    lines.end()
    return "\n".join(lines.lines).strip("\n")


def render(html: str | None) -> str:
    """The page's visible text; "" for null, empty or wholly hidden pages. Never fails on malformed markup."""
    root = parse(html or "")
    return _layout(root.children, True, 0) if root.has_box() else ""


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points of text) for every row of pages, repeated rows included.

    A null or empty page, and one without visible text, has the text "". Other columns are ignored; an empty table gives
    an empty result. A page of any length is rendered whole, in a time and a length in proportion to it (see WIDE, GROWTH,
    NESTED and MAX_INDENT for where layout gives way). There is no shuffle: every page is rendered where it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
