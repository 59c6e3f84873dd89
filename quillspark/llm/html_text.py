"""HTML to text as it is laid out: all visible text, with block spacing, lists and aligned tables.

A tree builder reads tags with the implied ends and starts of HTML (a paragraph
ends at the next block, a list item at the next item, a cell at the next cell),
raw-text elements and character references. Its serialised tree (open, text and
close events) is rendered in one pass without recursion, so nesting of any depth
works. Subtrees that aren't laid out give nothing; visibility is inherited and may
be turned on again inside. Cells keep their column under row and column spans.
Preformatted text keeps its blanks and lines, and no-break spaces stay as many as
they are where they stand beside text; other white space is folded.
"""

from __future__ import annotations

import bisect
import html
import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import tidy

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption search".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure ul ol dl".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup tbody td tfoot th thead tr caption legend".split())
#: Start tag -> (tags that it ends, tags beyond which it doesn't look).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}),
}
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes datalist object audio video canvas svg math rp".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript head".split())
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
MOST_COLUMNS, MOST_ROWS = 1000, 65534

#: By default lines of a cell that are longer wrap at blanks, so that padding stays in proportion; columns stay aligned.
WIDEST = 400
#: By default so many list levels add to the indent; browsers bound a tree's depth alike.
DEEPEST = 512
#: Line breaks and blanks that aren't folded, as codes that no text can hold until it is done: of preformatted text, and no-break spaces.
BREAK, BLANK, HARD = "\ud800", "\ud801", "\ud802"
_KEEP = str.maketrans({"\n": BREAK, " ": BLANK, "\xa0": BLANK})
_DONE = str.maketrans({BREAK: "\n", BLANK: " ", HARD: " "})


def events(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """The tree of a page as (kind, tag or text, attributes); kinds are open, close and text."""
    stack: list[str] = []
    where: dict[str, list[int]] = {}  # depths of each open tag

    def push(tag: str) -> None:
        where.setdefault(tag, []).append(len(stack))
        stack.append(tag)

    def close_to(depth: int) -> Iterator[tuple[str, str, dict[str, str]]]:
        while len(stack) > depth:
            tag = stack.pop()
            where[tag].pop()
            yield "close", tag, {}

    def deepest(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            end = n if m is None else m.start()
            text = page[at:end]
            if where.get("head") and not where.get("body") and text.strip() and deepest(HIDDEN - {"head"}) < 0:
                yield from close_to(where["head"][-1])
            yield "text", html.unescape(text), {}
            if m is None:
                break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
            elif tag == "p" and not where.get("p"):
                yield "open", "p", {}
                yield "close", "p", {}
            elif where.get(tag):
                depth = where[tag][-1]
                # an end tag inside a cell doesn't close what lies outside the table's cell
                if tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "body", "html") and depth < deepest(("td", "th", "caption")):
                    continue
                yield from close_to(depth)
            continue
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield "text", m[0][9:].removesuffix("]]>"), {}
            continue
        tag = m[2].lower()
        attributes = {}
        for k, v in ATTRIBUTE.findall(m[3]):
            attributes.setdefault(k.lower(), html.unescape(v[1:-1] if v[:1] in ("'", '"') else v))
        if where.get("head") and tag not in HEAD_ONLY and deepest(HIDDEN - {"head"}) < 0:
            yield from close_to(where["head"][-1])
        if tag in ("html", "body", "head") and where.get(tag):
            continue
        if tag in CLOSES_P and where.get("p") and where["p"][-1] > deepest(("td", "th", "caption", "button", "object", "table")):
            yield from close_to(where["p"][-1])
        if tag in ENDS:
            ended, fence = ENDS[tag]
            floor = deepest(fence)
            found = min((where[t][-1] for t in ended if where.get(t) and where[t][-1] > floor), default=None)
            if found is not None:
                yield from close_to(found)
        if tag in ("td", "th") and deepest(("tr",)) < deepest(("table",)):
            push("tr")
            yield "open", "tr", {}
        push(tag)
        yield "open", tag, attributes
        if tag in VOID:
            yield from close_to(len(stack) - 1)
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            text = page[at : end.start() if end else n]
            yield "text", html.unescape(text) if tag in ("title", "textarea") else text, {}
            yield from close_to(len(stack) - 1)
            at = n if end is None else page.find(">", end.end()) + 1 or n
        elif tag == "plaintext":
            yield "text", page[at:], {}
            break
    yield from close_to(0)


class _Out:
    """Text under construction: inline runs, line breaks, the blank lines that blocks ask for, and the list items that lines stand in."""

    def __init__(self, deepest: int | None = DEEPEST) -> None:
        self.deepest = deepest
        self.parts: list[str] = []
        self.breaks = 0  # line breaks wanted before the next text
        self.space = False
        self.empty = True
        self.fresh = True  # the next text starts a line
        self.marks: list[str] = []  # of open list items
        self.shown = 0  # of these, how many are written; the others wait for text
        self.width = [0]  # indent behind each number of items

    def ask(self, n: int) -> None:
        self.breaks = max(self.breaks, n)
        self.space = False

    def open_item(self, mark: str) -> None:
        self.marks.append(mark)
        self.width.append(self.width[-1] + (len(mark) if self.deepest is None or len(self.marks) <= self.deepest else 0))

    def close_item(self) -> None:
        self.marks.pop()
        self.width.pop()
        self.shown = min(self.shown, len(self.marks))

    def _indent(self) -> str:
        return " " * self.width[self.shown]

    def _feed(self) -> None:
        if self.breaks and not self.empty:
            self.parts.append("\n" * self.breaks)
            self.fresh = True
        self.breaks = 0

    def line(self) -> None:
        """A forced line break."""
        self._feed()
        if not self.empty:
            self.parts.append("\n")
            self.fresh = True
        self.space = False

    def add(self, text: str) -> None:
        self._feed()
        if self.fresh or self.shown < len(self.marks):
            if not self.fresh:
                self.parts.append("\n")
            self.parts.append(self._indent())
            self.parts += self.marks[self.shown :]
            self.shown = len(self.marks)
        elif self.space and not self.parts[-1].endswith(("\n", BREAK)):
            self.parts.append(" ")
        if BREAK in text:
            text = text.replace(BREAK, BREAK + self._indent())
        self.space = self.empty = self.fresh = False
        self.parts.append(text)

    def kept(self, text: str) -> None:
        """Preformatted text, or a block of lines that is laid out already."""
        if text:
            self.add(text.translate(_KEEP))

    def end_of_kept(self) -> None:
        """A line break at the end of preformatted text opens no line."""
        if self.parts and self.parts[-1].endswith(BREAK):
            self.parts[-1] = self.parts[-1][:-1]

    def inline(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = self.space or bool(text)
            return
        if "\xa0" in text:
            text = text.replace("\xa0", HARD)
            words = text.split()
        if text[0].isspace():
            self.space = True
        self.add(" ".join(words))
        self.space = text[-1].isspace()

    def text(self) -> str:
        """What there is, its kept line breaks as such; blanks that aren't folded are still codes."""
        lines = "\n".join(x.rstrip(f" {HARD}") for x in "".join(self.parts).split("\n"))
        return re.sub(r"\n{3,}", "\n\n", lines).strip("\n").replace(BREAK, "\n")


def _span(value: str | None, most: int) -> int:
    """A span attribute as browsers read it; 0 is kept, for all the rows below."""
    m = re.match(r"\s*\+?(\d{1,9})", value or "")
    return min(int(m[1]), most) if m else 1


def _wrapped(text: str, widest: int | None) -> list[str]:
    out = []
    for x in text.split("\n"):
        out += textwrap.wrap(x, widest, break_on_hyphens=False, drop_whitespace=False, expand_tabs=False, replace_whitespace=False) if widest and len(x) > widest else [x]
    return out


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[int, int, str]]]:
    """(column, columns, text) of each row's cells: a cell takes the first column that no cell of a row above reaches into."""
    spans: list[tuple[int, int, int]] = []  # of columns from above, by column: (from, to, first row that is free of them)
    out = []
    for y, row in enumerate(rows):
        if spans:
            spans = [s for s in spans if s[2] > y]
        placed, new, x, k = [], [], 0, 0
        for text, wide, high in row:
            while k < len(spans) and spans[k][0] <= x:
                x = max(x, spans[k][1])
                k += 1
            wide = max(wide, 1)
            placed.append((x, wide, text))
            below = len(rows) if high == 0 else y + high
            if below > y + 1:
                if new and new[-1][1:] == (x, below):
                    new[-1] = (new[-1][0], x + wide, below)
                else:
                    new.append((x, x + wide, below))
            x += wide
        out.append(placed)
        if new:
            spans = _over(spans, new)
    return out


def _over(old: list[tuple[int, int, int]], new: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Both lists of disjoint spans in order; where they overlap the new ones hold."""
    out, k = [], 0
    for a, b, below in old:
        while k < len(new) and new[k][1] <= a:
            k += 1
        at = k
        while at < len(new) and new[at][0] < b:
            if a < new[at][0]:
                out.append((a, new[at][0], below))
            a = max(a, new[at][1])
            at += 1
        if a < b:
            out.append((a, b, below))
    return sorted(out + new)


def _table(rows: list[list[tuple[str, int, int]]], widest: int | None) -> str:
    """Rows of cells (text, columns, rows) with columns padded to their widest cell; rows without text are left out."""
    placed = [row for row in _placed(rows) if any(text for *_, text in row)]
    starts = sorted({x for row in placed for x, _, _ in row})  # a column where no cell starts has no width of its own
    at = {x: k for k, x in enumerate(starts)}
    grid = [[(at[x], bisect.bisect_left(starts, x + wide) - at[x], _wrapped(text, widest)) for x, wide, text in row] for row in placed]
    widths = [0] * len(starts)
    for row in grid:
        for k, n, lines in row:
            if n == 1:
                widths[k] = max(widths[k], *map(len, lines))
    for row in grid:
        for k, n, lines in row:
            if n > 1:  # what a spanning cell lacks goes to its last column
                widths[k + n - 1] += max(0, max(map(len, lines)) - sum(widths[k : k + n]) - 3 * (n - 1))
    out = []
    for row in grid:
        for y in range(max(len(lines) for *_, lines in row)):
            cells, k = [], 0
            for at_, n, lines in row:
                cells += [" " * w for w in widths[k:at_]]
                cells.append((lines[y] if y < len(lines) else "").ljust(sum(widths[at_ : at_ + n]) + 3 * (n - 1)))
                k = at_ + n
            cells += [" " * w for w in widths[k:]]
            out.append(" | ".join(cells).rstrip(" |") if not "".join(cells).strip() else " | ".join(cells).rstrip(" "))
    return "\n".join(out)


def render(page: str | None, widest: int | None = WIDEST, deepest: int | None = DEEPEST) -> str:
    """The visible text of a page; null gives the empty text.

    Lines of a table's cell that are longer than ``widest`` wrap, and lists deeper than
    ``deepest`` aren't indented further; None leaves them as they are.
    """
    outs = [_Out(deepest)]
    lists: list[int | None] = []  # number of the next item, None in bullet lists
    tables: list[list[list[tuple[str, int, int]]]] = []
    cells: list[tuple[int, int]] = []  # spans of open cells
    hidden = 0  # open elements that aren't laid out
    visible = [True]  # inherited, and set anew by a style
    closed_details: list[bool] = []
    open_tags: list[tuple[str, bool]] = []
    pre = 0
    new_pre = False
    for kind, what, attributes in events(page or ""):
        out = outs[-1]
        if kind == "text":
            if hidden or not visible[-1] or (closed_details and closed_details[-1] and open_tags[-1][0] == "details"):
                continue
            if pre:
                out.kept(what[1:] if new_pre and what[0] == "\n" else what)
            else:
                out.inline(what)
            new_pre = False
            continue
        new_pre = False
        if kind == "open":
            style = attributes.get("style", "")
            hides = what in HIDDEN or "hidden" in attributes or bool(NOT_SHOWN.search(style)) or (what == "input" and attributes.get("type", "").lower() == "hidden")
            if closed_details and closed_details[-1] and open_tags and open_tags[-1][0] == "details" and what != "summary":
                hides = True
            said = VISIBILITY.findall(style)
            visible.append(said[-1].lower() == "visible" if said else visible[-1])
            open_tags.append((what, hides))
            hidden += hides
            if what == "details":
                closed_details.append("open" not in attributes)
            if hidden:
                continue
            if what == "br":
                out.line()
            elif what == "hr":
                out.ask(1)
                if visible[-1]:
                    out.add("---")
                out.ask(1)
            elif what == "input" and visible[-1] and attributes.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url") and attributes.get("value"):
                out.inline(f" {attributes['value']} ")
            elif what in BLOCK:
                out.ask(2 if what in SPACED and not (what in ("ul", "ol") and lists) else 1)
            if what in ("ul", "ol", "menu"):
                start = attributes.get("start", "1")
                lists.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if what == "ol" else None)
            elif what == "li":
                mark = "- "
                if lists and lists[-1] is not None:
                    mark = f"{lists[-1]}. "
                    lists[-1] += 1
                out.open_item(mark if visible[-1] else " " * len(mark))
            elif what in ("td", "th", "caption"):
                outs.append(_Out(deepest))
                cells.append((_span(attributes.get("colspan"), MOST_COLUMNS), _span(attributes.get("rowspan"), MOST_ROWS)))
            elif what == "table":
                tables.append([])
            elif what == "tr" and tables:
                tables[-1].append([])
            elif what in ("pre", "xmp", "textarea"):
                pre += 1
                new_pre = True
            continue
        _, hides = open_tags.pop()
        visible.pop()
        if what == "details":
            closed_details.pop()
        if hidden:
            hidden -= hides
            continue
        if what == "li":
            out.close_item()
        elif what in ("td", "th", "caption"):
            text = outs.pop().text()
            spans = cells.pop()
            out = outs[-1]
            if what == "caption" or not tables:
                out.ask(1)
                out.kept(text)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((text, *spans))
        elif what == "table" and tables:
            out.kept(_table(tables.pop(), widest))
        elif what in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif what in ("pre", "xmp", "textarea") and pre:
            pre -= 1
            outs[-1].end_of_kept()
        if what in BLOCK:
            outs[-1].ask(2 if what in SPACED and not (what in ("ul", "ol") and lists) else 1)
    return outs[0].text().translate(_DONE)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", widest: int | None = WIDEST, deepest: int | None = DEEPEST) -> DataFrame:
    """(id, text, n_chars, n_lines) for each row of ``pages``; ``render`` tells of the two limits.

    Null and empty pages give the empty text with 0 lines; repeated and null ids
    are rendered row by row; other columns aren't read; an empty table gives none.
    No shuffle.
    """
    schema = T.StructType([pages.schema[id_col], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False), T.StructField("n_lines", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            for a in range(0, len(batch), 200):
                part = batch.slice(a, 200)
                texts = [render(x, widest, deepest) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=schema.names)

    return pages.select(id_col, html_col).mapInArrow(run, schema)
