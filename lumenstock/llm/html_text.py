"""Visible text of web pages by layout-aware rendering.

A tokenizer cuts the page into tags and text; a tree builder supplies the tags authors leave out (`p`, `li`, `dt`,
`option`, table rows, sections and cells, the end of everything open) and ignores stray end tags; visibility rules drop
what a browser does not show (head, scripts, styles, templates, fallback content, `hidden`, `display: none`,
`visibility: hidden` until a descendant is visible again, closed details and dialogs, gauges, hidden inputs, options not selected, drawing definitions, annotations of
formulas). The head ends at the first tag or text that cannot stand in it. In `svg` and `math` tags may close
themselves, and a tag of HTML ends them. The renderer then lays out blocks with collapsed margins, keeps
`pre`, marks and indents list items, and aligns table cells in columns. Of styles the `style` attribute counts; rules
of style sheets are not read.

A quote counts in a tag only where a value may start, after `=`; elsewhere it is part of a name. A tag that the page
ends in is no text.

Null and empty pages give an empty text. Rows without an id are left out; rows that repeat an id are rendered each.
Depth has no limit: the layout is of generators run from a stack, and open elements are looked up by name.
"""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas progress meter datalist map meta link base".split())
UNSEEN_FOREIGN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
# Tags of HTML that end open svg and math elements, and the foreign elements that hold HTML.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption thead tbody tfoot tr td th ul".split())
MARGIN = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
ENDS_P = BLOCK - frozenset("html body option optgroup caption thead tbody tfoot tr td th".split())
ROWS = frozenset("thead tbody tfoot".split())
# An opening tag ends these open elements, looking up to a boundary.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
           "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), **{r: ({"tr", "td", "th", "caption", "thead", "tbody", "tfoot"}, {"table"}) for r in ROWS}}
SCOPE = frozenset("table td th caption html button object foreignobject".split())
_VALUE = r"(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))"
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+{_VALUE}?)?+", re.S)
_ATTRIBUTES = r"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)?+)*+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(>|\Z)|[^<]+|<", re.S)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_DECLARATION = re.compile(r"(?:[^;\"'(]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|\([^)]*(?:\)|\Z))+")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children", "foreign", "holds")

    def __init__(self, name: str, attributes: dict | None = None, foreign: str = ""):
        self.name, self.attributes, self.children = name, attributes or {}, []
        # What the element is, and what it holds: "" for HTML, "svg" (text is not drawn), "text" (of a drawing) or "math".
        self.foreign = foreign
        self.holds = "" if foreign and name in HOLDS_HTML else "text" if foreign == "svg" and name == "text" else foreign


def parse(page: str) -> Node:
    """The tree of a page; text children are strings."""
    root = Node("html")
    stack = [root]
    at = 0
    started = False  # whether anything came that only a body or a head's end may hold

    places: dict[str, list[int]] = {}  # of the open elements by name, without the root

    def cut(i: int) -> None:
        for node in stack[i:]:
            places[node.name].pop()
        del stack[i:]

    def last(names) -> int:
        return max([places[n][-1] for n in names if places.get(n)], default=0)

    def close(names, boundary) -> bool:
        i = last(names)
        if not i or i < last(boundary):
            return False
        cut(i)
        return True

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        places.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][:2] not in ("<!", "<?") or m[0] == "<":
                if m[0].strip(" \t\n\r\f"):
                    started = True
                    if stack[-1].name == "head":
                        cut(len(stack) - 1)
                if stack[-1].holds != "svg":
                    stack[-1].children.append(html.unescape(m[0]))
            continue
        if not m[4]:
            break  # the page ends inside a tag
        name = name.lower()
        if stack[-1].name == "head" and (name in ("body", "html", "br") if m[1] else name not in IN_HEAD and name not in ("html", "head")):
            cut(len(stack) - 1)
        if m[1]:
            if name in ("br", "p") and not places.get(name):
                stack[-1].children.append(Node(name))
            elif name not in ("html", "body"):
                close({name}, SCOPE - {name} if name not in ("table", *ROWS, "tr") else {"table"} - {name})
            continue
        attributes = {}
        for a in _ATTRIBUTE.finditer(m[3]):
            attributes.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        if name in ("html", "body"):
            root.attributes |= attributes
            started = started or name == "body"
            continue
        if stack[-1].holds and (name in BREAKOUT or name == "font" and attributes.keys() & {"color", "face", "size"}):
            while stack[-1].holds:
                cut(len(stack) - 1)
        foreign = stack[-1].holds or (name if name in ("svg", "math") else "")
        if foreign:
            started = True
            node = Node(name, attributes, "svg" if name == "svg" else foreign)
            if m[3].rstrip().endswith("/"):
                stack[-1].children.append(node)
            else:
                push(node)
            continue
        if name == "head":
            if started or len(stack) > 1:
                continue  # a head after the start of the body is ignored
            started = True
        elif name not in IN_HEAD:
            started = True
        if name in ("select", "input", "textarea"):
            close({"select"}, SCOPE)
        if name in ENDS_P:
            close({"p"}, SCOPE)
        if name in IMPLIED:
            while close(*IMPLIED[name]):
                pass
        if name in ("td", "th", "tr", *ROWS):
            table = last(("table",))
            if not table:
                continue  # a cell outside a table is only its text
            if name in ("td", "th") and last(("tr",)) < table:
                push(Node("tr"))
        elif re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].name):
            cut(len(stack) - 1)
        node = Node(name, attributes)
        if name in VOID:
            stack[-1].children.append(node)
        elif name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            text = page[at:end.start() if end else len(page)]
            if name == "textarea":
                text = html.unescape(re.sub(r"\A\r?\n", "", text))
            node.children.append(text)
            stack[-1].children.append(node)
            at = end.end() if end else len(page)
        else:
            push(node)
    return root


def _style(style: str) -> dict[str, str]:
    """Property and value of each declaration; the last one counts, and an important one before others."""
    found: dict[str, tuple[bool, str]] = {}
    for part in _DECLARATION.findall(_COMMENT.sub(" ", style.lower())):
        name, colon, value = part.partition(":")
        value, mark, _ = value.partition("!")
        name, value = name.strip(), value.strip()
        if colon and value and bool(mark) >= found.get(name, (False, ""))[0]:
            found[name] = bool(mark), value
    return {name: value for name, (_, value) in found.items()}


def seen(node: Node) -> bool:
    """Whether the element has a box."""
    if node.name in UNSEEN or "hidden" in node.attributes or node.foreign and node.name in UNSEEN_FOREIGN:
        return False
    if node.name == "dialog" and "open" not in node.attributes:
        return False
    return "style" not in node.attributes or _style(node.attributes["style"]).get("display") != "none"


def visible(node: Node, outer: bool) -> bool:
    """Whether the element's own text is drawn; the property is inherited and may be turned on again."""
    value = _style(node.attributes["style"]).get("visibility") if "style" in node.attributes else None
    return value == "visible" or outer and value not in ("hidden", "collapse") or value == "initial"


def _shown_options(select: Node) -> list[str]:
    """A drop-down shows its selected option, or the first that can be chosen; a list shows all."""
    size = select.attributes.get("size", "")
    every = "multiple" in select.attributes or bool(re.fullmatch(r"\s*\d+\s*", size)) and int(size) > 1
    lines, choice, first, open_nodes = [], None, None, [(select, False)]
    while open_nodes:
        node, disabled = open_nodes.pop()
        off = disabled or "disabled" in node.attributes and node is not select
        shown = seen(node) and visible(node, True)
        if node.name == "option":
            text = _BLANK.sub(" ", node.attributes.get("label") or _all_text(node)).strip()
            if shown:
                lines.append(text)
            if "selected" in node.attributes:
                choice = text
            if first is None and not off:
                first = text
            continue
        if every and not shown and node is not select:
            continue
        if node.name == "optgroup":
            lines.append(_BLANK.sub(" ", node.attributes.get("label", "")).strip())
        open_nodes += [(c, off) for c in reversed(node.children) if not isinstance(c, str)]
    if every:
        return [t for t in lines if t]
    return [choice if choice is not None else first or ""]


def _all_text(node: Node) -> str:
    out, left = [], [node]
    while left:
        n = left.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.name not in ("script", "style", "template"):
            left += reversed(n.children)
    return "".join(out)


class _Lines:
    """Finished lines of a box, and the one being filled."""

    def __init__(self):
        self.lines: list[str] = []
        self.open, self.margin = "", 0

    def text(self, text: str, kept: bool) -> None:
        if kept:
            first, *more = text.split("\n")
            self._write(first)
            for line in more:
                self.brk()
                self._write(line)
            return
        text = _BLANK.sub(" ", text)
        if not self.open or self.open.endswith(" "):
            text = text.lstrip(" ")
        if text:
            self._write(text)

    def _write(self, text: str) -> None:
        if text and not self.open and self.lines and self.margin:
            self.lines.append("")
        if text:
            self.margin = 0
        self.open += text

    def brk(self) -> None:
        self.lines.append(self.open.rstrip(" "))
        self.open = ""

    def block(self, margin: bool) -> None:
        """A boundary between blocks; margins of neighbours collapse into one blank line."""
        if self.open.strip():
            self.brk()
        self.open = ""
        self.margin = max(self.margin, int(margin))

    def box(self, lines: list[str]) -> None:
        if any(lines):
            if self.lines and self.margin:
                self.lines.append("")
            self.lines += lines
            self.margin = 0

    def done(self) -> list[str]:
        self.block(False)
        lines = list(self.lines)
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _width(text: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in text) if not text.isascii() else len(text)


def _run(step):
    """The result of a generator that yields the steps it waits for; the steps are kept on a stack, not in calls."""
    waiting, value = [step], None
    while waiting:
        try:
            step = waiting[-1].send(value)
        except StopIteration as end:
            waiting.pop()
            value = end.value
        else:
            waiting.append(step)
            value = None
    return value


def _lay(node: Node, out: _Lines, kept: bool = False, drawn: bool = True):
    number = int(node.attributes["start"]) if node.name == "ol" and re.fullmatch(r"-?\d{1,9}", node.attributes.get("start", "")) else 1
    closed = node.name == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if drawn and not closed:
                out.text(child, kept)
            continue
        name = child.name
        if not seen(child) or closed and name != "summary":
            continue
        draw = visible(child, drawn)
        if not draw and name in ("br", "hr", "input", "select"):
            continue
        if name == "br":
            out.brk()
        elif name == "hr":
            out.block(True)
            out.box(["---"])
            out.block(True)
        elif name == "input":
            if child.attributes.get("type", "text").lower() in ("submit", "reset", "button"):
                out.text(child.attributes.get("value", ""), False)
        elif name == "select":
            first, *more = _shown_options(child) or [""]
            out.text(first, False)
            for text in more:
                out.brk()
                out.text(text, False)
        elif name == "textarea":
            yield _lay(child, out, True, draw)
        elif name == "text" and child.foreign == "svg":  # every text of a drawing has a place of its own
            out.block(False)
            yield _lay(child, out, kept, draw)
            out.block(False)
        elif name == "table":
            out.block(True)
            out.box((yield _table(child, draw)))
            out.block(True)
        elif name == "li":
            out.block(False)
            mark = f"{number}. " if node.name == "ol" else "- "
            number += 1
            yield _indented(child, out, mark, kept, draw)
        elif name in ("blockquote", "dd"):
            out.block(name in MARGIN)
            yield _indented(child, out, "  ", kept, draw)
            out.block(name in MARGIN)
        elif name in BLOCK:
            margin = name in MARGIN and not (name in ("ul", "ol", "menu") and node.name == "li")
            out.block(margin)
            yield _lay(child, out, kept or name == "pre", draw)
            out.block(margin)
        else:
            yield _lay(child, out, kept, draw)


def _indented(node: Node, out: _Lines, mark: str, kept: bool, drawn: bool):
    inner = _Lines()
    yield _lay(node, inner, kept, drawn)
    lines = inner.done()
    out.box([(mark if i == 0 else " " * len(mark)) + line if line else "" for i, line in enumerate(lines)])
    out.block(False)


def _table(table: Node, drawn: bool):
    """Rows with their cells in aligned columns, two spaces apart; captions and stray text first."""
    captions, rows = [], []

    def gather(node: Node, drawn: bool):
        for child in node.children:
            if isinstance(child, str):
                captions.extend([_BLANK.sub(" ", child).strip()] if drawn and child.strip(" \t\n\r\f") else [])
                continue
            if not seen(child):
                continue
            draw = visible(child, drawn)
            if child.name == "tr":
                rows.append([(c, visible(c, draw)) for c in child.children if not isinstance(c, str) and c.name in ("td", "th") and seen(c)])
                rest = Node("tr")  # what stands in a row outside its cells
                rest.children = [c for c in child.children if isinstance(c, str) or c.name not in ("td", "th")]
                yield gather(rest, draw)
            elif child.name in ROWS:
                yield gather(child, draw)
            else:
                inner = _Lines()
                yield _lay_one(child, inner, drawn)
                captions.extend(inner.done())

    yield gather(table, drawn)
    grid: list[list[tuple[int, int, list[str]]]] = []  # (column, span, lines)
    taken: dict[int, int] = {}
    for cells in rows:
        line, column = [], 0
        for cell, draw in cells:
            while taken.get(column, 0):
                column += 1
            span = _count(cell.attributes.get("colspan"), 1000)
            inner = _Lines()
            yield _lay(cell, inner, False, draw)
            line.append((column, span, inner.done()))
            for c in range(column, column + span):
                taken[c] = _count(cell.attributes.get("rowspan"), 65534)
            column += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        for column, span, lines in line:
            if span == 1:
                widths[column] = max([widths.get(column, 0), *map(_width, lines)])
    starts, place = {}, 0
    for column in range(max([c + s for line in grid for c, s, _ in line], default=0) + 1):
        starts[column] = place
        if column in widths:
            place += widths[column] + 2 if widths[column] else 0
    out = captions
    for line in grid:
        for i in range(max([len(c[2]) for c in line], default=0)):
            text = ""
            for column, _, lines in line:
                if i < len(lines) and lines[i]:
                    gap = starts[column] - _width(text)
                    text += " " * (max(gap, 2) if text else gap) + lines[i]
            out.append(text.rstrip())
    return out


def _lay_one(node: Node, out: _Lines, drawn: bool):
    holder = Node("div")
    holder.children.append(node)
    yield _lay(holder, out, False, drawn)


def _count(value: str | None, most: int) -> int:
    """A span, with the bound that HTML sets; 1 where it is no number."""
    digits = re.match(r"\s*\+?0*(\d+)", value or "", re.A)
    return 1 if not digits else most if len(digits[1]) > 5 else min(max(1, int(digits[1])), most)


def render(page: str | None) -> str:
    if not page:
        return ""
    out = _Lines()
    _run(_lay(parse(page), out))
    return "\n".join(out.done())


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).alias("html")).where("page_id IS NOT NULL")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [render(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t.split("\n")) if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_lines"])

    return rows.mapInArrow(run, "page_id long, text string, n_lines long")
