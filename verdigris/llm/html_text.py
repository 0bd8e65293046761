"""Visible text of web pages, laid out.

A tolerant tokenizer feeds a tree builder that knows implied tags (a new list item ends the open one, a block ends an
open paragraph, and so on) and a stack that outlives stray end tags. Visibility rules drop what a browser doesn't
show. A renderer then writes all visible text: blocks on lines of their own with blank lines between paragraphs,
markers before list items, and table cells aligned in columns.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import small_batches

# Fixed values of the HTML standard.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
_HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes title meta link base object embed audio video canvas "
    "datalist area map source track param annotation annotation-xml".split()
)
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
#: Blocks with a blank line around them.
_APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure fieldset hr".split())
_ENDS_PARAGRAPH = _BLOCKS - frozenset("td th tr tbody thead tfoot caption body html".split())
#: An opening tag ends the open element of these names, unless one of the limits lies between.
_ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: An end tag doesn't reach through these for an element outside.
_WALLS = frozenset("table td th caption".split())
_INLINE = frozenset(
    "a abbr b big cite code em font i kbd label mark q s samp small span strike strong sub sup tt u var".split()
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.IGNORECASE)
_VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z]+)", re.IGNORECASE)
#: Simple rules of a style sheet: a comment, an at-rule's head, or selectors with declarations.
_RULE = re.compile(r"/\*.*?(?:\*/|\Z)|@[^{};]*[;{]|\}|([^{}@;]+)\{([^{}]*)\}", re.DOTALL)
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9-]*)?([.#][\w-]+)?", re.IGNORECASE)
#: Elements of an image whose text is drawn, and those that only hold others.
_SVG_TEXT = frozenset(["text", "foreignobject"])
_SVG_GROUPS = frozenset("svg g a switch".split())
#: Inputs that show their value, and buttons with the label that browsers give them.
_WRITTEN = frozenset("text search email tel url number date time month week datetime-local".split()) | {""}
_BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
_BLANKS = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    #: What style sheets say of it: a display and a visibility.
    display: str | None = None
    visibility: str | None = None


@dataclass(frozen=True)
class _Look:
    """What elements inherit: whether white space is kept, and whether text is shown."""

    kept: bool = False
    shown: bool = True


def _attributes(raw: str) -> dict[str, str]:
    if not raw.strip():
        return {}
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        found.setdefault(m[1].lower(), html.unescape(value))
    return found


class _Builder:
    def __init__(self) -> None:
        self.root = Node("#root")
        self.open = [self.root]
        self.sheets: list[str] = []
        # Where elements of each name, and blocks, stand in ``open``: no tag needs a walk through a deep page.
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def text(self, raw: str) -> None:
        if raw:
            self.open[-1].children.append(raw)

    def _open(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.open))
        if node.name in _BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def _close_to(self, at: int) -> None:
        while len(self.open) > at:
            node = self.open.pop()
            self.places[node.name].pop()
            if node.name in _BLOCKS:
                self.blocks.pop()

    def _last(self, names: frozenset[str]) -> int:
        """Where the innermost of the open ``names`` is; 0 if there is none."""
        return max((self.places[name][-1] for name in names if self.places.get(name)), default=0)

    def _find(self, names: frozenset[str], limits: frozenset[str]) -> int | None:
        """Where the outermost of the open ``names`` is that no limit hides."""
        behind = self._last(limits)
        found = None
        for name in names:
            places = self.places.get(name)
            if places and places[-1] > behind:
                first = places[bisect.bisect_right(places, behind)]
                found = first if found is None else min(found, first)
        return found

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        if name in ("html", "body") and self.places.get(name):
            return
        if name in _BLOCKS and self._find(frozenset(["head"]), frozenset()) is not None and name != "html":
            self._close_to(self._find(frozenset(["head"]), frozenset()))
        if name in _ENDS_PARAGRAPH:
            at = self._find(frozenset(["p"]), _WALLS)
            if at is not None:
                self._close_to(at)
        if name in _ENDS:
            at = self._find(*_ENDS[name])
            if at is not None:
                self._close_to(at)
        if name in ("td", "th") and self.open[-1].name in ("table", "tbody", "thead", "tfoot"):
            self.start("tr", {}, False)
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        if name not in _VOID and not closed:
            self._open(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", {}, True)
            return
        walls = frozenset() if name in ("body", "html", "table") else _WALLS - {name}
        at, behind = self._last(frozenset([name])), self._last(walls)
        if name in _INLINE and self.blocks:
            behind = max(behind, self.blocks[-1])
        if at > behind:
            self._close_to(at)
            return
        if name == "p":
            self.start("p", {}, True)


def parse(source: str) -> Node:
    """The tree of a page; never fails."""
    builder, at = _Builder(), 0
    while at < len(source):
        m = _TAG.search(source, at)
        if m is None:
            builder.text(source[at:])
            break
        builder.text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            builder.end(name)
            continue
        closed = m[3].rstrip().endswith("/")
        builder.start(name, _attributes(m[3]), closed and name not in _RAW and name not in _BLOCKS)
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(source, at)
            raw = source[at : stop.start() if stop else len(source)]
            builder.text(raw)
            if name == "style" and builder.open[-1].attributes.get("media", "all").lower() in ("", "all", "screen"):
                builder.sheets.append(raw)
            at = stop.end() if stop else len(source)
            builder.end(name)
    if builder.sheets:
        _apply(builder.root, _rules(builder.sheets))
    return builder.root


def _said(declarations: str) -> tuple[str | None, str | None]:
    """The last display and visibility of some declarations."""
    found = (_DISPLAY.findall(declarations), _VISIBILITY.findall(declarations))
    return tuple(values[-1].lower() if values else None for values in found)


def _rules(sheets: list[str]) -> dict[str, list[tuple[str, str | None, str | None]]]:
    """(tag or *, display, visibility) by tag, .class and #id, in order; rules inside at-rules don't count."""
    rules: dict[str, list[tuple[str, str | None, str | None]]] = {}
    for sheet in sheets:
        depth = 0
        for m in _RULE.finditer(sheet):
            if m[1] is None:
                depth += m[0].startswith("@") and m[0].endswith("{")
                depth -= m[0] == "}" and depth > 0
                continue
            said = _said(m[2])
            if depth or said == (None, None):
                continue
            for selector in m[1].split(","):
                simple = _SELECTOR.fullmatch(selector.strip())
                if simple and selector.strip():
                    tag, part = (simple[1] or "*").lower(), simple[2]
                    rules.setdefault(part or tag, []).append((tag, *said))
    return rules


def _apply(root: Node, rules: dict[str, list[tuple[str, str | None, str | None]]]) -> None:
    """Give every element what the rules say of it; ids come before classes, classes before tags, later before earlier."""
    stack = [root]
    while stack:
        node = stack.pop()
        names = ["*", node.name, *(f".{c}" for c in node.attributes.get("class", "").split()), f"#{node.attributes.get('id', '')}"]
        for name in names:
            for tag, display, visibility in rules.get(name, ()):
                if tag in ("*", node.name):
                    node.display, node.visibility = display or node.display, visibility or node.visibility
        stack += [c for c in node.children if isinstance(c, Node)]


def visible(node: Node) -> bool:
    """Whether a browser makes a box for the element: rules and styles of display come before the hidden attribute."""
    if node.name in _HIDDEN or (node.name == "dialog" and "open" not in node.attributes):
        return False
    if node.name == "input" and node.attributes.get("type", "").lower() == "hidden":
        return False
    style = node.attributes.get("style")
    display = (_said(style)[0] if style else None) or node.display
    return display != "none" if display else "hidden" not in node.attributes


def _looked(node: Node, look: _Look) -> _Look:
    """What the element hands on: its visibility may differ from its parent's."""
    style = node.attributes.get("style")
    own = (_said(style)[1] if style else None) or node.visibility
    if own in ("hidden", "collapse", "visible") and (own == "visible") != look.shown:
        return replace(look, shown=own == "visible")
    return look


def width(text: str) -> int:
    """Columns of a monospaced display: wide letters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text
    )


class _Page:
    """Lines being written."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.current: list[str] = []
        self.blank = False  # whether a blank precedes the next letter
        self.gap = False  # whether an empty line precedes the next line

    def write(self, text: str, kept: bool) -> None:
        if kept:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.break_line(always=True)
                self._put(line)
            return
        pieces = _BLANKS.split(text)
        for k, piece in enumerate(pieces):
            if k:
                self.blank = True
            if piece:
                self._put((" " if self.blank and self.current else "") + piece)
                self.blank = False

    def _put(self, text: str) -> None:
        if text:
            self.current.append(text)

    def break_line(self, always: bool = False) -> None:
        line = "".join(self.current).rstrip(" \t")
        if line or always:
            if self.gap and self.lines and line:
                self.lines.append("")
            if line:
                self.gap = False
            self.lines.append(line)
        self.current, self.blank = [], False

    def apart(self) -> None:
        self.break_line()
        self.gap = True

    def add(self, lines: list[str], first: str, rest: str) -> None:
        """Lines of an inner page, with a margin."""
        self.break_line()
        for k, line in enumerate(lines):
            self.current = [(first if k == 0 else rest) + line]
            self.break_line(always=bool(k))

    def done(self) -> list[str]:
        self.break_line()
        return self.lines


def _letters(number: int) -> str:
    """1 is a, 26 z, 27 aa."""
    out = ""
    while number > 0:
        number, place = divmod(number - 1, 26)
        out = chr(97 + place) + out
    return out


def _roman(number: int) -> str:
    signs = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
    out = ""
    for value, sign in signs:
        out, number = out + sign * (number // value), number % value
    return out


def _list_marker(node: Node, item: Node, number: int) -> str:
    if node.name != "ol":
        return "- "
    kind = item.attributes.get("type", node.attributes.get("type", "1"))
    shown = str(number)
    if kind in ("a", "A") and number > 0:
        shown = _letters(number)
    elif kind in ("i", "I") and 0 < number < 4000:
        shown = _roman(number)
    return f"{shown.upper() if kind in ('A', 'I') else shown}. "


def _number(value: str | None, otherwise: int) -> int:
    return int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else otherwise


#: A step of the renderer: it yields the steps that it waits for and is sent their results, so that the depth of a page
#: is that of a list, not of the interpreter's stack.
_Step = Generator["_Step", list[str] | None, list[str] | None]


def _done(step: _Step) -> list[str] | None:
    """The result of a step and all that it waits for."""
    waiting, result = [step], None
    while waiting:
        try:
            waiting.append(waiting[-1].send(result))
            result = None
        except StopIteration as end:
            waiting.pop()
            result = end.value
    return result


def _write(page: _Page, raw: str, look: _Look) -> None:
    if look.shown:
        page.write(html.unescape(raw), look.kept)


def _render(node: Node, page: _Page, look: _Look) -> _Step:
    for child in node.children:
        if isinstance(child, str):
            _write(page, child, look)
        elif visible(child):
            yield _render_element(child, page, look)


def _inner(node: Node, look: _Look) -> _Step:
    page = _Page()
    yield _render(node, page, look)
    return page.done()


def _plain(node: Node) -> str:
    """All text inside, white space collapsed."""
    found, stack = [], [node]
    while stack:
        own = stack.pop()
        if isinstance(own, str):
            found.append(own)
        else:
            stack += reversed(own.children)
    return _BLANKS.sub(" ", html.unescape("".join(found))).strip()


def _input_text(node: Node) -> str:
    """What an input shows: a button's label, a field's value or placeholder, an image's alternative."""
    kind, value = node.attributes.get("type", "").lower(), node.attributes.get("value")
    if kind in _BUTTONS:
        return value if value is not None else _BUTTONS[kind]
    if kind == "image":
        return node.attributes.get("alt", "")
    if kind == "password":
        return "" if value else node.attributes.get("placeholder", "")
    return (value or node.attributes.get("placeholder", "")) if kind in _WRITTEN else ""


def _options(select: Node) -> list[Node]:
    """Options and labelled groups of a select, in order."""
    found, stack = [], list(reversed(select.children))
    while stack:
        node = stack.pop()
        if isinstance(node, Node) and visible(node):
            if node.name in ("option", "optgroup"):
                found.append(node)
            if node.name != "option":
                stack += reversed(node.children)
    return found


def _option_text(node: Node) -> str:
    return node.attributes.get("label") or (_plain(node) if node.name == "option" else "")


def _render_select(node: Node, page: _Page, look: _Look) -> None:
    """A list shows all options, a menu the chosen one: the last that is selected, else the first."""
    options = _options(node)
    if "multiple" in node.attributes or _number(node.attributes.get("size"), 1) > 1:
        for option in options:
            page.break_line()
            page.write(_option_text(option), False)
        page.break_line()
        return
    options = [option for option in options if option.name == "option"]
    chosen = [option for option in options if "selected" in option.attributes] or options[:1]
    if chosen:
        page.write(_option_text(chosen[-1]), False)


def _render_svg(node: Node, page: _Page, look: _Look) -> _Step:
    """The texts of an image, each on a line of its own; titles, definitions and shapes aren't text."""
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.name in _SVG_TEXT:
                page.break_line()
                yield _render(child, page, _looked(child, look))
                page.break_line()
            elif child.name in _SVG_GROUPS:
                yield _render_svg(child, page, _looked(child, look))


def _render_list(node: Node, page: _Page, look: _Look) -> _Step:
    items = [c for c in node.children if isinstance(c, Node) and c.name == "li" and visible(c)]
    step = -1 if node.name == "ol" and "reversed" in node.attributes else 1
    number = _number(node.attributes.get("start"), len(items) if step < 0 else 1)
    for child in node.children:
        if isinstance(child, str):
            _write(page, child, look)
        elif child.name == "li" and visible(child):
            own = _looked(child, look)
            number = _number(child.attributes.get("value"), number)
            marker = _list_marker(node, child, number) if own.shown else ""
            page.add((yield _inner(child, own)), marker, " " * len(marker))
            number += step
        elif visible(child):
            yield _render_element(child, page, look)


def _render_element(node: Node, page: _Page, outer: _Look) -> _Step:
    name, look = node.name, _looked(node, outer)
    if name == "br":
        page.break_line(always=True)
    elif name == "wbr":
        pass
    elif name in ("img", "input"):
        if look.shown:
            page.write(node.attributes.get("alt", "") if name == "img" else _input_text(node), False)
    elif name == "textarea":
        page.break_line()
        yield _render(node, page, replace(look, kept=True))
        page.break_line()
    elif name == "select":
        if look.shown:
            _render_select(node, page, look)
    elif name == "svg":
        yield _render_svg(node, page, look)
    elif name == "hr":
        page.apart()
    elif name in ("ul", "ol", "menu"):
        page.apart() if name != "menu" else page.break_line()
        yield _render_list(node, page, look)
        page.apart()
    elif name in ("dd", "blockquote"):
        page.apart() if name == "blockquote" else page.break_line()
        page.add((yield _inner(node, look)), "  ", "  ")
        page.apart() if name == "blockquote" else page.break_line()
    elif name == "table":
        page.apart()
        yield _render_table(node, page, look)
        page.apart()
    elif name in _APART:
        page.apart()
        yield _render(node, page, replace(look, kept=True) if name == "pre" else look)
        page.apart()
    elif name in _BLOCKS:
        page.break_line()
        yield _render(node, page, look)
        page.break_line()
    else:
        yield _render(node, page, look)


def _groups_of(table: Node, look: _Look) -> Iterator[list[tuple[Node, _Look]]]:
    """Rows with their look, by group; rows outside of groups are one with their neighbours."""
    loose: list[tuple[Node, _Look]] = []
    for child in table.children:
        if isinstance(child, Node) and visible(child):
            if child.name == "tr":
                loose.append((child, _looked(child, look)))
            elif child.name in ("tbody", "thead", "tfoot"):
                yield loose
                loose = []
                yield from _groups_of(child, _looked(child, look))
    yield loose


def _render_table(table: Node, page: _Page, look: _Look) -> _Step:
    """Captions and stray text first, then the rows with their cells in columns; a lone column is plain text.

    A cell that spans rows keeps its columns free in those beneath it, to the end of its row group at most.
    """
    for child in table.children:
        if isinstance(child, str):
            _write(page, child, look)
        elif child.name not in ("tr", "tbody", "thead", "tfoot") and visible(child):
            yield _render_element(child, page, look)
    page.break_line()
    rows = []
    for group in _groups_of(table, look):
        taken: dict[int, int] = {}  # columns that cells from above reach into, and for how many rows
        for at, (row, row_look) in enumerate(group):
            cells: dict[int, list[str]] = {}
            column, spans = 0, {}
            for cell in row.children:
                if isinstance(cell, str):
                    if not cell.strip():
                        continue
                    own, across, down = [_BLANKS.sub(" ", html.unescape(cell)).strip()] if row_look.shown else [], 1, 1
                elif visible(cell):
                    inside = cell if cell.name in ("td", "th") else Node("#cell", {}, [cell])
                    own = yield _inner(inside, _looked(inside, row_look))
                    across = min(max(_number(cell.attributes.get("colspan"), 1), 1), 1000)
                    down = _number(cell.attributes.get("rowspan"), 1)
                    down = len(group) - at if down == 0 else max(down, 1)
                else:
                    continue
                while taken.get(column, 0):
                    column += 1
                cells[column] = own
                for k in range(column, column + across):
                    cells.setdefault(k, [])
                    spans[k] = down
                column += across
            taken = {k: left - 1 for k, left in taken.items() if left > 1}
            taken.update({k: down - 1 for k, down in spans.items() if down > 1})
            if any(cells.values()):
                rows.append(cells)
    columns = 1 + max((max(row) for row in rows), default=-1)
    widths = [0] * columns
    for row in rows:
        for j, lines in row.items():
            widths[j] = max([widths[j], *map(width, lines)])
    for row in rows:
        last = max(row)
        for k in range(max(map(len, row.values()))):
            parts = [row[j][k] if j in row and k < len(row[j]) else "" for j in range(last + 1)]
            line = "  ".join(part + " " * (widths[j] - width(part)) for j, part in enumerate(parts))
            page.current = [line.rstrip()]
            page.break_line(always=True)


def render(source: str) -> str:
    """All visible text of a page, laid out; without an empty line at the ends."""
    lines = _done(_inner(parse(source), _Look()))
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, title and text of each page.

    Null html is an empty page: title and text are empty. Null ids and urls stay, repeated rows are rendered each, an
    empty table gives an empty result, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, titles = [], []
            for source in batch.column(2).to_pylist():
                tree = parse(source or "")
                texts.append("\n".join(_done(_inner(tree, _Look()))).strip("\n"))
                titles.append(_title(tree))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(titles, pa.string()), pa.array(texts, pa.string())],
                names=["page_id", "url", "title", "text"],
            )

    small = small_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")))
    return small.mapInArrow(run, "page_id long, url string, title string, text string")


def _title(tree: Node) -> str:
    """The text of the first title element outside of images."""
    stack: list[Node] = [tree]
    while stack:
        node = stack.pop()
        if node.name == "title":
            return _BLANKS.sub(" ", html.unescape("".join(c for c in node.children if isinstance(c, str)))).strip()
        if node.name not in ("svg", "math"):
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return ""
