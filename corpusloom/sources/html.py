"""HTML pages as element rows: parser, display rules, section plan, walk.

A page becomes the preorder event table of the document model: one row for each
start, end and text.  Parsing is the one step that Spark has no operator for, so it runs
in Arrow batches of pages, each page on its own.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.storage import spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = {f"h{n}": n for n in range(1, 7)}
SKIPPED = frozenset(("script", "noscript", "style", "svg"))
#: Tags that break text into blocks, a fixed set of the document model.
BLOCKS = frozenset(
    """article aside blockquote body br button canvas caption col colgroup dd div dl dt embed fieldset figcaption figure footer form h1 h2 h3 h4 h5
    h6 header hgroup hr li map object ol output p pre progress section table tbody textarea tfoot th thead tr ul video""".split()
)
#: Start tags that close an open paragraph.
_ENDS_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main
    menu nav ol p pre section table ul""".split()
)
#: Start tag -> (open tags it closes, tags beyond which it does not look).
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
#: Elements that go on in the next block if the one they were opened in ends before them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: What may stand directly in the parts of a table; anything else is put before the table.
_IN_TABLE = frozenset("caption colgroup col tbody tfoot thead tr td th script style template form".split())
_TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
_HEAD_ONLY = frozenset(("title", "base", "meta", "link", "style", "script"))


@dataclass(eq=False, slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list = field(default_factory=list)  # Node or str

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def path(self) -> list[Node]:
        """Elements from the root down to this one."""
        out, node = [], self
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += reversed(node.elements())

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)


class TreeBuilder(HTMLParser):
    """Tree of a page with implied ends, an implied root, head and body.

    A formatting element that is still open when the block around it ends goes on in what follows, as a
    new element of the same attributes; what stands in a table outside of its cells is put before the table.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.head = Node("head", parent=self.root)
        self.body: Node | None = None
        self.root.children.append(self.head)
        self.open = [self.root, self.head]
        self.pending: list[Node] = []  # formatting elements to be opened again
        self.held: Counter[str] = Counter()  # open elements by tag
        self.deepest = 2

    def _cut(self, at: int, closed: str = "") -> None:
        """Take the open elements from a place on off the stack; formatting ones that were not closed by their tag go on later."""
        for node in self.open[at:]:
            if node.tag in FORMATTING and node.tag != closed and not any(p.tag == node.tag for p in self.pending):
                self.pending.append(node)
        self._drop(at)

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.held[node.tag] += 1
        self.deepest = max(self.deepest, len(self.open))

    def _drop(self, at: int) -> None:
        for node in self.open[at:]:
            self.held[node.tag] -= 1
        del self.open[at:]

    def _insert(self, child: Node | str, tag: str | None) -> None:
        """Put a node or text below the innermost open element, or before the table it may not stand in."""
        at = len(self.open) - 1
        if self.open[at].tag in _TABLE_PARTS and tag not in _IN_TABLE:
            while at > 1 and self.open[at].tag != "table":
                at -= 1
            table, parent = self.open[at], self.open[at].parent
            if table.tag == "table" and parent is not None:
                place = next(i for i, c in enumerate(parent.children) if c is table)
                if isinstance(child, str):
                    if place and isinstance(parent.children[place - 1], str):
                        parent.children[place - 1] += child
                        return
                else:
                    child.parent = parent
                parent.children.insert(place, child)
                return
        siblings = self.open[-1].children
        if isinstance(child, str) and siblings and isinstance(siblings[-1], str):
            siblings[-1] += child
        else:
            siblings.append(child)

    def _reopen(self) -> None:
        """Open formatting elements again that an ended block has cut off."""
        pending, self.pending = self.pending, []
        for old in pending:
            node = Node(old.tag, dict(old.attrs), self.open[-1])
            self._insert(node, node.tag)
            self._push(node)

    def _in_body(self) -> None:
        if self.body is None:
            self.body = Node("body", parent=self.root)
            self.root.children.append(self.body)
            self.open = [self.root, self.body]
            self.held.clear()

    def _close(self, tags: tuple[str, ...], limits: tuple[str, ...]) -> None:
        if not any(self.held[tag] for tag in tags):
            return
        at = len(self.open) - 1
        while at > 1:
            tag = self.open[at].tag
            if tag in tags:
                self._cut(at, tag)
            elif tag in limits:
                return
            at -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named: dict[str, str] = {}
        for key, value in attrs:
            named.setdefault(key, value or "")
        if tag in ("html", "head", "body"):
            target = {"html": self.root, "head": self.head}.get(tag)
            if tag == "body":
                self._in_body()
                target = self.body
            for key, value in named.items():
                target.attrs.setdefault(key, value)
            return
        if self.body is None and tag not in _HEAD_ONLY and self.open[-1].tag not in ("title", "style", "script", "noscript"):
            if not (tag == "noscript" and self.open[-1] is self.head):
                self._in_body()
        if tag in _ENDS_P:
            self._close(("p",), ("table", "td", "th", "caption", "button", "object"))
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._drop(len(self.open) - 1)
        if tag in _IMPLIED:
            self._close(*_IMPLIED[tag])
        if tag == "a":
            self._close(("a",), ("table", "td", "th", "caption", "object"))
            self.pending = [p for p in self.pending if p.tag != "a"]
        if tag in _IN_TABLE and tag not in ("script", "style", "template", "form"):
            self._to_table()
        elif self.pending and tag not in _ENDS_P and tag not in _IMPLIED and tag not in _HEAD_ONLY and self.body is not None:
            self._reopen()
        node = Node(tag, named, self.open[-1])
        self._insert(node, tag)
        if tag not in VOID:
            self._push(node)

    def _to_table(self) -> None:
        """Leave elements that were put before a table, so that its next part stands in the table again."""
        for at in range(len(self.open) - 1, 1, -1):
            if self.open[at].tag in ("td", "th", "caption"):
                return
            if self.open[at].tag in _TABLE_PARTS:
                self._drop(at + 1)
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash says nothing on an element that is not void

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in ("html", "body", "head"):
            return
        for at in range(len(self.open) - 1, 1, -1):
            if self.open[at].tag == tag or tag in HEADINGS and self.open[at].tag in HEADINGS:
                self._cut(at, tag)
                self.pending = [p for p in self.pending if p.tag != tag]
                return
            if self.open[at].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return
        self.pending = [p for p in self.pending if p.tag != tag]
        if tag == "p":
            self.handle_starttag("p", [])
            self._drop(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if self.body is None and self.open[-1] in (self.root, self.head):
            if not data.strip():
                return
            self._in_body()
        blank = not data.strip()
        if self.pending and not blank and self.body is not None:
            self._reopen()
        self._insert(data, "script" if blank else None)


def parse(html: str) -> Node:
    """Root element of a page; any text gives a tree."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    builder._in_body()
    _allow_depth(builder.deepest)
    return builder.root


def _allow_depth(deepest: int) -> None:
    """The walk calls itself a few times for each level of a page; these are calls of Python alone, which take no stack of the process."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * deepest + 10_000))


# ---- display: the one style that decides about blocks ----

_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)\s*(!important)?", re.I)
_TOKEN = re.compile(r"\s*([>+~])\s*|\s+|((?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+|\[[^\]]+\]|:[\w-]+(?:\([^()]*\))?)*)")
_PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]|:([\w-]+)(?:\(([^()]*)\))?")
_TAG = re.compile(r"[a-zA-Z][\w-]*|\*")
_NTH = re.compile(r"(?:([+-]?\d*)n)?\s*([+-]?\s*\d+)?$")


class Selector(NamedTuple):
    steps: tuple[tuple[str, str, tuple], ...]  # (combinator before, tag, parts), outermost first
    weight: tuple[int, int, int]


def _nth(text: str) -> tuple[int, int] | None:
    """(a, b) of ``an+b``; None for anything else."""
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip().lower(), text.strip().lower())
    m = _NTH.match(text)
    if not text or not m:
        return None
    a = 0 if "n" not in text else int((m.group(1) or "+").replace("+", "+0") + "1") if m.group(1) in (None, "", "+", "-") else int(m.group(1))
    a = -1 if m.group(1) == "-" else 1 if "n" in text and m.group(1) in (None, "", "+") else a
    return a, int((m.group(2) or "0").replace(" ", ""))


#: Pseudo-classes of the structure of a page; rules with any other one hold in no state of a page at rest.
_STRUCTURAL = frozenset("first-child last-child only-child first-of-type last-of-type nth-child nth-last-child nth-of-type not empty root link any-link".split())


def parse_selector(text: str) -> Selector | None:
    """Selector of tags, classes, ids, attributes and structural pseudo-classes with all four combinators; None for others, which match nothing."""
    steps, weight, combinator, at = [], [0, 0, 0], " ", 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            return None
        at = m.end()
        if m.group(1):
            combinator = m.group(1)
            continue
        simple = m.group(2)
        if not simple:
            continue
        tag = _TAG.match(simple)
        parts = tuple(p.groups() for p in _PART.finditer(simple, tag.end() if tag else 0))
        for p in parts:
            if p[5] and (p[5] not in _STRUCTURAL or p[5].startswith("nth") and _nth(p[6] or "") is None or p[5] == "not" and parse_selector(p[6] or "") is None):
                return None
        if "::" in simple:
            return None
        weight[0] += sum(p[0] == "#" for p in parts)
        weight[1] += sum(p[0] != "#" and p[5] != "not" for p in parts)
        for p in parts:
            if p[5] == "not":
                weight = [x + y for x, y in zip(weight, parse_selector(p[6]).weight, strict=True)]
        name = tag.group().lower() if tag else "*"
        weight[2] += name != "*"
        steps.append((combinator, name, parts))
        combinator = " "
    return Selector(tuple(steps), tuple(weight)) if steps else None


def _is_structural(node: Node, name: str, argument: str | None) -> bool:
    if name == "root":
        return node.parent is None
    if name in ("link", "any-link"):
        return node.tag in ("a", "area") and "href" in node.attrs
    if name == "empty":
        return not node.children
    if name == "not":
        return not matches(node, parse_selector(argument or ""))
    if node.parent is None:
        return False
    siblings = [c for c in node.parent.elements() if "type" not in name or c.tag == node.tag]
    place = next(i for i, c in enumerate(siblings, 1) if c is node)
    if "last" in name:
        place = len(siblings) + 1 - place
    if name == "only-child":
        return len(siblings) == 1
    if name.startswith("nth"):
        a, b = _nth(argument or "")
        return (place - b) % a == 0 and (place - b) // a >= 0 if a else place == b
    return place == 1


def _matches_simple(node: Node, tag: str, parts: tuple) -> bool:
    if tag not in ("*", node.tag):
        return False
    for mark, name, attr, op, value, pseudo, argument in parts:
        if pseudo:
            if not _is_structural(node, pseudo, argument):
                return False
        elif mark == ".":
            if name not in node.attrs.get("class", "").split():
                return False
        elif mark == "#":
            if node.attrs.get("id") != name:
                return False
        else:
            own = node.attrs.get(attr)
            tests = {
                None: lambda: True, "=": lambda: own == value, "~=": lambda: value in own.split(), "|=": lambda: own == value or own.startswith(value + "-"),
                "^=": lambda: own.startswith(value), "$=": lambda: own.endswith(value), "*=": lambda: value in own,
            }
            if own is None or not tests[op]():
                return False
    return True


def matches(node: Node, selector: Selector) -> bool:
    return _matches(node, selector.steps)


def _matches(node: Node, steps: tuple) -> bool:
    combinator, tag, parts = steps[-1]
    if not _matches_simple(node, tag, parts):
        return False
    if len(steps) == 1:
        return True
    if combinator in "+~":
        before = []
        for c in node.parent.elements() if node.parent is not None else ():
            if c is node:
                break
            before.append(c)
        return any(_matches(c, steps[:-1]) for c in (before[-1:] if combinator == "+" else before))
    above = node.parent
    while above is not None:
        if _matches(above, steps[:-1]):
            return True
        if combinator == ">":
            return False
        above = above.parent
    return False


def select(root: Node, selectors: str) -> list[Node]:
    """Elements below a node, in order, that any selector of a comma-separated list matches."""
    wanted = [x for x in map(parse_selector, selectors.split(",")) if x]
    return [n for n in root.walk() if n is not root and any(matches(n, x) for x in wanted)]


def select_first(root: Node, selectors: str) -> Node | None:
    return next(iter(select(root, selectors)), None)


def _holds(condition: str) -> bool:
    """Whether a media query holds for a screen; conditions on sizes are taken to hold."""
    for part in condition.lower().split(","):
        words = part.replace("(", " (").split()
        negated = words[:1] == ["not"]
        kinds = [w for w in words if w in ("all", "screen", "print", "speech", "tty", "tv", "projection", "handheld", "braille", "embossed", "aural")]
        if (not kinds or kinds[0] in ("all", "screen")) != negated:
            return True
    return not condition.strip()


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a sheet, also of those within conditions that hold."""
    at, n = 0, len(css)
    while at < n:
        brace = css.find("{", at)
        if brace < 0:
            return
        head = css[at:brace].rpartition(";")[2].strip() if "@" in css[at:brace] and ";" in css[at:brace] else css[at:brace].strip()
        depth, end = 1, brace + 1
        while end < n and depth:
            depth += (css[end] == "{") - (css[end] == "}")
            end += 1
        body = css[brace + 1 : end - 1 if depth == 0 else end]
        if head.lower().startswith("@media"):
            if _holds(head[6:]):
                yield from css_rules(body)
        elif head.lower().startswith(("@supports", "@layer", "@document")):
            yield from css_rules(body)
        elif not head.startswith("@"):
            yield head, body
        at = end


class Display:
    """Computed ``display`` of links and spans, from the style sheets of a page and inline styles."""

    def __init__(self, root: Node, sheets: Iterable[str] = ()):
        self.rules: list[tuple[bool, tuple, int, Selector, str]] = []
        for node in root.walk():
            if node.tag == "style" and _holds(node.attrs.get("media", "")):
                self._add(node.text())
        for sheet in sheets:
            self._add(sheet)
        self.rules.sort(key=lambda r: r[:3])

    def _add(self, css: str) -> None:
        for head, body in css_rules(_COMMENT.sub(" ", css)):
            found = _DISPLAY.findall(body)
            if not found:
                continue
            value, important = found[-1]
            for part in head.split(","):
                selector = parse_selector(part)
                if selector:
                    self.rules.append((bool(important), selector.weight, len(self.rules), selector, value.lower()))

    def of(self, node: Node) -> str:
        value, forced = "", False
        for important, _, _, selector, display in self.rules:
            if matches(node, selector):
                value, forced = display, important
        inline = _DISPLAY.findall(node.attrs.get("style", ""))
        if inline and (not forced or inline[-1][1]):
            value = inline[-1][0].lower()
        if value == "inherit":
            value = self.of(node.parent) if node.parent is not None else ""
        return value

    def is_block(self, node: Node) -> bool:
        return node.tag in BLOCKS or node.tag in ("a", "span") and self.of(node).endswith("block")


# ---- sections ----


def is_heading(node: Node) -> bool:
    return node.tag in HEADINGS or node.tag == "p" and node.attrs.get("role") == "heading" and "aria-level" in node.attrs


def heading_level(node: Node) -> int:
    if node.tag in HEADINGS:
        return HEADINGS[node.tag]
    digits = re.match(r"\s*[+-]?\d+", node.attrs["aria-level"])
    return int(digits.group()) if digits else 2


class _Level:
    """Headings that share one enclosing element."""

    def __init__(self, root: Node):
        self.root, self.last = root, None


def section_containers(root: Node) -> dict[Node, Node]:
    """Element -> heading whose section begins with that element.

    A heading governs the largest element around it that holds no neighbouring heading.
    Of the two neighbours the nearer one decides, and the previous one at equal
    distance unless the element would be the head of the page.
    """
    headings = [n for n in root.walk() if is_heading(n)]
    paths = {h: h.path() for h in headings}
    before: dict[Node, tuple[int, Node]] = {}
    after: dict[Node, tuple[int, Node]] = {}
    levels = [_Level(root)]
    for index, heading in enumerate(headings):
        own = paths[heading]
        while len(levels) > 1 and levels[-1].root not in own:
            levels.pop()
        previous = levels[-1].last
        if previous is not None and previous in own:  # a heading within a heading
            levels.append(_Level(previous))
        elif previous is not None:
            other = paths[previous]
            shared = 0
            while shared < min(len(own), len(other)) and own[shared] is other[shared]:
                shared += 1
            if 0 < shared < len(own):
                before[heading] = (len(own) - shared, own[shared])
                if shared < len(other):
                    last = headings[index - 1]
                    after[last] = (len(paths[last]) - shared, other[shared])
        levels[-1].last = heading
    out: dict[Node, Node] = {}
    for heading in headings:
        one, two = before.get(heading), after.get(heading)
        if one and two and one[0] == two[0]:
            chosen = two[1] if one[1].tag == "head" else one[1]
        else:
            nearest = min((x for x in (one, two) if x), key=lambda x: x[0], default=None)
            chosen = nearest[1] if nearest else None
        if chosen is not None and chosen is not heading and (not chosen.elements() or chosen.elements()[0] is not heading):
            out[chosen] = heading
    return out


# ---- rows ----


def is_hidden(attrs: dict[str, str]) -> bool:
    """Parts that do not show, told by attributes alone: ``aria-hidden`` counts whatever its value."""
    return any(x in attrs.get("class", "") for x in ("hidden", "invisible", "login", "search")) or "search" in attrs.get("role", "") or "aria-hidden" in attrs


def is_navigation(node: Node) -> bool:
    """A list of links: only items, at least one link among their elements, at most one other element."""
    links = others = 0
    for item in node.elements():
        if item.tag != "li":
            return False
        for part in item.elements():
            links, others = (links + 1, others) if part.tag == "a" else (links, others + 1)
    return links > 0 and others <= 1


def _span(value: str | None) -> int:
    if value is None:
        return 1
    return int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else 0


class Row(NamedTuple):
    pos: int
    elt_type: str
    cmd: str
    nesting_level: int
    path: list[int]
    text: str | None
    row: int | None
    rowspan: int | None
    col: int | None
    colspan: int | None


class Walker:
    """Rows of one page in preorder."""

    def __init__(self, root: Node, sheets: Iterable[str] = ()):
        self.display, self.sections = Display(root, sheets), section_containers(root)
        self.governed = set(self.sections.values())
        self.title: str | None = None
        self.rows: list[Row] = []
        self.groups: list[tuple[str, int]] = []  # (type, pos) of open groups
        self.buffers: list[list[str]] = []
        self.capturing = False
        self.tables: list[dict] = []
        self.begin_block()
        self.visit(root)
        self.end_block()

    # events

    def _emit(self, kind: str, cmd: str, text: str | None = None, cell: tuple = (None,) * 4) -> None:
        above = [p for _, p in self.groups]
        self.rows.append(Row(len(self.rows), kind, cmd, len(above) + 1, above, text, *cell))

    def start(self, kind: str, text: str | None = None, cell: tuple = (None,) * 4) -> None:
        self._emit(kind, "Start", text, cell)
        self.groups.append((kind, len(self.rows) - 1))

    def end(self) -> None:
        kind, _ = self.groups.pop()
        self._emit(kind, "End")

    def begin_block(self, capture: bool = False) -> None:
        self.buffers.append([])
        if capture:
            self.capturing = True

    def end_block(self, capture: bool = False) -> str | None:
        if capture:
            self.capturing = False  # one flag and no stack, as the model has it
        pieces = self.buffers.pop()
        text = " ".join(pieces) if pieces else None
        if text and not capture and (not self.groups or self.groups[-1][0] not in ("List", "NavigationList", "Table")):
            self._emit("TextBlock", "Text", text)
        return text or None

    def add(self, text: str) -> None:
        if self.buffers:
            text = unescape(text.strip()).strip("\xa0")
            if text or self.buffers[-1]:
                self.buffers[-1].append(text)

    # nodes

    def visit(self, node: Node) -> None:
        open_: list[int] = []  # levels of sections begun among these children
        if node in self.sections:
            self.section(self.sections[node], open_)
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    self.add(child)
            elif not is_hidden(child.attrs) and child.tag not in SKIPPED:
                self.element(child, open_)
        for _ in open_:
            self.end()

    def element(self, node: Node, open_: list[int]) -> None:
        tag = node.tag
        if tag == "title":
            self.title = self.captured(node)
        elif tag in HEADINGS:
            if node not in self.governed:
                self.section(node, open_)
        elif tag in ("ul", "ol"):
            self.start("NavigationList" if is_navigation(node) else "List")
            self.visit(node)
            self.end()
        elif tag == "li":
            self.start("ListItem")
            self.block(node)
            self.end()
        elif tag == "table":
            self.tables.append({"row": 1, "col": 1, "taken": []})
            self.start("Table")
            self.visit(node)
            self.end()
            self.tables.pop()
        elif tag == "tr":
            self.visit(node)
            if self.tables:
                self.tables[-1]["row"] += 1
                self.tables[-1]["col"] = 1
        elif tag in ("td", "th"):
            self.cell(node)
        elif tag == "img":
            if node.attrs.get("alt"):
                self.add(node.attrs["alt"])
        elif tag == "a" and not node.children and "title" in node.attrs:
            self.add(node.attrs["title"])
        elif not self.capturing and self.display.is_block(node):
            self.block(node)
        else:
            self.visit(node)

    def block(self, node: Node) -> None:
        self.begin_block()
        self.visit(node)
        self.end_block()

    def captured(self, node: Node) -> str | None:
        if not node.children:
            return None
        self.begin_block(True)
        self.visit(node)
        return self.end_block(True)

    def section(self, heading: Node, open_: list[int]) -> None:
        level = heading_level(heading)
        while open_ and level <= open_[-1]:
            open_.pop()
            self.end()
        self.start("Section", self.captured(heading))
        open_.append(level)

    def cell(self, node: Node) -> None:
        table = self.tables[-1] if self.tables else {"row": 1, "col": 1, "taken": []}
        table["taken"] = [x for x in table["taken"] if x[0] >= table["row"]]
        moved = True
        while moved:  # past the cells of rows above that reach down to this one
            moved = False
            for last_row, first_col, last_col in table["taken"]:
                if first_col <= table["col"] <= last_col:
                    table["col"], moved = last_col + 1, True
        rows, cols = _span(node.attrs.get("rowspan")), _span(node.attrs.get("colspan"))
        row, col = table["row"], table["col"]
        self.begin_block()
        self.start("TableHeader" if node.tag == "th" else "TableCell", None, (row, rows, col, cols))
        self.visit(node)
        self.end_block()
        self.end()
        if rows > 1 and cols > 0:
            table["taken"].append((row + rows - 1, col, col + cols - 1))
        table["col"] += cols


def page_rows(html: str, sheets: Iterable[str] = ()) -> tuple[str | None, list[Row]]:
    """Title and rows of a page; ``sheets`` are the texts of its external style sheets."""
    walker = Walker(parse(html), sheets)
    return walker.title, walker.rows


# ---- links ----


def page_links(html: str | Node) -> list[tuple[int, str, str, bool]]:
    """(pos, kind, href, nofollow) of anchors and areas with a target, then of canonical links; nothing if robots meta forbids to follow."""
    root = parse(html) if isinstance(html, str) else html
    metas = [n.attrs.get("content", "").lower() for n in root.walk() if n.tag == "meta" and n.attrs.get("name", "").lower() == "robots"]
    if any("nofollow" in m or "none" in m for m in metas):
        return []
    found = [("anchor", n.attrs["href"].strip(), n.attrs.get("rel", "").strip().lower() == "nofollow") for n in root.walk() if n.tag in ("a", "area") and n.attrs.get("href", "").strip()]
    found += [("canonical", n.attrs["href"].strip(), False) for n in root.walk() if n.tag == "link" and n.attrs.get("rel", "").lower() == "canonical" and n.attrs.get("href", "").strip()]
    return [(i, *f) for i, f in enumerate(found)]


def base_href(html: str | Node) -> str | None:
    root = parse(html) if isinstance(html, str) else html
    return next((n.attrs["href"] for n in root.walk() if n.tag == "base" and n.attrs.get("href")), None)


def sheet_links(html: str | Node) -> list[str]:
    """Addresses of the external style sheets of a page that hold for a screen, in order."""
    root = parse(html) if isinstance(html, str) else html
    return [
        n.attrs["href"].strip() for n in root.walk()
        if n.tag == "link" and "stylesheet" in n.attrs.get("rel", "").lower().split() and n.attrs.get("href", "").strip() and _holds(n.attrs.get("media", ""))
    ]


ELEMENTS_DDL = (
    "page_id bigint, title string, pos int, elt_type string, cmd string, nesting_level int, path array<int>, text string,"
    " `row` int, rowspan int, col int, colspan int, error string"
)


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sheets_col: str | None = None) -> DataFrame:
    """Element rows of each page, however deep; a page that cannot be walked gives one row with its error and never fails the task.

    ``sheets_col`` names an array of the texts of a page's external style sheets; see :func:`with_sheets`.
    """
    types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), *[pa.int32()] * 4, pa.string()]
    names = ["page_id", "title", "pos", "elt_type", "cmd", "nesting_level", "path", "text", "row", "rowspan", "col", "colspan", "error"]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, html, sheets in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if html is None:
                    continue
                try:
                    title, rows = page_rows(html, sheets or ())
                    out += [(key, title, *r, None) for r in rows]
                except (RecursionError, ValueError) as problem:
                    out.append((key, None, 0, "Document", "Error", 0, [], *[None] * 5, type(problem).__name__))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)

    sheets = F.col(sheets_col) if sheets_col else F.lit(None).cast("array<string>")
    return spread(pages.select(F.col(id_col).cast("bigint"), F.col(html_col), sheets)).mapInArrow(work, ELEMENTS_DDL)


def html_sheets(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, href) of the external style sheets of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, i, x) for key, html in zip(*(c.to_pylist() for c in batch.columns), strict=True) if html and "stylesheet" in html.lower() for i, x in enumerate(sheet_links(html))]
            keys, places, hrefs = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(hrefs, pa.string())], names=["page_id", "pos", "href"])

    return spread(pages.select(F.col(id_col).cast("bigint"), F.col(html_col))).mapInArrow(work, "page_id bigint, pos int, href string")


def with_sheets(pages: DataFrame, sheets: DataFrame, url_col: str = "url") -> DataFrame:
    """Pages with ``sheets``: the texts of their external style sheets, from a table (url, css) of those that could be had.

    Pages without any keep null.  Sheets of a page are few, and their texts are joined to the links and not to the pages.
    """
    from corpusloom.operators.frontier import resolve

    links = html_sheets(pages).join(pages.select("page_id", F.col(url_col).alias("_base")), "page_id")
    named = links.select("page_id", "pos", resolve(F.col("_base"), F.col("href")).alias("_sheet"))
    found = named.join(sheets.select(F.col("url").alias("_sheet"), "css").where("css IS NOT NULL"), "_sheet")
    own = found.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "css"))), lambda x: x["css"]).alias("sheets"))
    return pages.join(own, "page_id", "left")


def html_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, pos, kind, href, nofollow, base) of each page."""
    types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    schema = pa.schema(list(zip(["page_id", "pos", "kind", "href", "nofollow", "base"], types, strict=True)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if html and "href" in html.lower():
                    root = parse(html)
                    base = base_href(root)
                    rows += [(key, *link, base) for link in page_links(root)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], schema=schema)

    return spread(pages.select(F.col(id_col).cast("bigint"), F.col(html_col))).mapInArrow(work, "page_id bigint, pos int, kind string, href string, nofollow boolean, base string")
