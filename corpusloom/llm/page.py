"""Lines of a page and their split into main body and frame by minimum cut.

One page is one graph.  Every non-blank line is a node; the additive log-odds
of :func:`line_score` give its two terminal capacities (frame against body),
neighbouring lines are joined by smoothness edges, and the head of a box of
references and its entries, inferred from the text, by stronger ones.  There are no
edges from the proximity of elements in the page's tree: only text is read.
The cut of least capacity labels the page.  Everything here works on a single
text and is plain Python, so that a partition is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import deque

from corpusloom.llm.lexicon import LABEL_KEYS, RELATED_KEYS, skeleton
from corpusloom.llm.lexicon import PHRASES as KNOWN

# Kinds of lines; the page operators share them.
PROSE, HEADING, LIST, TABLE, TITLE, RELATED, FRAME, OTHER, MESSAGE, FILLER = range(10)

#: Kinds of the lists of phrases.
_PHRASES = (MESSAGE, FILLER, FRAME)

#: Log-odds (in hundredths) that a line of a kind belongs to the frame.
SCORES = {PROSE: -400, HEADING: -600, LIST: -150, TABLE: -300, TITLE: -60, RELATED: 500, FRAME: 500, OTHER: -120, MESSAGE: -200, FILLER: -500}

#: Capacities of edges: neighbours, and lines of one inferred block.
ADJACENT, SAME_BLOCK = 30, 450

#: Log-odds that a title-shaped line is an entry of the box of references it stands in: of the first entry, and how much
#: less with each further one; on a page that has titles outside of boxes as well it falls faster.  The edge to the next
#: entry falls too, so the cut ends a long run of such lines by itself and no number of entries is fixed.
ENTRY, ENTRY_FALL, LISTED_FALL, EDGE_FALL = 40, 8, 24, 25

_SEPARATED = re.compile(r" [^\sA-Za-z0-9]{1,12} |\t")
_MARK = re.compile(r"^(?:[-–*•›»>]|\d{1,3}[.)])\s+")
_TITLE_MARK = re.compile(r"^(?:-|[^\sA-Za-z0-9*•–]{1,12})\s+")
_TITLE_SHAPE = re.compile(r"\s(?:[:–-]|[^\sA-Za-z0-9]{1,12})\s|\s\d{4}$|\(\d{4}\)$|, [A-ZÀ-Þ]\S*(?: [A-ZÀ-Þ]\S*)?$|^(?:\S+ )+[A-ZÀ-Þ]{3,}$")
_ARTICLE = re.compile(r"^(?:le|la|les|l.|the|der|die|das|el|los|las|il|lo|gli|i|un|una|une)\b", re.I)
_CELLS = re.compile(r"\||\t|;")
_WORD = re.compile(r"[^\W\d_]+")
#: Ends of sentences within a line.
_SENTENCES = re.compile(r"(?<=[^\W\d_][.!?…])\s+(?=[^\W\d_a-z])")
_DIGITS = re.compile(r"[0-9]+")
#: Longer than any label of a menu.
LABEL_LENGTH = max(map(len, LABEL_KEYS | RELATED_KEYS)) + 4
#: Beginnings of all labels and heads of boxes.
LABEL_HEADS = frozenset(x[:3] for x in RELATED_KEYS | LABEL_KEYS)
_URL = re.compile(r"\.(?:example|test|com|org|net)\b|https?:|www\.")


def _labels(parts: list[str]) -> int:
    return sum(skeleton(p) in LABEL_KEYS for p in parts)


def line_kind(line: str) -> int:
    """Kind of one stripped, non-blank line, without regard to its place: that of its phrase, else that of its shape."""
    if line[0] == "#":
        return HEADING
    kind = phrase_kind(line)
    return shape_kind(line) if kind is None else kind


def phrase_kind(line: str, key: str | None = None, parts: list[str] | None = None) -> int | None:
    """Kind that the fixed phrases give a line of any length, None if they say nothing.

    A phrase must make up a part of what it is found in.  It may be the whole line; of a line of more than two sentences
    the first one must be a phrase of the frame, or half of them messages or fillers.
    """
    if line[0] == "©":
        return FRAME
    bare = _MARK.sub("", skeleton(line) if key is None else key)
    if parts is None:
        parts = parted(line)
    known = KNOWN.may(bare)
    if not known and len(parts) < 2 and (len(line) > LABEL_LENGTH or bare[:3] not in LABEL_HEADS):
        return None
    if known and len(line) > LABEL_LENGTH:
        sentences = _SENTENCES.split(line)
        if len(sentences) > 1:
            kinds = [KNOWN.number(_MARK.sub("", skeleton(x))) for x in sentences]
            for number in (0, 1):
                if 2 * kinds.count(number) >= len(kinds):
                    return _PHRASES[number]
            if kinds[0] == 2:
                return FRAME
            if len(sentences) > 2:
                return None
    if bare in LABEL_KEYS:
        return FRAME
    if bare in RELATED_KEYS or bare.rstrip(" :") in RELATED_KEYS:
        return RELATED
    number = KNOWN.number(bare) if known else None
    if number is not None:
        return _PHRASES[number]
    head, colon, _ = bare.partition(" : ")
    if not colon:
        head, colon, _ = bare.partition(": ")
    if colon and head in RELATED_KEYS:
        return FRAME
    if len(parts) > 1:
        hits = _labels(parts)
        if hits and (hits * 2 >= len(parts) or skeleton(parts[0]) in LABEL_KEYS):
            return FRAME
    return None


def parted(line: str) -> list[str]:
    """Items of a line between separators."""
    return [p for p in _SEPARATED.split(line) if p.strip()] if _SEPARATED.search(line) else [line]


def shape_kind(line: str) -> int:
    """Kind of a line by its shape alone."""
    if line[0] == "#":
        return HEADING
    if line[0] == "|" or line.count(";") > 2 or line.count("\t") > 1:
        return TABLE
    if _URL.search(line):
        return OTHER
    ended = is_ended(line)
    if not ended and len(line) <= 110 and line[0] not in "*•–0123456789":
        title = _TITLE_MARK.sub("", line)
        if title[:1].isupper() and (_TITLE_SHAPE.search(title) or _ARTICLE.match(title)):
            return TITLE
    if _MARK.match(line):
        return LIST
    if ended and len(line) > 40:
        return PROSE
    return OTHER


def is_ended(line: str) -> bool:
    """Whether a line ends as a sentence."""
    return line.rstrip("'\"”»)] \t\r")[-1:] in _ENDINGS


_ENDINGS = frozenset(".!?…:;")


class Classifier:
    """Kinds of lines with a bounded memory of short ones, since frames recur on every page of a site."""

    KEPT = 170  # characters; longer lines are judged anew each time, by the same rules

    def __init__(self, bound: int = 40_000):
        self.bound, self.memory = bound, {}

    def __call__(self, line: str) -> int:
        if len(line) > self.KEPT:
            return line_kind(line)
        kind = self.memory.get(line)
        if kind is None:
            if len(self.memory) >= self.bound:
                self.memory.clear()
            kind = self.memory[line] = line_kind(line)
        return kind


def minimum_cut(score: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: node i pays max(0, score[i]) if False and max(0, -score[i]) if True, an edge its capacity if it is cut.

    Terminal arcs are cancelled first; what is left flows from positive to negative
    nodes by shortest augmenting paths.  A search that finds no deficit marks all it
    reached as the source side, so no node is searched again.  Edges join near
    lines, hence searches stay local and the work is in proportion to the lines.
    """
    excess = list(score)
    near: list[list[list]] = [[] for _ in score]
    for a, b, capacity in edges:
        there, back = [b, capacity, None], [a, capacity, None]
        there[2], back[2] = back, there
        near[a].append(there)
        near[b].append(back)
    source = [False] * len(score)
    for start in range(len(score)):
        while excess[start] > 0 and not source[start]:
            came: dict[int, list | None] = {start: None}
            queue, goal = deque([start]), -1
            while queue and goal < 0:
                a = queue.popleft()
                for arc in near[a]:
                    b = arc[0]
                    if arc[1] > 0 and b not in came and not source[b]:
                        came[b] = arc
                        if excess[b] < 0:
                            goal = b
                            break
                        queue.append(b)
            if goal < 0:
                for a in came:
                    source[a] = True
                break
            flow, path, b = min(excess[start], -excess[goal]), [], goal
            while came[b] is not None:
                arc = came[b]
                path.append(arc)
                flow = min(flow, arc[1])
                b = arc[2][0]
            for arc in path:
                arc[1] -= flow
                arc[2][1] += flow
            excess[start] -= flow
            excess[goal] += flow
    return source


class Page:
    """Non-blank lines of a text with their number, kind and side of the cut."""

    __slots__ = ("numbers", "lines", "kinds", "frame")

    def __init__(self, text: str | None, title: str | None, kind_of: Classifier):
        self.numbers, self.lines, self.kinds = [], [], []
        for number, raw in enumerate((text or "").split("\n"), 1):
            line = raw.strip()
            if line:
                self.numbers.append(number)
                self.lines.append(line)
                self.kinds.append(kind_of(line))
        self.frame = label_lines(self.lines, self.kinds, title)

    def body(self) -> list[int]:
        return [i for i, out in enumerate(self.frame) if not out]


def message_scores(kinds: list[int], scripts: list[bool]) -> dict[int, int]:
    """Scores of server and browser messages by their place.

    Beside content of any kind a request to allow scripts is a notice of the frame, and so is another
    message above the first line of real content, below the last one, or between two lines of
    the frame; elsewhere it stands for content.  On a page without content it is the main body.
    """
    if MESSAGE not in kinds:
        return {}
    own = sum(k not in (FRAME, RELATED, MESSAGE, HEADING, TITLE) for k in kinds)
    content = [i for i, k in enumerate(kinds) if k in (PROSE, LIST, TABLE)]
    first = min(content[0], next((i for i, k in enumerate(kinds) if k == HEADING), content[0])) if content else 0
    last = len(kinds) - 1
    out = {}
    for i, kind in enumerate(kinds):
        if kind != MESSAGE:
            continue
        if own > 1 and scripts[i] or content and (i < first or i > content[-1] and i < last):
            out[i] = 300
        elif content and 0 < i < last and kinds[i - 1] in (FRAME, RELATED) and kinds[i + 1] in (FRAME, RELATED):
            out[i] = 100
        else:
            out[i] = SCORES[MESSAGE]
    return out


#: Words of notices that a page needs scripts or is still loading.
_SCRIPTS = re.compile(r"script|skript|loading|wird geladen|chargement|cargando|caricamento", re.I)


def label_lines(lines: list[str], kinds: list[int], title: str | None) -> list[bool]:
    """True for each line outside the main body."""
    if not any(k in (FRAME, RELATED, MESSAGE) for k in kinds):
        return [False] * len(lines)
    score = [SCORES[k] for k in kinds]
    kinds = list(kinds)
    for i, s in message_scores(kinds, [k == MESSAGE and _SCRIPTS.search(x) is not None for k, x in zip(kinds, lines, strict=True)]).items():
        score[i] = s
    for i in own_titles(lines, title):
        score[i], kinds[i] = -600, HEADING
    edges = box_edges(kinds, score)
    return minimum_cut(score, edges)


def own_titles(lines: list[str], title: str | None) -> list[int]:
    """Lines that repeat the title of their document."""
    name = " ".join((title or "").lower().split())
    return [i for i, x in enumerate(lines) if name and len(x) < len(name) + 6 and " ".join(x.lstrip("# ").lower().split()) == name]


def box_edges(kinds: list[int], score: list[int]) -> list[tuple[int, int, int]]:
    """Smoothness edges of a page, those of entries of boxes of references being stronger; the scores of entries are set in place."""
    entries = titles = 0
    place = [0] * len(kinds)  # from 1 in a box
    for i, kind in enumerate(kinds):
        entries = 1 if kind == RELATED else entries + 1 if entries and kind == TITLE else 0
        place[i] = entries - 1 if entries > 1 else 0
        titles += kind == TITLE and not place[i]
    fall = LISTED_FALL if titles > 5 else ENTRY_FALL
    edges = []
    for i in range(len(kinds)):
        k = place[i]
        if k:
            score[i] = ENTRY - fall * (k - 1)
        if i:
            edges.append((i - 1, i, max(ADJACENT, SAME_BLOCK - EDGE_FALL * (k - 1)) if k else ADJACENT))
    return edges
