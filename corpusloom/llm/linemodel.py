"""A fitted classifier of the lines of pages: log-odds that a line belongs to the frame.

Every line is a set of binary features, held as the bits of one integer: its shape, the
phrase list it meets if any, its place in the page, and how many documents of its site hold
it or its beginning.  Weights are fitted by logistic regression.  There are no labelled lines, so
labels come from seeds: lines that meet a phrase of the frame against lines in the shape
of content.  Every example is also given without its phrase bits, with more weight, and without its counts,
with less, hence what the seeds have in common is learned, and lines that meet no phrase are told by it.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from corpusloom.llm.lexicon import has_marks, has_note, skeleton
from corpusloom.llm.page import (
    _MARK, _SCRIPTS, _SEPARATED, _URL, FILLER, FRAME, HEADING, LIST, MESSAGE, OTHER, PROSE, RELATED, TABLE, TITLE, Classifier, box_edges,
    is_ended, message_scores, minimum_cut, own_titles, parted, phrase_kind, shape_kind,
)
from corpusloom.llm.residue import has_placeholder, is_latin_filler
from corpusloom.llm.spam import FUNCTION_WORDS

#: Bits of a line.
SHAPES = {HEADING: 0, PROSE: 1, LIST: 2, TABLE: 3, TITLE: 4, OTHER: 5}
PHRASES = {FRAME: 6, RELATED: 7, MESSAGE: 8, FILLER: 9}
LENGTHS = 10  # eight classes of powers of two
ENDED, PARTED, COLON, NUMBERS, DATED, LINKED, FUNCTION, MARKED, FEW_WORDS, FEW_LETTERS = range(18, 28)
BEFORE, AFTER, TOP, BOTTOM, SHORT_ABOVE, SHORT_BELOW, NO_PROSE = range(28, 35)
OWN_TITLE, SCRIPT, RESIDUE = 35, 36, 37  # without weights
COUNTS, SHARES, HEADS = 38, 43, 47  # five classes of documents of the site, four of their share, three of the line's beginning
N_BITS = 50

PHRASE_BITS = sum(1 << b for b in PHRASES.values())
COUNT_BITS = sum(1 << b for b in range(COUNTS, N_BITS))
STRUCTURE_BITS = 1 << OWN_TITLE | 1 << SCRIPT | 1 << RESIDUE
#: Lines of another shape than content that stand in so many documents of their site are no examples.
RECURRENT_BITS = sum(1 << COUNTS + i for i in (2, 3, 4))

#: Classes of a hash by which documents are sampled for the fit.
PLACES = 1 << 30

#: Log-odds are cut here (in hundredths), and a line in a place that the structure of the page decides gets these.
LIMIT, TITLE_SCORE, RESIDUE_SCORE = 600, -600, -500
#: A line counts as frame from these log-odds on, which are odds of six to five.
MARGIN = 20

_DATE = re.compile(r"0[./-]0[./-]0|\(c\)")  # of a skeleton
_NO_LETTERS = {i: None for i in range(128) if not chr(i).isalpha()}


def document_class(n: int, of: int) -> int:
    """Bits of a line, or beginning, that stands in n of the documents of a site."""
    if n < 2:
        return 0
    bits = 1 << COUNTS + (0 if n < 3 else 1 if n < 5 else 2 if n < 10 else 3 if n < 30 else 4)
    return bits | sum(1 << SHARES + i for i, part in enumerate((0.01, 0.05, 0.2, 0.5)) if n >= part * of)


def head_class(n: int, of: int) -> int:
    return (1 << HEADS if n >= 3 else 0) | (1 << HEADS + 1 if n >= 10 else 0) | (1 << HEADS + 2 if n >= 3 and n >= 0.05 * of else 0)


class LineReader:
    """Bits and keys of single lines, with a bounded memory of short ones."""

    def __init__(self, bound: int = 40_000):
        self.bound, self.memory = bound, {}

    def __call__(self, line: str) -> tuple[int, int, int]:
        """(bits, hash of the line, hash of its beginning or 0)."""
        known = self.memory.get(line)
        if known is None:
            known = self._read(line)
            if len(line) <= Classifier.KEPT:
                if len(self.memory) >= self.bound:
                    self.memory.clear()
                self.memory[line] = known
        return known

    def _read(self, line: str) -> tuple[int, int, int]:
        bits = 1 << SHAPES[shape_kind(line)]
        key, parts = skeleton(line), parted(line)
        phrase = phrase_kind(line, key, parts) if line[0] != "#" else None
        if phrase in PHRASES:
            bits |= 1 << PHRASES[phrase]
            if phrase == MESSAGE and _SCRIPTS.search(line):
                bits |= 1 << SCRIPT
        if phrase == FILLER or has_placeholder(line) or has_marks(key) and (has_note(line) or is_latin_filler(line)):
            bits |= 1 << RESIDUE
        bits |= 1 << LENGTHS + min(7, max(0, len(line).bit_length() - 4))
        words, letters = key.split(), len(key.translate(_NO_LETTERS))
        head, colon, _ = line.partition(":")
        led = bool(colon) and len(head) < 30
        bits |= is_ended(line) << ENDED | (len(parts) > 1) << PARTED | led << COLON
        bits |= ("0" in key and sum(map(line.count, "0123456789")) * 10 > 3 * len(line)) << NUMBERS
        bits |= ("©" in line or "0" in key and bool(_DATE.search(key))) << DATED
        bits |= (bool(_URL.search(line)) or "@" in line) << LINKED | (sum(map(FUNCTION_WORDS.__contains__, words)) * 5 >= len(words) > 0) << FUNCTION
        bits |= bool(_MARK.match(line)) << MARKED | (len(words) <= 3) << FEW_WORDS | (letters * 2 < len(line)) << FEW_LETTERS
        own = key.lstrip("#-*> ")
        first = skeleton(parts[0]) if len(parts) > 1 else skeleton(head) if led else ""
        return bits, _hash(own) if own else 0, _hash("\x00" + first) if len(first) > 1 else 0


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def page_bits(lines: list[str], title: str | None, read: LineReader) -> tuple[list[int], list[int], list[int]]:
    """Bits, keys and keys of beginnings of the lines of a page, without counts."""
    made = [read(x) for x in lines]
    bits = [m[0] for m in made]
    kinds = [kind_of_bits(b) for b in bits]
    n = len(lines)
    content = [i for i, k in enumerate(kinds) if k in (PROSE, HEADING, TABLE)]
    first, last = (content[0], content[-1]) if content else (n, n)
    short = [k in (OTHER, TITLE, FRAME, RELATED, MESSAGE) for k in kinds]
    whole = (PROSE not in kinds) << NO_PROSE
    for i in range(n):
        b = whole | (i < first) << BEFORE | (i > last) << AFTER | (i < 3) << TOP | (n - i <= 3) << BOTTOM
        b |= (i > 0 and short[i - 1]) << SHORT_ABOVE | (i + 1 < n and short[i + 1]) << SHORT_BELOW
        bits[i] |= b
    for i in own_titles(lines, title):
        bits[i] |= 1 << OWN_TITLE
    return bits, [m[1] for m in made], [m[2] for m in made]


def kind_of_bits(bits: int) -> int:
    """Kind of a line: that of its phrase, else that of its shape."""
    for kind, b in PHRASES.items():
        if bits >> b & 1:
            return kind
    return next(kind for kind, b in SHAPES.items() if bits >> b & 1)


def examples(masks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks, labels and weights for the fit: seeds of the frame, and lines in the shape of content or that stand in no other document."""
    has = lambda bits: (masks & bits) != 0
    frame = has(1 << PHRASES[FRAME] | 1 << PHRASES[RELATED])
    loose = has(1 << SHAPES[OTHER] | 1 << SHAPES[TITLE])
    content = ~has(PHRASE_BITS) & (~loose | ~has(RECURRENT_BITS)) | has(1 << OWN_TITLE)
    used = frame | content
    m, y, w = masks[used], (frame & ~has(1 << OWN_TITLE))[used], counts[used].astype(float)
    views = ((m, 1.0), (m & ~PHRASE_BITS, 2.0), (m & ~COUNT_BITS, 0.1))
    return np.concatenate([v for v, _ in views]), np.tile(y, len(views)).astype(float), np.concatenate([w * part for _, part in views])


def matrix(masks: np.ndarray) -> np.ndarray:
    """Features as columns, and a constant one."""
    x = (masks[:, None] >> np.arange(N_BITS)[None, :] & 1).astype(float)
    x[:, [OWN_TITLE, SCRIPT, RESIDUE]] = 0.0
    return np.concatenate([x, np.ones((len(masks), 1))], axis=1)


def fit(masks: np.ndarray, counts: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights by Newton steps of the penalised logistic likelihood; zeros if one of both labels is missing."""
    m, y, w = examples(np.asarray(masks, np.int64), np.asarray(counts))
    beta = np.zeros(N_BITS + 1)
    if not len(m) or y.min() == y.max():
        return beta
    x = matrix(m)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - penalty * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-4:
            break
    return beta


class Scorer:
    """Scores of lines by their bits, as capacities of the cut."""

    def __init__(self, weights: np.ndarray):
        self.weights = [round(100 * float(w)) for w in weights]
        self.memory: dict[int, int] = {}

    def __call__(self, bits: int) -> int:
        score = self.memory.get(bits)
        if score is None:
            if len(self.memory) > 200_000:
                self.memory.clear()
            score = self.weights[N_BITS] - MARGIN + sum(w for b, w in enumerate(self.weights[:N_BITS]) if bits >> b & 1)
            score = self.memory[bits] = max(-LIMIT, min(LIMIT, score))
        return score

    def label(self, bits: list[int]) -> list[bool]:
        """True for each line outside the main body: the least cut over all lines of a page."""
        kinds = [kind_of_bits(b) for b in bits]
        score = [self(b) for b in bits]
        if max(score, default=0) <= 0:
            return [False] * len(bits)
        for i, s in message_scores(kinds, [bool(b >> SCRIPT & 1) for b in bits]).items():
            score[i] = s
        for i, b in enumerate(bits):
            if b >> OWN_TITLE & 1:
                score[i], kinds[i] = TITLE_SCORE, HEADING
            elif b >> RESIDUE & 1:  # stands for content
                score[i] = RESIDUE_SCORE
        return minimum_cut(score, box_edges(kinds, score))
