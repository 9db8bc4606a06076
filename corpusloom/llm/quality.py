"""Problem 4: per-document text quality statistics."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import columns, map_rows, spread
from corpusloom.llm.mojibake import Repairer, repaired
from corpusloom.llm.page import Classifier, Page
from corpusloom.llm.residue import CANDIDATE, candidate_hashes, page_signs, recurring
from corpusloom.llm.spam import is_spam
from corpusloom.storage import checkpointed

#: A text is cut into chunks of so many characters; their counts are added up by a tree.
CHUNK = 1 << 16

_SPACE = re.compile(r"\s+")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'’\"()-]")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"\d")
_ENDS = (".", "!", "?", "…", ":", ";", "»", "”", '"')


class Counts(NamedTuple):
    """Partial counts of a stretch of text; ``+`` of neighbours is associative.

    A word or a line may go on in the next stretch.  ``head`` and ``tail`` hold the
    first KEEP letters before the first and after the last white space, and ``head_n`` and ``tail_n``
    how many there are, so that the word across a seam is counted once; ``one`` marks a stretch
    without any white space, whose head is all of it.  Lines are counted at their newline, hence ``last`` and ``blank``
    hold the end and the emptiness of the open last line.
    """

    chars: int = 0
    words: int = 0
    word_chars: int = 0
    symbols: int = 0
    letters: int = 0
    digits: int = 0
    common: int = 0
    lines: int = 0
    ended: int = 0
    one: bool = True
    head: str = ""
    head_n: int = 0
    tail: str = ""
    tail_n: int = 0
    first_line: str = ""
    last_line: str = ""
    newline: bool = False


#: Letters of an open word that are kept; a longer one is no common word, so only its length counts.
KEEP = 64


def _word(text: str, common: frozenset[str], n: int = 0) -> int:
    return n <= KEEP and text.lower().strip(".,;:!?'’\"()«»“”-") in common


def _line(text: str) -> tuple[int, int]:
    stripped = text.strip()
    return (1, int(stripped.endswith(_ENDS))) if stripped else (0, 0)


def count(text: str, common: frozenset[str]) -> Counts:
    """Counts of one chunk."""
    parts = _SPACE.split(text)
    inner = parts[1:-1]
    rows = text.split("\n")
    done = [_line(r) for r in rows[1:-1]]
    letters = len(_LETTER.findall(text))
    return Counts(
        len(text), len(inner), sum(map(len, inner)), len(_SYMBOL.findall(text)), letters, len(_DIGIT.findall(text)),
        sum(_word(w, common) for w in inner), sum(a for a, _ in done), sum(b for _, b in done),
        len(parts) == 1, parts[0][:KEEP], len(parts[0]), parts[-1][:KEEP] if len(parts) > 1 else "", len(parts[-1]) if len(parts) > 1 else 0, _edge(rows[0]), _edge(rows[-1]) if len(rows) > 1 else "", len(rows) > 1,
    )


def _edge(row: str) -> str:
    """What later counts need of an open line: whether it is blank and how it ends."""
    row = row.rstrip(" \t\r") if row.strip() else ""
    return row[-1:]


def merge(a: Counts, b: Counts, common: frozenset[str]) -> Counts:
    """Counts of a stretch and the one after it, with the word and the line across the seam put together."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    extra = (0, 0, 0)
    front, back = ((a.head + b.head)[:KEEP], a.head_n + b.head_n), ((a.tail + b.head)[:KEEP], a.tail_n + b.head_n)
    if a.one and b.one:
        one, head, tail = True, front, ("", 0)
    elif a.one:
        one, head, tail = False, front, (b.tail, b.tail_n)
    elif b.one:
        one, head, tail = False, (a.head, a.head_n), back
    else:
        one, head, tail = False, (a.head, a.head_n), (b.tail, b.tail_n)
        extra = (1, back[1], _word(a.tail + b.head, common, back[1])) if back[1] else extra
    open_a = a.last_line if a.newline else a.first_line
    seam_line = b.first_line or open_a  # the end of the line across the seam
    lines = ended = 0
    if a.newline and b.newline:
        lines, ended = _line(seam_line)
        first, last = a.first_line, b.last_line
    elif b.newline:
        first, last = seam_line, b.last_line
    elif a.newline:
        first, last = a.first_line, seam_line
    else:
        first, last = seam_line, ""
    return Counts(
        a.chars + b.chars, a.words + b.words + extra[0], a.word_chars + b.word_chars + extra[1], a.symbols + b.symbols,
        a.letters + b.letters, a.digits + b.digits, a.common + b.common + extra[2], a.lines + b.lines + lines, a.ended + b.ended + ended,
        one, *head, *tail, first, last, a.newline or b.newline,
    )


def close(c: Counts, common: frozenset[str]) -> Counts:
    """Final counts: what stands at both ends of the text is no longer open."""
    ends = [w for w in ((c.head, c.head_n), (c.tail, c.tail_n)) if w[1]]
    rows = [_line(c.first_line), _line(c.last_line) if c.newline else (0, 0)]
    return c._replace(
        words=c.words + len(ends), word_chars=c.word_chars + sum(n for _, n in ends), common=c.common + sum(_word(w, common, n) for w, n in ends),
        lines=c.lines + sum(a for a, _ in rows), ended=c.ended + sum(b for _, b in rows),
    )


def tree(parts: list, known: object, join: Callable = merge, none: NamedTuple = Counts()):  # noqa: B008
    """Merge neighbours pairwise until one is left; ``known`` tells words to ``join``, ``none`` is the count of nothing."""
    while len(parts) > 1:
        parts = [reduce(lambda a, b: join(a, b, known), parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0] if parts else none


def text_counts(text: str, common: frozenset[str], chunk: int = CHUNK) -> Counts:
    return close(tree([count(text[i : i + chunk], common) for i in range(0, len(text), chunk)], common), common)


_STATISTICS = ["n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "ended_line_ratio", "common_word_ratio", "n_lines", "prose"]


def quality_statistics(
    docs: DataFrame, common_words: Iterable[str], id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """(id, n_words, mean_word_length, symbol_ratio, digit_ratio, ended_line_ratio, common_word_ratio, n_lines, prose) per document.

    A text is cut into chunks whose partial counts are associative, with the open word
    and the open line at both ends as boundary state; a tree merges them.  Texts of one chunk, which are most, are
    counted where they stand.  The chunks of longer ones are rows of their own, spread over all tasks; their partial counts,
    some 200 bytes each, are brought together by document and merged.  No task holds more
    of a text than it was read with.  ``common_words`` is a small fixed list.  Null and empty texts give
    zero counts and null ratios; repeated rows and null ids are kept.
    """
    common = frozenset(w.lower() for w in common_words if w)
    types = dict(zip(_STATISTICS, [pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.bool_()], strict=True))
    ddl = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'double'}" for n, t in types.items())
    fields = [("id", pa.int64()), *types.items()]
    partial = [("c" + n, pa.string() if isinstance(v, str) else pa.bool_() if isinstance(v, bool) else pa.int64()) for n, v in zip(Counts._fields, Counts(), strict=True)]
    parts_ddl = ", ".join(f"{n} {'string' if t == pa.string() else 'boolean' if t == pa.bool_() else 'bigint'}" for n, t in partial)

    rows = spread(columns(docs, id=id_col, text=text_col))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = map_rows(rows.where(~long), "id bigint, " + ddl, lambda: lambda key, text: [(key, *_ratios(text_counts(text or "", common, chunk)))], fields)
    starts = F.sequence(F.lit(0), ((F.length("text") - 1) / chunk).cast("int"))
    cut = rows.where(long).withColumn("uid", F.expr("uuid()")).select("id", "uid", F.explode(starts).alias("part"), "text")
    cut = cut.select("id", "uid", "part", F.substring("text", F.col("part") * chunk + 1, F.lit(chunk)).alias("text"))
    # the identifiers are random, so the chunks are written before anything is joined by them
    chunks = checkpointed(cut).repartition(rows.sparkSession.sparkContext.defaultParallelism, "uid", "part")
    made = map_rows(
        chunks, f"id bigint, uid string, part int, {parts_ddl}", lambda: lambda key, uid, part, text: [(key, uid, part, *count(text, common))],
        [("id", pa.int64()), ("uid", pa.string()), ("part", pa.int32()), *partial],
    )
    listed = made.groupBy("id", "uid").agg(F.sort_array(F.collect_list(F.struct("part", *(n for n, _ in partial)))).alias("parts"))

    def merged():
        def one(key, parts):
            return [(key, *_ratios(close(tree([Counts(*list(p.values())[1:]) for p in parts], common), common)))]

        return one

    return short.union(map_rows(listed.select("id", "parts"), "id bigint, " + ddl, merged, fields)).withColumnRenamed("id", id_col)


def _ratios(c: Counts) -> tuple:
    share = lambda n, of: n / of if of else None
    common_share, ended, symbols = share(c.common, c.words), share(c.ended, c.lines), share(c.symbols, c.chars)
    prose = bool(c.words >= 20 and common_share >= 0.12 and ended >= 0.3 and symbols <= 0.1)
    return c.words, share(c.word_chars, c.words), symbols, share(c.digits, c.chars), ended, common_share, c.lines, prose


# ---- kinds of documents that are no prose ----

_BULLET = re.compile(r"^(?:[-–*•›»>+]|\d{1,3}[.)]|[a-z]\))\s+")
_PAIR = re.compile(r"^\S+(?: \S+){0,4} ?[,:–-] \S+(?: \S+){0,5}$")
_CELLS = re.compile(r"[\s;|]+")
_GAPS = re.compile(r"\s{2,}")
_NUMBER = re.compile(r"^[\d.,%€$£()/+-]*\d[\d.,%€$£()/+-]*$")
_READABLE = re.compile(r"^[(«“\"'¿¡]*[^\W\d_]+(?:[’'-][^\W\d_]+)*[.,;:!?)»”\"'…]*$")


class Readable:
    """Words whose letter triples occur in a bounded sample of clean text and its word list."""

    def __init__(self, sample: Iterable[str]):
        self.known: set[str] = set()
        for text in sample:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                word = f"^{word}$"
                self.known.update(word[i : i + 3] for i in range(len(word) - 2))
        self.memory: dict[str, bool] = {}

    def __call__(self, token: str) -> bool:
        known = self.memory.get(token)
        if known is None:
            if len(self.memory) > 100_000:
                self.memory.clear()
            known = self.memory[token] = self._test(token)
        return known

    def _test(self, token: str) -> bool:
        if not _READABLE.match(token):
            return False
        letters = re.findall(r"[^\W\d_]+", token.lower())
        hits = total = 0
        for part in letters:
            word = f"^{part}$"
            total += len(word) - 2
            hits += sum(word[i : i + 3] in self.known for i in range(len(word) - 2))
        return hits * 10 >= total * 6 and sum(map(len, letters)) > 1


def is_row(line: str) -> bool:
    """A line of at least three cells, or of two of which one is a number."""
    for cells in (line.strip("|").split("|"), line.split("\t"), line.split(";"), _GAPS.split(line)):
        if len(cells) >= 3 or len(cells) == 2 and any(_NUMBER.match(c.strip()) for c in cells):
            return True
    return False


class Shapes(NamedTuple):
    """Partial counts of the shapes of lines; :func:`join_shapes` of neighbours is associative.

    ``text`` and ``headings`` hold lines, rows, entries, sentences, characters of prose and
    characters of the lines that are no headings and of those that are.  Tokens end at
    line ends at the latest, so they are counted with their line.  A line may go on in the
    next stretch: ``head`` and ``tail`` are the open first and last one, which are kept whole
    because a row is known by all its cells; without a newline the stretch is all head.
    """

    text: tuple[int, ...] = (0,) * 6
    headings: tuple[int, ...] = (0,) * 6
    tokens: int = 0
    token_chars: int = 0
    readable: int = 0
    readable_chars: int = 0
    numbers: int = 0
    newline: bool = False
    head: str = ""
    tail: str = ""


def _shape(line: str) -> tuple[int, int, int, int]:
    """Whether a line is a row, an entry or a sentence, and its characters of prose."""
    if is_row(line):
        return 1, 0, 0, 0
    if len(line) <= 90 and (_BULLET.match(line) or _PAIR.match(line) and line[-1] not in ".!?" or line[-1] not in ".!?:…" and line.count(" ") <= 9):
        return 0, 1, 0, 0
    return (0, 0, 1, len(line)) if line[-1] in ".!?" and len(line) > 30 else (0, 0, 0, 0)


def _with_lines(c: Shapes, lines: Iterable[str], readable: Readable) -> Shapes:
    """Counts with whole lines added; blank ones count for nothing."""
    sums = ([*c.text], [*c.headings])
    tokens, token_chars, known, known_chars, numbers = c[2:7]
    for line in lines:
        if not line:
            continue
        own = sums[line[0] == "#"]
        row, entry, sentence, prose = _shape(line)
        own[0] += 1
        own[1] += row
        own[2] += entry
        own[3] += sentence
        own[4] += prose
        own[5] += len(line)
        for token in _CELLS.split(line):
            if token:
                tokens += 1
                token_chars += len(token)
                if readable(token):
                    known += 1
                    known_chars += len(token)
                elif _NUMBER.match(token):
                    numbers += 1
    return Shapes(tuple(sums[0]), tuple(sums[1]), tokens, token_chars, known, known_chars, numbers, c.newline, c.head, c.tail)


def count_shapes(text: str, readable: Readable) -> Shapes:
    """Counts of one chunk of a body of stripped lines."""
    rows = text.split("\n")
    if len(rows) == 1:
        return Shapes(head=text)
    return _with_lines(Shapes(newline=True, head=rows[0], tail=rows[-1]), rows[1:-1], readable)


def join_shapes(a: Shapes, b: Shapes, readable: Readable) -> Shapes:
    """Counts of a stretch and the one after it, with the line across the seam put together."""
    text, headings = (tuple(map(sum, zip(x, y, strict=True))) for x, y in zip(a[:2], b[:2], strict=True))
    sums = (text, headings, *(x + y for x, y in zip(a[2:7], b[2:7], strict=True)))
    if not a.newline:
        return Shapes(*sums, b.newline, a.head + b.head, b.tail)
    if not b.newline:
        return Shapes(*sums, True, a.head, a.tail + b.head)
    return _with_lines(Shapes(*sums, True, a.head, b.tail), [a.tail + b.head], readable)


def body_shapes(lines: list[str], readable: Readable, chunk: int = CHUNK) -> Shapes:
    """Final counts of the lines of a body, by chunks and a tree over them."""
    text = "\n".join(lines)
    c = tree([count_shapes(text[i : i + chunk], readable) for i in range(0, len(text), chunk)], readable, join_shapes, Shapes())
    return _with_lines(c, (c.head, c.tail), readable)


def kind_of_shapes(c: Shapes) -> str | None:
    """Kind by the ratios of the merged counts; headings decide only where there is nothing else."""
    total, rows, entries, sentences, prose, chars = c.text if c.text[0] else c.headings
    if not total:
        return None
    share = c.readable_chars / max(1, c.token_chars)
    if rows * 2 > total and (c.readable + c.numbers) * 3 >= c.tokens:
        return "table"
    if prose * 2 > chars and (sentences or prose) and share >= 0.35:
        return None
    if share < 0.35:
        return "junk"
    return "list" if entries * 2 > total else None


def page_kind(page: Page, readable: Readable, chunk: int = CHUNK) -> str | None:
    """``list``, ``table`` or ``junk``, or None for prose and for pages without a body."""
    return kind_of_shapes(body_shapes([page.lines[i] for i in page.body()], readable, chunk))


def document_kinds(
    docs: DataFrame, sample: Iterable[str], id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", source_col: str = "source",
    chunk: int = CHUNK,
) -> DataFrame:
    """(id, kind): documents whose main body is a list, a table or junk.

    The body is cut into chunks whose counts of shapes are associative, with the open line at
    both ends as boundary state; a tree merges them and the ratios decide.
    ``sample`` is a bounded sample of clean text and words that tells readable letter
    sequences.  Cases of residue and spam are left out; their signs are read off the same
    page in the same pass, and only candidate lines of residue, which recurrence across
    sources decides about, and the few rows found are shuffled.  Null, empty and
    all-frame texts give no row; repeated rows give one row; null ids are left out.
    """
    texts = list(sample)

    def make():
        kind_of, readable, repairer = Classifier(), Readable(texts), Repairer()

        def one(key, text, title, source):
            if key is None or not text:
                return []
            page = Page(repaired(text, repairer), title, kind_of)
            signs = page_signs(page)
            if any(sign != CANDIDATE for sign, _ in signs):
                return []
            rows = [(key, None, source, h) for h in candidate_hashes(signs)]
            kind = page_kind(page, readable, chunk)
            if kind is not None and not is_spam(page, readable):
                rows.append((key, kind, None, None))
            return rows

        return one

    fields = [("id", pa.int64()), ("kind", pa.string()), ("source", pa.string()), ("hash", pa.int64())]
    rows = spread(columns(docs, id=id_col, text=text_col, title=title_col, source=source_col))
    made = checkpointed(map_rows(rows, "id bigint, kind string, source string, hash bigint", make, fields))
    cases = recurring(made.where("hash IS NOT NULL").select("id", "source", "hash"))
    return made.where("hash IS NULL").select("id", "kind").distinct().join(cases, "id", "left_anti").withColumnRenamed("id", id_col)
