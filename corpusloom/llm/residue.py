"""Problem 2: template residue and error-page text."""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import columns, map_rows, salted_semi, spread
from corpusloom.llm.lexicon import FIELDS, LATIN_FILLER, has_latin, has_note, skeleton
from corpusloom.llm.mojibake import Repairer, repaired
from corpusloom.llm.page import _SENTENCES, FILLER, HEADING, MESSAGE, Classifier, Page
from corpusloom.storage import checkpointed

#: A name between the brackets of common template engines.
_NAME = r"\s*[^\W\d][\w.]{2,40}\s*"
_PLACEHOLDER = re.compile(
    rf"\{{\{{{_NAME}\}}\}}|[$#]\{{{_NAME}\}}|\[\[{_NAME}\]\]|%%{_NAME}%%|@@{_NAME}@@|<%=?{_NAME}%>|\{{%{_NAME}%\}}"
    rf"|(?<![\w$])\$[A-Z][A-Z0-9_]{{2,}}\$(?![\w$])|(?<![\w])__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?![\w])"
    rf"|\[(?i:insert|enter|add|your|our|company|client|customer|ins[ée]rer|votre|nom|ihre?|name|hier|inserte|insertar|su|nombre|inserire|inserisci|il tuo|nome) [^\W\d_][^\[\]\n|]{{2,40}}\](?![(\[])"
    rf"|(?<![\w$#{{%`])\{{[^\W\d][\w.]{{2,40}}\}}(?!\}})|\[[^\W\d][\w.]{{2,40}}\](?![(\[])"
)
#: No placeholder is without one of these.
_OPENERS = ("{", "[", "%%", "@@", "<%", "$", "__")

#: A placeholder that a text quotes as its example stands between such marks.
_QUOTED_BEFORE, _QUOTED_AFTER = re.compile(r"[`“«\"‘„'\ufffd]\s*$"), re.compile(r"^\s*[`”»\"’“'\ufffd]")

_MASKS = (
    (re.compile(r"https?://\S+|www\.\S+"), "<url>"),
    (re.compile(r"\S+@\S+\.\w+"), "<mail>"),
    (re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}"), "<date>"),
    (re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}(?:-[0-9a-f]+)*\b"), "<id>"),
)

_LETTERS = re.compile(r"[^\W\d_]{3}")

#: What a line says about its document.
RULE, PHRASE, CANDIDATE = 2, 1, 0

#: A line that no rule knows must stand in so many sources, each time as all there is of a page.
MIN_SOURCES = 3


def message_key(line: str) -> str:
    """A line with addresses, dates, codes and numbers masked, lower-cased, single-spaced."""
    key = line.lower()
    for pattern, mask in _MASKS:
        key = pattern.sub(mask, key)
    return skeleton(key)


def has_placeholder(line: str) -> bool:
    """An unfilled placeholder that is not quoted as an example."""
    if not any(x in line for x in _OPENERS):
        return False
    for m in _PLACEHOLDER.finditer(line):
        if m.group()[0] in "$_" and m.group()[1] != "{" and m.group() != m.group().upper():
            continue
        name = m.group().strip("[]").lower()
        if " " not in name.strip() and m.group()[:1] == "[" != m.group()[1:2] and "." not in name and "_" not in name and name not in FIELDS:
            continue
        if not (_QUOTED_BEFORE.search(line[max(0, m.start() - 3) : m.start()]) and _QUOTED_AFTER.search(line[m.end() : m.end() + 3])):
            return True
    return False


def is_latin_filler(line: str) -> bool:
    words = re.findall(r"[^\W\d_]+", line.lower())
    return len(words) >= 5 and sum(w in LATIN_FILLER for w in words) * 10 >= len(words) * 7


#: A body of at most so many lines besides its headings may be a message as a whole.
BARE_LINES = 3


def page_signs(page: Page) -> list[tuple[int, str]]:
    """(sign, key) of the lines of the main body that may be residue.

    Placeholders, notes to the author, fillers and known messages count wherever they stand in the body.  A body of few lines, none of more than two sentences, may be an
    unknown message: its lines are candidates, about which recurrence across sources decides.
    Each rule is tried on the whole body first, line by line only where it can hold.
    """
    at = page.body()
    body = "\n".join([page.lines[i] for i in at])
    low = body.lower()
    placeholders = any(x in body for x in _OPENERS) and _PLACEHOLDER.search(body) is not None
    notes, latin = has_note(body), has_latin(low)
    own = [i for i in at if page.kinds[i] != HEADING]
    bare = len(own) <= BARE_LINES and all(len(_SENTENCES.split(page.lines[i])) <= 2 for i in own)
    signs = []
    for i in at:
        line, kind = page.lines[i], page.kinds[i]
        if kind == MESSAGE:
            signs.append((PHRASE, message_key(line)))
        elif kind == FILLER or placeholders and has_placeholder(line) or notes and has_note(line) or latin and is_latin_filler(line):
            signs.append((RULE, message_key(line)))
        elif bare and kind != HEADING and _LETTERS.search(line):
            signs.append((CANDIDATE, message_key(line)))
    return signs


def residue_signs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", source_col: str = "source"
) -> DataFrame:
    """(id, source, sign, key): signs of residue in the main body of each document, before any grouping."""

    def make():
        kind_of, repairer = Classifier(), Repairer()

        def one(key, text, title, source):
            if not text:
                return []
            return [(key, source, sign, k) for sign, k in dict.fromkeys(page_signs(Page(repaired(text, repairer), title, kind_of)))]

        return one

    rows = spread(columns(docs, id=id_col, text=text_col, title=title_col, source=source_col))
    fields = [("id", pa.int64()), ("source", pa.string()), ("sign", pa.int32()), ("key", pa.string())]
    return map_rows(rows, "id bigint, source string, sign int, key string", make, fields)


def residue_messages(signs: DataFrame) -> DataFrame:
    """(message, n_sources, n_docs, sign): masked messages by exact hash, counted across sources.

    Both counts are two-level aggregates with partial sums, so a message that stands
    in a third of all documents is added up before the shuffle.
    """
    keyed = signs.withColumn("hash", F.xxhash64("key"))
    by_source = keyed.groupBy("hash", "source").agg(F.first("key").alias("key"), F.max("sign").alias("sign"), F.count(F.lit(1)).alias("n"))
    return by_source.groupBy("hash").agg(
        F.first("key").alias("message"), F.count("source").alias("n_sources"), F.sum("n").alias("n_docs"), F.max("sign").alias("sign")
    )


def residue_groups(kept: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """(hash) of the groups of equal masked lines (id, source, sign, hash) that are residue: those that a placeholder or phrase
    rule knows, and those that no rule knows but that are all there is of pages of enough sources."""
    by_source = kept.groupBy("hash", "source").agg(F.max("sign").alias("sign"))
    groups = by_source.groupBy("hash").agg(F.count("source").alias("n_sources"), F.max("sign").alias("sign"))
    return groups.where(f"sign > {CANDIDATE} OR n_sources >= {min_sources}").select("hash")


def residue_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    title_col: str = "title",
    source_col: str = "source",
    min_sources: int = MIN_SOURCES,
) -> DataFrame:
    """(id): documents in whose main body residue stands, in all of it or in a part.

    Lines of the body that may be residue are masked and hashed, groups of equal hashes are counted across
    sources and classified by :func:`residue_groups`, and a document is a case if one of its lines is of
    such a group.  Only these few lines are shuffled.  Messages in the frame of a page, notices about scripts beside
    content and placeholders quoted as an example do not count.  Null or empty text is no case, a
    null source counts as no source, repeated rows give one row, null ids are left out.
    """
    signs = residue_signs(docs, id_col, text_col, title_col, source_col).where("id IS NOT NULL")
    kept = checkpointed(signs.select("id", "source", "sign", F.xxhash64("key").alias("hash")))  # few rows, used twice
    found = salted_semi(kept.select("id", "hash"), residue_groups(kept, min_sources), ["hash"], "id")
    return found.select("id").distinct().withColumnRenamed("id", id_col)


def recurring(candidates: DataFrame, min_sources: int = MIN_SOURCES) -> DataFrame:
    """(id) of candidate lines (id, source, hash) whose hash stands in enough sources."""
    wide = candidates.groupBy("hash", "source").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("source").alias("n_sources"))
    return salted_semi(candidates.select("id", "hash"), wide.where(f"n_sources >= {min_sources}").select("hash"), ["hash"], "id").select("id")


def candidate_hashes(signs: list[tuple[int, str]]) -> list[int]:
    """Signed hashes of the lines that only recurrence decides about."""
    return [xxhash.xxh3_64_intdigest(key) - (1 << 63) for sign, key in dict.fromkeys(signs) if sign == CANDIDATE]
