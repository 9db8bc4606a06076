"""Statistics, encodings and hashes of text blocks."""

from __future__ import annotations

import html

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

_PLANE = r"&&[\x{0}-\x{FFFF}]"
#: White space of the text model, a fixed set that differs from Java's and Python's own.  It is a string of characters to look
#: up, which is several times faster than a negated class of ranges.
WHITE_CHARS = "\t\n\x0b\x0c\r \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LETTERS, NUMBERS = rf"[\p{{L}}{_PLANE}]++", rf"[\p{{N}}{_PLANE}]++"


def _removed(text: Column, pattern: str) -> Column:
    """Number of characters in runs of a class.

    Runs are cut out and lengths compared; counting matches would build an array of
    them, one string a match.
    """
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("int")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, in which a character beyond the basic plane counts twice."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def _astral(text: Column) -> Column:
    return utf16_length(text) - F.length(text)


def _shown(text: Column) -> Column:
    """Number of characters that are no white space."""
    return F.length(F.translate(text, WHITE_CHARS, ""))


def _marked(text: Column) -> Column:
    """Length of a text with one mark in place of each run of visible characters."""
    return F.length(F.regexp_replace(F.translate(text, WHITE_CHARS, " " * len(WHITE_CHARS)), "[^ ]++", "x"))


def words(text: Column) -> Column:
    """Number of runs of visible characters."""
    return (_marked(text) + _shown(text) - F.length(text)).cast("int")


def letters(text: Column) -> Column:
    return _removed(text, LETTERS)


def numbers(text: Column) -> Column:
    return _removed(text, NUMBERS)


def visible(text: Column) -> Column:
    """Units that are no white space."""
    return (_shown(text) + _astral(text)).cast("int")


def others(text: Column) -> Column:
    return visible(text) - letters(text) - numbers(text)


def _ends_shown(text: Column) -> Column:
    """1 if the last character is no white space, else 0."""
    return F.length(F.translate(F.substring(text, -1, 1), WHITE_CHARS, ""))


def average_word_length(text: Column, strict_parity: bool = True) -> Column:
    """Integer mean length of words; with ``strict_parity`` a word that ends the text counts one unit less, as the model has it."""
    short = _ends_shown(text) if strict_parity else F.lit(0)
    return F.when(words(text) > 0, F.floor((visible(text) - short) / words(text))).when(text.isNotNull(), 0).cast("int")


STATISTICS = ("chars", "words", "avg_word_length", "letter_chars", "number_chars", "other_chars")


def with_statistics(df: DataFrame, text_col: str = "text", strict_parity: bool = True) -> DataFrame:
    """Rows with the statistics of a text: chars, words, avg_word_length, letter_chars, number_chars, other_chars.

    Each class is matched once; the results are arithmetic over those columns, in a
    projection of its own, since conditions would otherwise match again.
    """
    text = F.col(text_col)
    base = df.withColumns(
        {
            "chars": utf16_length(text), "_length": F.length(text), "_shown": _shown(text), "_marked": _marked(text), "letter_chars": letters(text),
            "number_chars": numbers(text), "_short": _ends_shown(text) if strict_parity else F.lit(0),
        }
    )
    shown, count = F.col("_shown") + F.col("chars") - F.col("_length"), F.col("_marked") + F.col("_shown") - F.col("_length")
    average = F.when(count > 0, F.floor((shown - F.col("_short")) / count)).when(text.isNotNull(), 0).cast("int")
    out = base.withColumns({"words": count.cast("int"), "avg_word_length": average, "other_chars": (shown - F.col("letter_chars") - F.col("number_chars")).cast("int")})
    return out.drop("_length", "_shown", "_marked", "_short")


def trimmed(text: Column) -> Column:
    """Text without white space of the model at both ends."""
    return F.btrim(text, F.lit(WHITE_CHARS))


def csv_encoded(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('""'))


def csv_decoded(line: Column) -> Column:
    """Text between the first ``;"`` and the last ``";`` of a line, quotes left doubled; empty if they are not there."""
    return F.regexp_extract(line, r'(?s)^.*?;"(.*)";', 1)


def html_encoded(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


@F.pandas_udf(StringType())
def html_decoded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(LongType())
def block_hash(text: pd.Series) -> pd.Series:
    """xxHash64 with seed 0 of the UTF-8 text, bytes reversed, as a signed number; null for null."""
    swap = lambda t: int.from_bytes(xxhash.xxh64_digest(t.encode("utf-8", "surrogatepass"), 0), "little", signed=True)
    return text.map(lambda t: None if t is None else swap(t)).astype("Int64")


def accepted_language(label: Column, score: Column, threshold: float = 0.6) -> Column:
    """Last two letters of a label if its score is above the threshold, else ``?``."""
    return F.when(score > threshold, F.substring(label, -2, 2)).otherwise(F.lit("?"))


def output_name(base: Column, language: Column, extension: str) -> Column:
    lang = F.when(F.coalesce(language, F.lit("?")) == "?", "xx").otherwise(language)
    return F.concat(base, F.lit("."), lang, F.lit(extension))


def cell_coordinates(row: Column, rowspan: Column, col: Column, colspan: Column) -> Column:
    """``r,c``, or ``r:rs,c:cs`` for a cell that spans more than one row or column."""
    plain = F.format_string("%d,%d", row, col)
    return F.when((rowspan != 1) | (colspan != 1), F.format_string("%d:%d,%d:%d", row, rowspan, col, colspan)).otherwise(plain)


def size_category(n: Column) -> Column:
    """Size class of a dataset by its number of examples, as in the header of a dataset card."""
    classes = [(3, "1K<n<10K"), (4, "10K<n<100K"), (5, "100K<n<1M"), (6, "1M<n<10M"), (7, "10M<n<100M"), (8, "100M<n<1B"), (9, "1B<n<10B")]
    out = F.lit("n<1K")
    for power, name in classes:
        out = F.when(n > 10**power, name).otherwise(out)
    return out
