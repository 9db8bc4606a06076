"""Blocks of documents, the site-wide claim of unique text, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def explode_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """(id, *keep, pos, block): the non-empty lines of each document, trimmed; positions count all lines from 0."""
    lines = docs.where(F.col(text_col).isNotNull()).select(id_col, *keep, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "block"))
    return lines.withColumn("block", T.trimmed(F.col("block"))).where("block <> ''")


def claim_unique(units: DataFrame, site: str, order: tuple[str, ...], text_col: str = "block") -> DataFrame:
    """Units with ``is_unique``: true for the first occurrence of a text within its site.

    The shuffle key is the site and a hash of the text, not the text; equal hashes are
    told apart by the text within the group.  The first occurrence of each text is
    found by a partial minimum before the shuffle, so a line that a third of a site's
    documents share costs one row a task, and is joined back.
    """
    key = F.xxhash64(text_col)
    place = F.struct(*(F.col(c) for c in order))
    first = units.groupBy(F.col(site).alias("_site"), key.alias("_hash"), F.col(text_col).alias("_text")).agg(F.min(place).alias("_first"))
    firsts = first.select("_site", "_first").withColumn("_one", F.lit(True))
    tagged = units.withColumn("_place", place)
    joined = tagged.join(firsts, F.col(site).eqNullSafe(F.col("_site")) & (F.col("_place") == F.col("_first")), "left")
    return joined.withColumn("is_unique", F.coalesce("_one", F.lit(False))).drop("_site", "_first", "_one", "_place")


def document_words(units: DataFrame, id_col: str = "doc_id", words: Column | None = None) -> DataFrame:
    """(id, total_words, unique_words, pct_unique)."""
    w = F.col("words") if words is None else words
    sums = units.groupBy(id_col).agg(F.sum(w).alias("total_words"), F.sum(F.when(F.col("is_unique"), w).otherwise(0)).alias("unique_words"))
    return sums.withColumn("pct_unique", F.when(F.col("total_words") > 0, F.col("unique_words") / F.col("total_words")).otherwise(F.lit(0.0)))


def keep_documents(words: DataFrame) -> DataFrame:
    """Documents with any unique words; only these are written."""
    return words.where("unique_words > 0")


def words_by_language(units: DataFrame, key: str, lang: str = "lang", words: str = "words") -> DataFrame:
    """(key, lang, words): words of each language; an unknown one counts as ``?``."""
    return units.groupBy(key, F.coalesce(F.col(lang), F.lit("?")).alias("lang")).agg(F.sum(words).alias("words"))


def main_language(units: DataFrame, key: str, order: tuple[str, ...], lang: str = "lang", words: str = "words") -> DataFrame:
    """(key, lang): language of most words; of equals the one seen last for the first time, and ``?`` competes.

    One aggregate by language and one by key; no window over the units.
    """
    by = units.groupBy(key, F.coalesce(F.col(lang), F.lit("?")).alias("lang")).agg(F.sum(words).alias("w"), F.min(F.struct(*order)).alias("seen"))
    return by.groupBy(key).agg(F.max_by("lang", F.struct("w", "seen")).alias("lang"))


def metadata_words(by_language: DataFrame, key: str) -> DataFrame:
    """(key, metadata): map of ``words-count:<lang>`` to a count, as a string."""
    entry = F.struct(F.concat(F.lit("words-count:"), F.col("lang")), F.col("words").cast("string"))
    return by_language.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("metadata"))


# ---- the unique view of trees ----


def group_unique(elements: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, pos, contains_unique) of each group: whether any text block below it, not a title, is unique."""
    blocks = elements.where("elt_type = 'TextBlock'").select(id_col, F.explode("path").alias("pos"), "is_unique")
    any_unique = blocks.groupBy(id_col, "pos").agg(F.bool_or(F.coalesce("is_unique", F.lit(False))).alias("contains_unique"))
    groups = elements.where("cmd = 'Start'").select(id_col, "pos", "elt_type")
    return groups.join(any_unique, [id_col, "pos"], "left").select(id_col, "pos", "elt_type", F.coalesce("contains_unique", F.lit(False)).alias("contains_unique"))


def unique_view(elements: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Elements that text output keeps.

    At the top of a document a text block is kept if it is unique and a group if it
    contains unique text.  Within a kept group text blocks stay even if they are repeated,
    items and cells always stay, and sections, lists and tables need unique text.
    """
    groups = group_unique(elements, id_col)
    top = elements.where("cmd = 'Start'").select(id_col, "pos", F.size("path").alias("depth"))
    bad = groups.join(top, [id_col, "pos"]).where(
        ~F.col("contains_unique") & ((F.col("depth") == 0) | F.col("elt_type").isin("Section", "List", "NavigationList", "Table"))
    )
    dropped = bad.groupBy(id_col).agg(F.collect_set("pos").alias("dropped"))
    # an end row has the position of its own; its group is the last one open before it at its level
    own = elements.join(dropped, id_col, "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    level = Window.partitionBy(id_col, "nesting_level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("cmd") == "Start", F.col("pos")), True).over(level)
    own = own.withColumn("_own", F.when(F.col("cmd") == "Text", F.lit(None).cast("int")).otherwise(start))
    gone = F.arrays_overlap("path", "dropped") | F.coalesce(F.array_contains("dropped", F.col("_own")), F.lit(False))
    lone = (F.col("cmd") == "Text") & (F.size("path") == 0) & ~F.coalesce("is_unique", F.lit(False))
    return own.where(~gone & ~lone).drop("dropped", "_own")


def implied_tree(elements: DataFrame) -> DataFrame:
    """Tree rows of element rows (page_id, pos, elt_type, cmd, nesting_level, text, is_unique) whose groups have a start and no end.

    A group goes on as long as rows are nested deeper than its start; its end row is put after them.  Rows are numbered
    anew, ``origin`` being the position they had; ``path`` has the positions of the groups around a row.  Rows of a
    document are sorted within the partition of its id and read as a stream, so no document is held as a whole.
    """
    names = ["page_id", "pos", "origin", "elt_type", "cmd", "nesting_level", "path", "text", "is_unique"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.string(), pa.bool_()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, n = None, 0
        groups: list[tuple[int, int, str]] = []  # position, level and kind of open groups
        out: list[tuple] = []

        def end(level: int) -> None:
            nonlocal n
            while groups and groups[-1][1] >= level:
                _, own, kind = groups.pop()
                out.append((page, n, None, kind, "End", own, [g[0] for g in groups], None, None))
                n += 1

        for batch in batches:
            for key, pos, kind, cmd, level, text, unique in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != page:
                    end(0)
                    page, n = key, 0
                end(level)
                out.append((key, n, pos, kind, cmd, level, [g[0] for g in groups], text, unique))
                if cmd == "Start":
                    groups.append((n, level, kind))
                n += 1
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                    out.clear()
        end(0)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    placed = elements.select("page_id", "pos", "elt_type", "cmd", "nesting_level", "text", "is_unique").repartition("page_id").sortWithinPartitions("page_id", "pos")
    ddl = "page_id bigint, pos int, origin int, elt_type string, cmd string, nesting_level int, path array<int>, text string, is_unique boolean"
    return placed.mapInArrow(work, ddl)
