"""Problem 1: page boilerplate mixed with main content."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import linemodel
from corpusloom.llm.common import columns, salted, spread
from corpusloom.llm.mojibake import Repairer, repaired
from corpusloom.storage import checkpointed, written

#: Bound of the sample the classifier is fitted on: lines of documents of least hash, and at most this many different ones.
MAX_FIT_DOCS, MAX_FIT_MASKS = 4_000, 60_000

_FIELDS = [
    ("id", pa.int64()), ("site", pa.int64()), ("place", pa.int32()), ("numbers", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64())),
    ("keys", pa.list_(pa.int64())), ("heads", pa.list_(pa.int64())),
]
_CLASSES = ("hashes", "ns", "ofs")
_DDL = "id bigint, site bigint, place int, numbers array<int>, bits array<bigint>, keys array<bigint>, heads array<bigint>"


def _reader(keep_text: bool):
    """Map of documents to their lines as bits and keys, beside the restored lines if wanted."""
    fields = [*_FIELDS, ("lines", pa.list_(pa.string()))] if keep_text else _FIELDS
    schema = pa.schema([pa.field(n, t) for n, t in fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, repairer = linemodel.LineReader(), Repairer()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                out: list[list] = [[] for _ in fields]
                for key, text, title, site, place in zip(*(c.to_pylist() for c in whole.slice(start, 500).columns), strict=True):
                    numbers, lines = [], []
                    for number, raw in enumerate(repaired(text, repairer).split("\n") if text else (), 1):
                        line = raw.strip()
                        if line:
                            numbers.append(number)
                            lines.append(line)
                    bits, keys, heads = linemodel.page_bits(lines, title, read)
                    for column, value in zip(out, (key, site, place, numbers, bits, keys, heads, lines if text is not None else None), strict=False):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)

    return work, _DDL + (", lines array<string>" if keep_text else "")


def _counted(made: DataFrame) -> DataFrame:
    """(uid, hashes, ns, ofs): of each document, those of its lines and beginnings that stand in several documents of its site, in how many, of how many.

    Counts are partial sums by (site, hash); only lines in two documents or more are joined back to the
    documents, in parts by a hash of the document, so a line that a third of a site's pages share is no single task.
    """
    each = made.where("site IS NOT NULL").select("uid", "site", F.explode(F.array_distinct(F.concat("keys", F.filter("heads", lambda h: h != 0)))).alias("hash")).where("hash <> 0")
    counts = each.groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = made.where("site IS NOT NULL").groupBy("site").agg(F.count(F.lit(1)).alias("of"))
    known = salted(counts, sizes, ["site"], "hash").select("site", "hash", "n", "of")
    rows = salted(each, known, ["site", "hash"], "uid").select("uid", F.struct("hash", "n", "of").alias("x"))
    own = rows.groupBy("uid").agg(F.collect_list("x").alias("x"))
    return own.select("uid", F.col("x.hash").alias("hashes"), F.col("x.n").alias("ns"), F.col("x.of").alias("ofs"))


def _lists(column: pa.ListArray) -> list[list]:
    """Python lists of a column of lists of numbers, by one conversion of all values; null is an empty list."""
    ends, values = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False).tolist()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _full_bits(bits: list[int], keys: list[int], heads: list[int], hashes: list[int], ns: list[int], ofs: list[int]) -> list[int]:
    if not hashes:
        return bits
    known = {h: (n, of) for h, n, of in zip(hashes, ns, ofs, strict=True)}
    out = []
    for b, k, h in zip(bits, keys, heads, strict=True):
        if k in known:
            b |= linemodel.document_class(*known[k])
        if h in known:
            b |= linemodel.head_class(*known[h])
        out.append(b)
    return out


def _fitted(rows: DataFrame, documents: int) -> np.ndarray:
    """Weights of the classifier, from the documents whose hash is below the bound of the sample.

    Different lines become equal sets of bits, so what reaches the driver is a table of counts of a few thousand rows.
    """

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, int] = {}
            for values in zip(*map(_lists, batch.columns), strict=True):
                for b in _full_bits(*values):
                    found[b] = found.get(b, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["mask", "n"])

    below = min(linemodel.PLACES, MAX_FIT_DOCS * linemodel.PLACES // max(1, documents) + 1)
    sample = rows.where(F.col("place") < below).select("bits", "keys", "heads", *_CLASSES)
    counts = sample.mapInArrow(masks, "mask bigint, n bigint").groupBy("mask").agg(F.sum("n").alias("n"))
    got = counts.orderBy(F.desc("n"), "mask").limit(MAX_FIT_MASKS).collect()
    return linemodel.fit(np.array([r.mask for r in got], np.int64), np.array([r.n for r in got], np.int64))


def _labelled(docs: DataFrame, id_col: str, text_col: str, title_col: str, site_col: str, keep_text: bool, make, ddl: str) -> DataFrame:
    """Rows that ``make(scorer)`` gives of every document: read once, counted, fitted, and cut page by page."""
    work, schema = _reader(keep_text)
    given = columns(docs, id=id_col, text=text_col, title=title_col, site=site_col)
    place = F.pmod(F.xxhash64("id", "text"), F.lit(linemodel.PLACES)).cast("int")
    rows = spread(given.select("id", "text", "title", F.when(F.col("site").isNotNull(), F.xxhash64("site")).alias("site"), place.alias("place")))
    made = written(rows.mapInArrow(work, schema).withColumn("uid", F.monotonically_increasing_id()))
    classes = checkpointed(_counted(made))
    joined = made.join(classes, "uid", "left")
    weights = _fitted(joined, made.count())
    return joined.select("id", "numbers", "bits", "keys", "heads", *_CLASSES, *(["lines"] if keep_text else [])).mapInArrow(make(weights), ddl)


def frame_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", site_col: str = "source") -> DataFrame:
    """(id, line_no): every non-blank line outside the main body, by minimum cut on each page.

    Terminal capacities are the log-odds of a fitted classifier (:mod:`corpusloom.llm.linemodel`) over the
    shape, place and phrase of a line and the documents of its site that hold it; neighbouring lines and lines of one
    box are joined by edges.  Texts are read once into bits and hashes of their lines, which alone are counted and
    joined; no text is shuffled.  Null or blank text gives no row; a null site has no counts;
    wrongly decoded lines are judged by their restored text; repeated rows give repeated rows and count as
    documents of their own; a null id is kept as null; a null title only means that no line is
    known to repeat it; an empty table gives an empty one.  Texts are processed whole, in time
    proportional to their lines.
    """

    def make(weights: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = linemodel.Scorer(weights)
            for batch in batches:
                ids, numbers = [], []
                for key, own, *values in zip(batch.column(0).to_pylist(), *map(_lists, batch.columns[1:]), strict=True):
                    cut = [n for n, out in zip(own, scorer.label(_full_bits(*values)), strict=True) if out]
                    ids += [key] * len(cut)
                    numbers += cut
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], names=["id", "line_no"])

        return work

    return _labelled(docs, id_col, text_col, title_col, site_col, False, make, "id bigint, line_no int").withColumnRenamed("id", id_col)


def main_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str = "title", site_col: str = "source") -> DataFrame:
    """(id, main_text): the lines of the main body of each text, restored where they were decoded wrongly, joined by newlines.

    Labels are those of :func:`frame_lines`; the restored lines are written once beside their bits.  Null text stays null, blank text gives an empty one.
    """

    def make(weights: np.ndarray):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = linemodel.Scorer(weights)
            for batch in batches:
                ids, texts = [], []
                for key, lines, _, *values in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), *map(_lists, batch.columns[1:-1]), strict=True):
                    ids.append(key)
                    if lines is None:
                        texts.append(None)
                        continue
                    label = scorer.label(_full_bits(*values))
                    texts.append("\n".join(line for line, out in zip(lines, label, strict=True) if not out))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "main_text"])

        return work

    return _labelled(docs, id_col, text_col, title_col, site_col, True, make, "id bigint, main_text string").withColumnRenamed("id", id_col)
