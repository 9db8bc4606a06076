"""Problem 3: lines repeated across one site's documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import columns, salted, salted_semi, spread
from corpusloom.storage import written

#: A block counts if it stands in so many documents and in such a part of the documents of its root.
MIN_DOCS, MIN_PART = 5, 0.05

#: Lines of a suffix that the sort compares.  A longer block that spans many documents is a chain of overlapping ones of
#: this length, each of which spans as many, so the lines that blocks cover do not depend on it.
DEPTH = 4

_SPACES = re.compile(r"[ \t\r]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTER = re.compile(r"[^\W\d_]")


def line_key(line: str) -> str:
    """Form in which lines are compared: lower case, single spaces, trimmed, runs of digits as 0."""
    return _DIGITS.sub("0", _SPACES.sub(" ", line.lower()).strip(" "))


def _root(column: str):
    bare = F.regexp_replace(F.lower(F.trim(column)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(bare, "/$", "")


def _inputs(docs: DataFrame, id_col: str, text_col: str, root_col: str) -> DataFrame:
    return columns(docs, id=id_col, text=text_col, root=root_col).where("root IS NOT NULL AND id IS NOT NULL").select("id", "text", _root("root").alias("root"))


_LINES = [f"s{k}" for k in range(DEPTH)]
_NAMES = ["root", *(f"s{k}" for k in range(DEPTH)), "first", "id", "line_no", "next_no"]
_DDL = "root bigint, " + ", ".join(f"s{k} bigint" for k in range(DEPTH)) + ", first int, id bigint, line_no int, next_no int"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a line with a letter: the identifiers of it and the next lines of its document.  Bit d of ``first`` says that the
    document has not had the same d + 1 lines before, so that summing bits counts documents."""
    memory: dict[str, int] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 2_000):
            part = batch.slice(start, 2_000)
            ids, numbers, owners, roots = [], [], [], []
            for row, (key, text, root) in enumerate(zip(*(c.to_pylist() for c in part.columns), strict=True)):
                root = xxhash.xxh3_64_intdigest(root)
                for number, line in enumerate((text or "").split("\n"), 1):
                    known = memory.get(line)
                    if known is None:
                        norm = line_key(line)
                        known = xxhash.xxh3_64_intdigest(norm) | 1 if _LETTER.search(norm) else 0
                        if len(line) < 200:
                            if len(memory) > 50_000:
                                memory.clear()
                            memory[line] = known
                    if known:
                        ids.append(known)
                        numbers.append(number)
                        owners.append((row, key))
                        roots.append(root)
            n = len(ids)
            if not n:
                continue
            s = np.zeros((DEPTH, n), np.uint64)
            row_of = np.fromiter((o[0] for o in owners), np.int64, n)
            s[0] = ids
            for k in range(1, DEPTH):
                s[k, : n - k] = np.where(row_of[k:] == row_of[: n - k], s[0, k:], 0) if n > k else 0
            first, prefix = np.zeros(n, np.int32), row_of.astype(np.uint64)
            for k in range(DEPTH):
                prefix = (prefix ^ s[k]) * np.uint64(0x9E3779B97F4A7C15)
                prefix ^= prefix >> np.uint64(29)
                _, at = np.unique(prefix, return_index=True)
                if k == 0:
                    first[at] |= 1
                else:
                    first[at] |= 1 << k
                    first[s[k] == 0] &= ~(1 << k)  # too near the end of the document for so long a block
            signed = [pa.array(x.view(np.int64)) for x in s]
            following = np.array([*numbers[1:], 0], np.int32)
            following = np.where(s[1] != 0, following, 0)  # number of the next line of the document, 0 after the last
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(roots, np.uint64).view(np.int64)), *signed, pa.array(first), pa.array([o[1] for o in owners], pa.int64()), pa.array(numbers, pa.int32()), pa.array(following, pa.int32())],
                names=_NAMES,
            )


def _intervals(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal prefixes in the sorted suffixes of one partition, as (root, depth, s0, ..., docs), lines beyond the depth being 0.

    A run at the edge of a partition may go on in the next one and is always given, with
    its part of the count; an inner run is whole and is given only if it has at least ``least`` documents.
    """
    open_: list[tuple[tuple, int, bool] | None] = [None] * DEPTH
    last: np.ndarray | None = None
    out: list[tuple] = []

    def done(k: int, run: tuple[tuple, int, bool], edge: bool) -> None:
        key, docs, from_edge = run
        if key[k + 1] and docs and (edge or from_edge or docs >= least):
            out.append((key[0], k + 1, *key[1 : k + 2], *[0] * (DEPTH - k - 1), docs))

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        m = np.stack([batch.column(i).to_numpy() for i in range(DEPTH + 1)])
        first = batch.column(DEPTH + 1).to_numpy()
        place = np.stack([batch.column(DEPTH + 2).to_numpy(), batch.column(DEPTH + 3).to_numpy().astype(np.int64)])
        whole = np.concatenate([m, place])
        before = np.concatenate([last[:, None] if last is not None else np.full((len(whole), 1), -1), whole[:, :-1]], axis=1)
        if last is None:
            before[:, 0] = whole[:, 0] ^ 1
        differs = m != before[: DEPTH + 1]
        repeated_row = ~(whole != before).any(axis=0)  # the same row of the input once more
        changed = differs[0]
        for k in range(DEPTH):
            changed = changed | differs[k + 1]
            bit = np.where(repeated_row, 0, (first >> k) & 1)
            starts = np.flatnonzero(changed)
            if not len(starts) or starts[0] != 0:  # the run of the last batch goes on
                end = starts[0] if len(starts) else n
                key, docs, edge = open_[k]
                open_[k] = (key, docs + int(bit[:end].sum()), edge)
            if len(starts):
                sums = np.add.reduceat(bit, starts)
                if open_[k] is not None:
                    done(k, open_[k], False)
                for i in np.flatnonzero(sums[:-1] >= least) if len(starts) > 1 else ():
                    done(k, (tuple(m[:, starts[i]].tolist()), int(sums[i]), False), False)
                if last is None and len(starts) > 1 and sums[0] < least:
                    done(k, (tuple(m[:, 0].tolist()), int(sums[0]), True), True)
                open_[k] = (tuple(m[:, starts[-1]].tolist()), int(sums[-1]), last is None and len(starts) == 1)
        last = whole[:, -1]
        if len(out) > 10_000:
            yield _interval_batch(out)
            out = []
    for k in range(DEPTH):
        if open_[k] is not None:
            done(k, open_[k], True)
    yield _interval_batch(out)


def _interval_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.int64()] * DEPTH, pa.int64()]
    cols = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["root", "depth", *_LINES, "docs"])


def suffix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root_col: str = "rooturl") -> tuple[DataFrame, DataFrame]:
    """Suffixes of the line sequences of all documents, written once, and (root, n): the documents of each root."""
    rows = _inputs(docs, id_col, text_col, root_col)
    counts = rows.groupBy("root").agg(F.countDistinct("id").alias("n"))
    # the same hash as of the suffixes is taken in Python, once a distinct root
    return written(spread(rows).mapInArrow(_suffixes, _DDL)), counts.mapInArrow(_hashed_roots, "root bigint, n bigint")


def repeated_blocks(suffixes: DataFrame, sizes: DataFrame, min_docs: int = MIN_DOCS, min_part: float = MIN_PART) -> DataFrame:
    """(root, depth, s0, ..., docs): blocks of 1 to DEPTH lines that span many documents of one root.

    The suffixes are sorted by (root, line ids), which is the suffix array of each root's
    concatenated lines; runs of a common prefix are its intervals.  The sort is by ranges with the
    document as last key, so a root or a line that a third of all rows have is spread over
    many partitions; their parts of an interval are added up.  Nothing is collected or broadcast.
    """
    order = ["root", *_LINES, "id", "line_no"]
    partitions = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = suffixes.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select("root", *_LINES, "first", "id", "line_no")
    ddl = "root bigint, depth int, " + ", ".join(f"{x} bigint" for x in _LINES) + ", docs bigint"
    runs = ordered.mapInArrow(lambda batches: _intervals(batches, min_docs), ddl)
    spans = runs.groupBy("root", "depth", *_LINES).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    return salted(spans, sizes, ["root"], "s0").where(F.col("docs") >= F.col("n") * min_part - 1e-9).select("root", "depth", *_LINES, "docs")


def _hashed_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.array([xxhash.xxh3_64_intdigest(r) for r in batch.column(0).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1)], names=["root", "n"])


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root_col: str = "rooturl", min_docs: int = MIN_DOCS, min_part: float = MIN_PART
) -> DataFrame:
    """(id, line_no): every line covered by a block that spans many documents of its root.

    Roots are equal without scheme, case and final slash; documents with null root or
    null id are left out, those with null or empty text count among the documents of a
    root.  Lines without a letter are no part of any block.  A row repeated in the input
    counts once and gives its lines as often as it stands there.  The block whose lines
    cover most is the shortest one, since each line of a spanning block spans as many
    documents itself; hence occurrences are those of the first lines of all blocks.
    """
    suffixes, sizes = suffix_rows(docs, id_col, text_col, root_col)
    keys = repeated_blocks(suffixes, sizes, min_docs, min_part).where("depth = 1").select("root", "s0")
    return salted_semi(suffixes.select("root", "s0", "id", "line_no"), keys, ["root", "s0"], "id").select(F.col("id").alias(id_col), "line_no")


def repeated_block_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root_col: str = "rooturl", min_docs: int = MIN_DOCS, min_part: float = MIN_PART
) -> DataFrame:
    """(id, line_no): every line within a block of two or more lines that spans many documents of its root as a block.

    Fewer lines than :func:`repeated_lines` gives, since lines that recur each by itself are no block, and more, since what
    stands between two lines of a block goes with it: blank lines, rules and other lines without a letter.  Longer blocks
    are chains of pairs.  Rows that are equal in the input give their lines once.
    """
    suffixes, sizes = suffix_rows(docs, id_col, text_col, root_col)
    keys = repeated_blocks(suffixes, sizes, min_docs, min_part).where("depth = 2").select("root", "s0", "s1")
    pairs = salted_semi(suffixes.select("root", "s0", "s1", "id", "line_no", "next_no"), keys, ["root", "s0", "s1"], "id")
    return pairs.select(F.col("id").alias(id_col), F.explode(F.sequence("line_no", "next_no")).alias("line_no")).distinct()


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", root_col: str = "rooturl", **limits) -> DataFrame:
    """(id, text): texts with their repeated lines deleted; null stays null.  Ids must be unique; rows with a null id are kept as they are."""
    hits = repeated_lines(docs, id_col, text_col, root_col, **limits).groupBy(id_col).agg(F.collect_set("line_no").alias("cut"))
    own = columns(docs, id=id_col, text=text_col).join(hits.select(F.col(id_col).alias("id"), "cut"), "id", "left")
    kept = F.expr("filter(split(text, '\\n', -1), (x, i) -> NOT array_contains(cut, i + 1))")
    return own.select(F.col("id").alias(id_col), F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
