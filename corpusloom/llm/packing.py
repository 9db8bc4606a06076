"""Problem 8: filling fixed-capacity containers with items."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import columns, spread
from corpusloom.llm.tokens import TOKENIZER, Counter, load
from corpusloom.storage import checkpointed

#: A container with at most this part of its capacity unused is closed at once.
NEARLY_FULL = 0.01

#: So many open containers are merged by one task in a round.
GROUP = 20_000

#: Items packed together in the first round, of one task.
CHUNK = 20_000

#: Bound of the table of capacities, which every task gets.
MAX_SPECS = 1_000


class Spec(NamedTuple):
    name: str
    capacity: int
    separator: int


def pieces(tokens: int, capacity: int) -> list[int]:
    """Sizes of an item: itself, or for one above capacity full pieces and a rest."""
    if tokens <= capacity:
        return [tokens]
    return [capacity] * (tokens // capacity) + ([tokens % capacity] if tokens % capacity else [])


def best_fit(loads: list[tuple[int, list]], capacity: int, separator: int) -> list[tuple[int, list]]:
    """Best-fit decreasing: each load goes where it leaves least room; (used, contents) of the containers.

    A load of k items is as large as its items and k - 1 separators; joining two loads
    adds one separator.
    """
    room: list[tuple[int, int]] = []  # (free after one more separator, container)
    out: list[tuple[int, list]] = []
    for size, contents in sorted(loads, key=lambda x: (-x[0], x[1][0][:2])):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, k = room.pop(at)
            used, held = out[k]
            held.extend(contents)
            out[k] = (used + separator + size, held)
            free -= size + separator
        else:
            k = len(out)
            out.append((size, list(contents)))
            free = capacity - size - separator
        if free >= 0:
            insort(room, (free, k))
    return out


def _rows(pack: str, bins: list[tuple[int, list]], capacity: int, last: bool) -> list[tuple]:
    return [(pack, used, last or capacity - used <= NEARLY_FULL * capacity, contents) for used, contents in bins]


_TYPES = pa.schema(
    [
        ("pack_name", pa.string()), ("used", pa.int64()), ("done", pa.bool_()),
        ("items", pa.list_(pa.struct([("id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int64())]))),
    ]
)
_DDL = "pack_name string, used bigint, done boolean, items array<struct<id: bigint, piece: int, tokens: bigint>>"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    items = [[{"id": i, "piece": p, "tokens": t} for i, p, t in x] for x in cols[3]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols[:3], items], _TYPES.types, strict=True)], schema=_TYPES)


def pack_documents(
    docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER
) -> DataFrame:
    """(pack_name, container_id, id, piece_no, tokens): a container for every document, for each row of ``specs``.

    Hierarchical residual packing: every task packs its own documents by best-fit
    decreasing and closes containers that are nearly full; the others are loads for the
    next round, in which groups of at most GROUP are packed anew, until one group is
    left, or a round closes no container and joins none, or the rounds are as many as a tree over the groups is high.  The rows that move are the
    underfull containers alone, with ids and sizes but no text.  A document is split only
    if it is longer than the capacity.  Empty text is an item of size 0; null text and
    null ids are left out; repeated rows are items of their own; specs without positive
    capacity are left out.  ``container_id`` names the least item of the container.
    """
    rows = specs.select("pack_name", "capacity_tokens", "separator_tokens").where("capacity_tokens > 0").limit(MAX_SPECS + 1).collect()
    if len(rows) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} capacities")
    plan = [Spec(r[0], r[1], r[2] or 0) for r in rows]
    by_name = {s.name: s for s in plan}
    vocabulary = load(docs.sparkSession, tokenizer)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, items = Counter(vocabulary.value), []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is not None and text is not None:
                    items.append((key, count(text)))
                    if len(items) >= CHUNK:
                        yield packed(items)
                        items = []
        yield packed(items)

    def packed(items: list[tuple[int, int]]) -> pa.RecordBatch:
        out = []
        for spec in plan:
            loads = [(size, [(key, n, size)]) for key, tokens in items for n, size in enumerate(pieces(tokens, spec.capacity))]
            out += _rows(spec.name, best_fit(loads, spec.capacity, spec.separator), spec.capacity, False)
        return _batch(out)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads: dict[str, list] = {}
        for batch in batches:
            for name, used, items in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                loads.setdefault(name, []).append((used, [(x["id"], x["piece"], x["tokens"]) for x in items]))
                if len(loads[name]) >= GROUP:
                    yield repacked(name, loads.pop(name))
        for name, own in loads.items():
            yield repacked(name, own)

    def repacked(name: str, own: list) -> pa.RecordBatch:
        spec = by_name[name]
        return _batch(_rows(name, best_fit(own, spec.capacity, spec.separator), spec.capacity, False))

    made = checkpointed(spread(columns(docs, id=id_col, text=text_col)).mapInArrow(first, _DDL))
    closed, open_ = [made.where("done")], made.where("NOT done")
    left = open_.count()
    height = max(1, -(-left // GROUP)).bit_length() + 1
    while left and height:
        height -= 1
        groups = -(-left // GROUP)
        spread_out = open_.select("pack_name", "used", "items").repartition(max(groups, len(plan)) if groups > 1 else len(plan), *(["pack_name"] if groups == 1 else []))
        made = checkpointed(spread_out.mapInArrow(again, _DDL))
        closed.append(made.where("done"))
        open_ = made.where("NOT done")
        before, left = left, open_.count()
        if groups == 1 or left == before:
            break
    closed.append(open_)
    bins = closed[0]
    for part in closed[1:]:
        bins = bins.union(part)
    named = bins.withColumn("least", F.array_min(F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece")))))
    named = named.withColumn("container_id", F.concat_ws("-", "pack_name", "least.id", "least.piece"))
    exploded = named.select("pack_name", "container_id", F.explode("items").alias("x"))
    return exploded.select("pack_name", "container_id", F.col("x.id").alias(id_col), F.col("x.piece").alias("piece_no"), F.col("x.tokens").alias("tokens"))


def packing_report(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """(pack_name, containers, items, tokens, fill): use of the containers of each pack."""
    by_bin = placed.groupBy("pack_name", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))
    by_pack = by_bin.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    joined = by_pack.join(specs.select("pack_name", "capacity_tokens", "separator_tokens"), "pack_name")
    used = F.col("tokens") + (F.col("items") - F.col("containers")) * F.coalesce("separator_tokens", F.lit(0))
    return joined.select("pack_name", "containers", "items", "tokens", (used / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"))


def packing_faults(docs: DataFrame, placed: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(pack_name, documents, overfull, split, loose): what a packing must keep.

    Documents placed, containers above their capacity, documents in several pieces though they fit into one container, and
    containers beyond nine tenths of the capacity on average that a packing could do without: as many as
    the least possible number and a ninth of it are allowed.
    """
    spec = specs.select("pack_name", "capacity_tokens", F.coalesce("separator_tokens", F.lit(0)).alias("separator")).where("capacity_tokens > 0")
    bins = placed.groupBy("pack_name", "container_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    whole = bins.join(spec, "pack_name").groupBy("pack_name").agg(
        F.count_if(F.col("tokens") + (F.col("items") - 1) * F.col("separator") > F.col("capacity_tokens")).alias("overfull"),
        F.greatest(F.lit(0), F.count(F.lit(1)) - F.ceil(F.sum("tokens") / F.first("capacity_tokens") * 10 / 9) - 1).alias("loose"),
    )
    own = placed.groupBy("pack_name", id_col).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))
    items = own.join(spec, "pack_name").groupBy("pack_name").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split")
    )
    return items.join(whole, "pack_name").select("pack_name", "documents", "overfull", "split", "loose")
