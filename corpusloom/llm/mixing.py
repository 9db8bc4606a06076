"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import columns, map_rows, spread
from corpusloom.llm.tokens import TOKENIZER, Counter, load
from corpusloom.storage import checkpointed

#: Bound of the table of targets, which is collected.
MAX_TARGETS = 100_000

#: Hash classes in which the fractional part of a source is cut.
CLASSES = 4_096


class Source(NamedTuple):
    share: float
    available: float
    max_repeats: int


def water_fill(sources: list[Source], total: float | None = None) -> list[float]:
    """Tokens each source gives: its share of ``total``, at most ``max_repeats`` times what it has.

    Sources above their cap are clamped there and the weight they leave is given to the
    others in proportion to their targets, until none is above.  Without ``total`` the
    largest one is taken at which no source with documents needs to be clamped, so that
    all of them have their share.
    """
    share = [max(0.0, s.share) for s in sources]
    cap = [max(0.0, s.available) * max(0, s.max_repeats) for s in sources]
    live = [i for i in range(len(sources)) if cap[i] > 0 and share[i] > 0]
    weight = sum(share[i] for i in live)
    if not live:
        return [0.0] * len(sources)
    if total is None:
        total = min(cap[i] * weight / share[i] for i in live)
    given, free, rest = [0.0] * len(sources), set(live), float(total)
    while free:
        weight = sum(share[i] for i in free)
        over = [i for i in free if rest * share[i] > cap[i] * weight * (1 + 1e-12)]
        if not over:
            for i in free:
                given[i] = rest * share[i] / weight
            break
        for i in over:
            given[i] = cap[i]
            free.remove(i)
        rest -= sum(cap[i] for i in over)
    return given


def document_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of each document; null text has no tokens."""
    vocabulary = load(docs.sparkSession, tokenizer)

    def make():
        count = Counter(vocabulary.value)
        return lambda key, text, source: [(key, source, count(text) if text else 0)]

    fields = [("id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())]
    return map_rows(spread(columns(docs, id=id_col, text=text_col, source=source_col)), "id bigint, source string, tokens bigint", make, fields)


#: Total of a mix that is all its sources have.
EVERYTHING = -1.0


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    total_tokens: float | None = None,
    seed: int = 9,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """Rows (mix_name, source, id, tokens, repeats) and report (mix_name, source, target_share, actual_share, epochs, ...).

    ``total_tokens`` is the size of each mix, EVERYTHING standing for all tokens its sources have, at which sources that
    have less than their share are clamped at their repeats and the others take the rest in proportion; by
    default it is the largest size at which every source has exactly its share.
    Tokens of each source are added up with partial sums; the plan is made on the
    driver from one row a target, whose number is checked.  Every document of a source
    is repeated as often as the whole part of its epochs, and a seeded sample of them
    once more for the fraction: documents are ordered by a hash, whole hash classes are
    taken as long as they fit, and only the class at the cut is ordered within, so no
    source is sorted in one task and the share is met to within one document.  Documents
    without tokens, sources without targets and null ids give no row; a source without
    documents gets a report row of share 0; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    sized = checkpointed(document_tokens(docs, id_col, text_col, source_col, tokenizer).where("tokens > 0 AND id IS NOT NULL"))
    goals = targets.select("mix_name", "source", F.col("target_share").cast("double"), "max_repeats").dropDuplicates(["mix_name", "source"])
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("n_docs"), F.max("tokens").alias("largest"))
    listed = goals.join(have, "source", "left").select("mix_name", "source", "target_share", "max_repeats", "available", "n_docs", "largest")
    rows = listed.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    plan = []
    for mix in sorted({r.mix_name for r in rows if r.mix_name is not None}):
        own = sorted((r for r in rows if r.mix_name == mix), key=lambda r: r.source or "")
        total = sum(r.available or 0 for r in own) if total_tokens == EVERYTHING else total_tokens
        given = water_fill([Source(r.target_share or 0.0, r.available or 0, r.max_repeats or 0) for r in own], total)
        for r, tokens in zip(own, given, strict=True):
            epochs = tokens / r.available if r.available else 0.0
            capped = bool(r.available and tokens >= r.available * (r.max_repeats or 0) * (1 - 1e-9))
            whole = int(epochs + 1e-9)
            plan.append((mix, r.source, r.target_share, r.max_repeats, r.available or 0, whole, max(0.0, tokens - whole * (r.available or 0)), epochs, capped, r.largest or 0))
    ddl = "mix_name string, source string, target_share double, max_repeats int, available bigint, whole int, rest double, epochs double, capped boolean, largest bigint"
    planned = spark.createDataFrame(plan, ddl)
    order = F.xxhash64("id", "mix_name", F.lit(seed))
    ranked = sized.join(planned.where("epochs > 0").drop("largest"), "source").withColumn("order", order).withColumn("class", F.pmod("order", F.lit(CLASSES)).cast("int"))
    by_class = ranked.where("rest > 0").groupBy("mix_name", "source", "class").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("mix_name", "source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1))
    cuts = by_class.select("mix_name", "source", "class", F.coalesce(before, F.lit(0)).alias("before"), "t")
    placed = ranked.join(cuts, ["mix_name", "source", "class"], "left")
    full = F.coalesce(F.col("before") + F.col("t") <= F.col("rest"), F.lit(False))
    cut = F.coalesce((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest")), F.lit(False))
    sure = placed.where(~cut).withColumn("repeats", F.col("whole") + full.cast("int"))
    within = Window.partitionBy("mix_name", "source", "class").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where(cut).withColumn("upto", F.sum("tokens").over(within) + F.col("before") - F.col("tokens") / 2)
    edge = edge.withColumn("repeats", F.col("whole") + (F.col("upto") <= F.col("rest")).cast("int")).drop("upto")
    names = ["mix_name", "source", F.col("id").alias(id_col), "tokens", "repeats"]
    mixed = sure.select(*names).union(edge.select(*names)).where("repeats > 0")
    given = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    report = planned.join(given, ["mix_name", "source"], "left").fillna(0, ["tokens", "n_docs", "most_repeats"])
    whole_mix = F.sum("tokens").over(Window.partitionBy("mix_name"))
    report = report.withColumn("actual_share", F.when(whole_mix > 0, F.col("tokens") / whole_mix).otherwise(F.lit(0.0)))
    return mixed, report.select("mix_name", "source", "target_share", "actual_share", "available", "tokens", "n_docs", "epochs", "max_repeats", "most_repeats", "capped", "largest")


def mixing_faults(report: DataFrame) -> DataFrame:
    """(mix_name, source, repeated, missed, unfair): whether a source breaks what a mix must keep.

    A document repeated above the limit, a source that gives more or less than its plan by over two of its largest
    documents, and a source below its cap whose tokens by target differ from those of the other such sources
    by more than its plan allows.
    """
    own = report.withColumn("slack", 2 * F.col("largest"))
    free = (~F.col("capped")) & (F.col("available") > 0) & (F.col("target_share") > 0)
    level = F.max(F.when(free, F.col("epochs") * F.col("available") / F.col("target_share"))).over(Window.partitionBy("mix_name"))
    planned = F.col("epochs") * F.col("available")
    return own.select(
        "mix_name", "source", (F.col("most_repeats") > F.col("max_repeats")).alias("repeated"), (F.abs(F.col("tokens") - planned) > F.col("slack")).alias("missed"),
        (free & (F.abs(F.col("tokens") - F.col("target_share") * level) > F.col("slack"))).alias("unfair"),
    )
