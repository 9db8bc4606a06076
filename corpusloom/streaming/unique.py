"""Streaming: pages in, unique flags and moving uniqueness out, with state by site and text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.control import LAST, unique_last


def unique_stream(blocks: DataFrame, dropped_after: str | None = None) -> DataFrame:
    """Blocks (site, doc_id, pos, hash, words, ts) of a stream with repeated ones dropped by Spark's own state.

    State is one key a site and text hash, in the state store, spread over all partitions
    and cut by the watermark if one is given.
    """
    if dropped_after:
        return blocks.withWatermark("ts", dropped_after).dropDuplicatesWithinWatermark(["site", "hash"])
    return blocks.dropDuplicates(["site", "hash"])


def document_blocks(docs: DataFrame) -> DataFrame:
    """(site, hash, seq, pos, doc_id, words): the blocks of a stream of documents (site, seq, doc_id, blocks)."""
    each = docs.select("site", "seq", "doc_id", F.posexplode("blocks").alias("pos", "x"))
    return each.select("site", F.col("x.hash").alias("hash"), "seq", "pos", "doc_id", F.col("x.words").alias("words"))


def document_totals(docs: DataFrame) -> DataFrame:
    """(site, seq, doc_id, total_words) of a stream of documents, without state."""
    return docs.select("site", "seq", "doc_id", F.aggregate("blocks", F.lit(0).cast("bigint"), lambda n, x: n + x["words"]).alias("total_words"))


def first_occurrences(blocks: DataFrame) -> DataFrame:
    """(site, hash, first): the first block of each text of a site so far, of a stream of blocks.

    State is one row a site and text hash in Spark's own store, so a large site is spread over all
    partitions; a batch rewrites the rows of its own texts alone.  In update mode a text comes out when
    it is first seen, and again only if a block that comes before it arrives later.
    """
    return blocks.groupBy("site", "hash").agg(F.min(F.struct("seq", "doc_id", "pos", "words")).alias("first"))


def uniqueness(totals: DataFrame, firsts: DataFrame, last: int = LAST) -> DataFrame:
    """(site, doc_id, total_words, unique_words, pct_unique, unique_last) from what the two streams have written."""
    own = firsts.groupBy("site", "hash").agg(F.min("first").alias("x")).groupBy("site", F.col("x.doc_id").alias("doc_id")).agg(F.sum("x.words").alias("unique_words"))
    made = totals.join(own, ["site", "doc_id"], "left").withColumn("unique_words", F.coalesce("unique_words", F.lit(0)))
    made = made.withColumn("pct_unique", F.when(F.col("total_words") > 0, F.col("unique_words") / F.col("total_words")).otherwise(F.lit(0.0)))
    return unique_last(made, "site", "seq", last=last).drop("seq")


def request_rates(log: DataFrame, window: str = "10 minutes", late: str = "6 hours") -> DataFrame:
    """(start, website, requests, errors, bytes) of a request log by time window, with late rows up to a watermark."""
    timed = log.withWatermark("clock", late)
    return (
        timed.groupBy(F.window("clock", window).alias("w"), "website")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.coalesce(F.col("status_code") != 200, F.lit(True))).alias("errors"), F.sum("content_bytes").alias("bytes"))
        .select(F.col("w.start").alias("start"), "website", "requests", "errors", "bytes")
    )
