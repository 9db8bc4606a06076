"""Crawl control: moving uniqueness, stop conditions, automatic exclusion, status."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.storage import checkpointed

LAST = 10


@dataclass(frozen=True)
class Limits:
    """Limits of a crawl; 0 switches one off."""

    max_duration: int = 0  # minutes
    max_page_count: int = 0
    max_errors: int = 10
    min_unique_text: int = 5  # per cent
    max_size_on_disk: int = 0  # megabytes


#: Rows of a site that are put in order in one task; a larger site is cut into more parts.
PART_ROWS = 1 << 16


def numbered(rows: DataFrame, site: str, seq: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Rows with ``_rank``, their number from 1 in the order of ``seq`` within a site, and running sums of columns under new names.

    A site is cut into parts of about PART_ROWS rows by ranges of ``seq``, a number; each part is ordered in a task of its
    own, and what stands before a part is added from the totals of the parts.  So the plan does not
    depend on the size of a site.
    """
    sums = sums or {}
    spans = rows.groupBy(F.col(site).alias("_site")).agg(F.min(seq).alias("_low"), F.max(seq).alias("_high"), F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("_parts"))
    part = F.floor((F.col(seq) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * F.col("_parts"))
    placed = rows.join(spans, F.col(site).eqNullSafe(F.col("_site"))).withColumn("_part", F.coalesce(part, F.lit(0).cast("bigint"))).drop("_site", "_low", "_high", "_parts")
    totals = placed.groupBy(F.col(site).alias("_site"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()))
    before = Window.partitionBy("_site").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offset = lambda c, n: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n)
    offsets = totals.select("_site", "_p", offset("_n", "_n"), *(offset(f"_sum_{n}", f"_sum_{n}") for n in sums))
    upto = Window.partitionBy(site, "_part").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({"_rank": F.row_number().over(upto).cast("bigint"), **{n: F.sum(c).over(upto) for n, c in sums.items()}})
    joined = own.join(offsets, F.col(site).eqNullSafe(F.col("_site")) & (F.col("_part") == F.col("_p")))
    made = {"_rank": F.col("_rank") + F.col("_n"), **{n: F.col(n) + F.col(f"_sum_{n}") for n in sums}}
    return joined.withColumns(made).drop("_part", "_site", "_p", "_n", *(f"_sum_{n}" for n in sums))


def with_last_mean(ranked: DataFrame, site: str, value: str, name: str, last: int = LAST) -> DataFrame:
    """Numbered rows with the mean of a value over the last documents of their site, up to and with their own.

    Rows are put in order in blocks of PART_ROWS by their number; the last ones of a block are copied to the next, where
    they are counted and left out.
    """
    block = F.floor((F.col("_rank") - 1) / PART_ROWS)
    tail = (F.col("_rank") - 1) % PART_ROWS > PART_ROWS - last
    copies = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    placed = ranked.withColumn("_block", F.explode(copies))
    window = Window.partitionBy(site, "_block").orderBy("_rank").rowsBetween(1 - last, 0)
    return placed.withColumn(name, F.avg(value).over(window)).where(F.col("_block") == block).drop("_block")


def unique_last(documents: DataFrame, site: str, seq: str, pct: str = "pct_unique", last: int = LAST) -> DataFrame:
    own = checkpointed(documents)  # a few numbers a document, read for the spans of sites, the totals of parts and the rows
    return with_last_mean(numbered(own, site, seq), site, pct, "unique_last", last).drop("_rank")


def stop_events(pages: DataFrame, site: str, seq: str, limits: Limits, strict_parity: bool = True) -> DataFrame:
    """(site, seq, reason): first page of each site after which a limit stops the crawl.

    ``pages`` has a row for each converted page with ``minutes`` since the start, ``errors``
    and ``bytes`` so far as increments, and ``pct_unique``.  With ``strict_parity`` the duration is the minutes component alone, 0
    to 59, as the model has it.
    """
    ranked = numbered(checkpointed(pages.select(site, seq, "minutes", "errors", "bytes", "pct_unique")), site, seq, {"e": "errors", "b": "bytes"})
    run = with_last_mean(ranked, site, "pct_unique", "u").select(
        site, seq, (F.col("minutes") % 60 if strict_parity else F.col("minutes")).alias("m"), F.col("_rank").alias("n"), "e", "b", "u"
    )
    rules = [
        (limits.max_duration, F.col("m") >= limits.max_duration, "duration"),
        (limits.max_page_count, F.col("n") >= limits.max_page_count, "pages"),
        (limits.max_errors, F.col("e") >= limits.max_errors, "errors"),
        (limits.min_unique_text, (F.col("n") >= LAST) & (F.floor(F.col("u") * 100) < limits.min_unique_text), "unique text"),
        (limits.max_size_on_disk, F.col("b") >= limits.max_size_on_disk * 1_048_576, "size"),
    ]
    reason = F.lit(None).cast("string")
    for limit, test, name in reversed(rules):
        if limit:
            reason = F.when(test, name).otherwise(reason)
    hits = run.withColumn("reason", reason).where("reason IS NOT NULL")
    return hits.groupBy(site).agg(F.min(F.struct(seq, "reason")).alias("x")).select(site, F.col(f"x.{seq}").alias(seq), "x.reason")


def low_unique(pages: DataFrame, site: str, seq: str, min_unique_text: int = 5, pct: str = "pct_unique", url: str = "url", strict_parity: bool = True) -> DataFrame:
    """(site, url) of the last pages of each site whose share of unique text is below the limit.

    With ``strict_parity`` the percentages come from a ring by slot and the addresses
    from a queue by age, so the two are paired as slots and ages, not by page.
    """
    rank = F.row_number().over(Window.partitionBy(site).orderBy(F.desc(seq)))  # tasks keep their last ten of each site before anything is moved
    sizes = pages.groupBy(F.col(site).alias("_site")).agg(F.count(F.lit(1)).alias("_size"))
    last = pages.select(site, seq, url, pct).withColumn("back", rank).where(F.col("back") <= LAST)
    last = last.join(sizes, F.col(site).eqNullSafe(F.col("_site"))).withColumn("n", F.col("_size") - F.col("back"))
    last = last.withColumn("age", F.least(F.col("_size"), F.lit(LAST)) - F.col("back")).withColumn("slot", F.col("n") % LAST).drop("_site", "_size")
    if not strict_parity:
        return last.where(F.floor(F.col(pct) * 100) < min_unique_text).select(site, url)
    by_age = last.select(site, F.col("age").alias("k"), url)
    by_slot = last.select(site, F.col("slot").alias("k"), pct)
    return by_age.join(by_slot, [site, "k"]).where(F.floor(F.col(pct) * 100) < min_unique_text).select(site, url)


def excluded_prefix(low: DataFrame, site: str, url: str = "url", strict_parity: bool = True) -> DataFrame:
    """(site, prefix, accepted): longest common prefix of the low addresses of each site.

    The common prefix of a set is that of its least and greatest member, so two
    aggregates find it.  With ``strict_parity`` addresses that never differ within the
    shortest one give an empty prefix.  It is accepted if longer than a quarter of the
    shortest address.
    """
    edges = low.groupBy(site).agg(F.min(url).alias("a"), F.max(url).alias("b"), F.min(F.length(url)).alias("shortest"))
    prefix = U.common_prefix(F.col("a"), F.col("b"))
    if strict_parity:
        prefix = F.when(F.length(prefix) == F.col("shortest"), F.lit("")).otherwise(prefix)
    out = edges.withColumn("prefix", prefix)
    return out.select(site, "prefix", (F.length("prefix") > F.floor(F.col("shortest") / 4)).alias("accepted"))


def counters(requests: DataFrame, key: str) -> DataFrame:
    """(key, pages, html, pdf, errors, bytes, ms): counters of a crawl, all partial sums."""
    return requests.groupBy(key).agg(
        F.count(F.lit(1)).alias("analyzed"), F.count_if(F.col("ok") & ~F.col("pdf")).alias("html"), F.count_if(F.col("ok") & F.col("pdf")).alias("pdf"),
        F.count_if("error").alias("errors"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"), F.sum(F.coalesce("ms", F.lit(0.0))).alias("ms"),
    )


def excluded_count(analyzed: Column, html: Column, pdf: Column, errors: Column, remaining: Column) -> Column:
    return analyzed - html - pdf - errors - remaining


def clock_text(seconds: Column) -> Column:
    """``h:mm:ss`` of a number of seconds."""
    s = F.floor(seconds)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def request_log_line(message: Column) -> Column:
    """A message as it stands in a line of the request log: separators and line ends replaced."""
    return F.translate(message, ";\n", ", ")


#: Fixed columns of the request log.
REQUEST_LOG = (
    "Clock", "Url", "Status code", "Reponse time (ms)", "Download time (ms)", "Content size (bytes)", "Unique text blocks (%)", "Crawl depth", "Parent Url",
    "Redirected from", "Retry count", "Retry after (s)", "Error message",
)


def request_log_rows(log: DataFrame, *keys: str) -> DataFrame:
    """Rows of the request log: its thirteen columns as text, empty where there is nothing; ``keys`` are kept before them."""
    whole = lambda c: F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(""))
    text = lambda c: F.coalesce(request_log_line(F.col(c)), F.lit(""))
    clock = F.coalesce(F.date_format("clock", "HH:mm:ss.SSS"), F.lit(""))
    made = (
        clock, text("url"), whole("status_code"), whole("response_ms"), whole("download_ms"), whole("content_bytes"), whole("unique_pct"), whole("crawl_depth"),
        text("parent_url"), text("redirected_from"), whole("retry_count"), whole("retry_after_s"), text("error_message"),
    )
    return log.select(*keys, *(c.alias(n) for c, n in zip(made, REQUEST_LOG, strict=True)))


def exceptions_log(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, clock, url, message): the requests that failed with a message, in one line each."""
    failed = log.where("error_message IS NOT NULL")
    return failed.select(*keys, F.coalesce(F.date_format("clock", "HH:mm:ss.SSS"), F.lit("")).alias("clock"), "url", request_log_line(F.col("error_message")).alias("message"))
