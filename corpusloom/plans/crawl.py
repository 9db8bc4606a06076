"""Crawl by rounds over a table of pages, and the batch pipeline behind it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import robots as R
from corpusloom.functions import url as U
from corpusloom.operators import frontier as FR
from corpusloom.sources.html import html_links
from corpusloom.storage import checkpointed, written


@dataclass
class Rounds:
    """What a crawl has found: pages with their depth, and the addresses it knows."""

    crawled: DataFrame
    known: DataFrame
    frontier: DataFrame


def links_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", robots_tag_col: str | None = None) -> DataFrame:
    """(page_id, parent, pos, url): absolute links of pages, each address once a page, in order.

    Left out are ``nofollow`` links, all links of a page whose robots header or meta tag
    forbids to follow, and a canonical link of a page to itself.
    """
    if robots_tag_col:
        pages = pages.where(~F.coalesce(F.lower(robots_tag_col).rlike("nofollow|none"), F.lit(False)))
    found = html_links(pages, id_col, html_col).where("NOT nofollow")
    own = found.join(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("parent")), "page_id")
    base = F.when(F.col("base").isNull(), F.col("parent")).otherwise(FR.resolve(F.col("parent"), F.col("base")))
    made = own.select("page_id", "parent", "pos", "kind", FR.resolve(base, F.col("href")).alias("url"))
    made = made.where((F.col("kind") != "canonical") | (F.lower("url") != F.lower(U.canonical(F.col("parent")))))
    return made.groupBy("page_id", "parent", "url").agg(F.min("pos").alias("pos"))


@dataclass
class Hooks:
    """What a caller may decide or watch in a crawl; each gets rows and gives those that go on.

    ``page`` judges pages before they are taken (url, root, depth), ``links`` the links found (url, root, depth, parent),
    ``clean`` gives the address to use for a link, and ``done`` sees the pages of each round and keeps what it wants.
    """

    page: Callable[[DataFrame], DataFrame] | None = None
    links: Callable[[DataFrame], DataFrame] | None = None
    clean: Callable[[Column], Column] | None = None
    done: Callable[[int, DataFrame], None] | None = None


def breadth_first(
    pages: DataFrame,
    roots: DataFrame,
    scope: str = "domain",
    max_rounds: int | None = None,
    allowed: Callable[[DataFrame], DataFrame] | None = None,
    start: Rounds | None = None,
    hooks: Hooks | None = None,
) -> Rounds:
    """Crawl ``pages`` (page_id, url, html) from ``roots`` (root), one round a depth, until nothing is waiting.

    Pages are parsed once, before the first round: rounds join addresses with the table of their links and never
    see HTML.  Each round joins the frontier with the addresses, filters links by scope and
    by ``allowed``, removes known addresses by an anti-join and writes the new frontier to
    the checkpoint folder, so the plan does not grow with the rounds and a lost executor
    loses no round.  Known addresses are written once each, in the part of their round.  Every link seen
    becomes known, even if it is refused.
    """
    hooks = hooks or Hooks()
    seeds = roots.select(U.canonical(F.col("root")).alias("url"), U.canonical(F.col("root")).alias("root"), F.lit(0).alias("depth")).distinct()
    state = start or Rounds(seeds.limit(0).withColumn("page_id", F.lit(None).cast("bigint")), checkpointed(seeds.select("url")), checkpointed(seeds))
    keyed = pages.withColumn("url", U.canonical(F.col("url")))
    ids = written(keyed.select("url", "page_id"))
    found = links_of(keyed).select("parent", "url")
    if hooks.clean:
        found = found.withColumn("url", hooks.clean(F.col("url"))).where("url IS NOT NULL").distinct()
    links = written(found)
    crawled, known, waiting, rounds = [state.crawled], [state.known], state.frontier, 0
    while (max_rounds is None or rounds < max_rounds) and not waiting.isEmpty():
        rounds += 1
        got = checkpointed(waiting.join(ids, "url"))
        crawled.append(got.select("url", "root", "depth", "page_id"))
        if hooks.done:
            hooks.done(rounds - 1, got)
        out = links.join(got.select(F.col("url").alias("parent"), "root", "depth"), "parent")
        out = out.select("url", "root", (F.col("depth") + 1).alias("depth"), "parent")
        seen = (hooks.links(out) if hooks.links else out).select("url", "root", "depth")
        fresh = checkpointed(FR.new_pages(seen, _union(known)))
        known.append(fresh.select("url"))
        kept = fresh.where(U.in_scope(F.col("url"), F.col("root"), scope) & U.scheme(F.col("url")).startswith("http"))
        for judge in (allowed, hooks.page):
            kept = judge(kept).select("url", "root", "depth") if judge else kept
        waiting = checkpointed(kept)
    return Rounds(_union(crawled), _union(known), waiting)


def _union(parts: list[DataFrame]) -> DataFrame:
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(url, depth): least number of steps from any root over edges (parent, url), until no new address is found.

    Each round writes the addresses it finds and reads those of all rounds; none is written again.
    """
    parts = [checkpointed(roots.select("url").distinct().withColumn("depth", F.lit(0)))]
    while not parts[-1].isEmpty():
        last = parts[-1].select(F.col("url").alias("parent"))
        step = edges.join(last, "parent").select("url").distinct().join(_union(parts).select("url"), "url", "left_anti")
        parts.append(checkpointed(step.withColumn("depth", F.lit(len(parts)))))
    return _union(parts)


#: Columns of a response.
RESPONSE_DDL = (
    "url string, status int, content_type string, body binary, error string, final_url string, response_ms double, download_ms double,"
    " content_bytes bigint, retry_after string, redirects int, fetched_at timestamp"
)


def fetch(frontier: DataFrame, requester: Callable[[], Callable[[str], dict]], host: Column, slots: int = 1) -> DataFrame:
    """A response row (see RESPONSE_DDL) for each page, by requesters made once a task.

    Addresses of one host are in one partition, so that a requester can keep its delay; that is a limit of
    politeness and not of the plan.  With ``slots`` above one, those of a host are spread over so many partitions whose
    requesters keep a delay that is as many times longer.  A page that fails is a row with its error.
    """

    def work(batches):
        import pandas as pd

        names = [x.split()[0] for x in RESPONSE_DDL.split(",")]
        ask = requester()
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    got = ask(url)
                except Exception as problem:  # noqa: BLE001 - a page that fails must not fail the round
                    got = {"error": type(problem).__name__}
                rows.append([url, *(got.get(n) for n in names[1:])])
            out = pd.DataFrame(rows, columns=names)
            out["fetched_at"] = pd.to_datetime(out["fetched_at"])
            yield out

    placed = frontier.select("url", host.alias("_host")).withColumn("_slot", F.pmod(F.xxhash64("url"), F.lit(slots)))
    return placed.repartition("_host", "_slot").select("url").mapInPandas(work, RESPONSE_DDL)


def repaired_responses(responses: DataFrame) -> DataFrame:
    """Responses with ``moved``: the address their page is to be judged by, where it differs from the one asked for."""
    return responses.withColumn("moved", F.when(FR.is_redirect(F.col("url"), F.col("final_url")), FR.redirect_target(F.col("url"), F.col("final_url"))))


def robots_addresses(frontier: DataFrame) -> DataFrame:
    """(url): the robots.txt of each scheme and host among addresses."""
    u = F.col("url")
    return frontier.where(U.scheme(u).isin("http", "https")).select(F.concat(U.scheme(u), F.lit("://"), U.authority(u), F.lit("/robots.txt")).alias("url")).distinct()


def robots_rules(responses: DataFrame) -> DataFrame:
    """Rules of the robots.txt files that could be had, by host; a file that is missing allows everything."""
    texts = responses.where("status = 200 AND body IS NOT NULL").select(U.host(F.col("url")).alias("host"), F.decode("body", "UTF-8").alias("text"))
    return R.rules(texts)
