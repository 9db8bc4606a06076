from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import oracles, queries
from corpusloom.operators import control as C
from corpusloom.operators import dataset as D
from corpusloom.operators import frontier as FR
from corpusloom.plans import crawl

DATA = os.environ.get("CORPUSLOOM_TESTDATA", "/root/testdata/sf0.001")


def plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "" if x is None or x is pd.NaT or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) if not hasattr(x, "__len__") or isinstance(x, str) else str(list(x)) for x in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(oracles.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    numbers = [c for c in got.columns if got[c].dtype.kind in "iuf" or want[c].dtype.kind in "iuf"]
    got[numbers], want[numbers] = got[numbers].astype(float), want[numbers].astype(float)
    assert plain(got) == plain(want)


def test_breadth_first(spark):
    pages = [
        (1, "http://h.example/", '<a href="/a">1</a><a href="b#x">2</a><a href="b">3</a><a href="http://o.test/">4</a>'),
        (2, "http://h.example/a", '<a href="/c">1</a><a href="/">2</a>'), (3, "http://h.example/b", '<a href="/c" rel="nofollow">1</a>'), (4, "http://h.example/c", ""),
    ]
    site = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    roots = spark.createDataFrame([("http://H.example:80/",)], "root string")
    done = crawl.breadth_first(site, roots)
    assert {(r.url[16:], r.depth) for r in done.crawled.collect()} == {("/", 0), ("/a", 1), ("/b", 1), ("/c", 2)}
    assert "http://o.test/" in {r.url for r in done.known.collect()}
    half = crawl.breadth_first(site, roots, max_rounds=1)
    again = crawl.breadth_first(site, roots, start=half)
    assert {r.url for r in again.crawled.collect()} == {r.url for r in done.crawled.collect()}
    robots = crawl.breadth_first(site, roots, allowed=lambda f: f.where("NOT url LIKE '%/a'"))
    assert {r.url[16:] for r in robots.crawled.collect()} == {"/", "/b"}


def test_fetch_keeps_errors(spark):
    def requester():
        def one(url):
            if url.endswith("bad"):
                raise OSError("no")
            return {"status": 200, "content_type": "text/html", "body": b"x"}

        return one

    front = spark.createDataFrame([("http://h/a",), ("http://h/bad",)], "url string")
    got = {r.url[9:]: (r.status, r.error) for r in crawl.fetch(front, requester, F.lit("h")).collect()}
    assert got == {"a": (200, None), "bad": (None, "OSError")}


def test_chains_of_any_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n60", "n3")], "parent string, url string")
    found = {r.url: r.depth for r in crawl.depths(edges, spark.createDataFrame([("n0",)], "url string")).collect()}
    assert found == {f"n{i}": i for i in range(61)}


def test_hooks_decide_and_watch(spark):
    site = spark.createDataFrame([(1, "http://h.example/", '<a href="/a?s=1">1</a><a href="/b">2</a><a href="/c">3</a>'), (2, "http://h.example/a", '<a href="/">x</a>'), (3, "http://h.example/b", "")], "page_id bigint, url string, html string")
    seen = {}
    hooks = crawl.Hooks(
        page=lambda f: f.where("url NOT LIKE '%/b'"), links=lambda f: f.where("url NOT LIKE '%/c'"), clean=lambda u: F.regexp_replace(u, r"\?.*$", ""),
        done=lambda depth, rows: seen.update({depth: rows.count()}),
    )
    done = crawl.breadth_first(site, spark.createDataFrame([("http://h.example/",)], "root string"), hooks=hooks)
    assert {r.url[16:] for r in done.crawled.collect()} == {"/", "/a"} and seen == {0: 1, 1: 1}
    assert {r.url[16:] for r in done.known.collect()} == {"/", "/a", "/b"}


@pytest.mark.parametrize(("n", "want"), [(55, (44, 5, 6)), (1, (0, 0, 1)), (10, (8, 1, 1))])
def test_split_sizes(spark, n, want):
    docs = spark.range(n).select(F.lit("s").alias("site"), F.col("id").alias("doc_id"))
    got = {r.split: r.examples for r in D.split_counts(D.with_split(docs, "site", F.md5(F.col("doc_id").cast("string")))).collect()}
    assert tuple(got.get(s, 0) for s in D.SPLITS) == want


def test_sites_need_fifty_files(spark):
    docs = spark.range(99).select(F.when(F.col("id") < 50, "big").otherwise("small").alias("site"), F.lit("fr").alias("lang"))
    assert [r.site for r in D.sites_with(docs, "site", "lang", "fr").collect()] == ["big"]


def test_card():
    card = D.dataset_card("finance", "fr", "2301", {"train": 1500, "valid": 10, "test": 11}, 99, [("b", 1, 2, 3), ("a", 4, 5, 6)])
    assert "- 1K<n<10K" in card and "num_examples: 1500" in card and card.index("| a | 4 | 5 | 6 |") < card.index("| b | 1 | 2 | 3 |")


def test_stop_order_and_reset(spark):
    pages = spark.createDataFrame([("s", i, i * 30, 0, 0, 0.0) for i in range(12)], "site string, seq int, minutes int, errors int, bytes int, pct_unique double")
    first = C.stop_events(pages, "site", "seq", C.Limits()).first()
    assert (first.seq, first.reason) == (9, "unique text")
    assert C.stop_events(pages, "site", "seq", C.Limits(max_duration=60, max_errors=0, min_unique_text=0)).count() == 0
    loose = C.stop_events(pages, "site", "seq", C.Limits(max_duration=60, max_errors=0, min_unique_text=0), strict_parity=False).first()
    assert loose.seq == 2


def test_decisions(spark):
    r = spark.range(1).select(
        FR.download_decision(F.lit(200), F.lit("text/html"), F.lit(5)).alias("ok"), FR.download_decision(F.lit(404), F.lit("text/html"), F.lit(5)).alias("status"),
        FR.links_decision(F.lit(True), F.lit(False), F.lit(1)).alias("external"), FR.redirect_target(F.lit("http://h/a/b"), F.lit("c%20#f")).alias("target"),
    ).first()
    assert (r.ok, r.status, r.external, r.target) == (None, "status", "external", "http://h/a/c")


def test_response_rules(spark):
    now = F.lit("2023-01-04 11:00:00").cast("timestamp")
    r = spark.range(1).select(
        FR.retry_after(F.lit("120"), now).alias("seconds"), FR.retry_after(F.lit("Wed, 04 Jan 2023 11:00:30 GMT"), now).alias("date"), FR.retry_after(F.lit("soon"), now).alias("none"),
        FR.aligned_scheme(F.lit("http://h/a"), F.lit("https://h/")).alias("aligned"), FR.left_host(F.lit("http://h/a"), F.lit("http://o/a")).alias("left"),
        FR.is_bot_protected(F.lit(403), F.create_map(F.lit("X-DataDome"), F.lit("x"))).alias("bot"), FR.is_bot_protected(F.lit(200), F.create_map(F.lit("X-DataDome"), F.lit("x"))).alias("no"),
    ).first()
    assert (r.seconds, r.date, r.aligned, r.left, r.bot, r.no) == (120.0, 30.0, "https://h/a", True, True, False) and r.none is None


def test_links_of_pages(spark):
    rows = [
        (1, "http://h.example/a", '<link rel=canonical href="/A"><a href="b">x</a><a href="b#y">x</a>', None), (2, "http://h.example/c", '<link rel=canonical href="/d">', "noindex"),
        (3, "http://h.example/e", '<a href="f">x</a>', "NOFOLLOW"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, tag string")
    got = sorted((r.page_id, r.url) for r in crawl.links_of(pages, robots_tag_col="tag").collect())
    assert got == [(1, "http://h.example/b"), (2, "http://h.example/d")]


@pytest.mark.parametrize("part", [3, 16, 1 << 16])
def test_sites_in_parts(spark, monkeypatch, part):
    import random

    monkeypatch.setattr(C, "PART_ROWS", max(part, C.LAST))
    rng = random.Random(part)
    rows = [(site, i * i if site == "a" else i, rng.random(), rng.randint(0, 3)) for site, n in (("a", 150), ("b", 9), (None, 40)) for i in range(n)]
    table = spark.createDataFrame(rows, "site string, seq bigint, pct_unique double, errors int").repartition(5)
    got = {(r.site, r.seq): r for r in C.with_last_mean(C.numbered(table, "site", "seq", {"run": "errors"}), "site", "pct_unique", "mean").collect()}
    assert len(got) == len(rows)
    for site in ("a", "b", None):
        own = sorted(r for r in rows if r[0] == site)
        for i, r in enumerate(own):
            tail = [x[2] for x in own[max(0, i - 9) : i + 1]]
            now = got[site, r[1]]
            assert now._rank == i + 1 and now.run == sum(x[3] for x in own[: i + 1]) and now.mean == pytest.approx(sum(tail) / len(tail))
