from __future__ import annotations

import gzip
import http.server
import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import dataset as D
from corpusloom.plans import crawl
from corpusloom.sources import files
from corpusloom.sources.http import Requester, requesters


class Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        path = self.path.partition("?")[0]
        if path.startswith("/hop"):
            n = int(path[4:])
            self.send_response(302)
            self.send_header("Location", f"/hop{n - 1}" if n > 1 else "page")
            self.end_headers()
            return
        if path == "/secret" and self.headers.get("Authorization") != "Basic dTpw":
            self.send_response(401)
            self.end_headers()
            return
        if path == "/busy":
            self.send_response(503)
            self.send_header("Retry-After", "9")
            self.end_headers()
            return
        if path == "/slow":
            time.sleep(2)
        body = {"/robots.txt": b"User-agent: *\nDisallow: /x\nCrawl-delay: 1"}.get(path, b"<p>" + b"h" * 500 + b"</p>")
        packed = gzip.compress(body)
        self.send_response(200)
        self.send_header("Content-Type", "text/html; charset=utf-8")
        self.send_header("Content-Encoding", "gzip")
        self.send_header("Content-Length", str(len(packed)))
        self.end_headers()
        self.wfile.write(packed)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_requests(site):
    ask = Requester(timeout=1)
    page = ask(f"{site}/page")
    assert page["status"] == 200 and page["content_bytes"] == 507 and page["body"].startswith(b"<p>h") and page["response_ms"] > 0 and page["download_ms"] >= 0
    assert ask(f"{site}/hop7")["status"] == 200 and ask(f"{site}/hop7")["redirects"] == 7 and ask(f"{site}/hop7")["final_url"] == f"{site}/page"
    assert ask(f"{site}/hop8")["error"] == "too many redirects"
    assert ask(f"{site}/busy")["retry_after"] == "9" and ask(f"{site}/busy")["status"] == 503
    assert "imed out" in ask(f"{site}/slow")["error"] and ask("http://127.0.0.1:1/")["error"] and ask("nonsense")["error"]
    assert ask(f"{site}/secret")["status"] == 401 and Requester(logins={"127.0.0.1": ("u", "p")})(f"{site}/secret")["status"] == 200
    assert Requester(max_bytes=10)(f"{site}/page")["error"] == "too large"


def test_a_host_is_asked_in_time(site):
    ask, began = Requester(delay=0.15), time.monotonic()
    for _ in range(3):
        ask(f"{site}/page")
    assert time.monotonic() - began >= 0.3


def test_pages_and_robots_by_rows(spark, site):
    front = spark.createDataFrame([(f"{site}/page",), (f"{site}/hop2",), (f"{site}/busy",)], "url string")
    got = crawl.repaired_responses(crawl.fetch(front, requesters(timeout=5.0), F.lit("h"))).collect()
    by = {r.url.rpartition("/")[2]: r for r in got}
    assert by["page"].status == 200 and by["page"].moved is None and by["hop2"].moved == f"{site}/page" and by["busy"].status == 503 and by["page"].fetched_at is not None
    robots = crawl.fetch(crawl.robots_addresses(front), requesters(), F.lit("h"))
    rules = {(r.kind, r.value) for r in crawl.robots_rules(robots).collect()}
    assert rules == {("disallow", "/x"), ("crawl-delay", "1")}


def test_configuration():
    p = files.CrawlParams.parse(["ROOTURL = http://h/", " scope = Path ", "MaxErrorsCount=3", "excludeurls=/x"])
    assert (p.rootUrl, p.scope, p.maxErrorsCount, p.excludeUrls) == ("http://h/", "path", 3, ("/x",))
    for bad in ("rootUrl", "rootUrl=", "nobody=1", "scope=world", "maxPageCount=many"):
        with pytest.raises(ValueError, match="value|unknown|number"):
            files.CrawlParams.parse([bad])


def test_configuration_is_appended(tmp_path):
    path = str(tmp_path / "config.txt")
    for n in (1, 2):
        files.CrawlParams.parse([f"maxPageCount={n}", "rootUrl=http://h/"]).append_to(path)
    lines = open(path).read().splitlines()
    assert sum(x.startswith("# ") for x in lines) == 2 and files.CrawlParams.parse(lines).maxPageCount == 2


def test_checkpoint_round_trip(spark, tmp_path):
    known = spark.createDataFrame([(5,), (-7,)], "url_id bigint")
    waiting = spark.createDataFrame([("http://h/\"é", 2)], "Uri string, CrawlDepth int")
    blocks = spark.createDataFrame([(9, 4), (10, 5)], "hash bigint, words int")
    files.write_checkpoint(str(tmp_path / "a" / "b"), known, waiting, blocks, {"HtmlPagesCount": 3})
    back = files.read_checkpoint(spark, str(tmp_path / "a" / "b"))
    assert sorted(r.url_id for r in back["known"].collect()) == [-7, 5] and [(r.Uri, r.CrawlDepth) for r in back["frontier"].collect()] == [("http://h/\"é", 2)]
    assert sorted((r.hash, r.words) for r in back["unique_blocks"].collect()) == [(9, 4), (10, 5)]
    files.write_checkpoint(str(tmp_path / "none"), known.limit(0), waiting.limit(0), blocks.limit(0))
    assert files.read_checkpoint(spark, str(tmp_path / "none"))["known"].count() == 0


def test_large_sites_have_more_files(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("u"), "id").alias("Uri"), F.when(F.col("id") < 90, "big").otherwise("small").alias("Website"), F.lit("train").alias("split"))
    D.write_dataset(rows, str(tmp_path / "d"), records_per_file=20)
    files_ = [p.parent.name for p in (tmp_path / "d").rglob("*.parquet")]
    assert files_.count("Website=big") >= 4 and files_.count("Website=small") == 1 and spark.read.parquet(str(tmp_path / "d")).count() == 100
