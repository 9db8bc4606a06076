from __future__ import annotations

import hashlib
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import robots as R
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import frontier as FR

WHITE = set("\t\n\x0b\x0c\r \x85\xa0     　") | {chr(c) for c in range(0x2000, 0x200B)}


def stats_of(text: str) -> tuple[int, int, int]:
    """Chars, words and average of a text, counted unit by unit."""
    units = len(text.encode("utf-16-le")) // 2
    words, shown = 0, 0
    inside = False
    for c in text:
        if c in WHITE:
            inside = False
        else:
            shown += 1 + (ord(c) > 0xFFFF)
            words += not inside
            inside = True
    short = bool(text) and text[-1] not in WHITE
    return units, words, (shown - short) // words if words else 0


CASES = ["a", "ab cd", "ab cd ", "", "😀", "½ Ⅷ 3", "  x y　", "l’été 2024 !", "\x1cq"]


def test_statistics(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "t string").transform(lambda d: T.with_statistics(d, "t")).collect()
    for r in rows:
        assert (r.chars, r.words, r.avg_word_length) == stats_of(r.t), r.t
    by = {r.t: r for r in rows}
    assert by["a"].avg_word_length == 0 and by["ab cd"].avg_word_length == 1 and by["ab cd "].avg_word_length == 2
    assert by["😀"].chars == 2 and by["😀"].other_chars == 2 and by["½ Ⅷ 3"].number_chars == 3


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40), min_size=1, max_size=20))
def test_statistics_add_up(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").transform(lambda d: T.with_statistics(d, "t")).collect()
    for r in rows:
        assert (r.chars, r.words, r.avg_word_length) == stats_of(r.t)
        assert r.letter_chars + r.number_chars + r.other_chars == r.chars - sum(c in WHITE for c in r.t)


def test_block_hash(spark):
    rows = spark.createDataFrame([("",), (None,)], "t string").select(T.block_hash("t").alias("h")).collect()
    assert [r.h for r in rows] == [-7356110672991926545, None]


def test_csv_and_html(spark):
    r = spark.createDataFrame([('say "x" <b>&',)], "t string").select(
        T.csv_encoded(F.col("t")).alias("c"), T.html_encoded(F.col("t")).alias("h"), T.html_decoded(T.html_encoded(F.col("t"))).alias("back")
    ).first()
    assert r.c == 'say ""x"" <b>&' and r.h == "say &quot;x&quot; &lt;b&gt;&amp;" and r.back == 'say "x" <b>&'


@pytest.mark.parametrize(
    ("url", "domain", "root", "file"),
    [
        ("http://www.a.b.com/x.y/z", "b.com", "/", "x.y/z"),
        ("http://h.org/dir/page.html", "h.org", "/dir/", "dir/page.html"),
        ("http://h/a/b?q=1", "h", "/a/b", "a/b_" + hashlib.md5(b"?q=1").hexdigest().upper()),
        ("http://h/", "h", "/", "_default_"),
        ("http://10.0.0.1:80", "10.0.0.1", "/", "_default_"),
    ],
)
def test_addresses(spark, url, domain, root, file):
    u = F.lit(url)
    r = spark.range(1).select(U.base_domain(u).alias("d"), U.root_path(U.path(u)).alias("r"), U.file_path(u).alias("f")).first()
    assert (r.d, r.r, r.f) == (domain, root, file)


def test_url_id(spark):
    urls = [f"http://h.example/{i}" for i in range(200)]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", U.url_id(F.col("u")).alias("i")).collect()
    assert all(r.i == int.from_bytes(hashlib.md5(r.u.encode()).digest()[:8], "little", signed=True) for r in rows)


HREFS = ["c.html", "../d", "../../../e", "/x?y=1", "?z", "", "//o.test/p", "./f/./g", "a/../b", "g;x=1/../y", "http://q.test/r", "..", ".", "a/b/"]


def test_resolve_like_the_standard_library(spark):
    base = "http://h.example/a/b/c.html?q=1"
    rows = spark.createDataFrame([(h,) for h in HREFS], "h string").select("h", FR.resolve(F.lit(base), F.col("h")).alias("u")).collect()
    for r in rows:
        assert r.u == urljoin(base, r.h), r.h


PATTERNS = st.text(alphabet="ab/*$.?+", min_size=1, max_size=6).map(lambda p: "/" + p)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(PATTERNS, st.text(alphabet="ab/.?+$", max_size=8).map(lambda p: "/" + p)), min_size=1, max_size=20))
def test_robots_patterns(spark, pairs):
    rows = spark.createDataFrame(pairs, "p string, t string").select("p", "t", F.rlike(F.col("t"), R.pattern_regex(F.col("p"))).alias("m")).collect()
    for r in rows:
        assert r.m == R.pattern_matches(r.p, r.t), (r.p, r.t)


def test_robots_rules(spark):
    text = "User-agent: *\nDisallow: /a\nAllow: /a/b\n"
    parsed = R.for_agent(R.rules(spark.createDataFrame([("h", text)], "host string, text string")))
    urls = spark.createDataFrame([("h", "/a/b"), ("h", "/robots.txt"), ("h", "/c"), ("other", "/a")], "host string, path string")
    got = {(r.host, r.path): r.robots_allowed for r in R.allowed(urls, parsed, F.col("host"), F.col("path")).collect()}
    assert got == {("h", "/a/b"): False, ("h", "/robots.txt"): False, ("h", "/c"): True, ("other", "/a"): True}
    more = {(r.host, r.path): r.robots_allowed for r in R.allowed(urls, parsed, F.col("host"), F.col("path"), ["/c*"]).collect()}
    assert more[("h", "/c")] is False and more[("other", "/a")] is True


def test_common_prefix(spark):
    pairs = [("abc", "abd", "ab"), ("abc", "abc", "abc"), ("x", "y", ""), ("", "y", ""), ("ab", "abc", "ab")]
    rows = spark.createDataFrame(pairs, "a string, b string, want string").select("want", U.common_prefix(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_size_category(spark):
    rows = spark.createDataFrame([(0,), (1000,), (1001,), (10**9 + 1,)], "n bigint").select(T.size_category(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == ["n<1K", "n<1K", "1K<n<10K", "1B<n<10B"]
