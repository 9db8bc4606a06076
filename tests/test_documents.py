from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import queries as core
from corpusloom.operators import blocks as B
from corpusloom.sources import files, html, render


def texts(page: str) -> list[tuple]:
    return [(r.elt_type, r.text, r.nesting_level) for r in html.page_rows(page)[1] if r.text is not None]


def test_blocks():
    assert texts("<div>A<div>B</div>C</div>") == [("TextBlock", "B", 1), ("TextBlock", "A C", 1)]
    assert texts("<p>foo<b>bar</b><br>x</p>") == [("TextBlock", "foo bar x", 1)]
    assert texts('<a style="display:inline-block">x</a>y') == [("TextBlock", "x", 1), ("TextBlock", "y", 1)]
    assert texts("<style>span.k{display:block}</style><span class=k>x</span>y") == [("TextBlock", "x", 1), ("TextBlock", "y", 1)]
    assert texts("<p>&amp;lt;b</p>") == [("TextBlock", "<b", 1)]


def test_hidden_and_skipped():
    assert texts('<div class="research">t</div><p aria-hidden="false">t</p><script>s</script>left') == [("TextBlock", "left", 1)]


def test_lists():
    kinds = lambda p: [r.elt_type for r in html.page_rows(p)[1] if r.cmd == "Start"]
    assert kinds("<ul><li><a>1</a></li><li><a>2</a></li></ul>")[0] == "NavigationList"
    assert kinds("<ul><li><a>1</a><b>x</b></li><li><b>2</b></li></ul>")[0] == "List"


def test_tables():
    cells = [(r.row, r.rowspan, r.col, r.colspan) for r in html.page_rows("<table><caption>c</caption><tr><td rowspan=2>a</td><td colspan=x>b</td></tr><tr><td>c</td></tr></table>")[1] if r.row and r.cmd == "Start"]
    assert cells == [(1, 2, 1, 1), (1, 1, 2, 0), (2, 1, 2, 1)]
    assert ("TextBlock", "c", 2) not in texts("<table><caption>c</caption></table>")


def test_sections():
    got = [(r.text, r.nesting_level) for r in html.page_rows("<h1>a</h1><h2>b</h2><h2>c</h2>")[1] if r.elt_type == "Section" and r.cmd == "Start"]
    assert got == [("a", 1), ("b", 2), ("c", 2)]


def test_rows_are_balanced():
    for page in ("<ul><li>a<ul><li>b", "<table><tr><td><table><tr><td>x", "<h1>a<h2>b</p></div>", "", "<<<>>>", "<p>" * 50):
        rows = html.page_rows(page)[1]
        assert [r.pos for r in rows] == list(range(len(rows)))
        assert sum(r.cmd == "Start" for r in rows) == sum(r.cmd == "End" for r in rows)


def test_deep_pages_are_read_whole(spark):
    pages = spark.createDataFrame([(1, "<div>" * 30_000 + "x"), (2, None), (3, "ok"), (4, "<ul><li>" * 3_000 + "y")], "page_id bigint, html string")
    got = {r.page_id: (r.text, r.nesting_level) for r in html.html_elements(pages).where("text IS NOT NULL OR error IS NOT NULL").collect()}
    assert got == {1: ("x", 1), 3: ("ok", 1), 4: ("y", 6_001)}


def test_wide_cells():
    cells = [(r.row, r.col) for r in html.page_rows("<table><tr><td rowspan=100000 colspan=70000>a</td><td>b</td></tr><tr><td>c</td></tr><tr></tr><tr><td>d</td></tr></table>")[1] if r.row and r.cmd == "Start"]
    assert cells == [(1, 1), (1, 70_001), (2, 70_001), (4, 70_001)]
    many = "<table>" + ("<tr>" + "<td rowspan=2>x</td>" * 3 + "</tr><tr><td>y</td></tr>") * 3 + "</table>"
    assert [(r.row, r.col) for r in html.page_rows(many)[1] if r.row and r.cmd == "Start"] == [x for k in (1, 3, 5) for x in ((k, 1), (k, 2), (k, 3), (k + 1, 4))]


def test_formatting_goes_on_and_tables_keep_to_their_cells():
    tree = html.parse("<p><b>one<p>two</b>three</p>")
    assert [n.text() for n in html.select(tree, "b")] == ["one", "two"] and html.select_first(tree, "p + p").text() == "twothree"
    moved = html.parse("<table><b>x</b>y<tr><td>cell</td></tr>z</table>after")
    body = html.select_first(moved, "body")
    assert body.text() == "xyzcellafter" and html.select_first(moved, "table").text() == "cell"
    assert texts("<table>x<tr><td>cell</td></tr></table>")[-1] == ("TextBlock", "x", 1)


def test_selectors():
    root = html.parse('<div id=d class="a b"><p>1</p><p lang=en-GB>2</p><span>3</span><p>4</p></div><p>5<a href=x>l</a></p>')
    find = lambda q: [n.text() for n in html.select(root, q)]
    assert find("div > p") == ["1", "2", "4"] and find("p + p") == ["2"] and find("p ~ p") == ["2", "4"] and find("span + p, #d > span") == ["3", "4"]
    assert find(".a.b p:first-child") == ["1"] and find("p:nth-child(2n)") == ["2", "4"] + ["5l"] and find("div :last-child") == ["4"]
    assert find("div p:not([lang])") == ["1", "4"] and find("[lang|=en]") == ["2"] and find("p:nth-of-type(3)") == ["4"] and find("a:link") == ["l"] and find("a:hover") == []
    assert html.parse_selector("p::before") is None and html.parse_selector("p:nth-child(x)") is None and html.select_first(root, "h1") is None
    assert html.parse_selector("#d .a p:first-child").weight == (1, 2, 1)


def test_media_and_external_sheets(spark):
    block = "<span class=k>x</span>y"
    one, two = [("TextBlock", "x y", 1)], [("TextBlock", "x", 1), ("TextBlock", "y", 1)]
    assert texts(f"<style>@media print{{.k{{display:block}}}}</style>{block}") == one
    assert texts(f"<style>@media screen and (min-width:1px){{.k{{display:block}}}} .z{{color:red}}</style>{block}") == two
    assert texts(f"<style media=print>.k{{display:block}}</style>{block}") == one
    assert texts(f"<style>@import 'a.css'; @supports (display:grid){{@media all{{.k{{display:block}}}}}}</style>{block}") == two
    assert texts(f"<style>@media not screen{{.k{{display:block}}}}</style>{block}") == one
    pages = spark.createDataFrame([(1, "http://h/p/", f"<link rel=stylesheet href=../s.css>{block}"), (2, "http://h/", f"<link rel=stylesheet href=gone.css>{block}"), (3, "http://h/", block)], "page_id bigint, url string, html string")
    sheets = spark.createDataFrame([("http://h/s.css", ".k{display:block}"), ("http://h/other.css", "x")], "url string, css string")
    own = html.html_elements(html.with_sheets(pages, sheets), sheets_col="sheets").where("text IS NOT NULL")
    assert {r.page_id: r.n for r in own.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {1: 2, 2: 1, 3: 1}


def test_links():
    page = '<base href="/b/"><a href=" x ">1</a><a href=y rel="NoFollow ">2</a><a>3</a><area href=z><link rel=canonical href=c>'
    assert html.page_links(page) == [(0, "anchor", "x", False), (1, "anchor", "y", True), (2, "anchor", "z", False), (3, "canonical", "c", False)]
    assert html.page_links('<meta name=robots content="NOINDEX, NOFOLLOW"><a href=x>') == [] and html.base_href(page) == "/b/"


def view(spark, pages):
    rows = html.html_elements(spark.createDataFrame(pages, "page_id bigint, html string")).withColumn("site", F.lit("s"))
    found = B.claim_unique(rows.where("text IS NOT NULL"), "site", ("page_id", "pos"), "text").select("page_id", "pos", "is_unique")
    return rows.join(found, ["page_id", "pos"], "left")


def test_unique_view(spark):
    own = view(spark, [(1, "<p>dup</p>"), (2, "<h1>X</h1><p>dup</p>"), (3, "<h1>Y</h1><p>dup</p><p>new</p>")])
    kept = {(r.page_id, r.text) for r in B.unique_view(own).where("text IS NOT NULL").collect()}
    assert kept == {(1, "dup"), (3, "Y"), (3, "dup"), (3, "new")}
    words = B.document_words(own.where("text IS NOT NULL").withColumn("words", F.lit(1)), "page_id").where("page_id = 2").first()
    assert (words.total_words, words.unique_words) == (2, 1)  # a title counts although its section is dropped


def test_unique_view_queries_cover_the_documents(spark, tmp_path):
    docs = [(1, "# X\ndup\nnew", "s"), (2, "# Y\ndup\n# Z\nother", "s"), (3, "dup", "s"), (4, "dup", "t"), (5, None, "t")]
    rows = [(i, text, source, f"http://{source}.example/{i}", f"T{i}") for i, text, source in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, uri string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {(r.page_id, r.text) for r in core.q_unique_view_pages(spark, str(tmp_path)).where("text IS NOT NULL").collect()}
    assert kept == {(1, "X"), (1, "dup"), (1, "new"), (2, "Z"), (2, "other"), (4, "dup")}
    groups = {(r.page_id, r.contains_unique) for r in core.q_group_unique_pages(spark, str(tmp_path)).collect()}
    assert groups == {(1, True), (2, False), (2, True)}
    text = {r.page_id: r.text for r in render.render_documents(B.unique_view(core._page_view(spark, str(tmp_path)))).collect()}
    assert set(text) == {1, 2, 4} and text[1] == "# X\n\ndup\n\nnew\n\n\n" and text[2].startswith("# Z")
    preview = {r.page_id: r.text for r in render.render_documents(B.unique_view(core._page_view(spark, str(tmp_path))), "html").collect()}
    assert set(preview) == {1, 2, 4} and "<h1>Z</h1>" in preview[2]


def test_claim_takes_one_of_each_text(spark):
    rows = [("a", 1, 0, "x"), ("a", 1, 1, "x"), ("a", 2, 0, "x"), ("a", 2, 1, "y"), ("b", 1, 0, "x"), (None, 3, 0, "x"), (None, 4, 0, "x")]
    got = B.claim_unique(spark.createDataFrame(rows, "source string, doc_id int, pos int, block string"), "source", ("doc_id", "pos")).where("is_unique").collect()
    assert sorted((r.source or "", r.doc_id, r.pos) for r in got) == [("", 3, 0), ("a", 1, 0), ("a", 2, 1), ("b", 1, 0)]


def test_language_of_equal_words_is_the_last(spark):
    rows = spark.createDataFrame([(1, 0, "fr", 5), (1, 1, "en", 5), (2, 0, None, 9), (2, 1, "fr", 3)], "d int, pos int, lang string, words int")
    assert {r.d: r.lang for r in B.main_language(rows, "d", ("pos",)).collect()} == {1: "en", 2: "?"}


def test_markdown():
    def tree(page):
        import pandas as pd

        rows = pd.DataFrame([{**r._asdict(), "is_unique": True} for r in html.page_rows(page)[1]]).astype(object)
        return render.forest(rows.where(rows.notna(), None))

    assert render.markdown(tree("<h1>T</h1><p>a</p>")) == "# T\n\na\n\n\n"
    assert render.markdown(tree("<ul><li>a<ul><li>b</li></ul></li></ul>")).startswith("- b\n") is False
    two = tree("<ul><li><p>a</p><p>b</p></li></ul>")
    assert "- a\nb\n" in render.markdown(two) and "- a\n    b\n" in render.markdown(two, strict_parity=False)
    assert "<h1>T</h1>" in render.html_preview(tree("<h1>T</h1><p>a</p>"), "T", "http://x")


def test_csv_roundtrip(spark, tmp_path):
    rows = view(spark, [(1, '<h1>T "q"</h1><p>a; b</p><table><tr><td>c</td></tr></table>')]).withColumn("lang", F.lit("fr")).withColumn("hash", F.lit(7).cast("bigint"))
    csv = render.csv_documents(rows).withColumn("name", F.lit("x.fr.dataframe.csv"))
    render.write_documents(csv, str(tmp_path), text="csv")
    back = files.read_elements_csv(spark, str(tmp_path)).collect()
    assert [(r.DocEltType, r.DocEltCmd) for r in back] == [(r.elt_type, r.cmd) for r in rows.orderBy("pos").collect()]
    assert back[0].Text == 'T "q"' and back[1].Text == "a; b" and back[3].Text == "1,1"


def test_legacy_errors(spark):
    import pytest

    bad = spark.createDataFrame([(1, "## what is this")], "doc_id int, text string")
    with pytest.raises(Exception, match="malformed line"):
        files.parse_legacy(bad).collect()


def test_params():
    p = files.CrawlParams.parse(["# c", "scope=path", "rootUrl=http://h/?a=1", "excludeUrls=/x", "maxErrorsCount=3", "excludeUrls=/y"])
    assert p.scope == "path" and p.rootUrl == "http://h/?a" and p.excludeUrls == ("/x", "/y") and p.maxErrorsCount == 3
    assert files.CrawlParams.parse(["scope=domain"], p).excludeUrls == () and files.CrawlParams.parse(p.lines()) == p


def test_checkpoint_files(spark, tmp_path):
    (tmp_path / "crawledUrls.json").write_text('{"UrlRepository": {"5": 0, "-7": 0}}')
    (tmp_path / "pagesToCrawl.json").write_text('{"UrlQueue": [{"Uri": "http://h/", "CrawlDepth": 2}]}')
    (tmp_path / "uniqueTextBlocks.json").write_text('{"9": 4}')
    got = files.read_checkpoint(spark, str(tmp_path))
    assert sorted(r.url_id for r in got["known"].collect()) == [-7, 5]
    assert [(r.Uri, r.CrawlDepth) for r in got["frontier"].collect()] == [("http://h/", 2)]
    assert [(r.hash, r.words) for r in got["unique_blocks"].collect()] == [(9, 4)]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.fr.text.md").write_text("# T\n\nx\n")
    got = files.read_markdown(spark, str(tmp_path)).collect()
    assert [(r.lang, r.text) for r in got] == [("fr", "# T\n\nx\n")]


def test_groups_that_only_their_nesting_ends(spark):
    rows = [(1, 0, "Section", "Start", 1, "a", True), (1, 1, "Section", "Start", 2, "b", True), (1, 2, "TextBlock", "Text", 3, "x", False), (1, 5, "TextBlock", "Text", 2, "y", True), (1, 6, "TextBlock", "Text", 1, "z", False), (2, 0, "TextBlock", "Text", 1, "w", None)]
    table = spark.createDataFrame(rows, "page_id bigint, pos int, elt_type string, cmd string, nesting_level int, text string, is_unique boolean").repartition(3)
    tree = B.implied_tree(table)
    got = [(r.pos, r.origin, r.cmd, r.nesting_level, r.path) for r in tree.where("page_id = 1").orderBy("pos").collect()]
    assert got == [(0, 0, "Start", 1, []), (1, 1, "Start", 2, [0]), (2, 2, "Text", 3, [0, 1]), (3, None, "End", 2, [0]), (4, 5, "Text", 2, [0]), (5, None, "End", 1, []), (6, 6, "Text", 1, [])]
    assert {(r.pos, r.contains_unique) for r in B.group_unique(tree).collect()} == {(0, True), (1, False)}
    assert {r.origin for r in B.unique_view(tree).where("cmd <> 'End'").collect()} == {0, 5} and B.implied_tree(table.limit(0)).count() == 0
