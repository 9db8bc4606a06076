"""Queries over the reference's own operators, each over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import robots as R
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.operators import blocks as B
from corpusloom.operators import control as C
from corpusloom.operators import dataset as D
from corpusloom.operators import frontier as FR
from corpusloom.plans import crawl
from corpusloom.sources import files, html, render
from corpusloom.storage import checkpointed, shared_folder, spread
from corpusloom.streaming import unique as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _docs(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "documents")


def _requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests of the log, exact duplicates removed."""
    return _table(spark, path, "request_log").dropDuplicates(["request_id"])


def _elements(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "text_elements").dropDuplicates(["element_id"])


# ---- text statistics ----


@query
def q_text_stats(spark: SparkSession, path: str) -> DataFrame:
    return T.with_statistics(spread(_docs(spark, path).select("doc_id", "text"))).select("doc_id", *T.STATISTICS)


@query
def q_avg_word_len(spark: SparkSession, path: str) -> DataFrame:
    text = F.col("text")
    return spread(_docs(spark, path).select("doc_id", "text")).select("doc_id", T.average_word_length(text).alias("strict"), T.average_word_length(text, False).alias("plain"))


@query
def q_element_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of every element text, beside the ones the table holds."""
    own = _elements(spark, path).where("text IS NOT NULL")
    return T.with_statistics(own.select("element_id", "text")).select("element_id", *T.STATISTICS)


@query
def q_block_hash(spark: SparkSession, path: str) -> DataFrame:
    return _elements(spark, path).where("hashcode IS NOT NULL").select("element_id", T.block_hash("text").alias("hash"))


@query
def q_element_hash(spark: SparkSession, path: str) -> DataFrame:
    """Hash of each element's text as the elements table holds it: the number that also identifies addresses."""
    return _elements(spark, path).where("hashcode IS NOT NULL").select("element_id", U.url_id(F.col("text")).alias("hash"))


@query
def q_csv_field(spark: SparkSession, path: str) -> DataFrame:
    line = F.concat(F.lit('Document;Title;1;"'), T.csv_encoded(F.col("title")), F.lit('";fr;1;1;1;1;0;0;0;True'))
    return _docs(spark, path).where("title IS NOT NULL").select("doc_id", T.csv_decoded(line).alias("title"))


@query
def q_html_encode(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).where("text IS NOT NULL").select("doc_id", F.md5(T.html_encoded(F.col("text"))).alias("digest"))


@query
def q_output_name(spark: SparkSession, path: str) -> DataFrame:
    lang = F.when(F.col("lang").rlike("^[a-z]{2}$"), F.col("lang")).otherwise("?")
    return _docs(spark, path).select("doc_id", T.output_name(U.file_path(F.col("uri")), lang, ".text.md").alias("name"))


@query
def q_size_category(spark: SparkSession, path: str) -> DataFrame:
    counts = _docs(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("source", T.size_category(F.col("n")).alias("one"), T.size_category(F.col("n") * 1000).alias("thousand"), T.size_category(F.col("n") * 10_000_000).alias("many"))


@query
def q_lang_accept(spark: SparkSession, path: str) -> DataFrame:
    """Labels of the elements with the share of letters in their text as score: those above the threshold are accepted."""
    own = _elements(spark, path).where("hashcode IS NOT NULL")
    score = F.col("letterchars") / F.when(F.col("chars") > 0, F.col("chars"))
    return own.select("element_id", T.accepted_language(F.concat(F.lit("__label__"), "lang"), score).alias("accepted"))


@query
def q_cell_coords(spark: SparkSession, path: str) -> DataFrame:
    """Coordinates of cells at the place of each element, with spans of its numbers."""
    own = _elements(spark, path).where("words IS NOT NULL")
    row, col = F.col("pos") + 1, F.col("nestinglevel") + 1
    return own.select("element_id", T.cell_coordinates(row, F.col("words") % 3 + 1, col, F.col("numberchars") % 2 + 1).alias("coords"))


# ---- addresses ----


@query
def q_url_parts(spark: SparkSession, path: str) -> DataFrame:
    u = F.col("uri")
    return _docs(spark, path).select("doc_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"))


@query
def q_base_domain(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).select("doc_id", U.base_domain(F.col("uri")).alias("domain"))


@query
def q_subdomain(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).select("doc_id", U.sub_domain(F.col("uri")).alias("host"))


@query
def q_root_path(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).select("doc_id", U.root_path(U.path(F.col("uri"))).alias("root_path"))


@query
def q_site_dir(spark: SparkSession, path: str) -> DataFrame:
    return files.effective_config(_table(spark, path, "websites")).select("root_id", U.site_directory(F.col("rooturl"), F.col("crawl_scope")).alias("directory"))


@query
def q_file_path(spark: SparkSession, path: str) -> DataFrame:
    return _requests(spark, path).select("request_id", U.file_path(F.col("url")).alias("file"))


@query
def q_is_pdf(spark: SparkSession, path: str) -> DataFrame:
    return _docs(spark, path).select("doc_id", U.is_pdf(F.col("uri")).alias("pdf"))


@query
def q_url_id(spark: SparkSession, path: str) -> DataFrame:
    return _requests(spark, path).select("request_id", U.url_id(F.col("url")).alias("url_id"))


def _scoped(spark: SparkSession, path: str, scope: str) -> DataFrame:
    docs = _docs(spark, path).where("rooturl IS NOT NULL")
    return docs.select("doc_id", U.in_scope(F.col("uri"), F.col("rooturl"), scope).alias("inside"))


@query
def q_scope_domain(spark: SparkSession, path: str) -> DataFrame:
    return _scoped(spark, path, "domain")


@query
def q_scope_subdomain(spark: SparkSession, path: str) -> DataFrame:
    return _scoped(spark, path, "subdomain")


@query
def q_scope_path(spark: SparkSession, path: str) -> DataFrame:
    return _scoped(spark, path, "path")


# ---- blocks and uniqueness ----


def _units(spark: SparkSession, path: str) -> DataFrame:
    blocks = B.explode_blocks(spread(_docs(spark, path).select("doc_id", "source", "text")), keep=("source",))
    return B.claim_unique(blocks, "source", ("doc_id", "pos")).withColumn("words", T.words(F.col("block")))


def _doc_words(spark: SparkSession, path: str) -> DataFrame:
    units = _units(spark, path)
    return B.document_words(units.select("source", "doc_id", "words", "is_unique").withColumn("doc_id", F.struct("source", "doc_id"))).select("doc_id.*", "total_words", "unique_words", "pct_unique")


@query
def q_block_explode(spark: SparkSession, path: str) -> DataFrame:
    return B.explode_blocks(_docs(spark, path), keep=()).select("doc_id", "pos", "block")


@query
def q_block_dedup(spark: SparkSession, path: str) -> DataFrame:
    return _units(spark, path).select("doc_id", "pos", "is_unique")


@query
def q_doc_words(spark: SparkSession, path: str) -> DataFrame:
    return _doc_words(spark, path).select("doc_id", "total_words", "unique_words")


@query
def q_pct_unique(spark: SparkSession, path: str) -> DataFrame:
    return _doc_words(spark, path).select("doc_id", F.round("pct_unique", 6).alias("pct_unique"))


@query
def q_keep_docs(spark: SparkSession, path: str) -> DataFrame:
    return B.keep_documents(_doc_words(spark, path)).select("doc_id")


@query
def q_unique10(spark: SparkSession, path: str) -> DataFrame:
    last = C.unique_last(_doc_words(spark, path), "source", "doc_id")
    return last.select("doc_id", F.round("unique_last", 6).alias("unique_last"))


@query
def q_doc_quality(spark: SparkSession, path: str) -> DataFrame:
    """Flagship: blocks, statistics, site-wide claim, words, share of unique text, kept documents."""
    kept = C.unique_last(B.keep_documents(_doc_words(spark, path)), "source", "doc_id")
    return kept.select("source", "doc_id", "total_words", "unique_words", F.round("pct_unique", 6).alias("pct_unique"), F.round("unique_last", 6).alias("unique_last"))


@query
def q_words_by_lang(spark: SparkSession, path: str) -> DataFrame:
    return B.words_by_language(_elements(spark, path).where("words IS NOT NULL"), "doc_id")


@query
def q_words_metadata(spark: SparkSession, path: str) -> DataFrame:
    by = B.words_by_language(_elements(spark, path).where("words IS NOT NULL"), "doc_id")
    return B.metadata_words(by, "doc_id").select("doc_id", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("metadata"))


@query
def q_doc_language(spark: SparkSession, path: str) -> DataFrame:
    return B.main_language(_elements(spark, path).where("words IS NOT NULL"), "doc_id", ("pos",))


@query
def q_element_unique(spark: SparkSession, path: str) -> DataFrame:
    """First occurrence of each text in a website and crawl session, from the texts alone."""
    own = _elements(spark, path).where("hashcode IS NOT NULL").withColumn("site", F.concat_ws("/", "website", F.col("crawl_session").cast("string")))
    return B.claim_unique(own.select("site", "element_id", "doc_id", "pos", "text"), "site", ("doc_id", "pos"), "text").select("element_id", "is_unique")


# ---- crawl control ----


def _pages(spark: SparkSession, path: str) -> DataFrame:
    log = _requests(spark, path).where("website IS NOT NULL AND clock IS NOT NULL")
    log = log.join(log.groupBy("website").agg(F.min("clock").alias("began")), "website")
    minutes = F.floor((F.unix_timestamp(F.col("clock").cast("timestamp")) - F.unix_timestamp(F.col("began").cast("timestamp"))) / 60)
    return log.select(
        "website", "request_id", "url", minutes.alias("minutes"), FR.is_crawl_error(F.col("status_code"), F.col("error_message")).cast("int").alias("errors"),
        F.coalesce("content_bytes", F.lit(0)).alias("bytes"), (F.coalesce("unique_pct", F.lit(0.0)) / 100).alias("pct_unique"),
    )


@query
def q_stop_condition(spark: SparkSession, path: str) -> DataFrame:
    return C.stop_events(_pages(spark, path), "website", "request_id", C.Limits(max_page_count=200, max_errors=10, min_unique_text=5, max_size_on_disk=20))


@query
def q_stop_duration(spark: SparkSession, path: str) -> DataFrame:
    return C.stop_events(_pages(spark, path), "website", "request_id", C.Limits(max_duration=50, max_errors=0, min_unique_text=0))


@query
def q_zip_low_unique(spark: SparkSession, path: str) -> DataFrame:
    return C.low_unique(_pages(spark, path), "website", "request_id", 40)


@query
def q_lcp_exclude(spark: SparkSession, path: str) -> DataFrame:
    return C.excluded_prefix(C.low_unique(_pages(spark, path), "website", "request_id", 40), "website")


@query
def q_status(spark: SparkSession, path: str) -> DataFrame:
    log = _requests(spark, path).select(
        "website", (F.coalesce(F.col("status_code") == 200, F.lit(False)) & F.col("error_message").isNull()).alias("ok"), U.is_pdf(F.col("url")).alias("pdf"),
        FR.is_crawl_error(F.col("status_code"), F.col("error_message")).alias("error"), F.col("content_bytes").alias("bytes"), F.col("response_ms").alias("ms"),
    )
    out = C.counters(log, "website").withColumn("excluded", C.excluded_count(F.col("analyzed"), F.col("html"), F.col("pdf"), F.col("errors"), F.lit(0)))
    return out.withColumn("ms", F.round("ms", 1)).withColumn("took", C.clock_text(F.col("ms") / 1000))


@query
def q_request_log(spark: SparkSession, path: str) -> DataFrame:
    """The request log with its thirteen columns."""
    return C.request_log_rows(_requests(spark, path), "request_id")


@query
def q_exceptions_log(spark: SparkSession, path: str) -> DataFrame:
    return C.exceptions_log(_requests(spark, path), "request_id")


@query
def q_internal_uri(spark: SparkSession, path: str) -> DataFrame:
    """Requests that belong to the crawl of their website, as it was asked for or as it moved."""
    log = _requests(spark, path).where("website IS NOT NULL")
    root = F.concat(F.lit("http://"), F.col("website"), F.lit("/"))
    moved = F.coalesce("redirected_from", F.col("parent_url"))
    return log.select("request_id", FR.is_internal(F.col("url"), root, moved, "subdomain").alias("internal"))


@query
def q_crawl_errors(spark: SparkSession, path: str) -> DataFrame:
    return _requests(spark, path).select("request_id", FR.is_crawl_error(F.col("status_code"), F.col("error_message")).alias("error"))


@query
def q_crawl_decision(spark: SparkSession, path: str) -> DataFrame:
    log = _requests(spark, path)
    internal = F.coalesce(U.host(F.col("url")) == F.col("website"), F.lit(False))
    redirects = F.when(F.col("redirected_from").isNull(), 0).otherwise(F.col("retry_count") + 1)
    return log.select("request_id", FR.crawl_decision(F.col("url"), F.col("crawl_depth"), redirects, internal, F.lit(0), F.lit(0), max_depth=8, max_redirects=1).alias("reason"))


@query
def q_download_decision(spark: SparkSession, path: str) -> DataFrame:
    kind = F.when(U.is_pdf(F.col("url")), "application/pdf").when(F.lower("url").rlike(r"\.(png|jpe?g|gif|css|js)$"), "image/png").otherwise("text/html; charset=utf-8")
    log = _requests(spark, path)
    return log.select("request_id", FR.download_decision(F.col("status_code"), kind, F.col("content_bytes"), 25_000).alias("reason"), FR.content_kind(kind).alias("kind"))


@query
def q_content_type(spark: SparkSession, path: str) -> DataFrame:
    """Kinds of the documents by the type that their address names."""
    kind = F.when(F.col("pdf"), F.lit(" Application/PDF")).otherwise(F.lit("TEXT/html; charset=utf-8"))
    return _docs(spark, path).select("doc_id", FR.content_kind(kind).alias("kind"), FR.is_downloadable(kind).alias("taken"))


def _bodies(spark: SparkSession, path: str) -> DataFrame:
    """Texts of documents as bytes of three encodings, named by the header, by a meta tag, and by neither."""
    turn, text = F.col("doc_id") % 3, F.col("text")
    tagged = F.concat(F.lit('<meta charset="utf-8">'), text)
    body = F.when(turn == 0, F.encode(text, "UTF-16LE")).when(turn == 1, F.encode(tagged, "UTF-8")).otherwise(F.encode(text, "UTF-8"))
    kind = F.when(turn == 0, F.lit("text/html; charset=UTF-16LE")).otherwise(F.lit("text/html"))
    return _docs(spark, path).where("text IS NOT NULL").select("doc_id", body.alias("body"), kind.alias("type"))


@query
def q_charset_detect(spark: SparkSession, path: str) -> DataFrame:
    head = F.decode(F.substring("body", 1, 2048), "ISO-8859-1")
    return _bodies(spark, path).select("doc_id", FR.charset(F.col("type"), head).alias("charset"))


@query
def q_charset_decode(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the texts of all documents, decoded from bytes of the encoding that was found."""
    text = FR.decoded(F.col("body"), F.col("type"))
    return _bodies(spark, path).select("doc_id", F.md5(text).alias("digest"))


@query
def q_recrawl(spark: SparkSession, path: str) -> DataFrame:
    """Failed requests that may be tried again."""
    failed = FR.is_crawl_error(F.col("status_code"), F.col("error_message"))
    return _requests(spark, path).select("request_id", FR.recrawl_decision(failed, F.col("retry_count"), 3).alias("again"))


@query
def q_retry_after(spark: SparkSession, path: str) -> DataFrame:
    """Seconds to wait by headers made of the log: numbers, and dates so many seconds after the request."""
    log = _requests(spark, path).where("clock IS NOT NULL AND retry_after_s IS NOT NULL")
    seconds, now = F.col("retry_after_s").cast("int"), F.col("clock").cast("timestamp")
    date = F.date_format(now + F.make_dt_interval(secs=seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = F.when(F.col("request_id") % 2 == 0, seconds.cast("string")).otherwise(date)
    return log.select("request_id", FR.retry_after(header, now).alias("seconds"))


@query
def q_links_decision(spark: SparkSession, path: str) -> DataFrame:
    internal = F.coalesce(U.host(F.col("url")) == F.col("website"), F.lit(False))
    return _requests(spark, path).select("request_id", FR.links_decision(F.coalesce("content_bytes", F.lit(0)) > 0, internal, F.col("crawl_depth"), 3).alias("reason"))


@query
def q_response_place(spark: SparkSession, path: str) -> DataFrame:
    """Redirected requests: whether they left their host, where a relative target leads, and the address under the scheme of the root."""
    log = _requests(spark, path).where("redirected_from IS NOT NULL AND url IS NOT NULL AND website IS NOT NULL")
    location = F.concat(U.path(F.col("url")), F.lit("%20#part"))
    return log.select(
        "request_id", FR.left_host(F.col("redirected_from"), F.col("url")).alias("left"), FR.redirect_target(F.col("redirected_from"), location).alias("target"),
        FR.aligned_scheme(F.col("url"), F.concat(F.lit("https://"), "website")).alias("aligned"),
    )


@query
def q_bot_protected(spark: SparkSession, path: str) -> DataFrame:
    """Responses of a bot protection among those of the log, every fourth of which carries its header."""
    headers = F.when(F.col("request_id") % 4 == 0, F.create_map(F.lit("X-DataDome"), F.lit("1"))).otherwise(F.create_map(F.lit("Server"), F.lit("x")))
    return _requests(spark, path).select("request_id", FR.is_bot_protected(F.col("status_code"), headers).alias("protected"))


@query
def q_refilter(spark: SparkSession, path: str) -> DataFrame:
    """Waiting pages that the present configuration still allows."""
    judged = q_robots_allowed(spark, path)
    return FR.refilter(judged, F.col("robots_allowed")).select("request_id")


@query
def q_crawl_by_domain(spark: SparkSession, path: str) -> DataFrame:
    return _requests(spark, path).groupBy(U.authority(F.col("url")).alias("authority")).agg(F.count(F.lit(1)).alias("pages"), F.max("crawl_depth").alias("deepest"))


@query
def q_max_links(spark: SparkSession, path: str) -> DataFrame:
    return FR.limit_links(_requests(spark, path).where("parent_url IS NOT NULL").select("parent_url", "request_id", "url"), "parent_url", "request_id", 10)


@query
def q_frontier_antijoin(spark: SparkSession, path: str) -> DataFrame:
    log = _requests(spark, path)
    return FR.new_pages(log.where("parent_url IS NOT NULL").select(F.col("parent_url").alias("url")), log.select("url")).select("url")


@query
def q_bfs_depth(spark: SparkSession, path: str) -> DataFrame:
    log = _requests(spark, path).where("parent_url IS NOT NULL")
    roots = log.select(F.col("parent_url").alias("url")).join(log.select("url"), "url", "left_anti").distinct()
    return crawl.depths(log.select(F.col("parent_url").alias("parent"), "url").distinct(), roots)


@query
def q_redirects(spark: SparkSession, path: str) -> DataFrame:
    log = _requests(spark, path).where("redirected_from IS NOT NULL")
    return log.select("request_id", FR.is_redirect(F.col("redirected_from"), F.col("url")).alias("redirect"))


@query
def q_links(spark: SparkSession, path: str) -> DataFrame:
    """Targets of the Markdown links of documents, in order."""
    found = F.regexp_extract_all("text", F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))
    return _docs(spark, path).where("text IS NOT NULL").select("doc_id", F.posexplode(found).alias("pos", "url"))


@query
def q_links_abs(spark: SparkSession, path: str) -> DataFrame:
    """Paths of all requests as links from the pages they were found on."""
    log = _requests(spark, path).where("parent_url IS NOT NULL AND url IS NOT NULL")
    relative = F.concat(F.lit("../x/./"), F.col("request_id").cast("string"), F.lit(".html?a=1#f"))
    return log.select("request_id", FR.resolve(F.col("parent_url"), U.path(F.col("url"))).alias("url"), FR.resolve(F.concat(F.lit("http://h.test/a/b/"), F.col("request_id")), relative).alias("up"))


# ---- robots ----


@query
def q_robots_allowed(spark: SparkSession, path: str) -> DataFrame:
    """Requests against the exclusion patterns of their website's configuration."""
    config = files.effective_config(_table(spark, path, "websites")).where("website IS NOT NULL")
    rules = config.select(F.col("website").alias("host"), F.explode("excludeurls").alias("value")).select("host", F.lit("disallow").alias("kind"), "value")
    target = F.concat(U.path(F.col("url")), F.when(U.query(F.col("url")) != "", F.concat(F.lit("?"), U.query(F.col("url")))).otherwise(F.lit("")))
    return R.allowed(_requests(spark, path), rules, U.host(F.col("url")), target).select("request_id", "robots_allowed")


def _robots_files(spark: SparkSession, path: str) -> DataFrame:
    """A robots.txt for each configured root: its exclusions for every agent, its delay, and rules for another agent."""
    config = files.effective_config(_table(spark, path, "websites")).where("website IS NOT NULL")
    rules = F.transform(F.coalesce("excludeurls", F.array().cast("array<string>")), lambda x: F.concat(F.lit("Disallow: "), x, F.lit(" # own")))
    delay = F.concat(F.lit("Crawl-delay: "), F.coalesce(F.col("mincrawldelay").cast("string"), F.lit("none")))
    lines = F.concat(F.array(F.lit("# rules"), F.lit("User-agent: *")), rules, F.array(delay, F.lit(""), F.lit("User-agent: other"), F.lit("Disallow: /"), F.concat(F.lit("Sitemap: "), "rooturl")))
    return config.where("rooturl IS NOT NULL").select(F.col("root_id").cast("string").alias("host"), F.array_join(lines, "\r\n").alias("text"))


@query
def q_robots_match(spark: SparkSession, path: str) -> DataFrame:
    """Each request against each exclusion of its website."""
    config = files.effective_config(_table(spark, path, "websites")).where("website IS NOT NULL")
    patterns = config.select("website", F.explode("excludeurls").alias("pattern")).distinct()
    log = _requests(spark, path).select("request_id", "website", U.path(F.col("url")).alias("target"))
    return log.join(patterns, "website").select("request_id", "pattern", F.rlike(F.col("target"), R.pattern_regex(F.col("pattern"))).alias("match"))


@query
def q_robots_parse(spark: SparkSession, path: str) -> DataFrame:
    return R.rules(_robots_files(spark, path))


@query
def q_robots_delay(spark: SparkSession, path: str) -> DataFrame:
    return R.crawl_delay(R.for_agent(R.rules(_robots_files(spark, path)), "nobody"))


# ---- dataset ----


@query
def q_site_lang_counts(spark: SparkSession, path: str) -> DataFrame:
    return D.language_counts(_docs(spark, path), "source", "lang")


@query
def q_site_lang_min(spark: SparkSession, path: str) -> DataFrame:
    return D.sites_with(_docs(spark, path), "source", "lang", "fr")


@query
def q_split(spark: SparkSession, path: str) -> DataFrame:
    return D.with_split(_docs(spark, path).select("source", "doc_id"), "source", F.md5(F.col("doc_id").cast("string"))).select("doc_id", "split")


@query
def q_split_counts(spark: SparkSession, path: str) -> DataFrame:
    return D.split_counts(q_split(spark, path))


@query
def q_website_table(spark: SparkSession, path: str) -> DataFrame:
    rows = _table(spark, path, "dataset_records").dropDuplicates(["record_id"])
    return D.website_summary(rows.withColumn("site", F.lower("website")), "site", U.is_pdf(F.col("uri")), F.col("words"))


@query
def q_records(spark: SparkSession, path: str) -> DataFrame:
    """Dataset records made anew from the documents, without the text itself."""
    made = D.records(spread(_docs(spark, path).where("text IS NOT NULL")), "uri", F.col("crawled_at"), "lang", "title", "text", "source")
    return made.select("Uri", "Timestamp", "Lang", "Title", F.md5("Text").alias("Digest"), "Words", "AvgWordsLength", "Chars", "LetterChars", "NumberChars", "OtherChars", "Website", "PDF")


@query
def q_parquet_roundtrip(spark: SparkSession, path: str) -> DataFrame:
    """Records written by split and website, and read again."""
    made = D.records(spread(_docs(spark, path).where("text IS NOT NULL")), "uri", F.col("crawled_at"), "lang", "title", "text", "source")
    split = D.with_split(made, "Website", F.md5("Uri"), id_col="Uri")
    folder = f"{shared_folder(spark)}/dataset-{spark.sparkContext.applicationId}-{abs(hash(path)) % 10**8}"
    D.write_dataset(split, folder)
    back = spark.read.parquet(folder)
    return back.groupBy(F.col("Website").cast("string").alias("website"), "split").agg(F.count(F.lit(1)).alias("n"), F.sum("Words").alias("words"), F.count_if("PDF").alias("pdf"))


@query
def q_crawl_time(spark: SparkSession, path: str) -> DataFrame:
    """Crawl times of both notations, and whether the month of a record fits."""
    rows = _table(spark, path, "dataset_records").dropDuplicates(["record_id"])
    one = F.expr("try_to_timestamp(crawl_time, 'MM/dd/yyyy HH:mm:ss')")
    two = F.expr("try_to_timestamp(crawl_time, \"yyyy-MM-dd'T'HH:mm:ss\")")
    when = F.coalesce(one, two)
    return rows.select("record_id", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("crawled"), (F.date_format(when, "yyMM") == F.col("year_month")).alias("fits"))


@query
def q_effective_config(spark: SparkSession, path: str) -> DataFrame:
    return files.effective_config(_table(spark, path, "websites")).select("root_id", "website", "crawl_scope", "maxpagecount", "minuniquetext", F.array_join("excludeurls", ",").alias("excludes"))


# ---- documents as HTML, Markdown and CSV ----


def _html_pages(spark: SparkSession, path: str) -> DataFrame:
    """Documents as pages: headings, items and paragraphs of their lines."""
    line = lambda x: T.html_encoded(T.trimmed(x))
    tagged = F.transform(
        F.split("text", "\n", -1),
        lambda x: F.when(T.trimmed(x) == "", "").when(T.trimmed(x).startswith("# "), F.concat(F.lit("<h1>"), line(F.regexp_replace(T.trimmed(x), "^# ", "")), F.lit("</h1>")))
        .otherwise(F.concat(F.lit("<p>"), line(x))),
    )
    body = F.concat(F.lit("<html><head><title>"), T.html_encoded(F.coalesce("title", F.lit(""))), F.lit("</title><style>p{margin:0}</style></head><body>"), F.array_join(tagged, "\n"))
    return _docs(spark, path).where("text IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.col("uri").alias("url"), body.alias("html"))


@query
def q_html_blocks(spark: SparkSession, path: str) -> DataFrame:
    rows = html.html_elements(_html_pages(spark, path)).where("text IS NOT NULL")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("elt_type") == "Section").alias("sections"))


@query
def q_html_title(spark: SparkSession, path: str) -> DataFrame:
    return html.html_elements(_html_pages(spark, path)).where("title IS NOT NULL").groupBy("page_id").agg(F.max("title").alias("title"))


@query
def q_html_elements(spark: SparkSession, path: str) -> DataFrame:
    return html.html_elements(_html_pages(spark, path)).select("page_id", "pos", "elt_type", "cmd", "nesting_level", "text", F.size("path").alias("depth"))


def _built_pages(spark: SparkSession, path: str, build) -> DataFrame:
    """Pages of all documents whose body ``build`` makes of the array of their trimmed lines that are not blank."""
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: T.trimmed(x)), lambda x: x != "")
    rows = _docs(spark, path).where("text IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.col("uri").alias("url"), lines.alias("lines"))
    return rows.select("page_id", "url", F.concat(F.lit("<body>"), F.array_join(build(F.col("lines")), "")).alias("html"))


@query
def q_html_tables(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the Markdown tables of documents, made into tables whose first cell spans two rows."""
    cell = lambda x, i: F.concat(F.when(i == 0, F.lit("<td rowspan=2>")).otherwise(F.lit("<td>")), T.html_encoded(T.trimmed(x)))
    row = lambda x: F.concat(F.lit("<table><tr>"), F.array_join(F.transform(F.split(F.btrim(x, F.lit("|")), r"\|", -1), cell), ""), F.lit("<tr><td>x</table>"))
    pages = _built_pages(spark, path, lambda a: F.transform(F.filter(a, lambda x: x.rlike(r"(?s)^\|.*\|$")), row))
    rows = html.html_elements(pages).where("`row` IS NOT NULL AND cmd = 'Start'")
    return rows.groupBy("page_id", T.cell_coordinates(F.col("row"), F.col("rowspan"), F.col("col"), F.col("colspan")).alias("coords")).agg(F.count(F.lit(1)).alias("cells"))


@query
def q_html_lists(spark: SparkSession, path: str) -> DataFrame:
    """Items of the lists of documents, in one list a page."""
    pages = _built_pages(spark, path, lambda a: F.concat(F.array(F.lit("<ul>")), F.transform(F.filter(a, lambda x: x.rlike("^- .")), lambda x: F.concat(F.lit("<li>"), T.html_encoded(F.substring(x, F.lit(3), F.length(x)))))))
    return html.html_elements(pages).where("elt_type = 'ListItem' AND cmd = 'Start'").groupBy("page_id").agg(F.count(F.lit(1)).alias("items"), F.max("nesting_level").alias("level"))


@query
def q_nav_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lists of the exclusions of each root: of links alone they are for navigation, with bold items they are not."""
    config = files.effective_config(_table(spark, path, "websites")).where("size(excludeurls) > 0")
    tag = F.when(F.col("root_id") % 2 == 0, F.lit("a")).otherwise(F.lit("b"))
    items = F.transform("excludeurls", lambda x: F.concat(F.lit("<li><"), tag, F.lit(">"), x, F.lit("</"), tag, F.lit(">")))
    pages = config.select(F.col("root_id").cast("bigint").alias("page_id"), F.concat(F.lit("<ul>"), F.array_join(items, "")).alias("html"))
    return html.html_elements(pages).where("cmd = 'Start' AND elt_type LIKE '%List'").select("page_id", "elt_type", F.lit(1).alias("lists"))


@query
def q_html_hidden(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of documents of which every third one is hidden by its class, and every fifth one by an attribute."""
    mark = lambda i: F.when(i % 3 == 2, F.lit("<p class='is-hidden x'>")).when(i % 5 == 4, F.lit("<p aria-hidden=false>")).otherwise(F.lit("<p>"))
    pages = _built_pages(spark, path, lambda a: F.transform(a, lambda x, i: F.concat(mark(i), T.html_encoded(x))))
    rows = html.html_elements(pages).where("elt_type = 'TextBlock'")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("shown"), F.min("nesting_level").alias("level"))


@query
def q_html_sections(spark: SparkSession, path: str) -> DataFrame:
    """Nesting of the headings of documents as headings of one body, behind a first line of text."""
    level = lambda x: F.length(F.regexp_extract(x, "^(#{1,6}) ", 1)).cast("string")
    made = lambda x: F.concat(F.lit("<h"), level(x), F.lit(">"), T.html_encoded(F.regexp_replace(x, "^#+ ", "")), F.lit("</h"), level(x), F.lit(">"))
    pages = _built_pages(spark, path, lambda a: F.concat(F.array(F.lit("<p>start</p>")), F.transform(F.filter(a, lambda x: x.rlike("^#{1,6} [^#]")), made)))
    rows = html.html_elements(pages).where("elt_type = 'Section' AND cmd = 'Start'")
    return rows.groupBy("page_id", "nesting_level").agg(F.count(F.lit(1)).alias("sections"))


@query
def q_links_nofollow(spark: SparkSession, path: str) -> DataFrame:
    """Links of documents as anchors of a page, of which every second one is not to be followed."""
    found = F.regexp_extract_all("text", F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))
    anchor = F.transform(found, lambda x, i: F.concat(F.when(i % 2 == 1, F.lit('<a rel="NoFollow " href="')).otherwise(F.lit('<a href="')), T.html_encoded(x), F.lit('">x</a>')))
    pages = _docs(spark, path).where("text IS NOT NULL").select(F.col("doc_id").alias("page_id"), F.col("uri").alias("url"), F.array_join(anchor, "").alias("html"))
    links = html.html_links(pages).where("NOT nofollow")
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query
def q_scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages made of the documents, as the extraction reads them."""
    return _html_pages(spark, path).select("page_id", "url", F.length("html").alias("chars"))


def _page_view(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the pages of all documents, with uniqueness claimed over the pages of each site."""
    rows = html.html_elements(_html_pages(spark, path)).join(_docs(spark, path).select(F.col("doc_id").alias("page_id"), F.col("source").alias("site")), "page_id")
    rows = checkpointed(rows)  # read again for the claim, the groups and the rows themselves
    texts = B.claim_unique(rows.where("text IS NOT NULL"), "site", ("page_id", "pos"), "text").select("page_id", "pos", "is_unique")
    return rows.join(texts, ["page_id", "pos"], "left")


def _element_tree(spark: SparkSession, path: str) -> DataFrame:
    """The elements table as trees: every text is a block, groups end where the nesting does."""
    own = _elements(spark, path).where("docelttype <> 'Document'")
    kind = F.when(F.col("doceltcmd") == "Text", F.lit("TextBlock")).otherwise(F.col("docelttype"))
    return B.implied_tree(own.select(F.col("doc_id").alias("page_id"), "pos", kind.alias("elt_type"), F.col("doceltcmd").alias("cmd"), F.col("nestinglevel").alias("nesting_level"), "text", F.col("isunique").alias("is_unique")))


@query
def q_group_unique(spark: SparkSession, path: str) -> DataFrame:
    """Groups of the elements table, and whether there is unique text below them."""
    tree = checkpointed(_element_tree(spark, path))
    return B.group_unique(tree).join(tree.select("page_id", "pos", "origin"), ["page_id", "pos"]).select("page_id", "origin", "elt_type", "contains_unique")


def _element_view(spark: SparkSession, path: str) -> DataFrame:
    return B.unique_view(checkpointed(_element_tree(spark, path)))


@query
def q_unique_view_top(spark: SparkSession, path: str) -> DataFrame:
    """Elements that text output keeps outside of any group."""
    return _element_view(spark, path).where("cmd <> 'End' AND size(path) = 0").select("page_id", "origin", "elt_type")


@query
def q_unique_view_nested(spark: SparkSession, path: str) -> DataFrame:
    """Elements that text output keeps within groups."""
    return _element_view(spark, path).where("cmd <> 'End' AND size(path) > 0").select("page_id", "origin", "elt_type")


def _rendered(spark: SparkSession, path: str, form: str) -> DataFrame:
    plain = [F.lit(None).cast("int").alias(n) for n in ("row", "rowspan", "col", "colspan")]
    view = _element_view(spark, path).select("*", F.lit(None).cast("string").alias("title"), *plain)
    return render.render_documents(view, form).select("page_id", F.md5("text").alias("digest"))


@query
def q_render_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Digests of the Markdown of the documents of the elements table."""
    return _rendered(spark, path, "markdown")


@query
def q_render_html(spark: SparkSession, path: str) -> DataFrame:
    return _rendered(spark, path, "html")


@query
def q_group_unique_pages(spark: SparkSession, path: str) -> DataFrame:
    """The groups of q_group_unique, of the pages of all documents."""
    return B.group_unique(_page_view(spark, path))


@query
def q_unique_view_pages(spark: SparkSession, path: str) -> DataFrame:
    """Elements that text output keeps of the pages of all documents."""
    return B.unique_view(_page_view(spark, path)).select("page_id", "pos", "elt_type", "cmd", "text")


@query
def q_markdown_flat(spark: SparkSession, path: str) -> DataFrame:
    return render.flat_markdown(B.explode_blocks(_docs(spark, path), keep=())).select("doc_id", F.md5("markdown").alias("digest"))


@query
def q_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the CSV table of every text of the elements table, with the values it holds for language, hash and flag."""
    own = _elements(spark, path).where("hashcode IS NOT NULL AND doceltcmd = 'Text'")
    named = own.select(
        "element_id", F.col("docelttype").alias("elt_type"), F.col("doceltcmd").alias("cmd"), F.col("nestinglevel").alias("nesting_level"), "text", "lang",
        F.col("hashcode").alias("hash"), F.col("isunique").alias("is_unique"), *(F.lit(1).alias(n) for n in ("row", "rowspan", "col", "colspan")),
    )
    return render.csv_lines(named).select("element_id", F.md5("line").alias("digest"))


# ---- other sources ----


@query
def q_legacy_parse(spark: SparkSession, path: str) -> DataFrame:
    """The elements of each document written in the older line form and read again."""
    own = _elements(spark, path).where("text IS NOT NULL AND trim(text) <> '' AND NOT startswith(trim(text), '##') AND NOT contains(text, '\n') AND NOT contains(text, '\r') AND docelttype <> 'Document'")
    line = F.when(F.col("doceltcmd") == "Start", F.concat(F.lit("## "), F.col("nestinglevel").cast("string"), F.lit(" Section Start "), "text")).otherwise(F.col("text"))
    docs = own.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return files.parse_legacy(docs).select("doc_id", "pos", "elt_type", "cmd", F.md5("text").alias("digest"))


def _pdf(spark: SparkSession, path: str) -> DataFrame:
    """Elements of the documents that are PDF files: their lines as blocks, headings set larger, forty blocks a page, a running head on each."""
    lines = B.explode_blocks(_docs(spark, path).where("pdf"), keep=()).select("doc_id", "pos", "block")
    title = F.col("block").startswith("#")
    blocks = lines.select(
        "doc_id", F.floor(F.col("pos") / 40).alias("page"), F.col("pos").alias("ord"), F.regexp_replace("block", "^#+ *", "").alias("text"), F.lit(1).alias("n_lines"),
        F.when(title, 20.0).otherwise(10.0).alias("line_height"), (F.col("pos") % 40 == 39).alias("decoration"),
    )
    return files.pdf_elements(blocks)


@query
def q_pdf_blocks(spark: SparkSession, path: str) -> DataFrame:
    return _pdf(spark, path).select("doc_id", "ord", F.md5("text").alias("digest"))


@query
def q_pdf_titles(spark: SparkSession, path: str) -> DataFrame:
    return _pdf(spark, path).select("doc_id", "ord", "elt_type", "nesting_level")


@query
def q_crawl_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Pages made of the request log, crawled from the addresses that no request has: the links of a page are the requests under it."""
    log = _requests(spark, path).where("parent_url IS NOT NULL")
    links = log.groupBy(F.col("parent_url").alias("url")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("url")), lambda u: F.concat(F.lit('<a href="'), T.html_encoded(u), F.lit('">x</a>'))), "").alias("html"))
    leaves = log.select("url").join(links.select("url"), "url", "left_anti").distinct().withColumn("html", F.lit(""))
    pages = links.unionByName(leaves).withColumn("page_id", F.xxhash64("url"))
    roots = links.select("url").join(log.select("url"), "url", "left_anti").select(F.col("url").alias("root")).distinct()
    done = crawl.breadth_first(pages, roots, "domain").crawled
    return done.groupBy("url").agg(F.min("depth").alias("depth"))


# ---- streaming ----


def _drained(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """All rows of a stream over the files there are, each batch written to a folder of its own in the shared folder."""
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"  # a state of its own for each call

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")  # a repeated batch writes the same folder again

    job = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/*")


@query
def q_stream_unique(spark: SparkSession, path: str) -> DataFrame:
    """Distinct texts of each website and session, found by a stream over the elements."""
    schema = _table(spark, path, "text_elements").schema
    files_ = spark.readStream.schema(schema).parquet(f"{path}/text_elements.parquet*")
    blocks = files_.where("hashcode IS NOT NULL").select(F.concat_ws("/", "website", F.col("crawl_session").cast("string")).alias("site"), F.col("hashcode").alias("hash"))
    return _drained(S.unique_stream(blocks), spark, "unique").groupBy("site").agg(F.count(F.lit(1)).alias("texts"))


@query
def q_stream_last10(spark: SparkSession, path: str) -> DataFrame:
    """The batch result of q_unique10 from a stream of documents with state per site."""
    docs = spark.readStream.schema(_docs(spark, path).schema).parquet(f"{path}/documents.parquet*").where("text IS NOT NULL")
    lines = F.filter(F.transform(F.split("text", "\n", -1), lambda x: T.trimmed(x)), lambda x: x != "")
    blocks = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("hash"), T.words(x).alias("words")))
    units = docs.select(F.col("source").alias("site"), F.col("doc_id").alias("seq"), "doc_id", blocks.alias("blocks")).where(F.size("blocks") > 0)
    totals = _drained(S.document_totals(units), spark, "totals")
    firsts = _drained(S.first_occurrences(S.document_blocks(units)), spark, "firsts", "update")
    return S.uniqueness(totals, firsts).select("doc_id", F.round("unique_last", 6).alias("unique_last"))


@query
def q_request_rates(spark: SparkSession, path: str) -> DataFrame:
    """Requests, errors and bytes of each website in ten minutes, by a stream over the log."""
    log = spark.readStream.schema(_table(spark, path, "request_log").schema).parquet(f"{path}/request_log.parquet*").where("clock IS NOT NULL")
    rates = S.request_rates(log.withColumn("clock", F.col("clock").cast("timestamp")))
    last = _drained(rates, spark, "rates", "update").groupBy("start", "website").agg(F.max("requests").alias("requests"), F.max("errors").alias("errors"), F.max("bytes").alias("bytes"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "website", "requests", "errors", "bytes")
