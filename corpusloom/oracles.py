"""SQL for DuckDB over the same tables, written apart from the Spark plans."""

from __future__ import annotations

#: White space of the text model as a character class.
_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _n(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _stats(t: str) -> str:
    astral, shown = _n(t, _ASTRAL), _n(t, f"[^{_WS}]")
    words, letters, numbers = _n(t, f"[^{_WS}]+"), _n(t, r"\p{L}"), _n(t, r"\p{N}")
    ends = rf"CASE WHEN regexp_matches({t}, '[^{_WS}]\z') THEN 1 ELSE 0 END"
    return f"""CAST(length({t}) + {astral} AS INTEGER) AS chars, CAST({words} AS INTEGER) AS words,
      CAST(CASE WHEN {words} > 0 THEN ({shown} + {astral} - {ends}) // {words} WHEN {t} IS NULL THEN NULL ELSE 0 END AS INTEGER) AS avg_word_length,
      CAST({letters} AS INTEGER) AS letter_chars, CAST({numbers} AS INTEGER) AS number_chars,
      CAST({shown} + {astral} - {letters} - {numbers} AS INTEGER) AS other_chars"""


def _trim(t: str) -> str:
    return f"regexp_replace({t}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_ELEMENTS = "elements AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY element_id) AS copy FROM text_elements) WHERE copy = 1)"
_LOG = "log AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id) AS copy FROM request_log) WHERE copy = 1)"
_RECORDS = "records AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id) AS copy FROM dataset_records) WHERE copy = 1)"
_CONFIG = "config AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY config_line DESC) AS copy FROM websites) WHERE copy = 1)"

_SPLIT = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
_BLOCKS = f"blocks AS (SELECT doc_id, source, CAST(pos AS INTEGER) AS pos, {_trim('line')} AS block FROM ({_SPLIT}) WHERE {_trim('line')} <> '')"
_UNITS = f"""{_BLOCKS},
units AS (SELECT *, {_n('block', f'[^{_WS}]+')} AS words, row_number() OVER (PARTITION BY source, block ORDER BY doc_id, pos) = 1 AS is_unique FROM blocks),
doc_words AS (
  SELECT source, doc_id, CAST(sum(words) AS BIGINT) AS total_words, CAST(sum(CASE WHEN is_unique THEN words ELSE 0 END) AS BIGINT) AS unique_words,
         CASE WHEN sum(words) > 0 THEN sum(CASE WHEN is_unique THEN words ELSE 0 END) / CAST(sum(words) AS DOUBLE) ELSE 0 END AS pct_unique
  FROM units GROUP BY source, doc_id)"""
_LAST = "avg(pct_unique) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"

_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


def _host(u: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_extract({u}, {_URL}, 2), '^.*@', ''), ':\d*$', ''))"


def _path(u: str) -> str:
    return f"CASE WHEN regexp_extract({u}, {_URL}, 3) = '' THEN '/' ELSE regexp_extract({u}, {_URL}, 3) END"


def _query(u: str) -> str:
    return f"regexp_extract({u}, {_URL}, 4)"


def _domain(u: str) -> str:
    h = _host(u)
    return rf"CASE WHEN regexp_matches({h}, '^\d{{1,3}}(\.\d{{1,3}}){{3}}$') OR NOT contains({h}, '.') THEN {h} ELSE regexp_extract({h}, '([^.]*\.[^.]*)$', 1) END"


def _root(u: str) -> str:
    p = f"({_path(u)})"
    return f"CASE WHEN instr({p}, '.') > 1 THEN regexp_extract({p}, '^([^.]*/)', 1) ELSE {p} END"


def _file(u: str) -> str:
    p = rf"regexp_replace(regexp_replace(url_decode(replace({_path(u)}, '+', '%2B')), '\.+/', '/', 'g'), '^/+', '')"
    name = f"CASE WHEN {p} = '' OR {p} LIKE '%/' THEN {p} || '_default_' ELSE {p} END"
    return f"CASE WHEN {_query(u)} = '' THEN {name} ELSE ({name}) || '_' || upper(md5('?' || {_query(u)})) END"


_ERROR = """((coalesce(status_code <> 200, true) OR error_message IS NOT NULL)
  AND NOT (coalesce(status_code, 0) = 404 OR contains(lower(coalesce(error_message, '')), 'not found') OR contains(lower(coalesce(error_message, '')), 'moved')))"""

_PAGES = f"""{_LOG},
pages AS (
  SELECT website, request_id, url, (epoch_us(clock) // 1000000 - epoch_us(min(clock) OVER (PARTITION BY website)) // 1000000) // 60 AS minutes,
         CASE WHEN {_ERROR} THEN 1 ELSE 0 END AS errors, coalesce(content_bytes, 0) AS bytes, coalesce(unique_pct, 0) / 100 AS pct_unique
  FROM log WHERE website IS NOT NULL AND clock IS NOT NULL),
run AS (
  SELECT website, request_id, minutes % 60 AS m, row_number() OVER w AS n, sum(errors) OVER w AS e, sum(bytes) OVER w AS b,
         avg(pct_unique) OVER (PARTITION BY website ORDER BY request_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS u
  FROM pages WINDOW w AS (PARTITION BY website ORDER BY request_id ROWS UNBOUNDED PRECEDING))"""

_LOW = f"""{_PAGES},
tail AS (
  SELECT website, url, pct_unique, row_number() OVER (PARTITION BY website ORDER BY request_id DESC) AS back,
         row_number() OVER (PARTITION BY website ORDER BY request_id) - 1 AS n FROM pages),
ten AS (SELECT *, count(*) OVER (PARTITION BY website) - back AS age, n % 10 AS slot FROM tail WHERE back <= 10),
low AS (SELECT a.website, a.url FROM ten a JOIN ten b ON a.website = b.website AND a.age = b.slot WHERE floor(b.pct_unique * 100) < 40)"""

_RANKED = """ranked AS (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
split AS (SELECT doc_id, CASE WHEN i < floor(n * 80 / 100.0) THEN 'train' WHEN i < floor(n * 90 / 100.0) THEN 'valid' ELSE 'test' END AS split FROM ranked)"""


def _size(n: str) -> str:
    return f"""CASE WHEN {n} > 1000000000 THEN '1B<n<10B' WHEN {n} > 100000000 THEN '100M<n<1B' WHEN {n} > 10000000 THEN '10M<n<100M'
      WHEN {n} > 1000000 THEN '1M<n<10M' WHEN {n} > 100000 THEN '100K<n<1M' WHEN {n} > 10000 THEN '10K<n<100K' WHEN {n} > 1000 THEN '1K<n<10K' ELSE 'n<1K' END"""


_ENCODED = """replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""

#: Groups of the elements table: a start and the position where the nesting is no deeper any more.
_GROUPS = f"""{_ELEMENTS},
rows_ AS (SELECT * FROM elements WHERE docelttype <> 'Document'),
starts AS (
  SELECT s.doc_id, s.pos, s.docelttype, coalesce((SELECT min(r.pos) FROM rows_ r WHERE r.doc_id = s.doc_id AND r.pos > s.pos AND r.nestinglevel <= s.nestinglevel), 2147483647) AS until
  FROM rows_ s WHERE s.doceltcmd = 'Start'),
groups_ AS (
  SELECT s.doc_id, s.pos, s.docelttype, s.until, coalesce(bool_or(r.isunique), false) AS has_unique
  FROM starts s LEFT JOIN rows_ r ON r.doc_id = s.doc_id AND r.pos > s.pos AND r.pos < s.until AND r.doceltcmd = 'Text' GROUP BY ALL),
around AS (SELECT r.doc_id, r.pos, count(*) AS n, bool_and(g.has_unique) AS good FROM rows_ r JOIN groups_ g ON g.doc_id = r.doc_id AND g.pos < r.pos AND r.pos < g.until GROUP BY ALL),
view_ AS (
  SELECT r.*, coalesce(a.n, 0) AS depth FROM rows_ r LEFT JOIN around a ON a.doc_id = r.doc_id AND a.pos = r.pos
    LEFT JOIN groups_ g ON g.doc_id = r.doc_id AND g.pos = r.pos
  WHERE coalesce(a.good, true) AND coalesce(g.has_unique, true) AND (a.n IS NOT NULL OR r.doceltcmd = 'Start' OR coalesce(r.isunique, false)))"""

_KIND = "CASE WHEN doceltcmd = 'Text' THEN 'TextBlock' ELSE docelttype END"

_PDF = f"""{_BLOCKS},
lines AS (
  SELECT b.doc_id, b.pos, b.pos // 40 AS page, b.pos % 40 = 39 AS decoration, regexp_replace(b.block, '^#+ *', '') AS text, CASE WHEN b.block LIKE '#%' THEN 20.0 ELSE 10.0 END AS h
  FROM blocks b JOIN documents d ON d.doc_id = b.doc_id WHERE d.pdf),
kept AS (SELECT * FROM (SELECT *, max(page) OVER (PARTITION BY doc_id) AS pages FROM lines) WHERE pages <= 1 OR NOT decoration),
long AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1 AS last FROM kept) WHERE length({_trim('text')}) > 1 OR last),
titled AS (SELECT *, coalesce(h > lead(h) OVER (PARTITION BY doc_id ORDER BY pos) * 1.2 AND h > 8, false) AS title FROM long),
nested AS (SELECT *, sum(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM titled)"""

_ROBOTS = f"""{_CONFIG},
hosts AS (
  SELECT CAST(root_id AS VARCHAR) AS host, rooturl, mincrawldelay, [y FOR y IN coalesce(excludeurls, []) IF y IS NOT NULL] AS x
  FROM config WHERE website IS NOT NULL AND rooturl IS NOT NULL)"""

_PATTERN = """regexp_matches({t}, '^' || replace(replace(replace(regexp_replace({x}, '\\$$', ''), '.', '\\.'), '?', '\\?'), '*', '.*') || CASE WHEN {x} LIKE '%$' THEN '$' ELSE '' END)"""
_AUTHORITY = "regexp_replace(lower(regexp_replace(regexp_extract({u}, " + _URL + ", 2), '^.*@', '')), CASE WHEN {u} LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '')"


def _whole(c: str) -> str:
    return f"coalesce(CAST(CAST(trunc({c}) AS BIGINT) AS VARCHAR), '')"


def _line(c: str) -> str:
    return f"coalesce(replace(replace({c}, ';', ','), chr(10), ' '), '')"


_CLOCK = "coalesce(strftime(clock, '%H:%M:%S.') || lpad(CAST(epoch_us(clock) // 1000 % 1000 AS VARCHAR), 3, '0'), '')"

_ALLOWED = f"""WITH {_LOG}, {_CONFIG}, p AS (SELECT website AS host, list_distinct(flatten(list(excludeurls))) AS patterns FROM config WHERE excludeurls IS NOT NULL AND len(excludeurls) > 0 GROUP BY website),
      t AS (SELECT request_id, {_host('url')} AS host, ({_path('url')}) || CASE WHEN {_query('url')} <> '' THEN '?' || {_query('url')} ELSE '' END AS target FROM log)
      SELECT request_id, coalesce(target <> '/robots.txt', true) AND len([x FOR x IN coalesce(patterns, []) IF regexp_matches(target, '^' || replace(replace(replace(regexp_replace(x, '\\$$', ''), '.', '\\.'), '?', '\\?'), '*', '.*')
        || CASE WHEN x LIKE '%$' THEN '$' ELSE '' END)]) = 0 AS robots_allowed FROM t LEFT JOIN p ON p.host = t.host"""

SQL: dict[str, str] = {
    "q_text_stats": f"SELECT doc_id, {_stats('text')} FROM documents",
    "q_avg_word_len": f"""SELECT doc_id,
      CAST(CASE WHEN {_n('text', f'[^{_WS}]+')} > 0 THEN ({_n('text', f'[^{_WS}]')} + {_n('text', _ASTRAL)} - CASE WHEN regexp_matches(text, '[^{_WS}]\\z') THEN 1 ELSE 0 END) // {_n('text', f'[^{_WS}]+')} WHEN text IS NULL THEN NULL ELSE 0 END AS INTEGER) AS strict,
      CAST(CASE WHEN {_n('text', f'[^{_WS}]+')} > 0 THEN ({_n('text', f'[^{_WS}]')} + {_n('text', _ASTRAL)}) // {_n('text', f'[^{_WS}]+')} WHEN text IS NULL THEN NULL ELSE 0 END AS INTEGER) AS plain
      FROM documents""",
    "q_element_stats": f"WITH {_ELEMENTS} SELECT element_id, {_stats('text')} FROM elements WHERE text IS NOT NULL",
    "q_element_hash": f"WITH {_ELEMENTS} SELECT element_id, hashcode AS hash FROM elements WHERE hashcode IS NOT NULL",
    "q_csv_field": """SELECT doc_id, replace(title, '"', '""') AS title FROM documents WHERE title IS NOT NULL""",
    "q_html_encode": f"SELECT doc_id, md5({_ENCODED.format(t='text')}) AS digest FROM documents WHERE text IS NOT NULL",
    "q_output_name": f"SELECT doc_id, {_file('uri')} || '.' || CASE WHEN regexp_matches(coalesce(lang, '?'), '^[a-z]{{2}}$') THEN lang ELSE 'xx' END || '.text.md' AS name FROM documents",
    "q_size_category": f"SELECT source, {_size('n')} AS one, {_size('n * 1000')} AS thousand, {_size('n * 10000000')} AS many FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)",
    "q_url_parts": f"SELECT doc_id, lower(regexp_extract(uri, {_URL}, 1)) AS scheme, {_host('uri')} AS host, {_path('uri')} AS path, {_query('uri')} AS query FROM documents",
    "q_base_domain": f"SELECT doc_id, {_domain('uri')} AS domain FROM documents",
    "q_subdomain": f"SELECT doc_id, {_host('uri')} AS host FROM documents",
    "q_root_path": f"SELECT doc_id, {_root('uri')} AS root_path FROM documents",
    "q_site_dir": f"""WITH {_CONFIG} SELECT root_id, CASE crawl_scope WHEN 'domain' THEN {_domain('rooturl')} WHEN 'subdomain' THEN {_host('rooturl')}
      WHEN 'path' THEN {_host('rooturl')} || replace({_root('rooturl')}, '/', '_') END AS directory FROM config""",
    "q_file_path": f"WITH {_LOG} SELECT request_id, {_file('url')} AS file FROM log",
    "q_is_pdf": "SELECT doc_id, coalesce(lower(uri) LIKE '%.pdf', false) AS pdf FROM documents",
    "q_url_id": f"""WITH {_LOG}, h AS (SELECT request_id, md5(url) AS d FROM log),
      u AS (SELECT request_id, CAST(('0x' || substr(d,15,2) || substr(d,13,2) || substr(d,11,2) || substr(d,9,2) || substr(d,7,2) || substr(d,5,2) || substr(d,3,2) || substr(d,1,2)) AS UBIGINT) AS x FROM h)
      SELECT request_id, CAST(CASE WHEN x >= 9223372036854775808 THEN CAST(x AS HUGEINT) - 18446744073709551616 ELSE x END AS BIGINT) AS url_id FROM u""",
    "q_scope_domain": f"SELECT doc_id, {_domain('uri')} = {_domain('rooturl')} AS inside FROM documents WHERE rooturl IS NOT NULL",
    "q_scope_subdomain": f"SELECT doc_id, {_host('uri')} = {_host('rooturl')} AS inside FROM documents WHERE rooturl IS NOT NULL",
    "q_scope_path": f"SELECT doc_id, {_host('uri')} = {_host('rooturl')} AND starts_with({_path('uri')}, {_root('rooturl')}) AS inside FROM documents WHERE rooturl IS NOT NULL",
    "q_block_explode": f"WITH {_BLOCKS} SELECT doc_id, pos, block FROM blocks",
    "q_block_dedup": f"WITH {_UNITS} SELECT doc_id, pos, is_unique FROM units",
    "q_doc_words": f"WITH {_UNITS} SELECT doc_id, total_words, unique_words FROM doc_words",
    "q_pct_unique": f"WITH {_UNITS} SELECT doc_id, round(pct_unique, 6) AS pct_unique FROM doc_words",
    "q_keep_docs": f"WITH {_UNITS} SELECT doc_id FROM doc_words WHERE unique_words > 0",
    "q_unique10": f"WITH {_UNITS} SELECT doc_id, round({_LAST}, 6) AS unique_last FROM doc_words",
    "q_doc_quality": f"""WITH {_UNITS} SELECT source, doc_id, total_words, unique_words, round(pct_unique, 6) AS pct_unique, round({_LAST}, 6) AS unique_last
      FROM doc_words WHERE unique_words > 0""",
    "q_words_by_lang": f"WITH {_ELEMENTS} SELECT doc_id, coalesce(lang, '?') AS lang, CAST(sum(words) AS BIGINT) AS words FROM elements WHERE words IS NOT NULL GROUP BY 1, 2",
    "q_words_metadata": f"""WITH {_ELEMENTS}, by_lang AS (SELECT doc_id, coalesce(lang, '?') AS lang, sum(words) AS words FROM elements WHERE words IS NOT NULL GROUP BY 1, 2)
      SELECT doc_id, string_agg('words-count:' || lang || '=' || CAST(words AS VARCHAR), ',' ORDER BY 'words-count:' || lang) AS metadata FROM by_lang GROUP BY doc_id""",
    "q_doc_language": f"""WITH {_ELEMENTS}, by_lang AS (SELECT doc_id, coalesce(lang, '?') AS lang, sum(words) AS w, min(pos) AS seen FROM elements WHERE words IS NOT NULL GROUP BY 1, 2)
      SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, seen DESC) AS r FROM by_lang) WHERE r = 1""",
    "q_element_unique": f"""WITH {_ELEMENTS} SELECT element_id, row_number() OVER (PARTITION BY website, crawl_session, text ORDER BY doc_id, pos) = 1 AS is_unique
      FROM elements WHERE hashcode IS NOT NULL""",
    "q_stop_condition": f"""WITH {_PAGES}, hits AS (SELECT website, request_id, CASE WHEN n >= 200 THEN 'pages' WHEN e >= 10 THEN 'errors'
        WHEN n >= 10 AND floor(u * 100) < 5 THEN 'unique text' WHEN b >= 20 * 1048576 THEN 'size' END AS reason FROM run)
      SELECT website, request_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY website ORDER BY request_id) AS r FROM hits WHERE reason IS NOT NULL) WHERE r = 1""",
    "q_stop_duration": f"WITH {_PAGES} SELECT website, min(request_id) AS request_id, 'duration' AS reason FROM run WHERE m >= 50 GROUP BY website",
    "q_zip_low_unique": f"WITH {_LOW} SELECT website, url FROM low",
    "q_lcp_exclude": f"""WITH {_LOW}, edges AS (SELECT website, min(url) AS a, max(url) AS b, min(length(url)) AS s FROM low GROUP BY website),
      cut AS (SELECT *, list_max([k FOR k IN range(0, least(length(a), length(b)) + 1) IF left(a, k) = left(b, k)]) AS k FROM edges)
      SELECT website, CASE WHEN k = s THEN '' ELSE left(a, k) END AS prefix, (CASE WHEN k = s THEN 0 ELSE k END) > s // 4 AS accepted FROM cut""",
    "q_status": f"""WITH {_LOG}, f AS (SELECT website, coalesce(status_code = 200, false) AND error_message IS NULL AS ok, coalesce(lower(url) LIKE '%.pdf', false) AS pdf, {_ERROR} AS error,
        coalesce(content_bytes, 0) AS bytes, coalesce(response_ms, 0) AS ms FROM log),
      a AS (SELECT website, count(*) AS analyzed, count(*) FILTER (ok AND NOT pdf) AS html, count(*) FILTER (ok AND pdf) AS pdf, count(*) FILTER (error) AS errors,
        CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(ms), 1) AS ms FROM f GROUP BY website)
      SELECT *, analyzed - html - pdf - errors AS excluded, printf('%d:%02d:%02d', CAST(floor(ms / 1000) AS BIGINT) // 3600, CAST(floor(ms / 1000) AS BIGINT) // 60 % 60, CAST(floor(ms / 1000) AS BIGINT) % 60) AS took FROM a""",
    "q_crawl_errors": f"WITH {_LOG} SELECT request_id, {_ERROR} AS error FROM log",
    "q_crawl_decision": f"""WITH {_LOG} SELECT request_id, CASE WHEN url IS NULL THEN 'null page'
      WHEN (CASE WHEN redirected_from IS NULL THEN 0 ELSE retry_count + 1 END) > 1 THEN 'too many redirects' WHEN crawl_depth > 8 THEN 'too deep'
      WHEN NOT starts_with(lower(regexp_extract(url, {_URL}, 1)), 'http') THEN 'scheme' WHEN NOT coalesce({_host('url')} = website, false) THEN 'external' END AS reason FROM log""",
    "q_crawl_by_domain": f"""WITH {_LOG}, a AS (SELECT regexp_replace(lower(regexp_replace(regexp_extract(url, {_URL}, 2), '^.*@', '')), CASE WHEN url LIKE 'https:%' THEN ':443$' ELSE ':80$' END, '') AS authority, crawl_depth FROM log)
      SELECT authority, count(*) AS pages, max(crawl_depth) AS deepest FROM a GROUP BY authority""",
    "q_max_links": f"""WITH {_LOG} SELECT parent_url, request_id, url FROM (SELECT *, row_number() OVER (PARTITION BY parent_url ORDER BY request_id) AS r FROM log WHERE parent_url IS NOT NULL) WHERE r <= 10""",
    "q_frontier_antijoin": f"WITH {_LOG} SELECT DISTINCT parent_url AS url FROM log WHERE parent_url IS NOT NULL AND parent_url NOT IN (SELECT url FROM log WHERE url IS NOT NULL)",
    "q_bfs_depth": f"""WITH RECURSIVE {_LOG}, edges AS (SELECT DISTINCT parent_url AS parent, url FROM log WHERE parent_url IS NOT NULL),
      steps AS (SELECT parent AS url, 0 AS depth FROM edges WHERE parent NOT IN (SELECT url FROM log WHERE url IS NOT NULL AND parent_url IS NOT NULL)
        UNION SELECT e.url, s.depth + 1 FROM steps s JOIN edges e ON e.parent = s.url WHERE s.depth < (SELECT count(*) FROM edges))
      SELECT url, min(depth) AS depth FROM steps GROUP BY url""",
    "q_redirects": f"WITH {_LOG} SELECT request_id, redirected_from <> url AS redirect FROM log WHERE redirected_from IS NOT NULL",
    "q_links": r"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '\]\((https?://[^)\s]+)\)', 1) AS u FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS pos, unnest(u) AS url FROM f""",
    "q_robots_allowed": _ALLOWED,
    "q_site_lang_counts": "SELECT source, lang, count(*) AS files FROM documents GROUP BY source, lang",
    "q_site_lang_min": "SELECT source FROM documents WHERE lang = 'fr' GROUP BY source HAVING count(*) >= 50",
    "q_split": f"WITH {_RANKED} SELECT doc_id, split FROM split",
    "q_split_counts": f"WITH {_RANKED} SELECT split, count(*) AS examples FROM split GROUP BY split",
    "q_website_table": f"""WITH {_RECORDS} SELECT lower(website) AS site, count(*) FILTER (NOT coalesce(lower(uri) LIKE '%.pdf', false)) AS html_pages,
      count(*) FILTER (coalesce(lower(uri) LIKE '%.pdf', false)) AS pdf_documents, CAST(sum(words) AS BIGINT) AS words FROM records GROUP BY 1""",
    "q_records": f"""WITH d AS (SELECT *, {_stats('text')} FROM documents WHERE text IS NOT NULL)
      SELECT uri AS Uri, strftime(crawled_at, '%m/%d/%Y %H:%M:%S') AS "Timestamp", lang AS Lang, title AS Title, md5(text) AS Digest, words AS Words, avg_word_length AS AvgWordsLength, chars AS Chars,
        letter_chars AS LetterChars, number_chars AS NumberChars, other_chars AS OtherChars, source AS Website, coalesce(lower(uri) LIKE '%.pdf', false) AS PDF FROM d""",
    "q_parquet_roundtrip": f"""WITH r AS (SELECT source AS website, uri, {_n('text', f'[^{_WS}]+')} AS words, coalesce(lower(uri) LIKE '%.pdf', false) AS pdf,
        row_number() OVER (PARTITION BY source ORDER BY md5(uri), uri) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL),
      s AS (SELECT *, CASE WHEN i < floor(n * 80 / 100.0) THEN 'train' WHEN i < floor(n * 90 / 100.0) THEN 'valid' ELSE 'test' END AS split FROM r)
      SELECT website, split, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (pdf) AS pdf FROM s GROUP BY website, split""",
    "q_crawl_time": f"""WITH {_RECORDS}, p AS (SELECT record_id, year_month, coalesce(try_strptime(crawl_time, '%m/%d/%Y %H:%M:%S'), try_strptime(crawl_time, '%Y-%m-%dT%H:%M:%S')) AS t FROM records)
      SELECT record_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS crawled, strftime(t, '%y%m') = year_month AS fits FROM p""",
    "q_effective_config": f"WITH {_CONFIG} SELECT root_id, website, crawl_scope, maxpagecount, minuniquetext, array_to_string(excludeurls, ',') AS excludes FROM config",
    "q_html_blocks": f"""WITH {_BLOCKS}, t AS (SELECT doc_id, block LIKE '# %' AS head, {_trim("regexp_replace(block, '^# ', '')")} AS b FROM blocks)
      SELECT doc_id AS page_id, count(*) AS blocks, CAST(sum(length(b)) AS BIGINT) AS chars, count(*) FILTER (head) AS sections FROM t WHERE b <> '' GROUP BY doc_id""",
    "q_html_title": f"""SELECT doc_id AS page_id, {_trim('title')} AS title FROM documents WHERE {_trim("coalesce(title, '')")} <> '' AND {_trim("coalesce(text, '')")} <> ''""",
    "q_markdown_flat": f"WITH {_BLOCKS} SELECT doc_id, md5(string_agg(block, chr(10) || chr(10) ORDER BY pos) || chr(10) || chr(10) || chr(10)) AS digest FROM blocks GROUP BY doc_id",
    "q_csv_rows": f"""WITH {_ELEMENTS}, s AS (SELECT *, {_stats('text').replace(' AS chars', ' AS c1').replace(' AS words', ' AS c2').replace(' AS avg_word_length', ' AS c3').replace(' AS letter_chars', ' AS c4').replace(' AS number_chars', ' AS c5').replace(' AS other_chars', ' AS c6')}
        FROM elements WHERE hashcode IS NOT NULL AND doceltcmd = 'Text')
      SELECT element_id, md5(docelttype || ';Text;' || nestinglevel || ';"' || replace(text, '"', '""') || '";' || coalesce(lang, '?') || ';' || c1 || ';' || c2 || ';' || c3 || ';' || c4 || ';' || c5 || ';' || c6 || ';' || hashcode || ';'
        || CASE WHEN isunique THEN 'True' WHEN NOT isunique THEN 'False' ELSE '' END) AS digest FROM s""",
    "q_crawl_rounds": f"""WITH RECURSIVE {_LOG}, edges AS (SELECT DISTINCT parent_url AS parent, url FROM log WHERE parent_url IS NOT NULL),
      steps AS (SELECT parent AS url, {_domain('parent')} AS site, 0 AS depth FROM edges WHERE parent NOT IN (SELECT url FROM edges)
        UNION SELECT e.url, s.site, s.depth + 1 FROM steps s JOIN edges e ON e.parent = s.url WHERE s.depth < (SELECT count(*) FROM edges) AND {_domain('e.url')} = s.site)
      SELECT url, min(depth) AS depth FROM steps GROUP BY url""",
    "q_stream_unique": f"WITH {_ELEMENTS} SELECT website || '/' || crawl_session AS site, count(DISTINCT hashcode) AS texts FROM elements WHERE hashcode IS NOT NULL GROUP BY 1",
    "q_stream_last10": f"WITH {_UNITS} SELECT doc_id, round({_LAST}, 6) AS unique_last FROM doc_words",
    # ---- queries over rows that the tables hold in another form
    "q_lang_accept": f"WITH {_ELEMENTS} SELECT element_id, CASE WHEN letterchars / nullif(chars, 0) > 0.6 THEN right('__label__' || lang, 2) ELSE '?' END AS accepted FROM elements WHERE hashcode IS NOT NULL",
    "q_cell_coords": f"""WITH {_ELEMENTS}, n AS (SELECT element_id, pos + 1 AS r, words % 3 + 1 AS rs, nestinglevel + 1 AS c, numberchars % 2 + 1 AS cs FROM elements WHERE words IS NOT NULL)
      SELECT element_id, CASE WHEN rs <> 1 OR cs <> 1 THEN r || ':' || rs || ',' || c || ':' || cs ELSE r || ',' || c END AS coords FROM n""",
    "q_request_log": f"""WITH {_LOG} SELECT request_id, {_CLOCK} AS "Clock", {_line('url')} AS "Url", {_whole('status_code')} AS "Status code", {_whole('response_ms')} AS "Reponse time (ms)",
      {_whole('download_ms')} AS "Download time (ms)", {_whole('content_bytes')} AS "Content size (bytes)", {_whole('unique_pct')} AS "Unique text blocks (%)", {_whole('crawl_depth')} AS "Crawl depth",
      {_line('parent_url')} AS "Parent Url", {_line('redirected_from')} AS "Redirected from", {_whole('retry_count')} AS "Retry count", {_whole('retry_after_s')} AS "Retry after (s)", {_line('error_message')} AS "Error message" FROM log""",
    "q_exceptions_log": f"WITH {_LOG} SELECT request_id, {_CLOCK} AS clock, url, {_line('error_message')} AS message FROM log WHERE error_message IS NOT NULL",
    "q_internal_uri": f"""WITH {_LOG} SELECT request_id, coalesce({_host('url')} = {_host("('http://' || website || '/')")}, false) OR coalesce({_host('url')} = {_host('coalesce(redirected_from, parent_url)')}, false) AS internal
      FROM log WHERE website IS NOT NULL""",
    "q_download_decision": f"""WITH {_LOG}, k AS (SELECT *, CASE WHEN coalesce(lower(url) LIKE '%.pdf', false) THEN 'pdf' WHEN coalesce(regexp_matches(lower(url), '\\.(png|jpe?g|gif|css|js)$'), false) THEN 'other' ELSE 'html' END AS kind FROM log)
      SELECT request_id, CASE WHEN status_code IS NULL THEN 'no response' WHEN status_code <> 200 THEN 'status' WHEN kind = 'other' THEN 'content type' WHEN content_bytes > 25000 THEN 'size' END AS reason, kind FROM k""",
    "q_content_type": "SELECT doc_id, CASE WHEN pdf THEN 'pdf' ELSE 'html' END AS kind, TRUE AS taken FROM documents",
    "q_charset_detect": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'utf-16le' ELSE 'utf-8' END AS charset FROM documents WHERE text IS NOT NULL",
    "q_charset_decode": """SELECT doc_id, md5(CASE doc_id % 3 WHEN 1 THEN '<meta charset="utf-8">' || text ELSE text END) AS digest FROM documents WHERE text IS NOT NULL""",
    "q_links_abs": f"""WITH {_LOG} SELECT request_id, lower(regexp_extract(parent_url, {_URL}, 1)) || '://' || {_AUTHORITY.format(u='parent_url')} || ({_path('url')}) AS url,
      'http://h.test/a/x/' || request_id || '.html?a=1' AS up FROM log WHERE parent_url IS NOT NULL AND url IS NOT NULL""",
    "q_robots_match": f"""WITH {_LOG}, {_CONFIG}, p AS (SELECT DISTINCT website, unnest(excludeurls) AS pattern FROM config WHERE website IS NOT NULL)
      SELECT l.request_id, p.pattern, {_PATTERN.format(t=f"({_path('l.url')})", x='p.pattern')} AS match FROM log l JOIN p ON p.website = l.website""",
    "q_robots_parse": f"""WITH {_ROBOTS}, own AS (SELECT host, unnest(x) AS value, generate_subscripts(x, 1) AS i FROM hosts)
      SELECT host, CAST(1 + i AS INTEGER) AS line_no, '*' AS agent, 'disallow' AS kind, value FROM own WHERE value <> ''
      UNION ALL SELECT host, CAST(2 + len(x) AS INTEGER), '*', 'crawl-delay', coalesce(CAST(mincrawldelay AS VARCHAR), 'none') FROM hosts
      UNION ALL SELECT host, CAST(5 + len(x) AS INTEGER), 'other', 'disallow', '/' FROM hosts
      UNION ALL SELECT host, CAST(6 + len(x) AS INTEGER), NULL, 'sitemap', rooturl FROM hosts""",
    "q_robots_delay": f"WITH {_ROBOTS} SELECT host, CAST(least(coalesce(mincrawldelay, 0), 5) AS INTEGER) AS delay FROM hosts",
    "q_html_tables": rf"""WITH {_BLOCKS}, t AS (SELECT doc_id, len(string_split(trim(block, '|'), '|')) AS k FROM blocks WHERE regexp_matches(block, '(?s)^\|.*\|$')),
      c AS (SELECT doc_id, '1:2,1:1' AS coords FROM t UNION ALL SELECT doc_id, '2,2' FROM t UNION ALL SELECT doc_id, '1,' || unnest(range(2, k + 1)) FROM t)
      SELECT doc_id AS page_id, coords, count(*) AS cells FROM c GROUP BY ALL""",
    "q_html_lists": f"WITH {_BLOCKS} SELECT doc_id AS page_id, count(*) AS items, 2 AS level FROM blocks WHERE regexp_matches(block, '^- .') GROUP BY doc_id",
    "q_nav_lists": f"WITH {_CONFIG} SELECT CAST(root_id AS BIGINT) AS page_id, CASE WHEN root_id % 2 = 0 THEN 'NavigationList' ELSE 'List' END AS elt_type, 1 AS lists FROM config WHERE len(excludeurls) > 0",
    "q_html_hidden": f"""WITH {_BLOCKS}, n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i FROM blocks)
      SELECT doc_id AS page_id, count(*) AS shown, 1 AS level FROM n WHERE i % 3 <> 2 AND i % 5 <> 4 GROUP BY doc_id""",
    "q_html_sections": f"""WITH {_BLOCKS}, h AS (SELECT doc_id, length(regexp_extract(block, '^(#{{1,6}}) ', 1)) AS l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM blocks WHERE regexp_matches(block, '^#{{1,6}} [^#]')),
      p AS (SELECT a.doc_id, a.i, j.i AS ji, j.l AS jl, min(k.l) AS least FROM h a JOIN h j ON j.doc_id = a.doc_id AND j.i < a.i JOIN h k ON k.doc_id = a.doc_id AND k.i > j.i AND k.i <= a.i GROUP BY ALL),
      n AS (SELECT h.doc_id, h.i, 1 + count(p.ji) AS nesting_level FROM h LEFT JOIN p ON p.doc_id = h.doc_id AND p.i = h.i AND p.jl < p.least GROUP BY ALL)
      SELECT doc_id AS page_id, CAST(nesting_level AS INTEGER) AS nesting_level, count(*) AS sections FROM n GROUP BY ALL""",
    "q_links_nofollow": r"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '\]\((https?://[^)\s]+)\)', 1) AS u FROM documents WHERE text IS NOT NULL) SELECT doc_id AS page_id, (len(u) + 1) // 2 AS links FROM f WHERE len(u) > 0""",
    "q_scan_pages": f"""WITH t AS (SELECT doc_id, pos, {_trim('line')} AS x FROM ({_SPLIT})),
      made AS (SELECT doc_id, string_agg(CASE WHEN x = '' THEN '' WHEN starts_with(x, '# ') THEN '<h1>' || {_ENCODED.format(t=_trim("regexp_replace(x, '^# ', '')"))} || '</h1>' ELSE '<p>' || {_ENCODED.format(t='x')} END, chr(10) ORDER BY pos) AS body FROM t GROUP BY doc_id)
      SELECT d.doc_id AS page_id, d.uri AS url, CAST(length('<html><head><title>' || {_ENCODED.format(t="coalesce(d.title, '')")} || '</title><style>p{{margin:0}}</style></head><body>' || m.body) AS INTEGER) AS chars
      FROM documents d JOIN made m ON m.doc_id = d.doc_id""",
    "q_group_unique": f"WITH {_GROUPS} SELECT doc_id AS page_id, pos AS origin, docelttype AS elt_type, has_unique AS contains_unique FROM groups_",
    "q_unique_view_top": f"WITH {_GROUPS} SELECT doc_id AS page_id, pos AS origin, {_KIND} AS elt_type FROM view_ WHERE depth = 0",
    "q_unique_view_nested": f"WITH {_GROUPS} SELECT doc_id AS page_id, pos AS origin, {_KIND} AS elt_type FROM view_ WHERE depth > 0",
    "q_render_markdown": f"""WITH {_GROUPS} SELECT doc_id AS page_id, md5(string_agg(CASE WHEN doceltcmd = 'Start' THEN repeat('#', least(nestinglevel, 6)) || ' ' ELSE '' END || text || chr(10) || chr(10), '' ORDER BY pos) || chr(10)) AS digest
      FROM view_ GROUP BY doc_id""",
    "q_render_html": f"""WITH {_GROUPS}, x AS (SELECT doc_id, string_agg(CASE WHEN doceltcmd = 'Start' THEN '<h' || least(nestinglevel, 6) || '>' || {_ENCODED.format(t='text')} || '</h' || least(nestinglevel, 6) || '>'
        ELSE '<div class="p-2">' || {_ENCODED.format(t='text')} || '</div>' END, chr(10) ORDER BY pos) AS body FROM view_ GROUP BY doc_id)
      SELECT doc_id AS page_id, md5(concat_ws(chr(10), '<!doctype html>', '<html>', '<head>', '<title></title>', '<meta name="Uri" content="">', '</head>', '<body>', '<div class="p-2"><a href="" target="_blank"></a></div>', body, '</body>', '</html>', '')) AS digest FROM x""",
    "q_legacy_parse": f"""WITH {_ELEMENTS}, own AS (SELECT * FROM elements WHERE text IS NOT NULL AND trim(text) <> '' AND NOT starts_with(trim(text), '##') AND NOT contains(text, chr(10)) AND NOT contains(text, chr(13)) AND docelttype <> 'Document')
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, {_KIND} AS elt_type, doceltcmd AS cmd, md5(text) AS digest FROM own""",
    "q_pdf_blocks": f"WITH {_PDF} SELECT doc_id, pos AS ord, md5(text) AS digest FROM nested",
    "q_pdf_titles": f"""WITH {_PDF} SELECT doc_id, pos AS ord, CASE WHEN title THEN 'Section' ELSE 'TextBlock' END AS elt_type, CAST(n + CASE WHEN title THEN 0 ELSE 1 END AS INTEGER) AS nesting_level FROM nested""",
    "q_recrawl": f"WITH {_LOG} SELECT request_id, coalesce({_ERROR}, false) AND retry_count < 3 AS again FROM log",
    "q_retry_after": f"""WITH {_LOG} SELECT request_id, CAST(greatest(CAST(trunc(retry_after_s) AS INTEGER), 0) AS DOUBLE) AS seconds FROM log WHERE clock IS NOT NULL AND retry_after_s IS NOT NULL""",
    "q_links_decision": f"""WITH {_LOG} SELECT request_id, CASE WHEN coalesce(content_bytes, 0) <= 0 THEN 'no content' WHEN NOT coalesce({_host('url')} = website, false) THEN 'external'
      WHEN crawl_depth >= 3 THEN 'too deep' END AS reason FROM log""",
    "q_response_place": f"""WITH {_LOG} SELECT request_id, coalesce({_host('redirected_from')} <> {_host('url')}, false) AS "left",
      lower(regexp_extract(redirected_from, {_URL}, 1)) || '://' || {_AUTHORITY.format(u='redirected_from')} || ({_path('url')}) AS target,
      CASE WHEN lower(regexp_extract(url, {_URL}, 1)) IN ('http', 'https') THEN 'https' || regexp_replace(url, '^[A-Za-z]+', '') ELSE url END AS aligned
      FROM log WHERE redirected_from IS NOT NULL AND url IS NOT NULL AND website IS NOT NULL""",
    "q_bot_protected": f"WITH {_LOG} SELECT request_id, coalesce(status_code >= 400, false) AND request_id % 4 = 0 AS protected FROM log",
    "q_refilter": f"SELECT request_id FROM ({_ALLOWED}) WHERE robots_allowed",
    "q_request_rates": """SELECT strftime(time_bucket(INTERVAL 10 MINUTES, clock), '%Y-%m-%d %H:%M:%S') AS start, website, count(*) AS requests, count(*) FILTER (coalesce(status_code <> 200, true)) AS errors,
      CAST(sum(content_bytes) AS BIGINT) AS bytes FROM request_log WHERE clock IS NOT NULL GROUP BY 1, 2""",
}
