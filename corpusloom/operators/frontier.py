"""Frontier of a crawl: decisions, links, known addresses, rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions import url as U

HTML_OR_TEXT = ("text/html", "text/plain", "application/pdf")


def content_kind(content_type: Column) -> Column:
    """``html``, ``pdf`` or ``other``."""
    kind = F.lower(F.trim(content_type))
    return F.when(kind.startswith("text/html"), "html").when(kind.startswith("application/pdf"), "pdf").otherwise("other")


def is_downloadable(content_type: Column, types: tuple[str, ...] = HTML_OR_TEXT) -> Column:
    found = F.lit(False)
    for t in types:
        found = found | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(t))
    return found


def charset(content_type: Column, body: Column) -> Column:
    """Encoding named by the header, else by a meta tag of the body, else UTF-8."""
    header = F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset\s*=\s*[\"']?([\w-]+)", 1)
    meta = F.regexp_extract(F.coalesce(body, F.lit("")), r"(?is)<meta[^>]*?charset\s*=\s*[\"']?\s*([\w-]+)", 1)
    name = F.lower(F.when(header != "", header).when(meta != "", meta).otherwise(F.lit("utf-8")))
    return F.when(name == "cp1251", F.lit("windows-1251")).otherwise(name)


@F.pandas_udf(StringType())
def _decoded(body: pd.Series, name: pd.Series) -> pd.Series:
    def one(data: bytes | None, charset_name: str | None) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode(charset_name or "utf-8", "replace").removeprefix("\ufeff")
        except LookupError:  # no encoding of that name
            return bytes(data).decode("utf-8", "replace")

    return pd.Series([one(b, c) for b, c in zip(body, name, strict=True)])


def decoded(body: Column, content_type: Column) -> Column:
    """Text of the bytes of a response, by the encoding its header or a meta tag of its first bytes names; bytes that stand for
    nothing become U+FFFD, an unknown name counts as UTF-8, and a mark of byte order is left out."""
    head = F.decode(F.substring(body, 1, 2048), "ISO-8859-1")
    return _decoded(body, charset(content_type, head))


def crawl_decision(
    url: Column, depth: Column, redirects: Column, internal: Column, crawled: Column, crawled_host: Column,
    max_depth: int = 1000, max_redirects: int = 7, max_pages: int = 0, max_pages_per_domain: int = 0, external: bool = False,
) -> Column:
    """Reason why a page is not crawled, null if it is; the first rule that fails gives it, a limit of 0 is off."""
    rules = [
        (url.isNull(), "null page"), (redirects > max_redirects, "too many redirects"), (depth > max_depth, "too deep"), (~U.scheme(url).startswith("http"), "scheme"),
    ]
    if max_pages:
        rules.append((crawled >= max_pages, "page limit"))
    if max_pages_per_domain:
        rules.append((crawled_host >= max_pages_per_domain, "page limit of domain"))
    if not external:
        rules.append((~internal, "external"))
    out = F.when(rules[0][0], rules[0][1])
    for test, reason in rules[1:]:
        out = out.when(test, reason)
    return out


def links_decision(has_content: Column, internal: Column, depth: Column, max_depth: int = 1000) -> Column:
    return F.when(~has_content, "no content").when(~internal, "external").when(depth >= max_depth, "too deep")


def download_decision(status: Column, content_type: Column, size: Column, max_bytes: int = 0) -> Column:
    out = F.when(status.isNull(), "no response").when(status != 200, "status").when(~is_downloadable(content_type), "content type")
    return out.when(size > max_bytes, "size") if max_bytes else out


def recrawl_decision(failed: Column, retry_count: Column, max_retry: int = 0) -> Column:
    return F.coalesce(failed, F.lit(False)) & (retry_count < max_retry)


def is_crawl_error(status: Column, message: Column) -> Column:
    """A failed request counts as an error unless the page is missing or has moved."""
    failed = F.coalesce(status != 200, F.lit(True)) | message.isNotNull()
    said = F.lower(F.coalesce(message, F.lit("")))
    missing = (F.coalesce(status, F.lit(0)) == 404) | F.contains(said, F.lit("not found")) | F.contains(said, F.lit("moved"))
    return failed & ~missing


def is_bot_protected(status: Column, headers: Column) -> Column:
    """An error response of a bot protection, told by its header."""
    return F.coalesce(status >= 400, F.lit(False)) & F.map_contains_key(headers, F.lit("X-DataDome"))


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait from a Retry-After header that is a number or a date; null for neither, never negative."""
    date = F.try_to_timestamp(F.regexp_replace(header, r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = header.try_cast("double")
    waited = F.unix_timestamp(date) - F.unix_timestamp(now)
    known = F.coalesce(seconds, waited.cast("double"))
    return F.when(known.isNotNull(), F.greatest(known, F.lit(0.0)))


def aligned_scheme(url: Column, root: Column) -> Column:
    """A URL under the scheme of the root, if both are of the web; robots rules hold for one scheme of a host."""
    web = U.scheme(url).isin("http", "https") & U.scheme(root).isin("http", "https")
    return F.when(web, F.concat(U.scheme(root), F.regexp_replace(url, "^[A-Za-z]+", ""))).otherwise(url)


def left_host(url: Column, response_url: Column) -> Column:
    """Whether a response came from another host than was asked, so that its page must be judged again."""
    return F.coalesce(U.host(url) != U.host(response_url), F.lit(False))


def is_redirect(url: Column, response_url: Column) -> Column:
    return F.coalesce(U.canonical(url) != U.canonical(response_url), F.lit(False))


def redirect_target(url: Column, location: Column) -> Column:
    """Target of a redirect: fragment and final ``%20`` removed, a relative one against the page."""
    clean = F.regexp_replace(F.regexp_replace(location, "#.*$", ""), "(%20)+$", "")
    origin = F.concat(U.scheme(url), F.lit("://"), U.authority(url))
    folder = F.regexp_extract(U.path(url), "^(.*/)", 1)
    return F.when(clean.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), clean).when(clean.startswith("/"), F.concat(origin, clean)).otherwise(F.concat(origin, folder, clean))


def is_internal(url: Column, root: Column, original_root: Column, scope: Column | str) -> Column:
    """Whether a page belongs to the crawl of its root, or of the root that was asked for before it moved."""
    return F.coalesce(U.in_scope(url, root, scope), F.lit(False)) | F.coalesce(U.in_scope(url, original_root, scope), F.lit(False))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link without its fragment, by the reference resolution of RFC 3986.

    All cases are string expressions: absolute, of the same scheme, of the same host, of
    the query, and relative, whose dot segments are folded over the array of segments.
    """
    bare = F.substring_index(F.trim(href), "#", 1)
    scheme, auth = U.scheme(base), U.authority(base)
    folder = F.regexp_extract(U.path(base), "^(.*/)", 1)
    q = U.query(base)
    of_base = F.concat(U.path(base), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    target = F.when(bare == "", of_base).when(bare.startswith("?"), F.concat(U.path(base), bare)).when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    path, tail = F.substring_index(target, "?", 1), F.when(F.contains(target, F.lit("?")), F.regexp_extract(target, r"(\?.*)$", 1)).otherwise(F.lit(""))
    step = lambda done, s: (
        F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    )
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    last_dot = path.rlike(r"(^|/)\.{1,2}$")
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(last_dot & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit("")))
    own = F.concat(scheme, F.lit("://"), auth, joined, tail)
    absolute = bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute, U.canonical(bare)).when(bare.startswith("//"), U.canonical(F.concat(scheme, F.lit(":"), bare))).otherwise(own)


def new_pages(links: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Links that were never seen, each once; an anti-join on the address."""
    return links.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti")


def limit_links(links: DataFrame, page: str, order: str, most: int = 1000) -> DataFrame:
    """At most ``most`` links a page, in their order."""
    rank = F.row_number().over(Window.partitionBy(page).orderBy(order))
    return links.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def refilter(frontier: DataFrame, allowed: Column) -> DataFrame:
    """Waiting pages that a changed configuration still allows."""
    return frontier.where(allowed)
