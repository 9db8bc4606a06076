"""URL algebra as column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_IP = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\]|[0-9A-Fa-f]*:[0-9A-Fa-f:.]+)$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-cased host without user and port; empty for what is no absolute URL."""
    return F.lower(F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), r":\d*$", ""))


def authority(url: Column) -> Column:
    """Host with its port unless that is the scheme's own."""
    bare = F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    default = F.when(scheme(url) == "https", r":443$").otherwise(r":80$")
    return F.regexp_replace(F.regexp_replace(bare, default, F.lit("")), ":$", "")


def path(url: Column) -> Column:
    """Path, ``/`` if there is none."""
    p = _part(url, 3)
    return F.when(p == "", "/").otherwise(p)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def canonical(url: Column) -> Column:
    """Absolute URL with lower-case scheme and host, without default port and fragment."""
    q = query(url)
    built = F.concat(scheme(url), F.lit("://"), authority(url), path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.when(url.rlike(_URL), built).otherwise(url)


def base_domain(url: Column) -> Column:
    """Last two labels of a host name; an address or a shorter name as it is."""
    h = host(url)
    return F.when(h.rlike(_IP), h).otherwise(F.substring_index(h, ".", -2))


def sub_domain(url: Column) -> Column:
    return host(url)


def root_path(p: Column) -> Column:
    """Path up to the last slash before its first dot; unchanged without a dot after its first character."""
    return F.when(F.instr(p, ".") > 1, F.regexp_extract(p, r"^([^.]*/)", 1)).otherwise(p)


def site_directory(url: Column, scope: str | Column) -> Column:
    """Directory of a website under a crawl scope of ``domain``, ``subdomain`` or ``path``."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    whole = F.concat(host(url), F.translate(root_path(path(url)), "/", "_"))
    return F.when(scope == "domain", base_domain(url)).when(scope == "subdomain", host(url)).when(scope == "path", whole)


def file_path(url: Column) -> Column:
    """Relative file of a page: decoded segments, ``_default_`` for a directory, and the hash of the query."""
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(path(url), r"\+", "%2B")), path(url))
    clean = F.regexp_replace(F.regexp_replace(decoded, "\\x00", "_"), r"\.+/", "/")
    name = F.regexp_replace(clean, "^/+", "")
    name = F.when((name == "") | name.endswith("/"), F.concat(name, F.lit("_default_"))).otherwise(name)
    q = query(url)
    return F.when(q == "", name).otherwise(F.concat(name, F.lit("_"), F.upper(F.md5(F.concat(F.lit("?"), q)))))


def is_pdf(url: Column) -> Column:
    return F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))


def url_id(url: Column) -> Column:
    """Signed 64-bit integer of the first eight bytes of the MD5 of a URL, least byte first.

    Bytes are added up as numbers of 32 bits each, since ``conv`` overflows on the upper half.
    """
    digest = F.md5(url)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("bigint")
    low = byte(0) + byte(1) * 256 + byte(2) * 65_536 + byte(3) * 16_777_216
    high = byte(4) + byte(5) * 256 + byte(6) * 65_536 + byte(7) * 16_777_216
    signed = F.when(high >= 2_147_483_648, high - 4_294_967_296).otherwise(high)
    return F.shiftleft(signed, 32) + low


def in_scope(candidate: Column, root: Column, scope: str | Column) -> Column:
    """Whether a URL belongs to a crawl: equal base domain, equal host, or equal host and a path below the root's."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    below = (host(candidate) == host(root)) & path(candidate).startswith(root_path(path(root)))
    return (
        F.when(scope == "domain", base_domain(candidate) == base_domain(root))
        .when(scope == "subdomain", host(candidate) == host(root))
        .when(scope == "path", below)
        .otherwise(F.lit(False))
    )


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings."""
    places = F.sequence(F.lit(1), F.least(F.length(a), F.length(b)))
    mismatch = F.array_position(F.transform(places, lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))), True)
    shortest = F.least(F.length(a), F.length(b))
    length = F.when(mismatch > 0, mismatch.cast("int") - 1).otherwise(shortest)
    return F.when(shortest == 0, F.lit("")).otherwise(a.substr(F.lit(1), length))
