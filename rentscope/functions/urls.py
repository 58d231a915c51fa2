"""URL expressions: parts of an address and the keys derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def authority(url: Column) -> Column:
    """Host with user and port as written, lower-cased; empty when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def bare_domain(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def entity_text(url: Column) -> Column:
    """Host without www, path without trailing slashes, sorted parameters without tracking ones."""
    pairs = F.transform(
        F.filter(F.split(query_of(url), "&"), lambda p: p.rlike("=.") & ~p.startswith("utm_")),
        lambda p: F.struct(
            F.try_url_decode(F.regexp_extract(p, "^([^=]*)=", 1)).alias("k"),
            F.try_url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.transform(
        F.array_sort(pairs), lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))
    )
    base = F.concat(bare_domain(url), F.regexp_replace(path_of(url), "/+$", ""))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def entity_key(url: Column, prefix: str = "scraper_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(entity_text(url), 256), 1, 20))


def host_key(url: Column, prefix: str = "scraper_") -> Column:
    """Older key from the host alone; different listings of one site share it."""
    after = F.element_at(F.split(url, "//"), -1)
    return F.concat(F.lit(prefix), F.regexp_replace(F.split_part(after, F.lit("/"), F.lit(1)), r"^www\.", ""))


def cache_key(url: Column) -> Column:
    domain = F.regexp_replace(authority(url), r"[^A-Za-z0-9_]", "_")
    return F.concat(domain, F.lit("__"), F.substring(F.md5(path_of(url)), 1, 8))


def domain_cache_key(url: Column) -> Column:
    return F.regexp_replace(
        F.split_part(F.regexp_replace(url, "https?://", ""), F.lit("/"), F.lit(1)), r"[^A-Za-z0-9_]", "_"
    )


def norm_url(url: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "/+$", "")


def origin(url: Column) -> Column:
    return F.regexp_replace(url, r"^(https?://[^/]+).*$", "$1")


def is_relative(url: Column) -> Column:
    return url.isNotNull() & (url != "") & ~url.startswith("http")


def absolute_url(base: Column, url: Column) -> Column:
    """Relative paths are placed on the origin of ``base``; an empty value becomes NULL."""
    joined = F.concat(origin(base), F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url)))
    return F.when(is_relative(url), F.coalesce(joined, url)).otherwise(F.nullif(url, F.lit("")))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base``: full, scheme-relative, rooted or relative."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    directory = F.when(path_of(base) == "", F.concat(page, F.lit("/"))).otherwise(
        F.regexp_replace(page, r"[^/]*$", "")
    )
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(directory, href))
    )
