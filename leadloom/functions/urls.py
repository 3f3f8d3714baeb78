"""URL columns (host, path, registrable domain, link resolution) as native expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import any_of, col, empty_to_null, let, stripped

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _URL, 2)


def host(url: Column | str) -> Column:
    """Lower-case host without user info, port and IPv6 brackets; '' where there is none."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
    return F.lower(F.btrim(F.regexp_extract(col(url), pattern, 1), F.lit("[]")))


def port(url: Column | str) -> Column:
    """Text of the explicit port, '' where there is none."""
    return F.regexp_extract(authority(url), r":([^:\]@]*)$", 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _URL, 3)


def query(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(url), _URL, 4), F.lit(""))


_SITE = (r"([^.]+\.(?:" + "|".join(fixed.SECOND_LEVEL_LABELS) + r")\.[^.]+|[^.]+\.[^.]+|[^.]+)$")


def registrable(host_col: Column | str) -> Column:
    """Last two labels of a host, or three when the second-last is a known second-level label."""
    return F.regexp_extract(F.btrim(F.lower(col(host_col)), F.lit(".")), _SITE, 1)


def url_domain(url: Column | str) -> Column:
    return registrable(host(url))


def website_domain(website: Column | str) -> Column:
    """Registrable domain of a website typed with or without a scheme; null where there is none."""
    w = col(website)
    full = F.when(w.contains("://"), w).otherwise(F.concat(F.lit("http://"), w))
    return empty_to_null(url_domain(full))


def root_path(url: Column | str) -> Column:
    """Path of a URL, '/' where it is empty."""
    return F.regexp_replace(path(url), "^$", "/")


def dedupe_key(url: Column | str) -> Column:
    """Key under which two URLs are the same page: scheme, www., port, fragment and end slash off."""
    return F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.rtrim(path(url), F.lit("/")), F.lit("?"), query(url))


def path_depth(url: Column | str) -> Column:
    return F.length(F.regexp_replace(root_path(url), "[^/]", ""))


_LANGUAGES = "|".join(fixed.KOREAN_LANG_SEGMENTS + fixed.FOREIGN_LANG_SEGMENTS)


def language_segment(url: Column | str) -> Column:
    """First path segment when it is a language folder, else null."""
    return empty_to_null(F.regexp_extract(F.lower(path(url)), rf"^/*({_LANGUAGES})(?:/|$)", 1))


def is_foreign_language(url: Column, home_url: Column) -> Column:
    lang, home = language_segment(url), language_segment(home_url)
    return F.when(lang.isNull(), F.lit(False)).when(home.isNull(), lang.isin(*fixed.FOREIGN_LANG_SEGMENTS)).otherwise(lang != home)


def _collapse_dots(p: Column) -> Column:
    """Remove `.` and `..` segments of an absolute path."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: (F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                           .otherwise(F.concat(acc, F.array(s))))
    # a path that ends in a dot segment is a folder
    parts = F.split(F.regexp_replace(F.regexp_replace(p, r"(/\.{1,2})$", "$1/"), "^/", ""), "/", -1)
    folded = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, empty, step), "/"))
    return F.when(p.rlike(r"/\.{1,2}(/|$)"), folded).otherwise(p)


def link_parts(base: Column | str, href: Column | str) -> Column:
    """Scheme, authority, path and query of a link made absolute against `base` (absolute, network,
    root, query and relative forms)."""
    held = let(col(href), lambda t: F.struct(col(base).alias("base"), stripped(t).alias("href")))
    return let(held, lambda link: _link_parts(link["base"], link["href"]))


def _link_parts(b: Column, h: Column) -> Column:
    absolute, network = h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h.startswith("//")
    own = absolute | network
    full = F.when(network, F.concat(F.lit("http:"), h)).otherwise(h)
    rel = F.regexp_extract(h, r"^([^?#]*)", 1)
    folder = F.regexp_replace(root_path(b), "[^/]*$", "")
    return F.struct(
        h.alias("href"), F.when(absolute, scheme(h)).otherwise(scheme(b)).alias("scheme"),
        F.when(own, authority(full)).otherwise(authority(b)).alias("authority"),
        F.when(own, path(full)).when(rel == "", path(b)).otherwise(
            _collapse_dots(F.when(rel.startswith("/"), rel).otherwise(F.concat(folder, rel)))).alias("path"),
        F.regexp_extract(h, r"^[^?#]*\?([^#]*)", 1).alias("query"))


def cleaned_link(base: Column | str, href: Column | str) -> Column:
    """Absolute crawlable form of a link without its fragment, or null when it is not one."""
    skip = "^$|^" + any_of(fixed.SKIP_SCHEMES)
    files = any_of(fixed.SKIP_EXTENSIONS) + "$|" + any_of(fixed.SKIP_PATH_HINTS)

    def shaped(u: Column) -> Column:
        ok = ~u["href"].rlike(skip) & u["scheme"].isin("http", "https") & ~F.lower(u["path"]).rlike(files)
        return F.when(ok, F.concat(u["scheme"], F.lit("://"), u["authority"], F.regexp_replace(u["path"], "^$", "/"),
                                   F.regexp_replace(u["query"], "^(.+)$", "?$1")))

    return let(link_parts(base, href), shaped)
