"""HTML columns handled with native expressions: visible text, blocks, attributes.

There is no tree here: `elements` takes an element to end at the first end tag of its name. Where nesting matters,
`footer_blocks` balances tags within the column and `operators.elements` does over all tags of a page as rows.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut, let, stripped, unescape_html

_HIDDEN = (r"(?is)<!--.*?-->|<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>")
_TAG = r"(?s)</?[a-zA-Z!?][^>]*>"
_MARK = "\x01"
VOID = "area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr"
ATTR_VALUE = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def without_hidden(html: Column) -> Column:
    """HTML without comments, scripts, styles and other elements that show nothing."""
    return F.regexp_replace(html, _HIDDEN, _MARK)


def _nodes(html: Column, glue: str) -> Column:
    """Text nodes of an HTML fragment, each stripped, empty ones dropped, joined by `glue`."""
    marked = unescape_html(F.regexp_replace(html, _TAG, _MARK))
    joined = F.regexp_replace(marked, rf"(?U)[\s{_MARK}]*{_MARK}[\s{_MARK}]*", glue)
    return stripped(joined)


def visible_text(html: Column) -> Column:
    return F.regexp_replace(_nodes(without_hidden(html), "\n"), r"\n{3,}", "\n\n")


def inline_text(html: Column) -> Column:
    """Text of a fragment on one line (nodes separated by a blank)."""
    return _nodes(html, " ")


def block_text(html: Column) -> Column:
    return _nodes(html, "\n")


def title(html: Column) -> Column:
    return block_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def elements(html: Column, names: str) -> Column:
    """Array of the elements (tags included) whose name is in the alternation `names`."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<({names})\b[^>]*>.*?</\1\s*>"), F.lit(0))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in the first start tag of a fragment, '' where missing."""
    raw = F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return unescape_html(F.btrim(raw, F.lit("\"'")))


def meta_content(html: Column, key: str, value: str) -> Column:
    """`content` of the first <meta> whose attribute `key` is `value`, null where there is none."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    hits = F.filter(tags, lambda t: t.rlike(rf"(?is)\s{key}\s*=\s*[\"']?{value}[\"'\s/>]"))
    return attribute(F.try_element_at(hits, F.lit(1)), "content")


def footer_blocks(html: Column, limit: int | None = None) -> Column:
    """The outermost footer blocks, whole: <footer> first, then elements whose class or id says footer, then <address>.

    A block ends where its name's start and end tags balance, at the end of the page if they never do; what is nested in a block is
    part of it. One pass over the tags of the names that blocks have, with the open block and its depth as state.
    """
    quoted = r"\s(?:class|id)\s*=\s*[\"'][^\"'>]*footer[^\"'>]*[\"']"
    starts = rf"(?is)^<(?:(?:footer|address)\b|(?!(?:{VOID})\b)\w+\b[^>]*{quoted})"
    tag = r"(?s)</?[a-zA-Z][^>]*>"
    kind = lambda t: F.struct(F.lower(F.regexp_extract(t, r"^</?(\w+)", 1)).alias("name"), t.startswith("</").alias("close"), t.rlike(starts).alias("block"))
    span = "struct<name:string,open:int,end:int>"

    def step(s: Column, x: Column) -> Column:
        t, i = x["tag"], x["at"]
        depth = s["depth"] + F.when(t["name"] != s["name"], 0).when(t["close"], -1).otherwise(1)
        ended = s["name"].isNotNull() & (depth == 0)
        begins = s["name"].isNull() & t["block"]
        one = F.struct(s["name"].alias("name"), s["open"].alias("open"), i.alias("end"))
        return F.struct(F.when(begins, t["name"]).when(~ended, s["name"]).alias("name"), F.when(begins, 1).when(s["name"].isNull(), 0).otherwise(depth).alias("depth"),
                        F.when(begins, i).otherwise(s["open"]).alias("open"), F.when(ended, F.array_append(s["out"], one)).otherwise(s["out"]).alias("out"))

    def last(n: Column):
        return lambda s: F.when(s["name"].isNotNull(), F.array_append(s["out"], F.struct(s["name"].alias("name"), s["open"].alias("open"), n.alias("end")))).otherwise(s["out"])

    def blocks(tags: Column) -> Column:
        kinds = F.transform(tags, lambda t, i: F.struct(kind(t).alias("tag"), (i + 1).alias("at")))

        def scanned(ks: Column) -> Column:
            names = F.array_distinct(F.transform(F.filter(ks, lambda k: k["tag"]["block"]), lambda k: k["tag"]["name"]))
            counted = let(names, lambda ns: F.filter(ks, lambda k: F.array_contains(ns, k["tag"]["name"])))
            start = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("open"), F.array().cast(f"array<{span}>").alias("out"))
            return F.aggregate(counted, start, step, last(F.size(tags) + 1))

        def texts(spans: Column) -> Column:
            rank = lambda s: F.when(s["name"] == "footer", 0).when(s["name"] == "address", 2).otherwise(1)
            ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank(s).alias("rank"), s["open"].alias("open"), s["end"].alias("end"))))
            pieces = F.split(html, tag, -1)
            return let(F.zip_with(F.concat(F.array(F.lit("")), tags), pieces, lambda t, p: F.concat(t, p)),
                       lambda ps: F.transform(ordered, lambda s: F.array_join(F.slice(ps, s["open"] + 1, s["end"] - s["open"]), "")))
        return let(let(kinds, scanned), texts)

    found = F.when(html.rlike("(?i)footer|<address"), let(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), blocks)).otherwise(F.array().cast("array<string>"))
    return F.slice(found, 1, limit) if limit else found


def footer_text(html: Column, text: Column, max_chars: int | None = None) -> Column:
    """Footer blocks plus the last quarter of the text lines."""
    blocks = block_text(F.array_join(footer_blocks(without_hidden(html)), "<br>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x) != "")
    last_quarter = lambda ls: F.array_join(F.slice(
        ls, F.floor(F.size(ls) * 0.75).cast("int") + 1, F.size(ls) + 1), "\n")
    tail = let(lines, last_quarter)
    both = F.array_join(F.filter(F.array(blocks, tail), lambda x: F.btrim(x) != ""), "\n")
    return cut(F.regexp_replace(both, r"\n{3,}", "\n\n"), max_chars)
