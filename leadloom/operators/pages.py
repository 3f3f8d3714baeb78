"""Page text, titles, footers, page filters and page deduplication."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, html
from ..functions.ranking import top_per_key
from ..functions.text import any_of, cut
from ..functions.urls import dedupe_key, url_domain


def page_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", html.visible_text(F.col("html")))


def page_title(pages: DataFrame) -> DataFrame:
    return pages.withColumn("title", html.title(F.col("html")))


def build_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages with their visible text and title."""
    return page_title(page_text(pages))


def footer_text(pages: DataFrame) -> DataFrame:
    return pages.withColumn("footer", html.footer_text(F.col("html"), F.col("text")))


def page_filter(pages: DataFrame) -> DataFrame:
    """Pages fetched without an error and served as HTML or text (or without a content type)."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    return pages.where((F.col("status") < 400) & ((kind == "") | kind.contains("html") | kind.contains("text")))


def js_shell_pages(pages: DataFrame, max_chars: int = 400, empty_chars: int = 200) -> DataFrame:
    """Flags pages whose HTML holds almost no text because a script fills it in."""
    n = F.length("text")
    shell = (n < max_chars) & (F.lower("html").rlike(any_of(fixed.SPA_MARKERS)) | (n < empty_chars))
    return pages.withColumn("js_shell", shell)


def content_category_of(title: Column, text: Column, recruitment=fixed.RECRUITMENT_MARKERS,
                        management=fixed.MANAGEMENT_MARKERS, window: int | None = None) -> Column:
    """Category told by a title and a text (or its first `window` characters), else null."""
    head = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), cut(text, window)))
    count = F.lit(0)
    for marker in management:
        count = count + head.contains(marker).cast("int")
    return F.when(head.rlike(any_of(recruitment)), "recruitment").when(count >= 2, "management")


def content_category(pages: DataFrame, recruitment=fixed.RECRUITMENT_MARKERS,
                     management=fixed.MANAGEMENT_MARKERS) -> DataFrame:
    """Pages reached for another reason become recruitment or management pages by their content."""
    better = content_category_of(F.col("title"), F.col("text"), recruitment, management)
    weak = F.col("category").isin("other", "company", "contact")
    return pages.withColumn("category", F.when(weak, F.coalesce(better, F.col("category"))).otherwise(F.col("category")))


def within_budget(pages: DataFrame, max_pages: int) -> DataFrame:
    """The pages one scan may hold per domain, in crawl order."""
    return top_per_key(pages, ["domain"], [F.asc("page_idx")], max_pages, "_rn").drop("_rn")


def url_key(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("url_key", dedupe_key(url))


def fingerprint(text: Column) -> Column:
    """Digest of a whole text; null for an empty one."""
    return F.when(text != "", F.sha2(text, 256))


def dedupe_pages(pages: DataFrame, min_chars: int = 0) -> DataFrame:
    """Pages kept by a crawl: one per requested address, one per final address, one per content.

    Pages redirected off their domain go first. The home page (depth 0) always stays and lends
    its address, not its content. The choice is made on narrow rows (index and keys) with aggregates of
    (key, smallest index), so copies of one page never meet in one task; the wide rows are
    shuffled once, by the final semi join.
    """
    on_site = (url_domain("final_url") == F.col("domain")) | (F.col("depth") == 0)
    print_of = F.when((F.length("text") >= min_chars) & (F.col("depth") > 0), fingerprint(F.col("text")))
    rows = pages.where(on_site).select(
        "domain", F.struct((F.col("depth") > 0).alias("inner"), "page_idx").alias("at"),
        dedupe_key("url").alias("asked"), dedupe_key("final_url").alias("final"), print_of.alias("print"))
    first = lambda df, key, *rest: (df.groupBy("domain", key).agg(F.min_by(F.struct("at", *rest), "at").alias("_w"))
                                    .select("domain", key, "_w.*"))
    rows = first(first(rows, "asked", "final", "print"), "final", "print")
    # pages without a fingerprint keep a group of their own
    own = F.coalesce("print", F.concat(F.lit("page "), F.col("at.page_idx").cast("string")))
    winners = rows.withColumn("print", own).groupBy("domain", "print").agg(F.min("at.page_idx").alias("page_idx"))
    return pages.join(winners.select("domain", "page_idx"), ["domain", "page_idx"], "left_semi")
