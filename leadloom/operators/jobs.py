"""IT openings on recruitment pages."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, html
from ..functions import urls as U
from ..functions.ranking import first_per_key, top_per_key
from ..functions.text import any_of, computed, count_tokens, cut, escape, first_token, has_token, label_value, non_empty, tidy
from . import elements


def is_it_job(title: Column, keywords: Sequence[str] = fixed.IT_JOB_KEYWORDS) -> Column:
    return has_token(F.lower(title), keywords)


def it_jobs_only(c: DataFrame, keywords: Sequence[str] = fixed.IT_JOB_KEYWORDS, title: str = "title") -> DataFrame:
    return c.where(is_it_job(F.col(title), keywords))


def employment_type(text: Column) -> Column:
    return first_token(F.lower(text), fixed.EMPLOYMENT_TYPES)


def deadline(text: Column) -> Column:
    return non_empty(tidy(F.regexp_extract(text, "(?U)" + fixed.DEADLINE, 0)))


def location(text: Column) -> Column:
    named = label_value(text, fixed.LOCATION_LABELS)
    hints = [non_empty(tidy(F.regexp_extract(text, f"(?iU){escape(h)}{fixed.LOCATION_SUFFIX}", 0)))
             for h in fixed.LOCATION_HINTS]
    return F.coalesce(named, F.when(text.rlike("(?i)" + any_of(fixed.LOCATION_HINTS)), F.coalesce(*hints)))


def position(title: Column, keywords: Sequence[str] = fixed.IT_JOB_KEYWORDS) -> Column:
    return first_token(F.lower(title), [(k, k.title() if k.isascii() else k) for k in keywords])


def is_posting(title: Column, context: Column, markers: Sequence[str] = fixed.JOB_ROLE_MARKERS,
               nav: Sequence[str] = fixed.NAV_TOKENS) -> Column:
    """A real opening: short, no menu, and a role word or employment details around it."""
    low = F.lower(title)
    words = F.size(F.filter(F.split(title, r"(?U)\s+"), lambda x: x != ""))
    says_so = has_token(low, markers) | employment_type(context).isNotNull() | deadline(context).isNotNull()
    return (F.length(title) <= 60) & (words <= 8) & (count_tokens(low, nav) < 3) & says_so


def looks_like_posting(c: DataFrame, title: str = "title", context: str = "context", **lists) -> DataFrame:
    return c.where(is_posting(F.col(title), F.col(context), **lists))


ENTRIES = {"a": 0, "h1": 1, "h2": 1, "h3": 1, "h4": 1, "li": 2, "td": 3, "strong": 4}
BOXES = ("li", "tr", "article", "div")
TAGS = (*ENTRIES, "tr", "article", "div", "ul", "ol", "menu", "table", "th")


def job_candidates(pages: DataFrame, keywords: Sequence[str] = fixed.IT_JOB_KEYWORDS, **lists: Sequence[str]) -> DataFrame:
    """IT openings as written on recruitment pages.

    Phase 1 reads links, phase 2 headings, list entries, cells and bold text without a link. The context of an entry is the whole text of
    the innermost list entry, table row, article or division around it, with all that is nested in there; its own text where there is none.
    """
    key = ("domain", "page_idx")
    shown = pages.where("category = 'recruitment'").select(*key, "final_url", "html")
    # held, so that the filter stays above a dealing of the pages instead of reading their texts in the few tasks before it
    jobs = computed(shown, _h=html.without_hidden(F.col("html"))).drop("html").where(F.lower("_h").rlike(any_of(keywords)))
    found = elements.nearest(elements.spans(jobs, key, F.col("_h"), TAGS), key, BOXES, tuple(ENTRIES), TAGS)
    # all entries of a page meet its parts once
    listed = found.groupBy(*key).agg(F.collect_list(F.struct("open", "name", "end", "box_open", "box_end")).alias("_entries"))
    at = [F.col(f"j.{c}").eqNullSafe(F.col(f"l.{c}")) for c in key]
    rows = jobs.select(*key, "final_url", elements.parts(F.col("_h"), TAGS).alias("_parts")).alias("j").join(listed.alias("l"), at).select(
        "j.domain", "j.page_idx", "final_url", "_parts", F.explode("_entries").alias("e"))

    inner = elements.between(F.col("_parts"), F.col("e.open"), F.col("e.end"))
    phase = F.when(F.col("e.name") == "a", 1).otherwise(2)
    rows = computed(rows, inner=inner).where(F.lower("inner").rlike(any_of(keywords)))
    has_link = F.col("inner").rlike(r"(?i)<a\s(?:[^>]*?\s)?href\s*=")
    rows = rows.where(has_link == (phase == 1))
    titled = computed(rows, title=tidy(html.inline_text(F.col("inner")))).where(F.length("title").between(4, 120))
    box = elements.between(F.col("_parts"), F.col("e.box_open"), F.col("e.box_end"))
    around = F.when(F.col("e.box_open").isNotNull(), tidy(html.inline_text(box))).otherwise(F.col("title"))
    target = U.cleaned_link(F.col("final_url"), html.attribute(F.col("inner"), "href"))
    own = F.when((phase == 1) & (U.url_domain("_target") == F.col("domain")), F.col("_target"))
    c = computed(it_jobs_only(titled, keywords), context=around, _target=target)
    return looks_like_posting(c, **lists).select(
        "domain", "page_idx", phase.alias("phase"), "title", "context", F.coalesce(own, F.col("final_url")).alias("source_url"),
        F.struct("page_idx", phase.alias("phase"), F.col("e.open").alias("pos")).alias("seq"))


def dedupe_jobs(c: DataFrame) -> DataFrame:
    """One row per title of a domain (first wins); unlinked titles that contain an earlier title go.

    Containment is found by an equi join of an unlinked title's substrings, of the lengths that titles of its
    domain have, with those titles: linear in the rows, no pairs of titles.
    """
    low = c.withColumn("_t", F.lower("title"))
    firsts = low.groupBy("domain", F.col("_t").alias("_s")).agg(F.min("seq").alias("_first"))
    lengths = firsts.where("_s <> ''").groupBy("domain").agg(F.collect_set(F.length("_s")).alias("_lengths"))
    text = F.col("_t")
    loose = low.where("phase = 2").select("domain", "_t").distinct().join(lengths, "domain")
    fitting = F.filter("_lengths", lambda n: n <= F.length(text))
    stretches = F.flatten(F.transform(fitting, lambda n: F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))))
    probes = loose.select("domain", "_t", F.explode(F.array_distinct(stretches)).alias("_s"))
    # per title: the earliest title contained in it
    inner = probes.join(firsts, ["domain", "_s"]).groupBy("domain", "_t").agg(F.min("_first").alias("_inner"))
    marked = low.join(inner, ["domain", "_t"], "left")
    dropped = (F.col("phase") == 2) & F.coalesce(F.col("_inner") < F.col("seq"), F.lit(False))
    kept = marked.where(~dropped).drop("_inner")
    return first_per_key(kept, ["domain", "_t"], ["seq"]).drop("_t")


def job_fields(c: DataFrame, keywords: Sequence[str] = fixed.IT_JOB_KEYWORDS, max_chars: int | None = None) -> DataFrame:
    context = F.col("context")
    about = F.when(F.length(context) > F.length("title") + 10, cut(context, max_chars))
    return computed(c, position=position(F.col("title"), keywords), location=location(context),
                    employment_type=employment_type(context), deadline=deadline(context), description=about)


def top_jobs(c: DataFrame, n: int | None = None) -> DataFrame:
    """The n best openings per domain: own detail page first, then the most filled in."""
    shallow = F.when(F.length(F.regexp_replace(U.path("source_url"), "[^/]", "")) > 1, 0).otherwise(1)
    filled = sum((F.col(f).isNotNull().cast("int") for f in ("location", "employment_type", "deadline")), F.lit(0))
    return top_per_key(c, ["domain"], [shallow.asc(), filled.desc(), F.asc("seq")], n, "place")


def tech_from_jobs(jobs: DataFrame, n: int | None = None, keywords: Sequence[str] = fixed.TECH_KEYWORDS) -> DataFrame:
    """Technologies named in the openings of a domain, in list order.

    Every opening is reduced to one flag per keyword before anything is shuffled.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    rows = computed(jobs.select("domain", "title", "description"), _text=text)
    hit = lambda k: F.col("_text").contains(k) & F.col("_text").rlike(rf"(?<![a-z0-9]){escape(k)}(?![a-z0-9])")
    flags = rows.groupBy("domain").agg(*[F.bool_or(hit(k.lower())).alias(f"_k{i}") for i, k in enumerate(keywords)])
    found = F.array_compact(F.array(*[F.when(F.col(f"_k{i}"), k) for i, k in enumerate(keywords)]))
    return flags.select("domain", (F.slice(found, 1, n) if n else found).alias("tech"))
