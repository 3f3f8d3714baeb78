"""Links of pages: admissible addresses, categories, scores and the crawl plan."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, html
from ..functions import urls as U
from ..functions.ranking import first_per_key, top_per_key
from ..functions.text import any_of, computed, label_value, token_pattern, trimmed, value_map
from .rounds import distances

LETTERS = "a-z"


# --- admissible addresses ----------------------------------------------------------------


def _public_ipv4(ip: Column) -> Column:
    part = lambda i: F.split(ip, r"\.")[i].try_cast("int")
    a, b, c = part(0), part(1), part(2)
    private = ((a == 0) | (a == 10) | (a == 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
               | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2))
               | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100))
               | ((a == 203) & (b == 0) & (c == 113)) | (a >= 224))
    return ~private


def _public_ipv6(ip: Column) -> Column:
    mapped = F.regexp_extract(ip, r"^(?:0{0,4}:){1,6}(?:ffff|FFFF):(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    unicast = ip.rlike("^[23][0-9a-f]{3}:") & ~ip.rlike("^(2001:(:|0{0,3}[0-9a-f]{0,2}:|0?1[0-9a-f]{2}:|0?db8:)|2002:|3fff:0?[0-9a-f]{0,3}:)")
    return F.when(mapped != "", _public_ipv4(mapped)).otherwise(unicast)


def admissible_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Typed addresses made absolute, with `ok` and the reason of a refusal (names are not resolved)."""
    typed = trimmed(url)
    full = F.when(typed.contains("://"), typed).otherwise(F.concat(F.lit("https://"), typed))
    parsed = computed(computed(urls, _full=full), _scheme=U.scheme("_full"), _host=F.rtrim(U.host("_full"), F.lit(".")), _port=U.port("_full"))
    full, sch, host, port = (F.col(c) for c in ("_full", "_scheme", "_host", "_port"))
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    number = port.try_cast("int")
    reason = (F.when(full.isNull(), "empty").when(~sch.isin("http", "https"), "scheme")
              .when(host == "", "host")
              .when(host.isin(*fixed.BLOCKED_HOSTS) | host.rlike(r"\.(localhost|local)$"), "blocked_host")
              .when((port != "") & (number.isNull() | ~number.isin(*fixed.ALLOWED_PORTS)), "port")
              .when(host.rlike(rf"^{octet}(\.{octet}){{3}}$") & ~_public_ipv4(host), "private_address")
              .when(host.contains(":") & ~_public_ipv6(host), "private_address"))
    shaped = F.concat(sch, F.lit("://"), U.authority(full), U.root_path(full), F.regexp_replace(U.query(full), "^(.+)$", "?$1"))
    held = computed(parsed, normal_url=F.when(sch.isin("http", "https") & (host != ""), shaped), reason=reason)
    return held.withColumn("ok", F.col("reason").isNull()).drop("_full", "_scheme", "_host", "_port")


def clean_links(links: DataFrame, base: str = "base_url", href: str = "href") -> DataFrame:
    """Links with their absolute `url`; links that lead nowhere useful are dropped."""
    return computed(links, url=U.cleaned_link(base, href)).where("url is not null")


def registrable_domain(df: DataFrame, host_col: str, out: str = "domain") -> DataFrame:
    return df.withColumn(out, U.registrable(host_col))


def same_domain(df: DataFrame, url: str = "url", domain: str = "domain") -> DataFrame:
    """Only rows whose URL belongs to their domain or a subdomain of it."""
    return df.where((U.host(url) != "") & (U.url_domain(url) == F.col(domain)))


# --- categories --------------------------------------------------------------------------


def category_of(url: Column, anchor: Column, tokens: Mapping[str, Sequence[str]] = fixed.LINK_TOKENS) -> Column:
    """Category of a link by its path, query and short anchor text; null when it has none."""
    target = F.concat(F.lower(U.path(url)), F.lit(" "), F.lower(U.query(url)))
    label = F.lower(F.coalesce(trimmed(anchor), F.lit("")))
    label = F.when(F.length(label) > fixed.NAV_ANCHOR_MAX, "").otherwise(label)
    out = None
    for category, words in tokens.items():
        strict = [t for t in words if category == "management" and t.isascii() and t not in fixed.FREE_MANAGEMENT_TOKENS]
        free = [t for t in words if t not in strict]
        hit = F.lit(False)
        if free:
            hit = hit | target.rlike(token_pattern(free, LETTERS)) | label.rlike(token_pattern(free, LETTERS))
        if strict:
            whole_segment = rf"(?:^|/){any_of(strict)}(?:\.[^./]*)?(?:/|$)"
            hit = hit | F.lower(U.path(url)).rlike(whole_segment) | label.rlike(token_pattern(strict, LETTERS))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def classify_links(links: DataFrame, tokens: Mapping[str, Sequence[str]] = fixed.LINK_TOKENS) -> DataFrame:
    anchor = F.when(F.col("is_frame"), "").otherwise(F.col("anchor"))
    return computed(links, category=category_of(F.col("url"), anchor, tokens))


def foreign_language_links(links: DataFrame, homes: DataFrame) -> DataFrame:
    """Flags links into another language folder than the home page's (homes: domain, home_url)."""
    joined = links.join(homes.select("domain", "home_url"), "domain", "left")
    return joined.withColumn("foreign", U.is_foreign_language(F.col("url"), F.col("home_url"))).drop("home_url")


# --- extraction --------------------------------------------------------------------------


def extract_links(pages: DataFrame) -> DataFrame:
    """Links on the pages' own domain: anchors with their text and the sources of frames.

    Depth and category of the page go along where the pages have them."""
    known = [c for c in ("depth", "category") if c in pages.columns]
    named = {"depth": F.col("depth"), "category": F.col("category").alias("from_category")}
    body = html.without_hidden(F.col("html"))
    value = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    anchor = rf"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*{value}[^>]*>(.*?)</a\s*>"
    frame = rf"(?is)<i?frame\s(?:[^>]*?\s)?src\s*=\s*{value}[^>]*>"
    every = lambda pattern, group: F.regexp_extract_all("_body", F.lit(pattern), F.lit(group))
    pairs = lambda hrefs, texts, is_frame: F.zip_with(hrefs, texts, lambda h, t: F.struct(
        h.alias("href"), t.alias("inner"), F.lit(is_frame).alias("is_frame")))
    found = F.concat(pairs(every(frame, 1), every(frame, 1), True), pairs(every(anchor, 1), every(anchor, 2), False))
    kept = ["from_category" if c == "category" else c for c in known]
    rows = (pages.select("domain", F.col("page_idx").alias("from_idx"), "final_url", *[named[c] for c in known], body.alias("_body"))
            .select("domain", "from_idx", "final_url", *kept, F.posexplode(found).alias("pos", "_l")))
    text = html.inline_text(F.col("_l.inner"))
    href = html.unescape_html(F.btrim("_l.href", F.lit("\"'")))
    links = computed(rows, anchor=F.when(F.col("_l.is_frame"), "").otherwise(text),
                     url=U.cleaned_link(F.col("final_url"), href))
    out = links.select("domain", "from_idx", "pos", *kept, F.col("_l.is_frame").alias("is_frame"), "anchor", "url")
    return same_domain(out.where("url is not null"))


def link_graph(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Edges from a page to an address of its domain, with the page found there (if any)."""
    edges = links.select("domain", "from_idx", F.col("url").alias("to_url"), U.dedupe_key("url").alias("_k")).distinct()
    targets = pages.select("domain", "page_idx", U.dedupe_key("final_url").alias("_k"))
    by_key = targets.groupBy("domain", "_k").agg(F.min("page_idx").alias("to_idx"))
    return edges.join(by_key, ["domain", "_k"], "left").drop("_k")


def page_depths(pages: DataFrame, graph: DataFrame, most: int | None = None) -> DataFrame:
    """Link distance from the home page over any number of links; null for pages that none leads to (or beyond `most`)."""
    homes = pages.where("depth = 0").select("domain", F.col("page_idx").alias("node"))
    hops = graph.select("domain", F.col("from_idx").alias("source"), F.col("to_idx").alias("target"), F.lit(0).alias("place"))
    near = distances(homes, hops, most=most).select("domain", F.col("node").alias("page_idx"), F.col("distance").alias("link_depth"))
    return pages.join(near, ["domain", "page_idx"], "left")


# --- scoring and planning ----------------------------------------------------------------


def footer_coverage(homes: DataFrame) -> DataFrame:
    """Categories a home page's footer already answers (domain, html, text)."""
    foot = html.footer_text(F.col("html"), F.col("text"))
    mail = F.col("_f").rlike(fixed.EMAIL) | F.col("html").rlike(r"(?i)\sdata-cfemail\s*=")
    contact = F.col("_f").rlike("(?U)" + fixed.ADDRESS_HANGUL) & F.col("_f").rlike("(?U)" + fixed.PHONE) & mail
    named = label_value(F.col("_f"), fixed.NAME_LABELS, 60).isNotNull()
    flags = homes.withColumn("_f", foot).select("domain", contact.alias("contact"), (contact & named).alias("company"))
    return (flags.select("domain", F.explode(F.filter(F.array(
        F.when(F.col("contact"), "contact"), F.when(F.col("company"), "company")), lambda x: x.isNotNull())).alias("category")))


def sitemap_links(urls: DataFrame, tokens: Mapping[str, Sequence[str]] = fixed.LINK_TOKENS) -> DataFrame:
    """Listed addresses (domain, sitemap_url, file_no, pos, url) as classified links of the domain itself."""
    full = computed(urls, _url=U.cleaned_link(F.col("sitemap_url"), F.col("url")))
    links = full.where("_url is not null").select(
        "domain", F.lit(None).cast("bigint").alias("from_idx"), (F.col("file_no") * 1_000_000_000 + F.col("pos")).alias("pos"), F.lit(0).alias("depth"),
        F.lit("sitemap").alias("from_category"), F.lit(False).alias("is_frame"), F.lit("").alias("anchor"), F.col("_url").alias("url"))
    return classify_links(same_domain(links), tokens).where("category is not null")


def _link_order(scored: DataFrame) -> list[Column]:
    """Best first: real links by score, then spare ones, nearest to the root and shortest; page links before sitemap links."""
    spare = F.col("category") == "other"
    return [spare.alias("spare"), F.when(spare, U.path_depth("url")).otherwise(0).alias("steps"), F.when(spare, F.length("url")).otherwise(0).alias("chars"),
            (-F.coalesce("score", F.lit(0))).alias("s"), F.col("link_depth"), F.coalesce(F.col("from_idx"), F.lit(2**62)).alias("i"), F.col("pos")]


def score_links(links: DataFrame, homes: DataFrame, weights: Mapping[str, int] = fixed.CATEGORY_WEIGHT,
                covered: DataFrame | None = None, spare: bool = False) -> DataFrame:
    """Best score per address of a domain (links must be classified; `sitemap_links` may be among them).

    Category weight less the path depth; frames on top; foreign folders, categories the home
    footer covers (not for sitemap links) and links found deeper score less, job pages under job pages more. With `spare`,
    unclassified links outside news-like folders are kept too, as category 'other' without a score.
    """
    framed = links.withColumn("category", F.when(F.col("is_frame"), F.coalesce("category", F.lit("company")))
                              .otherwise(F.col("category")))
    if spare:
        low_value = F.lower(U.path("url")).rlike(any_of(fixed.LOW_VALUE_PATH_HINTS))
        framed = framed.withColumn("category", F.coalesce("category", F.when(~low_value, "other")))
    framed = framed.where("category is not null")
    flagged = foreign_language_links(framed, homes)
    if covered is not None:
        flagged = flagged.join(covered.select("domain", "category", F.lit(True).alias("_covered")), ["domain", "category"], "left")
    else:
        flagged = flagged.withColumn("_covered", F.lit(False))
    base = F.when(F.col("is_frame"), max(weights.values()) + 10).otherwise(
        value_map(F.col("category"), dict(weights)) - F.least(U.path_depth("url"), F.lit(5)))
    child, listed = F.col("depth") > 0, F.coalesce(F.col("from_category") == "sitemap", F.lit(False))
    bonus = F.when(child & (F.col("category") == "recruitment") & (F.col("from_category") == "recruitment"), 6).otherwise(0)
    penalty = (F.when(F.col("foreign"), fixed.FOREIGN_LANG_PENALTY).otherwise(0)
               + F.when(child, 5).when(F.coalesce("_covered", F.lit(False)) & ~listed, fixed.FOOTER_COVERED_PENALTY).otherwise(0))
    score = F.when(F.col("category") != "other", base + bonus - penalty)
    depth = F.when(F.col("category") == "other", 1).otherwise(F.col("depth") + 1)
    scored = computed(flagged, score=score.cast("int"), link_depth=depth)
    best = scored.groupBy("domain", "url").agg(F.min_by(
        F.struct("category", "score", "link_depth", "from_idx", "pos"), F.struct(*_link_order(scored))).alias("b"))
    return best.select("domain", "url", "b.*")


def crawl_plan(scored: DataFrame, max_pages: int | None = None, max_depth: int | None = None,
               max_recruit: int | None = None, have: int = 1) -> DataFrame:
    """The next pages per domain: best first, job pages beyond `max_recruit` after all others, then spare links.

    `have` pages of the budget `max_pages` are already there. Without limits the plan holds every link. With them, each kind of link is
    cut to what the budget can use before the kinds meet.
    """
    budget = max_pages - have if max_pages else None
    near = scored.where(F.col("link_depth") <= max_depth) if max_depth else scored
    places = {f"_o{i}": c for i, c in enumerate(_link_order(near))}
    keyed = computed(near, _k=U.dedupe_key("url"), **places)
    order = [F.asc(c) for c in (*places, "url")]
    once = first_per_key(keyed, ["domain", "_k"], [*places, "url"])
    kind = F.when(F.col("category") == "recruitment", "jobs").when(F.col("category") == "other", "spare").otherwise("rest")
    queue = top_per_key(once.withColumn("kind", kind), ["domain", "kind"], order, budget and (max_recruit or 0) + budget)
    late = (F.col("kind") == "jobs") & (F.col("rn") > max_recruit) if max_recruit else F.lit(False)
    phase = F.when(F.col("kind") == "spare", 2).when(late, 1).otherwise(0)
    ranked = top_per_key(queue.withColumn("phase", phase).drop("rn"), ["domain"], [F.asc("phase"), *order], budget, "rank")
    return ranked.select("domain", "rank", "url", "category", "phase", "score", "link_depth")
