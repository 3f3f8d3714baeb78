"""Key contacts: names next to titles, ranked, the best few per domain."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.ranking import top_per_key
from ..functions.text import computed, contains_any, escape, may_name, names_any, stripped, tidy
from . import rounds
from .facts import category_rank, display_name, is_korean_name, is_plausible_name

PEOPLE_PAGES = ("management", "company", "home", "contact")


def text_units(pages: DataFrame, max_unit: int | None = None, max_joined: int = 20) -> DataFrame:
    """Lines of a page and pairs of short neighbouring lines (a name above its title)."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: stripped(x)),
                     lambda x: x != "")
    unit = lambda text, joined: F.struct(text.alias("unit"), F.lit(joined).alias("joined"))
    short = lambda a, b: (F.length(a) <= max_joined) & (F.length(b) <= max_joined)
    pairs = F.zip_with("_lines", F.slice("_lines", F.lit(2), F.size("_lines")), lambda a, b: F.when(
        short(a, b), unit(F.concat(a, F.lit(" "), b), True)))
    every = F.concat(F.transform("_lines", lambda x: unit(x, False)), F.array_compact(pairs))
    rows = computed(pages, _lines=lines).select(
        *[c for c in pages.columns if c not in ("html", "text", "footer")], F.posexplode(every).alias("unit_pos", "_u"))
    units = rows.select(*[c for c in rows.columns if c != "_u"], "_u.unit", "_u.joined")
    return units.where(F.length("unit") <= max_unit) if max_unit else units


def _title_token(token: str) -> str:
    return rf"\b{escape(token)}\b" if token.isascii() else rf"(?<![가-힣]){escape(token)}(?![가-힣])"


def rank_of(title: Column, groups: Sequence[tuple[str, Sequence[str]]] = fixed.TITLE_GROUPS) -> Column:
    """Index of the highest title group named in a text (whole words), null when none is."""
    out = None
    for i, (_, tokens) in enumerate(groups):
        hit = title.rlike("(?iU)" + "|".join(_title_token(t) for t in tokens))
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def title_rank(c: DataFrame, titles: Sequence[tuple[str, Sequence[str]]] = fixed.TITLE_GROUPS, text: str = "title") -> DataFrame:
    label = F.get(F.array(*[F.lit(name) for name, _ in titles]), F.col("title_rank"))
    return computed(c, title_rank=rank_of(F.col(text), titles)).withColumn("title_group", label)


def is_excluded_role(text: Column) -> Column:
    """A role sales does not look for, unless the text also names an IT or chief title."""
    return contains_any(F.lower(text), fixed.EXCLUDED_TITLE_TOKENS) & rank_of(text).isNull()


def excluded_roles(c: DataFrame, text: str = "title") -> DataFrame:
    return c.where(~is_excluded_role(F.col(text)))


def banned_names(pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Words that are the company, not a person: its domain label, name parts and aliases."""
    label = pages.select("domain", F.lower(F.split("domain", r"\.")[0]).alias("word"))
    alias = pages.select("domain", F.explode(F.regexp_extract_all(
        "text", F.lit("(?U)" + fixed.COMPANY_ALIAS), F.lit(1))).alias("word"))
    out = label.unionByName(alias)
    if names is not None:
        parts = names.select("domain", F.explode(F.split("value", r"(?U)[\s(),.]+")).alias("word"))
        out = out.unionByName(parts.where(F.length("word") >= 2))
    return out.select("domain", F.lower("word").alias("word")).distinct()


def naming_titles(pages: DataFrame, titles: Sequence[tuple[str, Sequence[str]]] = fixed.TITLE_GROUPS) -> DataFrame:
    """Pages whose text can name a title; the others have no line that gives a contact."""
    return pages.where(may_name(F.col("text"), [t for _, words in titles for t in words]))


def contact_candidates(units: DataFrame, banned: DataFrame) -> DataFrame:
    """Names found beside a title, with the title's rank and the reading order."""
    tokens = sorted((t for _, words in fixed.TITLE_GROUPS for t in words), key=len, reverse=True)
    title = "(" + "|".join(rf"\b{escape(t)}\b" if t.isascii() else escape(t) for t in tokens) + ")"
    name = f"({fixed.KOREAN_NAME}|{fixed.ENGLISH_NAME})"
    title_first = rf"(?iU)(?<![가-힣]){title}{fixed.SECONDARY_TITLE}\s*[:：]?\s*{name}(?![가-힣])"
    name_first = rf"(?iU)(?<![가-힣]){name}\s*[,/·]?\s*{title}(?![가-힣])"
    both = lambda pattern, t, n: F.zip_with(
        F.regexp_extract_all("unit", F.lit(pattern), F.lit(t)), F.regexp_extract_all("unit", F.lit(pattern), F.lit(n)),
        lambda a, b: F.struct(a.alias("title"), b.alias("name")))
    near = units.where(names_any(F.col("unit"), tokens))
    rows = near.select(
        "domain", F.col("final_url").alias("source_url"), "unit", "joined",
        F.struct(category_rank(PEOPLE_PAGES).alias("cat"), "page_idx", "unit_pos").alias("_at"),
        F.posexplode(F.concat(both(title_first, 1, 2), both(name_first, 2, 1))).alias("pos", "c"))
    c = computed(rows, name=tidy("c.name"), title=tidy("c.title")).select(
        "domain", "source_url", "unit", "joined", F.struct("_at", "pos").alias("seq"), "name", "title")
    loose = F.lower("title").isin(*fixed.LOOSE_TITLES)
    syllables = F.length(F.regexp_replace("name", r"(?U)\s+", ""))
    good = (is_plausible_name(F.col("name")) & ~is_excluded_role(F.lower("unit"))
            & ~(loose & (F.col("joined") | (F.length("unit") > 45) | (is_korean_name(F.col("name")) & (syllables != 3)))))
    ranked = title_rank(c.where(good)).where("title_rank is not null")
    words = banned.select("domain", F.col("word").alias("_w"))
    kept = ranked.withColumn("_w", F.lower("name")).join(words, ["domain", "_w"], "left_anti")
    position = F.when(F.length("title") <= 40, F.col("title")).otherwise(F.col("title_group"))
    return kept.select("domain", "name", "title_rank", position.alias("position"), "source_url", "seq")


def name_variants(names: DataFrame) -> DataFrame:
    """(domain, long, short): different names of a domain (domain, name) one of which contains the other.

    Found by an equi join of a name's stretches, of the lengths that names of its domain have, with those names: no pairs of names are formed.
    """
    text = F.col("name")
    lengths = names.groupBy("domain").agg(F.collect_set(F.length("name")).alias("_lengths"))       # at most as many as the longest name has characters
    stretches = F.flatten(F.transform(F.filter("_lengths", lambda n: (n > 0) & (n <= F.length(text))), lambda n: F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))))
    probes = names.join(lengths, "domain").select("domain", F.col("name").alias("long"), F.explode(F.array_distinct(stretches)).alias("short"))
    return probes.where("short <> long").join(names.withColumnRenamed("name", "short"), ["domain", "short"]).select("domain", "long", "short")


def first_of_variants(ranked: DataFrame, variants: DataFrame) -> DataFrame:
    """`ranked` (domain, name, place: what sorts them, different for each) without names that are variants of a better one that stays.

    The choice of a walk from the best name on, made in rounds: names that no better variant is left of stay, their variants go, and what is left
    has fewer variants than before. Each round is a written table of the variants that are still open; variants come ordered by `place`, so a
    domain's names are never gathered.
    """
    side = lambda c: ranked.select("domain", F.col("name").alias(c), F.col("place").alias(f"{c}_place"))
    pairs = variants.join(side("long"), ["domain", "long"]).join(side("short"), ["domain", "short"])
    better = F.col("long_place") < F.col("short_place")
    open_pairs = rounds.written(pairs.select("domain", F.when(better, F.col("long")).otherwise(F.col("short")).alias("better"), F.when(better, F.col("short")).otherwise(F.col("long")).alias("worse")), "variants")
    lost = None
    while not open_pairs.isEmpty():
        worse = open_pairs.select("domain", F.col("worse").alias("better")).distinct()
        settled = open_pairs.join(worse, ["domain", "better"], "left_anti")
        gone = rounds.written(settled.select("domain", F.col("worse").alias("name")).distinct(), "lost")
        lost = gone if lost is None else lost.unionByName(gone)
        left = open_pairs
        for c in ("better", "worse"):
            left = left.join(gone.withColumnRenamed("name", c), ["domain", c], "left_anti")
        # a name that stays has no open variant any more: they are all gone
        open_pairs = rounds.written(left, "variants")
    return ranked if lost is None else ranked.join(lost, ["domain", "name"], "left_anti")


def key_contacts(c: DataFrame, n: int | None = None) -> DataFrame:
    """The (n best) people per domain; a name that contains, or is contained in, a better one is the same person.

    People are one row per domain and name throughout: variants are found by a join and settled in rounds, the best are cut per task.
    """
    people = c.groupBy("domain", "name").agg(
        F.min("title_rank").alias("title_rank"), F.min("seq").alias("first"),
        F.min_by(F.struct("position", "source_url"), F.struct("title_rank", "seq")).alias("p"))
    # spellings that differ in case only are variants of each other: the best of them stands for all
    low = people.groupBy("domain", F.lower("name").alias("_low")).agg(F.min(F.struct("title_rank", "first", "name", "p")).alias("b"))
    low = rounds.written(low.select("domain", F.col("_low").alias("name"), F.struct("b.title_rank", "b.first", "b.name").alias("place"), "b.p"), "people")
    kept = first_of_variants(low, name_variants(low.select("domain", "name")))
    best = top_per_key(kept, ["domain"], [F.asc("place")], n, "rn")
    return best.select("domain", F.col("rn").alias("place"), display_name(F.col("place.name")).alias("name"), "p.position", "p.source_url", "place.title_rank")


def with_ceo(contacts: DataFrame, ceo: DataFrame, n: int | None = None) -> DataFrame:
    """Contacts plus the representative of the footer where there is room and it is a new name."""
    compact = lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", ""))
    seen = contacts.groupBy("domain").agg(F.max("place").alias("_n"))
    known = contacts.select("domain", compact(F.col("name")).alias("_name")).distinct()
    extra = (ceo.join(seen, "domain", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).where(F.col("_n") < n if n else F.lit(True))
             .withColumn("_name", compact(F.col("value"))).join(known, ["domain", "_name"], "left_anti")
             .select("domain", (F.col("_n") + 1).alias("place"), F.col("value").alias("name"),
                     F.lit(fixed.CEO_FILL_POSITION).alias("position"), "source_url"))
    return contacts.select("domain", "place", "name", "position", "source_url").unionByName(extra)
