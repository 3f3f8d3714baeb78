"""The scan result of a domain, put together from its pages."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facts, jobs, people, rounds
from .pages import footer_text, within_budget
from .scans import signal_of

PART = 1000         # contacts, openings and pages that one row of a domain lists

PERSON = ("name", "position", "source_url")
OPENING = ("title", "position", "location", "employment_type", "deadline", "description", "source_url")


def scan_result(pages: DataFrame, max_pages: int | None = None, max_contacts: int | None = None, max_jobs: int | None = None, part: int = PART) -> DataFrame:
    """One nested record per domain: company, sources, contacts, openings, signal, page list.

    `pages` are built pages (text, title, category). All pages, contacts and openings count unless a number is given. Part 0 of a domain has its facts and the
    first `part` of each list; a domain with more has further rows (`part` 1, 2, …) with what follows in its lists, so that no row and no task
    holds a large domain whole.

    The pages with their footers are written once to the shared folder, as are the facts that others rest on; `rounds.release` deletes
    the tables at the end of the job. All that is found meets in one aggregate by domain and part.
    """
    budget = within_budget(pages, max_pages) if max_pages else pages
    scanned = rounds.written(footer_text(budget), "scanned")
    names = rounds.written(facts.company_name(scanned), "names")
    emails = rounds.written(facts.company_email(scanned), "emails")
    lines = rounds.written(facts.line_facts(facts.text_sources(scanned)), "lines")
    single = {"name": names, "address": facts.company_address(facts.text_sources(scanned)), "email": emails, "industry": facts.company_industry(scanned)}
    single |= {f: lines.select("domain", F.col(f).alias("value"), F.col(f"{f}_source").alias("source_url")) for f in ("phone", "biz_number", "ceo")}
    candidates = people.contact_candidates(people.text_units(people.naming_titles(scanned)), people.banned_names(scanned, names))
    ceo = single["ceo"].where("value is not null and value <> ''")
    contacts = people.with_ceo(people.key_contacts(candidates, max_contacts), ceo, max_contacts)
    entries = rounds.written(jobs.job_candidates(scanned), "entries")
    openings = rounds.written(jobs.top_jobs(jobs.job_fields(jobs.dedupe_jobs(entries)), max_jobs).select("domain", "place", *OPENING), "openings")
    listed = scanned.select("domain", "page_idx", "final_url", "url").withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy("page_idx")))

    def rows(df: DataFrame, **columns: Column) -> DataFrame:
        """Some columns of a domain; a row with a place belongs to the part that the place says."""
        number = F.floor((F.col("place") - 1) / part).cast("int") if "place" in df.columns else F.lit(0)
        return df.select("domain", number.alias("part"), *[c.alias(n) for n, c in columns.items()])

    placed = lambda *fields: F.struct(F.col("place").cast("int").alias("place"), F.struct(*fields).alias("v"))
    found = [rows(df, **{f"f_{fact}": F.struct("value", "source_url")}) for fact, df in single.items()]
    found += [rows(facts.email_hint(scanned, emails), hint=F.struct("type", "url")), rows(contacts, person=placed(*PERSON)), rows(openings, opening=placed(*OPENING)),
              rows(listed, page=placed("final_url", "url")), rows(scanned.groupBy("domain").agg(F.count("*").alias("n")), pages=F.col("n")),
              rows(openings.groupBy("domain").agg(F.count("*").alias("n")), jobs=F.col("n"))]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"]).alias(c)
    out = every.groupBy("domain", "part").agg(*[one(f"f_{f}") for f in facts.FACTS], one("hint"), one("pages"), one("jobs"), in_order("person"), in_order("opening"), in_order("page"))
    head = lambda c: F.when(F.col("part") == 0, c)
    company = F.struct(*[F.col(f"f_{f}.value").alias(f) for f in facts.FACTS], F.get("page", F.lit(0))["final_url"].alias("website"))
    sources = F.struct(*[F.col(f"f_{f}.source_url").alias(f) for f in facts.FACTS])
    hint = F.when(F.col("hint").isNotNull(), F.create_map(F.lit("email"), F.col("hint")))
    return out.select("domain", "part", head(company).alias("company"), head(sources).alias("company_sources"), hint.alias("company_hints"), F.col("person").alias("key_contacts"),
                      F.col("opening").alias("it_recruitment"), head(signal_of(F.coalesce("jobs", F.lit(0)))).alias("it_hiring"),
                      F.transform("page", lambda p: p["final_url"]).alias("sources"), head(F.get("page", F.lit(0))["url"]).alias("scanned_url"), F.col("pages").alias("pages_crawled"))
