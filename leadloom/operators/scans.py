"""Saved companies, scan history and the hiring trend between two scans."""
from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_per_key
from ..functions.text import empty_to_null
from ..functions.urls import host, registrable

COMPANY_FIELDS = ("name", "address", "phone", "email", "industry", "biz_number", "ceo", "website")
SEARCH_FIELDS = ("name", "industry", "website", "domain", "address", "email", "biz_number", "ceo")


def signal_of(jobs: Column) -> Column:
    return F.when(jobs >= 5, "High").when(jobs >= 2, "Medium").when(jobs == 1, "Low").otherwise("None")


def hiring_signal(domains: DataFrame, jobs: DataFrame) -> DataFrame:
    """Number of IT openings and hiring signal per domain; domains without jobs get None."""
    counts = jobs.groupBy("domain").agg(F.count(F.lit(1)).alias("it_jobs"))
    joined = domains.select("domain").distinct().join(counts, "domain", "left")
    n = F.coalesce("it_jobs", F.lit(0))
    return joined.select("domain", n.cast("bigint").alias("it_jobs"), signal_of(n).alias("it_hiring"))


def previous_scan(scan_history: DataFrame) -> DataFrame:
    """The scan before the newest one of every domain."""
    ranked = top_per_key(scan_history, ["domain"], [F.desc("scanned_at"), F.desc("id")], 2)
    return ranked.where("rn = 2").select("domain", "it_jobs", "it_hiring", "scanned_at")


def scan_history_top(scan_history: DataFrame, n: int | None = None) -> DataFrame:
    ranked = top_per_key(scan_history, ["domain"], [F.desc("scanned_at"), F.desc("id")], n)
    return ranked.select("domain", "rn", "scanned_at", "it_hiring", "it_jobs", "contacts")


def company_trend(companies: DataFrame, scan_history: DataFrame) -> DataFrame:
    """Companies with the job count of their previous scan; null for a first scan."""
    prev = previous_scan(scan_history).select(
        "domain", F.col("it_jobs").alias("prev_it_jobs"), F.col("scanned_at").alias("prev_scanned_at"))
    joined = companies.join(prev, "domain", "left")
    return joined.withColumn("jobs_delta", F.coalesce("it_jobs", F.lit(0)) - F.col("prev_it_jobs"))


def rising_companies(trend: DataFrame) -> DataFrame:
    return trend.where("jobs_delta > 0").orderBy(F.desc("jobs_delta"), "domain")


def trend_label(df: DataFrame, delta: str = "jobs_delta") -> DataFrame:
    d = F.col(delta)
    text = (F.when(d.isNull(), "new").when(d > 0, F.concat(F.lit("▲ +"), d.cast("string")))
            .when(d < 0, F.concat(F.lit("▼ "), d.cast("string"))).otherwise("="))
    return df.withColumn("trend", text)


def list_companies(trend: DataFrame) -> DataFrame:
    return trend.orderBy(F.desc("updated_at"), F.desc("id"))


def company_summary(companies: DataFrame, full: bool = False) -> DataFrame:
    """The summary columns; the full scan result only when asked for, so the scan can skip it."""
    cols = ["id", "domain", *COMPANY_FIELDS, "it_hiring", "it_jobs", "contacts", "created_at", "updated_at"]
    return companies.select(*cols, *(["result"] if full else []))


def search_companies(trend: DataFrame, query: str = "", rising_only: bool = False) -> DataFrame:
    out = trend.where("jobs_delta > 0") if rising_only else trend
    needle = query.strip().lower()
    if not needle:
        return out
    hit = F.lit(False)
    for c in SEARCH_FIELDS:
        hit = hit | F.coalesce(F.lower(c).contains(needle), F.lit(False))
    return out.where(hit)


def has_contact(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce(empty_to_null("email"), empty_to_null("phone")).isNotNull())


def rescan_targets(companies: DataFrame, days: int, as_of: Column) -> DataFrame:
    """Sites last updated more than `days` days before `as_of`; 0 takes them all."""
    due = companies if not days else companies.where(
        F.col("updated_at") < as_of - F.make_dt_interval(F.lit(days)))
    site = F.coalesce(empty_to_null("website"), F.concat(F.lit("https://"), F.col("domain")))
    return due.select("id", "domain", site.alias("url"), "updated_at")


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """One row of counts over a scan batch (url, status, has_result, jobs_delta)."""
    return outcomes.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("has_result").alias("done"),
        F.count_if(F.col("status") == "error").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("jobs_delta") > 0).alias("rising"))


# --- saving ------------------------------------------------------------------------------


def scan_rows(scans: DataFrame) -> DataFrame:
    """Nested scan results flattened to one row per save; results without a domain are rejected."""
    c = F.col("company")
    named = F.when(host(c["website"]) != "", host(c["website"])).otherwise(host("scanned_url"))
    flat = scans.select(
        "seq", "scanned_at", empty_to_null(registrable(named)).alias("domain"),
        *[c[f].alias(f) for f in COMPANY_FIELDS],
        F.coalesce(empty_to_null("it_hiring"), F.lit("None")).alias("it_hiring"),
        F.coalesce(F.size("it_recruitment"), F.lit(0)).cast("bigint").alias("it_jobs"),
        F.coalesce(F.size("key_contacts"), F.lit(0)).cast("bigint").alias("contacts"),
        F.struct(*[x for x in scans.columns if x not in ("seq", "scanned_at")]).alias("result"))
    return flat.where("domain is not null")


def append_scan_history(rows: DataFrame) -> DataFrame:
    """History rows of saves (output of `scan_rows`)."""
    return rows.select(
        F.col("seq").alias("id"), "domain", "scanned_at", "it_hiring", "it_jobs", "contacts",
        empty_to_null("email").isNotNull().alias("has_email"),
        empty_to_null("phone").isNotNull().alias("has_phone"))


def upsert_companies(current: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Companies after the saves in `rows`: newest values win (nulls included), id and creation stay.

    New companies take the seq of their first save as id."""
    fields = [*COMPANY_FIELDS, "it_hiring", "it_jobs", "contacts"]
    fields += [c for c in ("result",) if c in rows.columns]
    saves = rows.select("domain", F.col("seq").alias("id"), F.lit(1).alias("_new"), "seq",
                        F.col("scanned_at").alias("created_at"), F.col("scanned_at").alias("updated_at"), *fields)
    if current is not None:
        kept = current.select("domain", "id", F.lit(0).alias("_new"), F.lit(None).cast("bigint").alias("seq"),
                              "created_at", "updated_at", *[f for f in fields if f in current.columns])
        saves = saves.unionByName(kept, allowMissingColumns=True)
    newest = F.struct("_new", F.col("updated_at"), F.col("seq"))
    oldest = F.struct("_new", "created_at", "seq")
    merged = saves.groupBy("domain").agg(
        F.min_by("id", oldest).alias("id"), F.min_by("created_at", oldest).alias("created_at"),
        F.max_by(F.struct("updated_at", *fields), newest).alias("_v"))
    return merged.select("id", "domain", *[F.col(f"_v.{f}").alias(f) for f in fields],
                         "created_at", F.col("_v.updated_at").alias("updated_at"))


def delete_companies(companies: DataFrame, ids: DataFrame) -> DataFrame:
    """Companies without the given ids. Their scan history stays, so a re-added site keeps its trend."""
    return companies.join(ids.select("id").distinct(), "id", "left_anti")
