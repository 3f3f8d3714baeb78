"""Sales leads: normalising, scoring, lists and counts, matching and duplicates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as N
from ..functions import fixed
from ..functions.text import computed, empty_to_null, one_of, titled, trimmed, value_map
from ..functions.urls import website_domain

FIELDS = (
    "company_id", "domain", "company_name", "website", "biz_number", "industry", "company_size",
    "contact_name", "rank", "department", "phone", "mobile", "email", "kakao", "source", "project_type",
    "tech", "budget", "team_size", "expected_start", "bridge_se", "competitor", "lost_reason", "it_hiring",
    "status", "assignee", "next_action", "next_date", "last_contact", "memo")
HAYSTACK = ("company_name", "contact_name", "phone", "mobile", "email", "kakao", "biz_number", "industry",
            "website", "memo", "competitor")


def with_fields(raw: DataFrame) -> DataFrame:
    """Raw lead rows with every field present as text."""
    missing = [f for f in FIELDS if f not in raw.columns]
    return raw.withColumns({f: F.lit(None).cast("string") for f in missing}) if missing else raw


def normalised(raw: DataFrame) -> DataFrame:
    """Every raw row with typed fields and an error `code` (null for a good row)."""
    raw = with_fields(raw)
    c = F.col
    keep = [x for x in raw.columns if x not in FIELDS]
    name, email = trimmed(c("company_name")), F.lower(trimmed(c("email")))
    status = one_of(c("status"), fixed.LEAD_STATUSES, "new")
    code = (F.when(F.col("company_name").isNull(), "company_required")
            .when(~F.col("email").rlike(r"(?U)^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email_invalid"))
    text = lambda f: trimmed(c(f)).alias(f)
    typed = raw.select(
        *keep,
        N.whole_number(c("company_id")).alias("company_id"),
        F.coalesce(trimmed("domain"), website_domain(trimmed("website"))).alias("domain"),
        name.alias("company_name"), text("website"),
        N.biz_number(c("biz_number")).alias("biz_number"), text("industry"),
        one_of(c("company_size"), fixed.COMPANY_SIZES).alias("company_size"), text("contact_name"),
        N.rank_code(c("rank")).alias("rank"), text("department"), N.lead_phone(c("phone")).alias("phone"),
        N.lead_phone(c("mobile")).alias("mobile"), email.alias("email"), text("kakao"),
        one_of(c("source"), fixed.SOURCES, "other").alias("source"),
        one_of(c("project_type"), fixed.PROJECT_TYPES).alias("project_type"),
        N.tech_list(c("tech")).alias("tech"), N.budget(c("budget")).alias("budget"),
        N.digits_number(c("team_size")).alias("team_size"),
        N.year_month(c("expected_start")).alias("expected_start"),
        F.coalesce(F.lower(trimmed(c("bridge_se"))).isin(*fixed.TRUE_WORDS), F.lit(False)).alias("bridge_se"),
        text("competitor"),
        F.when(F.lower(trimmed("status")) == "lost", one_of(c("lost_reason"), fixed.LOST_REASONS)).alias("lost_reason"),
        titled(one_of(c("it_hiring"), fixed.HIRING_LEVELS)).alias("it_hiring"), status.alias("status"),
        text("assignee"), text("next_action"), N.iso_date(c("next_date")).alias("next_date"),
        N.iso_date(c("last_contact")).alias("last_contact"), text("memo"))
    return computed(typed, code=code)


def normalise_leads(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw rows (`row` + text fields) to (valid leads, errors(row, code))."""
    typed = normalised(raw)
    return typed.where("code is null").drop("code"), typed.where("code is not null").select("row", "code")


# --- scoring -----------------------------------------------------------------------------


def _points(as_of: Column) -> list[tuple[str, Column]]:
    """Points of every scoring rule; a rule without a hit gives 0."""
    c = F.col
    filled = lambda f: empty_to_null(f).isNotNull()
    flag = lambda cond, n: F.when(cond, n).otherwise(0)
    steps = lambda value, rules, hit: F.coalesce(*[F.when(hit(value, limit), n) for limit, n in rules], F.lit(0))
    months = N.months_until(c("expected_start"), as_of)
    return [
        ("hiring", F.coalesce(value_map(c("it_hiring"), fixed.HIRING_SCORE), F.lit(0))),
        ("rank", F.coalesce(value_map(c("rank"), fixed.RANK_SCORE), F.lit(0))),
        ("email", flag(filled("email"), 10)),
        ("phone", flag(filled("phone") | filled("mobile"), 10)),
        ("kakao", flag(filled("kakao"), 5)),
        ("budget", steps(c("budget"), fixed.BUDGET_POINTS, lambda v, limit: v >= limit)),
        ("source", F.coalesce(value_map(F.coalesce(c("source"), F.lit("other")), fixed.SOURCE_SCORE), F.lit(0))),
        ("project", flag(filled("project_type"), 5)),
        ("biz", flag(c("biz_number").rlike(r"^\d{3}-\d{2}-\d{5}$"), 3)),
        ("timing", steps(months, fixed.TIMING_POINTS, lambda v, limit: v <= limit)),
        ("team", flag(c("team_size") >= 3, 5)),
    ]


def score_leads(leads: DataFrame, as_of: Column) -> DataFrame:
    """Leads with their score (0..100) and the parts it is made of."""
    parts = [F.struct(F.lit(key).alias("key"), p.cast("int").alias("points")) for key, p in _points(as_of)]
    breakdown = F.filter(F.array(*parts), lambda x: x["points"] > 0)
    total = F.aggregate("score_breakdown", F.lit(0), lambda acc, x: acc + x["points"])
    scored = computed(leads, score_breakdown=breakdown)
    return computed(scored, score=F.greatest(F.lit(0), F.least(F.lit(100), total)))


# --- lists and counts --------------------------------------------------------------------


def _open() -> Column:
    return F.col("status").isin(*fixed.OPEN_STATUSES)


def is_overdue(as_of: Column) -> Column:
    return F.coalesce(_open() & (F.col("next_date") < as_of), F.lit(False))


def overdue_leads(leads: DataFrame, as_of: Column) -> DataFrame:
    return leads.withColumn("overdue", is_overdue(as_of))


def list_leads(leads: DataFrame) -> DataFrame:
    return leads.orderBy(F.desc("updated_at"), F.desc("id"))


def search_leads(leads: DataFrame, query: str = "", quick: str = "all", status: str = "", assignee: str = "",
                 as_of: Column | None = None) -> DataFrame:
    out = leads
    if quick == "hot":
        out = out.where(F.col("score") >= fixed.HOT_SCORE)
    elif quick == "overdue":
        out = out.where(is_overdue(as_of))
    elif quick == "week":
        out = out.where(_open() & F.col("next_date").between(as_of, F.date_add(as_of, 7)))
    if status:
        out = out.where(F.col("status") == status)
    if assignee:
        out = out.where(F.col("assignee") == assignee)
    needle = query.strip().lower()
    if needle:
        joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in HAYSTACK], F.array_join("tech", " "))
        out = out.where(F.lower(joined).contains(needle))
    return out


def lead_kpis(leads: DataFrame, as_of: Column) -> DataFrame:
    """One row: pipeline value, open leads, win rate, new leads of the month, overdue leads."""
    fresh = F.date_trunc("month", "created_at") == F.date_trunc("month", as_of)
    agg = leads.agg(
        F.count_if(_open()).alias("open_leads"),
        F.coalesce(F.sum(F.when(_open(), F.col("budget"))), F.lit(0)).alias("pipeline"),
        F.count_if(F.col("status") == "won").alias("won"), F.count_if(F.col("status") == "lost").alias("lost"),
        F.count_if(fresh).alias("new_this_month"),
        F.count_if(fresh & (F.col("score") >= fixed.HOT_SCORE)).alias("hot_this_month"),
        F.count_if(is_overdue(as_of)).alias("overdue"))
    closed = F.col("won") + F.col("lost")
    return agg.withColumn("win_rate", F.when(closed > 0, F.round(F.col("won") / closed * 100)).cast("bigint"))


def _status_dimension(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(fixed.LEAD_STATUSES)), "pos int, status string")


def status_counts(leads: DataFrame) -> DataFrame:
    counts = leads.groupBy("status").agg(F.count(F.lit(1)).alias("leads"))
    return (_status_dimension(leads).join(counts, "status", "left")
            .select("pos", "status", F.coalesce("leads", F.lit(0)).alias("leads")).orderBy("pos"))


def kanban_totals(leads: DataFrame) -> DataFrame:
    sums = leads.groupBy("status").agg(F.count(F.lit(1)).alias("leads"),
                                       F.coalesce(F.sum("budget"), F.lit(0)).alias("budget"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (_status_dimension(leads).join(sums, "status", "left")
            .select("pos", "status", zero("leads"), zero("budget")).orderBy("pos"))


def assignees(leads: DataFrame) -> DataFrame:
    return leads.where(empty_to_null("assignee").isNotNull()).select("assignee").distinct().orderBy("assignee")


# --- matching ----------------------------------------------------------------------------


def match_leads_to_company(companies: DataFrame, leads: DataFrame) -> DataFrame:
    """The lead each company already has: by company id first, then by domain (smallest lead id)."""
    by_id = leads.where("company_id is not null").groupBy(F.col("company_id").alias("id")).agg(
        F.min("id").alias("_by_id"))
    by_domain = leads.where("domain is not null").groupBy("domain").agg(F.min("id").alias("_by_domain"))
    joined = companies.join(by_id, "id", "left").join(by_domain, "domain", "left")
    return joined.select(*companies.columns, F.coalesce("_by_id", "_by_domain").alias("lead_id"))


def companies_without_lead(companies: DataFrame, leads: DataFrame) -> DataFrame:
    return match_leads_to_company(companies, leads).where("lead_id is null").drop("lead_id")


def match_leads_to_customers(leads: DataFrame, customers: DataFrame) -> DataFrame:
    """Leads with the signed customer of their domain, else of their company name.

    A name shared by several customers belongs to the last one in the customer list."""
    index = customers.select(
        F.col("customer_key").alias("_key"), F.col("grade").alias("_grade"), F.lower(trimmed("company_name")).alias("_name"),
        "total_value", "company_name")
    last = F.struct((-F.col("total_value")).alias("a"), F.col("company_name").alias("b"), F.col("_key").alias("c"),
                    F.col("_by_name").alias("d"))
    entries = (index.withColumn("_lookup", F.col("_key")).withColumn("_by_name", F.lit(0))
               .unionByName(index.withColumn("_lookup", F.col("_name")).withColumn("_by_name", F.lit(1))))
    lookup = entries.where("_lookup is not null").groupBy("_lookup").agg(
        F.max_by(F.struct("_key", "_grade"), last).alias("_c"))
    side = lambda name: lookup.select(F.col("_lookup").alias(f"_l{name}"), F.col("_c").alias(f"_c{name}"))
    keyed = leads.withColumn("_ldomain", empty_to_null("domain")).withColumn("_lname", F.lower(trimmed("company_name")))
    joined = keyed.join(side("domain"), "_ldomain", "left").join(side("name"), "_lname", "left")
    hit = F.coalesce("_cdomain", "_cname")
    return joined.select(*leads.columns, hit["_key"].alias("customer_key"), hit["_grade"].alias("customer_grade"))


def _probe_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_domain": website_domain(trimmed("website")), "_email": F.lower(trimmed("email")),
        "_name": F.lower(trimmed("company_name"))})


def _lead_keys(leads: DataFrame) -> DataFrame:
    return leads.select("id", empty_to_null("domain").alias("_domain"), empty_to_null(F.lower("email")).alias("_email"),
                        empty_to_null(F.lower("company_name")).alias("_name"))


REASONS = ("domain", "email", "name")


def _per_reason(df: DataFrame, who: str) -> DataFrame:
    """One row per key that a row has: `who`, reason, key."""
    pairs = F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"_{r}").alias("key")) for r in REASONS])
    rows = df.select(who, F.explode(F.filter(pairs, lambda p: p["key"].isNotNull())).alias("p"))
    return rows.select(who, "p.reason", "p.key")


def find_duplicate_leads(probes: DataFrame, leads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Why probes (probe_id, company_name, email, website) collide with leads, as two tables: (probe_id, reason, key) of shared
    keys, and (id, reason, key) of the leads that have them.

    Joined on (reason, key) they give the pairs of one probe; the tables are linear, also where a third of all leads share a name.
    """
    asked, known = _per_reason(_probe_keys(probes), "probe_id"), _per_reason(_lead_keys(leads), "id")
    shared = asked.join(known.select("reason", "key").distinct(), ["reason", "key"], "left_semi")
    having = known.join(asked.select("reason", "key").distinct(), ["reason", "key"], "left_semi")
    return shared.select("probe_id", "reason", "key"), having.select("id", "reason", "key")


def duplicate_summary(probes: DataFrame, leads: DataFrame) -> DataFrame:
    """Per probe: number of colliding leads, the strongest reason and the smallest lead id.

    Leads are counted per key and per combination of keys; inclusion and exclusion turns these
    counts into the size of the union. No pair of rows is ever built, so a value shared by a third
    of all leads costs one row.
    """
    combos = (("domain",), ("email",), ("name",), ("domain", "email"), ("domain", "name"), ("email", "name"),
              ("domain", "email", "name"))
    parts = [f"_{r}" for r in REASONS]

    def per_combo(df: DataFrame, *keep: str) -> DataFrame:
        """One row per combination of keys a row has; parts outside the combination are blank."""
        entry = lambda i, combo: F.when(F.expr(" and ".join(f"_{k} is not null" for k in combo)), F.struct(
            F.lit(i).alias("c"), *[(F.col(p) if p[1:] in combo else F.lit("")).alias(p) for p in parts]))
        rows = computed(df, **{p: F.col(p) for p in parts}).select(*keep, F.explode(F.array_compact(
            F.array(*[entry(i, combo) for i, combo in enumerate(combos)]))).alias("_c"))
        return rows.select(*keep, "_c.*")

    sizes = per_combo(_lead_keys(leads), "id").groupBy("c", *parts).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    probed = _probe_keys(probes)
    hits = per_combo(probed, "probe_id").join(sizes, ["c", *parts])
    sign = F.when(F.col("c").between(3, 5), -1).otherwise(1)
    found = hits.groupBy("probe_id").agg(
        F.sum(sign * F.col("n")).alias("matches"), F.min("first").alias("first_id"), F.min("c").alias("_c"))
    reason = F.get(F.array(*[F.lit(r) for r in REASONS]), F.col("_c"))
    return probed.select("probe_id").join(found, "probe_id", "left").select(
        "probe_id", F.coalesce("matches", F.lit(0)).alias("matches"), reason.alias("reason"), "first_id")


# --- activities --------------------------------------------------------------------------


def lead_activities(leads: DataFrame, activities: DataFrame) -> DataFrame:
    """Activities of existing leads, newest first within a lead."""
    known = activities.join(leads.select(F.col("id").alias("lead_id")), "lead_id", "left_semi")
    return known.orderBy("lead_id", F.desc("at"), F.desc("id"))


def add_activities(leads: DataFrame, activities: DataFrame, new: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(leads, activities) after new raw activities (id, lead_id, type, note, at).

    Activities of unknown leads are ignored; `last_contact` moves forward, never back."""
    known = new.join(leads.select(F.col("id").alias("lead_id")), "lead_id", "left_semi")
    typed = known.select(
        "id", "lead_id", one_of(F.col("type"), fixed.ACTIVITY_TYPES, "other").alias("type"),
        trimmed("note").alias("note"), F.coalesce(N.iso_date(F.col("at")), as_of.cast("date")).alias("at"))
    latest = typed.groupBy(F.col("lead_id").alias("id")).agg(F.max("at").alias("_last"))
    touched = (leads.join(latest, "id", "left")
               .withColumn("last_contact", F.greatest("last_contact", "_last"))
               .withColumn("updated_at", F.when(F.col("_last").isNotNull(), as_of).otherwise(F.col("updated_at")))
               .select(*leads.columns))
    return touched, activities.unionByName(typed, allowMissingColumns=True)


def delete_activities(activities: DataFrame, ids: DataFrame) -> DataFrame:
    return activities.join(ids.select("id").distinct(), "id", "left_anti")


def delete_leads(leads: DataFrame, activities: DataFrame, history: DataFrame,
                 ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the given leads and what hangs on them."""
    gone = ids.select("id").distinct()
    child = gone.select(F.col("id").alias("lead_id"))
    return (leads.join(gone, "id", "left_anti"), activities.join(child, "lead_id", "left_anti"),
            history.join(child, "lead_id", "left_anti"))
