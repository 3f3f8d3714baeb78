"""Contracts and the customers they add up to."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as N
from ..functions import fixed
from ..functions.ranking import first_per_key, top_per_key
from ..functions.text import computed, empty_to_null, one_of, trimmed
from ..functions.urls import website_domain

FIELDS = ("lead_id", "company_id", "domain", "company_name", "website", "biz_number", "title",
          "contract_no", "project_type", "status", "start_date", "end_date", "signed_date", "amount",
          "monthly_rate", "team_size", "payment_terms", "contact_name", "rank", "department", "phone",
          "email", "our_pm", "tech", "satisfaction", "renewal_notice_days", "memo")


def _live() -> Column:
    return F.col("status") != "terminated"


def _active() -> Column:
    return F.col("status") == "active"


def normalise_contracts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw text contracts (row + FIELDS as strings) to (valid contracts, errors(row, code)).

    A missing amount is monthly rate x team x months; an empty signing date is the start date.
    """
    rows = normalised(raw.select("row", *FIELDS))
    return rows.where("code is null").select("row", *FIELDS), rows.where("code is not null").select("row", "code")


def normalised(raw: DataFrame) -> DataFrame:
    """Every raw row with its other columns, typed fields and an error `code` (null for a good row)."""
    c = F.col
    keep = [x for x in raw.columns if x not in FIELDS]
    rating = N.whole_number(c("satisfaction"))
    typed = raw.select(
        *keep, N.whole_number(c("lead_id")).alias("lead_id"), N.whole_number(c("company_id")).alias("company_id"),
        F.coalesce(trimmed("domain"), website_domain(trimmed("website"))).alias("domain"),
        trimmed("company_name").alias("company_name"), trimmed("website").alias("website"),
        trimmed("biz_number").alias("biz_number"), trimmed("title").alias("title"),
        trimmed("contract_no").alias("contract_no"),
        one_of(c("project_type"), fixed.PROJECT_TYPES).alias("project_type"),
        one_of(c("status"), fixed.CONTRACT_STATUSES, "active").alias("status"),
        N.iso_date(c("start_date")).alias("start_date"), N.iso_date(c("end_date")).alias("end_date"),
        N.iso_date(c("signed_date")).alias("_signed"), N.budget(c("amount")).alias("_amount"),
        N.budget(c("monthly_rate")).alias("monthly_rate"), N.whole_number(c("team_size")).alias("team_size"),
        one_of(c("payment_terms"), fixed.PAYMENT_TERMS).alias("payment_terms"),
        trimmed("contact_name").alias("contact_name"), N.rank_code(c("rank")).alias("rank"),
        trimmed("department").alias("department"), N.lead_phone(c("phone")).alias("phone"),
        F.lower(trimmed("email")).alias("email"), trimmed("our_pm").alias("our_pm"),
        N.tech_list(c("tech")).alias("tech"), rating.alias("_rating"),
        N.whole_number(c("renewal_notice_days")).alias("_notice"), trimmed("memo").alias("memo"))
    held = computed(typed, **{f: c(f) for f in ("company_name", "start_date", "end_date", "_signed", "_amount", "monthly_rate",
                                                "team_size", "_rating", "_notice")})
    # months with one decimal, counted in tenths so that the product stays exact
    days = F.datediff("end_date", "start_date") + 1
    tenths = F.greatest(F.lit(10), F.bround(F.bround(days / fixed.DAYS_PER_MONTH, 1) * 10).cast("bigint"))
    team = F.coalesce(F.nullif("team_size", F.lit(0)), F.lit(1))
    derived = F.when(c("monthly_rate") != 0, F.floor(c("monthly_rate") * team * tenths / F.lit(10).cast("decimal(2,0)")).cast("bigint"))
    priced = computed(held, amount=F.coalesce("_amount", derived))
    code = (F.when(c("company_name").isNull(), "company_required").when(c("end_date") < c("start_date"), "dates_invalid")
            .when(c("amount").isNull(), "amount_required"))
    return priced.withColumns({
        "code": code, "signed_date": F.coalesce("_signed", "start_date"),
        "satisfaction": F.when(c("_rating").between(1, 5), c("_rating")),
        "renewal_notice_days": F.coalesce(F.nullif("_notice", F.lit(0)), F.lit(fixed.RENEWAL_NOTICE_DAYS))})


def contract_flags(contracts: DataFrame, as_of: Column) -> DataFrame:
    """Days left, expiring (also when already past its end) and past-end flags of active contracts."""
    left = F.datediff("end_date", as_of)
    notice = F.coalesce(F.nullif("renewal_notice_days", F.lit(0)), F.lit(fixed.RENEWAL_NOTICE_DAYS))
    flag = lambda cond: F.coalesce(_active() & cond, F.lit(False))
    return (contracts.withColumn("days_left", left)
            .withColumn("expiring", flag(F.col("days_left") <= notice))
            .withColumn("overdue_end", flag(F.col("days_left") < 0)))


def with_customer_key(contracts: DataFrame) -> DataFrame:
    key = F.coalesce(empty_to_null("domain"), F.lower(trimmed("company_name")))
    return contracts.withColumn("customer_key", key)


def _list_order() -> list[Column]:
    return [F.coalesce("end_date", "start_date", "signed_date").desc_nulls_last(), F.desc("id")]


def _newest_key() -> Column:
    """Ascending key of 'newest contract first': start (or signing), then list order."""
    far = F.lit("9999-12-31").cast("date")
    back = lambda d: F.datediff(far, F.coalesce(d, F.lit("0001-01-01").cast("date")))
    return F.struct(back(F.coalesce("start_date", "signed_date")).alias("a"),
                    back(F.coalesce("end_date", "start_date", "signed_date")).alias("b"), (-F.col("id")).alias("c"))


def list_contracts(contracts: DataFrame) -> DataFrame:
    return contracts.orderBy(*_list_order())


def latest_contract(contracts: DataFrame) -> DataFrame:
    """The newest contract of every customer."""
    return first_per_key(with_customer_key(contracts), ["customer_key"], [_newest_key()])


def newest_contracts(contracts: DataFrame, n: int | None = None) -> DataFrame:
    """The n newest contracts per customer with their position."""
    return top_per_key(with_customer_key(contracts).withColumn("_k", _newest_key()),
                       ["customer_key"], [F.asc("_k")], n, "position").drop("_k")


def grade_of(total: Column, count: Column) -> Column:
    out = F.lit("C")
    for grade, least_total, least_count in reversed(fixed.GRADE_RULES):
        out = F.when((total >= least_total) & (count >= least_count), grade).otherwise(out)
    return out


def customer_grade(df: DataFrame, total: str = "total_value", count: str = "live_count") -> DataFrame:
    return df.withColumn("grade", grade_of(F.col(total), F.col(count)))


def customer_rollup(contracts: DataFrame, as_of: Column, tech_limit: int | None = None) -> DataFrame:
    """One row per customer: values, counts, dates, grade and the details of the newest contract.

    Contracts themselves stay in their own rows (`newest_contracts`, `customer_documents`): a customer may
    own a large share of them. The contracts are read once: beside a row with its measures, each has a row per technology, and the aggregate by
    (customer, technology) makes these distinct before they are gathered.
    """
    rows = with_customer_key(contract_flags(contracts, as_of))
    terms = F.coalesce(F.array_compact("tech"), F.array().cast("array<string>"))
    head = F.col("_term").isNull()
    rows = rows.select(*[c for c in rows.columns if c != "tech"], F.explode(F.concat(F.array(F.lit(None).cast("string")), terms)).alias("_term"))
    rows = rows.select("customer_key", "_term", *[F.when(head, F.col(c)).alias(c) for c in rows.columns if c not in ("customer_key", "_term")])
    active, live, newest = _active(), _live(), F.when(head, _newest_key())
    rating = F.nullif("satisfaction", F.lit(0))
    details = ("domain", "company_name", "website", "contact_name", "rank", "phone", "email", "our_pm",
               "project_type", "monthly_rate", "team_size", "payment_terms", "amount")
    amount = F.coalesce("amount", F.lit(0))
    measures = rows.groupBy("customer_key", "_term").agg(
        F.coalesce(F.sum(F.when(live, amount)), F.lit(0)).alias("total_value"),
        F.coalesce(F.sum(F.when(active, amount)), F.lit(0)).alias("active_value"),
        F.count_if(head).alias("contract_count"), F.count_if(live).alias("live_count"),
        F.count_if(active).alias("active_count"), F.count_if(F.col("status") == "renewed").alias("renewed_count"),
        F.count_if("expiring").alias("expiring_count"), F.min("signed_date").alias("first_signed"),
        F.max("end_date").alias("last_end"), F.min(F.when(active, F.col("end_date"))).alias("next_end"),
        F.sum(rating).alias("rating_sum"), F.count(rating).alias("ratings"),
        F.array_sort(F.collect_set("project_type")).alias("project_types"),
        F.min_by("biz_number", F.when(empty_to_null("biz_number").isNotNull(), newest)).alias("biz_number"),
        F.min_by("company_id", F.when(F.col("company_id") != 0, newest)).alias("company_id"),
        F.min_by(F.struct(*details), newest).alias("latest"))
    found = F.first(F.when(head, F.struct(*[c for c in measures.columns if c not in ("customer_key", "_term")])), ignorenulls=True)
    totals = measures.groupBy("customer_key").agg(found.alias("m"), F.array_sort(F.collect_list("_term")).alias("tech")).select("customer_key", "tech", "m.*")
    tech = F.col("tech")
    dormant = F.when((F.col("active_count") == 0) & F.col("last_end").isNotNull(), F.datediff(as_of, "last_end"))
    plain = ("total_value", "active_value", "contract_count", "live_count", "active_count", "renewed_count", "first_signed",
             "last_end", "next_end", "expiring_count")
    return totals.select(
        "customer_key", *[F.col(f"latest.{f}").alias(f) for f in details[:8]], "biz_number",
        "company_id", grade_of(F.col("total_value"), F.col("live_count")).alias("grade"),
        *plain, dormant.alias("dormant_days"),
        F.bround(F.col("rating_sum") / F.nullif("ratings", F.lit(0)), 1).alias("satisfaction"),
        "project_types", (F.slice(tech, 1, tech_limit) if tech_limit else tech).alias("tech"),
        *[F.col(f"latest.{f}").alias(f"latest_{f}") for f in details[8:]])


def list_customers(customers: DataFrame) -> DataFrame:
    return customers.orderBy(F.desc("total_value"), "company_name", "customer_key")


def contract_summary(contracts: DataFrame, as_of: Column) -> DataFrame:
    """One row over all contracts: values, counts, this year's business, distinct customers."""
    rows = with_customer_key(contract_flags(contracts, as_of))
    amount = F.coalesce("amount", F.lit(0))
    this_year = F.coalesce(_live() & (F.year("signed_date") == F.year(as_of)), F.lit(False))
    # per customer first, so that the distinct count needs no second pass over the contracts
    one = lambda cond, name: [F.sum(F.when(cond, amount)).alias(f"{name}_value"), F.count_if(cond).alias(f"{name}_count")]
    per_key = rows.groupBy("customer_key").agg(
        *one(_live(), "total"), *one(_active(), "active"), *one(this_year, "year"), *one(F.col("expiring"), "expiring"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return per_key.agg(total("total_value"), total("active_value"), total("active_count"), total("year_value"),
                       total("year_count"), total("expiring_count"), total("expiring_value"),
                       F.count(F.lit(1)).alias("customer_count"))


def grade_counts(customers: DataFrame) -> DataFrame:
    grades = customers.sparkSession.createDataFrame(list(enumerate(fixed.GRADES)), "pos int, grade string")
    counts = customers.groupBy("grade").agg(F.count(F.lit(1)).alias("customers"))
    return (grades.join(counts, "grade", "left")
            .select("pos", "grade", F.coalesce("customers", F.lit(0)).alias("customers")).orderBy("pos"))


def search_customers(customers: DataFrame, contracts: DataFrame, query: str = "", quick: str = "all",
                     grade: str = "") -> DataFrame:
    """Customers by quick filter, grade and text; the text also looks into their contracts."""
    out = customers
    if quick == "expiring":
        out = out.where("expiring_count > 0")
    elif quick == "active":
        out = out.where("active_count > 0")
    elif quick == "dormant":
        out = out.where("dormant_days >= 0")
    if grade:
        out = out.where(F.col("grade") == grade)
    needle = query.strip().lower()
    if not needle:
        return out
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    own = F.concat_ws(" ", *[part(c) for c in ("company_name", "domain", "contact_name", "email", "phone",
                                               "our_pm", "biz_number")], F.array_join("tech", " "))
    inner = F.concat_ws(" ", part("title"), part("contract_no"), part("memo"))
    keys = (with_customer_key(contracts).where(F.lower(inner).contains(needle))
            .select("customer_key").distinct().withColumn("_hit", F.lit(True)))
    return (out.join(keys, "customer_key", "left")
            .where(F.lower(own).contains(needle) | F.coalesce("_hit", F.lit(False))).drop("_hit"))


def contracts_from_leads(leads: DataFrame) -> DataFrame:
    """Contract drafts of won leads."""
    won = leads.where("status = 'won'")
    start = F.try_to_date(F.concat("expected_start", F.lit("-01")), "yyyy-MM-dd")
    return won.select(
        F.col("id").alias("lead_id"), "company_id", "domain", "company_name", "website", "biz_number",
        "project_type", F.col("budget").alias("amount"), "team_size", start.alias("start_date"), "contact_name",
        "rank", "department", F.coalesce(empty_to_null("mobile"), F.col("phone")).alias("phone"), "email",
        F.col("assignee").alias("our_pm"), "tech", "memo")


def _krw(amount: Column) -> Column:
    return F.concat(F.lit("₩"), F.format_number(F.coalesce(amount, F.lit(0)), 0))


def resell_leads(customers: DataFrame, contracts: DataFrame, shown: int | None = None) -> DataFrame:
    """Raw renewal leads of signed customers; the memo tells grade, total and the newest contracts."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.coalesce(empty_to_null("title"), empty_to_null("project_type"), F.lit("계약")), F.lit(" "),
                    text("start_date"), F.lit("~"), text("end_date"), F.lit(" "), _krw(F.col("amount")))
    recent = newest_contracts(contracts, shown).select("customer_key", F.struct("position", line.alias("line")).alias("p"))
    history = recent.groupBy("customer_key").agg(F.array_sort(F.collect_list("p")).alias("h"))
    memo = F.concat(F.lit("기존 고객 (등급 "), "grade", F.lit(", 누적 "), _krw(F.col("total_value")),
                    F.lit("). 계약 이력: "), F.coalesce(F.array_join(F.col("h.line"), "; "), F.lit("")))
    return customers.join(history, "customer_key", "left").select(
        "customer_key", "company_id", "domain", "company_name", "website", "biz_number", "contact_name", "rank",
        "phone", "email", F.lit("customer").alias("source"), F.col("latest_project_type").alias("project_type"),
        "tech", F.col("latest_amount").alias("budget"), F.col("latest_team_size").alias("team_size"),
        F.col("our_pm").alias("assignee"), F.lit("contacted").alias("status"),
        F.lit("재계약 / 추가 인력 제안").alias("next_action"), memo.alias("memo"))


def contract_template_for_customer(customers: DataFrame) -> DataFrame:
    """Prefilled next contract of every customer."""
    return customers.select(
        "customer_key", "company_name", "website", "domain", "biz_number", "company_id", "contact_name", "rank",
        "phone", "email", "our_pm", F.col("latest_project_type").alias("project_type"),
        F.col("latest_monthly_rate").alias("monthly_rate"), F.col("latest_team_size").alias("team_size"),
        F.col("latest_payment_terms").alias("payment_terms"), "tech")


def customer_documents(customers: DataFrame, contracts: DataFrame) -> DataFrame:
    """Customers with their contracts, one row per contract (`contract`, as a struct) with its position, newest first."""
    fields = [c for c in contracts.columns if c != "customer_key"]
    placed = newest_contracts(contracts).select("customer_key", F.col("position").cast("bigint").alias("position"), F.struct(*fields).alias("contract"))
    return customers.join(placed, "customer_key")


def delete_contracts(contracts: DataFrame, ids: DataFrame) -> DataFrame:
    return contracts.join(ids.select("id").distinct(), "id", "left_anti")
