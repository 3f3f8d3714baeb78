"""Every operator as a query over the given tables: name -> callable(spark, sf_dir)."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as N
from ..functions import fixed, html
from ..functions import urls as U

from ..operators import contracts as C
from ..operators import exports as X
from ..operators import facts, funnel, imports, jobs, people, rounds, scans, updates
from ..operators import leads as L
from ..operators import links as K
from ..operators import pages as P
from ..sources import readers as R
from ..streaming import streams
from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _s(*names: str) -> list[Column]:
    """Columns as text (dates and times compare the same in every engine)."""
    return [F.col(n).cast("string").alias(n) for n in names]


def _history(s, d):
    return T.status_history(s, d)


def _funnel(s, d):
    h = T.status_history(s, d)
    return h, T.funnel_leads(h)


def _scans(s, d):
    h = T.scan_history(s, d)
    return T.companies(h), h


def _customers(s, d):
    c = T.contracts(s, d)
    return C.customer_rollup(c, T.orders_as_of()), c


def _day() -> Column:
    return T.events_as_of().cast("date")


# --- hiring trend --------------------------------------------------------------------------


@query
def upsert_companies(s, d):
    cols = ["domain", "name", "phone", "email", "website", "it_hiring", "it_jobs", "contacts"]
    return _scans(s, d)[0].select("id", *cols, *_s("created_at", "updated_at"))


@query
def append_scan_history(s, d):
    h = T.scan_history(s, d)
    return h.select("id", "domain", *_s("scanned_at"), "it_hiring", "it_jobs", "contacts", "has_email", "has_phone")


@query
def previous_scan(s, d):
    return scans.previous_scan(T.scan_history(s, d)).select("domain", "it_jobs", "it_hiring", *_s("scanned_at"))


@query
def scan_history_top(s, d):
    h = scans.scan_history_top(T.scan_history(s, d), 12)
    return h.select("domain", F.col("rn").cast("bigint").alias("rn"), *_s("scanned_at"), "it_hiring", "it_jobs", "contacts")


@query
def company_trend(s, d):
    t = scans.company_trend(*_scans(s, d))
    return t.select("domain", "it_jobs", "prev_it_jobs", "jobs_delta", *_s("prev_scanned_at"))


@query
def rising_companies(s, d):
    return scans.rising_companies(scans.company_trend(*_scans(s, d))).select("domain", "it_hiring", "it_jobs", "jobs_delta")


@query
def trend_label(s, d):
    return scans.trend_label(scans.company_trend(*_scans(s, d))).select("domain", "trend")


@query
def hiring_signal(s, d):
    e = T.table(s, d, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("domain"), "event_type")
    return scans.hiring_signal(e.select("domain"), e.where("event_type = 'view'"))


@query
def list_companies(s, d):
    t = scans.company_trend(*_scans(s, d))
    return scans.list_companies(t).select("id", "domain", "name", "it_jobs", "jobs_delta", *_s("updated_at"))


@query
def company_summary(s, d):
    c = scans.company_summary(_scans(s, d)[0])
    return c.select("id", "domain", "name", "phone", "email", "it_hiring", *_s("created_at", "updated_at"))


@query
def search_companies(s, d):
    t = scans.company_trend(*_scans(s, d))
    return scans.search_companies(t, " U1", rising_only=True).select("domain", "it_jobs", "jobs_delta")


@query
def has_contact(s, d):
    return scans.has_contact(_scans(s, d)[0]).select("domain", "email", "phone")


@query
def rescan_targets(s, d):
    return scans.rescan_targets(_scans(s, d)[0], 3, T.events_as_of()).select("domain", "url", *_s("updated_at"))


@query
def batch_summary(s, d):
    t = scans.company_trend(*_scans(s, d))
    status = F.when(F.col("it_jobs") == 0, "error").when(F.col("email").isNull() & F.col("phone").isNull(), "skipped").otherwise("saved")
    return scans.batch_summary(t.withColumns({"status": status, "has_result": F.col("it_jobs") > 0}))


@query
def delete_companies(s, d):
    companies, history = _scans(s, d)
    gone = companies.where("it_hiring = 'None' or it_hiring = 'Low'").select("id")
    kept = scans.delete_companies(companies, gone)
    return kept.select("id", "domain", "it_jobs")


# --- funnel --------------------------------------------------------------------------------


@query
def status_history(s, d):
    return _history(s, d).select("id", "lead_id", "from_status", "to_status", *_s("at"))


@query
def orphan_history_filter(s, d):
    return funnel.orphan_history_filter(*_funnel(s, d)).select("id", "lead_id", "to_status")


@query
def pipeline_funnel(s, d):
    return funnel.pipeline_funnel(*_funnel(s, d)).drop("pos")


@query
def stage_intervals(s, d):
    rows = funnel.stage_intervals(_history(s, d), T.events_as_of())
    return rows.select("id", "lead_id", "to_status", *_s("at", "until"))


@query
def stage_durations(s, d):
    return funnel.stage_durations(*_funnel(s, d), T.events_as_of()).drop("pos")


@query
def sales_velocity(s, d):
    return funnel.sales_velocity(*_funnel(s, d))


@query
def lead_stage_since(s, d):
    h, leads = _funnel(s, d)
    out = funnel.lead_stage_since(leads, h, T.events_as_of())
    return out.select("id", "status", *_s("stage_since"), "days_in_stage")


@query
def stale_stage(s, d):
    h, leads = _funnel(s, d)
    return funnel.stale_stage(funnel.lead_stage_since(leads, h, T.events_as_of())).select("id", "days_in_stage", "stale")


@query
def current_stage(s, d):
    return funnel.current_stage(_history(s, d)).select("lead_id", "status", *_s("entered_at"))


@query
def seed_status_history(s, d):
    """Leads whose history starts with something else than a sign-up count as having none."""
    h, leads = _funnel(s, d)
    seen = h.where("from_status is null and to_status = 'new'")
    return funnel.seed_status_history(leads, seen).select("lead_id", "from_status", "to_status", *_s("at"))


@query
def append_status_history(s, d):
    """Every contacted lead is moved to meeting, and leads with a lost event are new to the old table."""
    h, leads = _funnel(s, d)
    lost = h.where("to_status = 'lost'").select(F.col("lead_id").alias("id"))
    new = leads.withColumn("status", F.when(F.col("status") == "contacted", "meeting").otherwise(F.col("status")))
    out = funnel.append_status_history(leads.join(lost, "id", "left_anti"), new, T.events_as_of())
    return out.select("lead_id", "from_status", "to_status", *_s("at"))


# --- contracts and customers ---------------------------------------------------------------


@query
def normalise_contracts(s, d):
    c = T.contracts(s, d)
    return c.select("id", "company_id", "domain", "company_name", "title", "biz_number", "project_type", "status",
                    *_s("start_date", "end_date", "signed_date"), "amount", "team_size", "satisfaction",
                    "renewal_notice_days", F.array_join("tech", "|").alias("tech"), "memo")


@query
def contract_flags(s, d):
    c = C.contract_flags(T.contracts(s, d), T.orders_as_of())
    return c.select("id", F.col("days_left").cast("bigint").alias("days_left"), "expiring", "overdue_end")


@query
def list_contracts(s, d):
    return C.list_contracts(T.contracts(s, d)).select("id", "company_name", *_s("end_date"), "amount")


@query
def latest_contract(s, d):
    return C.latest_contract(T.contracts(s, d)).select("customer_key", "id", *_s("start_date"), "amount")


@query
def customer_rollup(s, d):
    customers, _ = _customers(s, d)
    return customers.select(
        "customer_key", "company_name", "domain", "biz_number", "company_id", "grade", "total_value", "active_value",
        "contract_count", "live_count", "active_count", "renewed_count", "expiring_count",
        *_s("first_signed", "last_end", "next_end"), F.col("dormant_days").cast("bigint").alias("dormant_days"),
        "satisfaction", F.array_join("project_types", "|").alias("project_types"), F.array_join("tech", "|").alias("tech"),
        "latest_amount")


@query
def customer_grade(s, d):
    orders = T.table(s, d, "orders").groupBy("o_custkey").agg(
        F.sum(F.floor(F.col("o_totalprice")) * 100).alias("total_value"), F.count(F.lit(1)).alias("live_count"))
    return C.customer_grade(orders).select("o_custkey", "total_value", "live_count", "grade")


@query
def contract_summary(s, d):
    return C.contract_summary(T.contracts(s, d), T.orders_as_of())


@query
def grade_counts(s, d):
    return C.grade_counts(_customers(s, d)[0]).drop("pos")


@query
def list_customers(s, d):
    return C.list_customers(_customers(s, d)[0]).select("customer_key", "company_name", "total_value", "grade")


@query
def search_customers(s, d):
    customers, contracts = _customers(s, d)
    return C.search_customers(customers, contracts, "URGENT", quick="expiring").select("customer_key", "grade", "expiring_count")


@query
def resell_leads(s, d):
    customers, contracts = _customers(s, d)
    return C.resell_leads(customers, contracts, shown=5).select("customer_key", "source", "project_type", "budget", "team_size", "status", "memo")


@query
def contract_template_for_customer(s, d):
    t = C.contract_template_for_customer(_customers(s, d)[0])
    return t.select("customer_key", "company_name", "domain", "project_type", "team_size", F.array_join("tech", "|").alias("tech"))


@query
def export_contracts(s, d):
    customers, contracts = _customers(s, d)
    return X.contracts_export(customers, contracts).select(
        "grade", "company_name", "title", "project_type", "status", "start_date", "end_date", "amount", "team_size", "tech", "satisfaction")


@query
def customer_documents(s, d):
    """Nested export: every contract of a customer with its place, newest first."""
    docs = C.customer_documents(*_customers(s, d))
    return docs.select("customer_key", "grade", "position", F.col("contract.id").alias("id"), F.col("contract.amount").alias("amount"))


@query
def delete_contracts(s, d):
    c = T.contracts(s, d)
    left = C.delete_contracts(c, c.where("status = 'terminated'").select("id"))
    return left.select("id", "status", "amount")


# --- leads ---------------------------------------------------------------------------------


@query
def normalise_leads(s, d):
    l = T.leads(s, d)
    return l.select("id", "domain", "company_name", "website", "biz_number", "industry", "company_size", "contact_name", "rank",
                    "phone", "mobile", "email", "kakao", "source", "project_type", F.array_join("tech", "|").alias("tech"),
                    "budget", "team_size", "expected_start", "bridge_se", "lost_reason", "it_hiring", "status", "assignee",
                    "next_action", *_s("next_date", "last_contact"), "memo")


@query
def normalise_leads_errors(s, d):
    return L.normalise_leads(T.raw_leads(s, d))[1]


@query
def norm_rank(s, d):
    return T.raw_leads(s, d).select("row", N.rank_code(F.col("rank")).alias("rank"))


@query
def norm_budget(s, d):
    return T.raw_leads(s, d).select("row", N.budget(F.col("budget")).alias("budget"))


@query
def norm_phone(s, d):
    raw = T.raw_leads(s, d)
    return raw.select("row", N.lead_phone(F.coalesce("mobile", "phone")).alias("phone"), N.biz_number(F.col("biz_number")).alias("biz_number"))


@query
def norm_dates(s, d):
    raw = T.raw_leads(s, d)
    return raw.select("row", N.iso_date(F.col("next_date")).cast("string").alias("next_date"),
                      N.year_month(F.col("expected_start")).alias("expected_start"))


@query
def score_leads(s, d):
    parts = F.array_join(F.transform("score_breakdown", lambda p: F.concat(p["key"], F.lit("="), p["points"].cast("string"))), ",")
    return T.leads(s, d).select("id", F.col("score").cast("bigint").alias("score"), parts.alias("parts"))


@query
def lead_kpis(s, d):
    return L.lead_kpis(T.leads(s, d), T.events_as_of())


@query
def status_counts(s, d):
    return L.status_counts(T.leads(s, d)).drop("pos")


@query
def kanban_totals(s, d):
    return L.kanban_totals(T.leads(s, d)).drop("pos")


@query
def assignees(s, d):
    return L.assignees(T.leads(s, d))


@query
def list_leads(s, d):
    return L.list_leads(T.leads(s, d)).select("id", "company_name", "status", *_s("updated_at"))


@query
def overdue_leads(s, d):
    return L.overdue_leads(T.leads(s, d), _day()).select("id", "status", *_s("next_date"), "overdue")


@query
def search_leads(s, d):
    return L.search_leads(T.leads(s, d), "java", quick="week", as_of=_day()).select("id", "status", *_s("next_date"))


@query
def search_hot_leads(s, d):
    return L.search_leads(T.leads(s, d), "FURNITURE", quick="hot", assignee="rep 2").select("id", F.col("score").cast("bigint").alias("score"))


def _companies_of_customers(s, d) -> DataFrame:
    """Scanned companies: customers whose site was seen, with ids unrelated to leads."""
    c = T.table(s, d, "customer")
    slug = F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))
    return c.select((F.col("c_custkey") + 7).alias("id"), F.concat(slug, F.lit(".co.kr")).alias("domain"), "c_mktsegment")


@query
def match_leads_to_company(s, d):
    leads = T.leads(s, d).withColumn("company_id", F.when(F.col("it_hiring") == "High", F.col("id") + 7))
    return L.match_leads_to_company(_companies_of_customers(s, d), leads).select("id", "domain", "lead_id")


@query
def companies_without_lead(s, d):
    return L.companies_without_lead(_companies_of_customers(s, d), T.leads(s, d)).select("id", "domain")


@query
def match_leads_to_customers(s, d):
    out = L.match_leads_to_customers(T.leads(s, d), _customers(s, d)[0])
    return out.select("id", "customer_key", "customer_grade")


@query
def duplicate_summary(s, d):
    """Raw customer rows probed against the valid leads, as a linear summary."""
    raw = T.raw_leads(s, d).withColumnRenamed("row", "probe_id")
    probes = raw.withColumn("company_name", F.when(F.col("assignee").isNull(), F.col("company_name")))
    return L.duplicate_summary(probes, T.leads(s, d))


@query
def lead_activities(s, d):
    a = T.raw_activities(s, d)
    typed = a.select("id", "lead_id", F.lower("type").alias("type"), N.iso_date(F.col("at")).alias("at"))
    return L.lead_activities(T.leads(s, d), typed).select("id", "lead_id", "type", *_s("at"))


@query
def add_activities(s, d):
    raw = T.raw_activities(s, d)
    leads, _ = L.add_activities(T.leads(s, d), _no_activities(raw), raw, T.events_as_of())
    return leads.select("id", *_s("last_contact", "updated_at"))


def _no_activities(raw: DataFrame) -> DataFrame:
    return raw.select("id", "lead_id", "type", "note", N.iso_date(F.col("at")).alias("at")).where("false")


@query
def add_activities_rows(s, d):
    raw = T.raw_activities(s, d)
    _, rows = L.add_activities(T.leads(s, d), _no_activities(raw), raw, T.events_as_of())
    return rows.select("id", "lead_id", "type", *_s("at"), F.md5("note").alias("note"))


@query
def delete_leads(s, d):
    leads = T.leads(s, d)
    acts = T.raw_activities(s, d)
    history = leads.select(F.col("id").alias("lead_id"), "status")
    gone = leads.where("status in ('lost', 'hold')").select("id")
    left = L.delete_leads(leads, acts, history, gone)
    rows = [df.select(F.lit(name).alias("tbl"), F.col(key).alias("id")) for name, key, df in zip(("leads", "activities", "history"), ("id", "id", "lead_id"), left)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def write_leads(s, d):
    """Every lead in proposal gets a new rank, loses its phone and becomes lost for its price."""
    leads = T.leads(s, d)
    payload = F.create_map(*[F.lit(x).cast("string") for x in ("rank", "Vice President", "phone", None, "status", "LOST", "lost_reason", "price")])
    asked = leads.where("status = 'proposal'").select("id", payload.alias("payload"))
    after, _, _ = updates.write_leads(leads, asked, T.events_as_of())
    return after.select("id", "rank", "phone", "status", "lost_reason", F.col("score").cast("bigint").alias("score"), *_s("updated_at"))


@query
def write_leads_refused(s, d):
    """Leads that would lose their company name stay as they are and are told."""
    leads = T.leads(s, d)
    asked = leads.where("status = 'won'").select("id", F.create_map(F.lit("company_name"), F.lit(" "), F.lit("memo"), F.lit("x")).alias("payload"))
    after, history, errors = updates.write_leads(leads, asked, T.events_as_of())
    kept = after.join(errors, "id").select("id", "code", "company_name", "memo")
    return kept.unionByName(history.select(F.col("lead_id").alias("id"), *[F.lit("moved").alias(c) for c in ("code", "company_name", "memo")]))


@query
def change_status(s, d):
    leads = T.leads(s, d)
    _, history, _ = updates.change_status(leads, leads.where("score >= 60").select("id"), "won", T.events_as_of())
    return history.select("lead_id", "from_status", "to_status", *_s("at"))


@query
def write_contracts(s, d):
    c = T.contracts(s, d)
    payload = F.create_map(F.lit("amount"), F.lit("2.5억"), F.lit("satisfaction"), F.lit("9"), F.lit("memo"), F.lit(None).cast("string"))
    after, _ = updates.write_contracts(c, c.where("status = 'renewed'").select("id", payload.alias("payload")), T.orders_as_of())
    return after.select("id", "amount", "satisfaction", "memo", *_s("end_date"), F.array_join("tech", "|").alias("tech"))


@query
def contracts_from_leads(s, d):
    rows = C.contracts_from_leads(T.leads(s, d))
    return rows.select("lead_id", "domain", "company_name", "amount", "team_size", *_s("start_date"), "phone", "our_pm")


@query
def calendar_events(s, d):
    return X.calendar_events(T.leads(s, d), T.contracts(s, d)).select("uid", *_s("date"), "summary", "description")


@query
def label_codes(s, d):
    l = T.leads(s, d).select("id", "status", "rank", "company_size")
    return X.label_codes(l, X.label_table(s), "ko", {"status": "status", "rank": "rank", "company_size": "size"})


@query
def export_leads(s, d):
    return X.leads_export(T.leads(s, d).withColumn("id", F.col("id")), X.label_table(s), "vi").select(
        "company_name", "rank", "tech", "budget", "bridge_se", "status", "next_date", "score")


@query
def export_companies(s, d):
    return X.companies_export(scans.company_trend(*_scans(s, d)))


@query
def format_krw(s, d):
    l = T.leads(s, d).select("id", "budget")
    return X.format_krw(X.format_krw(l, "budget", "vi", "vi"), "budget", "ko", "ko").select("id", "ko", "vi")


TEMPLATES = {"cold": ("[{company}] {tech}", "{contact}, {company}.\n\n{team}{tech}\n\n{project}\n\n{signature}"),
             "quote": ("[{company}] quote", "{contact}\n{start}{project}\n\n\n\n{signature}")}


@query
def mail_drafts(s, d):
    return X.mail_drafts(T.leads(s, d), TEMPLATES, "Kim").select("id", "kind", "to", "subject", "body")


def _import_rows(s, d) -> DataFrame:
    """Customers as rows of an uploaded file with Korean headers; two of them share a contact."""
    raw = T.raw_leads(s, d)
    header = {"회사명": F.col("industry"), " 담당자명 ": F.concat(F.lit("P"), (F.col("row") / 2).cast("bigint").cast("string")),
              "이메일": F.when(F.col("source") == "website", F.col("email")), "유입경로": F.lit("전시회"), "예산": F.col("budget"),
              "상태": F.lit("미팅"), "color": F.lit("red")}
    return raw.select("row", F.create_map(*[x for k, v in header.items() for x in (F.lit(k), v)]).alias("raw"))


@query
def map_import_columns(s, d):
    return imports.map_import_columns(_import_rows(s, d)).select("row", "company_name", "contact_name", "email", "source", "status", "budget")


def _existing(s, d) -> DataFrame:
    return T.leads(s, d).where("source = 'website' or it_hiring = 'High'").withColumn("company_name", F.col("industry")).withColumn(
        "contact_name", F.concat(F.lit("P"), F.col("id").cast("string")))


@query
def import_classify(s, d):
    return imports.classify_import(_import_rows(s, d), _existing(s, d)).select("row", "outcome")


@query
def import_report(s, d):
    return imports.import_report(imports.classify_import(_import_rows(s, d), _existing(s, d)), inserted=True)


@query
def import_preview(s, d):
    p = imports.import_preview(imports.classify_import(_import_rows(s, d), _existing(s, d)), 5)
    return p.select("row", "company_name", "contact_name", "email", "source", "budget")


# --- addresses -----------------------------------------------------------------------------


def _typed_urls(s, d) -> DataFrame:
    """Addresses people type, made from customers: good ones, blocked hosts, private nets, bad ports."""
    forms = ("www.{n}.co.kr", "http://10.0.{k}.1/x", "https://{n}.com:8443/a?b=1#c", "ftp://{n}.com", "http://172.20.1.{k}",
             "http://8.8.4.{k}", "localhost:8080/{n}", "http://{n}.local", "http://{n}.com:22", "HTTP://{n}.NET", "http://169.254.169.254/{n}",
             "https://[::1]/", "https://[2400:cb00::{k}]/p", " ")
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("c_nationkey") % len(forms) + 1).cast("int"))
    slug = F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))
    small = (F.col("c_custkey") % 200).cast("string")
    url = F.replace(F.replace(form, F.lit("{n}"), slug), F.lit("{k}"), small)
    return T.table(s, d, "customer").select(F.col("c_custkey").alias("id"), url.alias("url"))


@query
def admissible_urls(s, d):
    return K.admissible_urls(_typed_urls(s, d)).select("id", "normal_url", "ok", "reason")


@query
def registrable_domain(s, d):
    p = T.table(s, d, "pages").select("page_id", U.host("url").alias("host"))
    c = _typed_urls(s, d).select((F.col("id") + 10_000_000).alias("page_id"), U.host("url").alias("host"))
    return K.registrable_domain(p.unionByName(c), "host").select("page_id", "domain")


@query
def same_domain(s, d):
    p = T.table(s, d, "pages").select("page_id", "url", F.lit("example.org").alias("domain"))
    return K.same_domain(p).select("page_id", "url")


def _hrefs(s, d) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    return T.table(s, d, "pages").select("page_id", F.col("url").alias("base_url"), F.posexplode(found).alias("pos", "href"))


@query
def clean_links(s, d):
    """Links in every form a page may hold: root, relative, parent, query, fragment, file."""
    forms = ("{h}", "..{h}", "https://other.example.org{h}#x", "?q=1", "mailto:a@b.c", "{h}.PDF", "/login{h}", "//cdn.example.net{h}")
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col("page_id") + F.col("pos")).cast("int") % len(forms) + 1)
    links = _hrefs(s, d).withColumn("href", F.replace(form, F.lit("{h}"), F.col("href")))
    return K.clean_links(links).select("page_id", F.col("pos").cast("bigint").alias("pos"), "url")


@query
def url_key(s, d):
    return P.url_key(T.table(s, d, "pages").select("page_id", "url")).select("page_id", "url_key")


@query
def read_url_list(s, d):
    lines = T.table(s, d, "pages").select(F.col("page_id").alias("line"), F.concat(F.col("url"), F.lit("; # note, "), U.host("url")).alias("value"))
    return R.read_url_list(lines).select("line", F.col("pos").cast("bigint").alias("pos"), "url")


@query
def sniff_urls(s, d):
    lines = T.table(s, d, "pages").select(F.col("page_id").alias("line"), "url", F.concat(F.lit("see "), "url", F.lit(" soon")).alias("value"))
    return R.url_tokens(lines, sniff=True).select("line", F.col("pos").cast("bigint").alias("pos"), "url")


# --- pages and links -----------------------------------------------------------------------

WORD_TOKENS = {"recruitment": ("the", "que"), "management": ("der", "und", "las"), "company": ("and", "en", "ie"),
               "contact": ("de", "of", "un")}
WORD_WEIGHTS = fixed.CATEGORY_WEIGHT


def _links(s, d) -> DataFrame:
    return T.page_links(s, d)


def _classified(s, d) -> DataFrame:
    return K.classify_links(_links(s, d), WORD_TOKENS)


def _homes(s, d) -> DataFrame:
    return T.site_pages(s, d).groupBy("domain").agg(F.min_by("url", "page_idx").alias("home_url"))


@query
def read_pages(s, d):
    p = R.read_pages(s, f"{d}/pages.parquet")
    return p.select("page_id", "url", F.length("html").cast("bigint").alias("chars"))


@query
def page_text(s, d):
    return P.page_text(R.read_pages(s, f"{d}/pages.parquet")).select("page_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text"))


@query
def page_title(s, d):
    return P.page_title(R.read_pages(s, f"{d}/pages.parquet")).select("page_id", "title")


@query
def footer_text(s, d):
    p = P.footer_text(P.page_text(R.read_pages(s, f"{d}/pages.parquet")))
    return p.select("page_id", F.length("footer").cast("bigint").alias("chars"), F.md5("footer").alias("footer"))


@query
def js_shell_pages(s, d):
    return P.js_shell_pages(P.page_text(R.read_pages(s, f"{d}/pages.parquet")), 3000, 1500).select("page_id", "js_shell")


@query
def content_category(s, d):
    p = P.content_category(T.pages(s, d), ("nicht ", "para "), ("que ", "les ", "the "))
    return p.select("page_idx", "category")


@query
def extract_links(s, d):
    return _links(s, d).select("domain", "from_idx", F.col("pos").cast("bigint").alias("pos"), "url", "anchor", "is_frame")


@query
def classify_links(s, d):
    return _classified(s, d).select("from_idx", F.col("pos").cast("bigint").alias("pos"), "category")


@query
def foreign_language_links(s, d):
    p = T.pages(s, d).select("domain", "page_idx", "url")
    return K.foreign_language_links(p, _homes(s, d)).select("page_idx", "foreign")


@query
def score_links(s, d):
    out = K.score_links(_classified(s, d), _homes(s, d), WORD_WEIGHTS)
    return out.select("domain", "url", "category", F.col("score").cast("bigint").alias("score"), F.col("link_depth").cast("bigint").alias("link_depth"))


@query
def crawl_plan(s, d):
    plan = K.crawl_plan(K.score_links(_classified(s, d), _homes(s, d), WORD_WEIGHTS, spare=True), fixed.MAX_PAGES, fixed.MAX_DEPTH, fixed.MAX_RECRUITMENT_PAGES)
    return plan.select("domain", F.col("rank").cast("bigint").alias("rank"), "url", "category", F.col("phase").cast("bigint").alias("phase"))


@query
def link_graph(s, d):
    return K.link_graph(T.pages(s, d), _links(s, d)).select("domain", "from_idx", "to_url", "to_idx")


@query
def dedupe_pages(s, d):
    return P.dedupe_pages(T.pages(s, d)).select("domain", "page_idx", "url")


@query
def dedupe_documents(s, d):
    return P.dedupe_pages(T.document_pages(s, d).withColumn("domain", F.lit("example.net"))).select("page_idx")


@query
def within_budget(s, d):
    return P.within_budget(T.pages(s, d), fixed.MAX_PAGES).select("domain", "page_idx")


# --- facts, people, openings ---------------------------------------------------------------

DOC_JUNK = ("noreply", "no-reply", "that.")
US_PHONE = r"\+1 \(\d{3}\) \d{3}-\d{4}"
DOC_KEYWORDS = ("that", "thatin", "pour", "sich", "elle", "keit", "mente", "ción")
DOC_TITLES = (("Chief", ("worthless", "shehe")), ("Head", ("sich", "pour")), ("Lead", ("that", "elle")))


def _docs(s, d) -> DataFrame:
    return T.document_pages(s, d)


def _doc_sources(s, d) -> DataFrame:
    return _docs(s, d).select("domain", F.struct(F.lit(1).alias("full"), F.lit(0).alias("cat"), F.col("page_idx").alias("idx")).alias("src"),
                              F.col("final_url").alias("source_url"), "text")


@query
def label_value(s, d):
    rows = facts.label_value(_doc_sources(s, d), ("secret", "token", "key"), None, "=")
    return rows.where("value is not null").select(F.col("src.idx").alias("page_idx"), "value")


@query
def company_phone(s, d):
    return facts.company_phone(_doc_sources(s, d), US_PHONE, ("tel", "phone"), lambda x: x)


def _mails(s, d) -> DataFrame:
    docs = T.table(s, d, "documents")
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(fixed.EMAIL), F.lit(0))).alias("pos", "email"))


@query
def usable_emails(s, d):
    return facts.usable_emails(_mails(s, d), junk=DOC_JUNK).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "email")


@query
def company_emails(s, d):
    rows = _mails(s, d).withColumn("domain", F.lit("mail2.example.com"))
    return facts.company_emails(rows).select("doc_id", "email")


@query
def company_email(s, d):
    docs = _docs(s, d).withColumn("own", F.lit("example.com"))
    return facts.company_email(docs, use_html=False, own="own", junk=DOC_JUNK)


@query
def company_industry(s, d):
    return facts.company_industry(_docs(s, d), ("industry",), DOC_KEYWORDS, use_html=False)


@query
def text_units(s, d):
    p = people.text_units(T.pages(s, d).select("domain", "page_idx", "text"))
    return p.select("page_idx", F.col("unit_pos").cast("bigint").alias("unit_pos"), "unit", "joined")


@query
def title_rank(s, d):
    docs = T.table(s, d, "documents").select("doc_id", "text")
    return people.title_rank(docs, DOC_TITLES, "text").select("doc_id", F.col("title_rank").cast("bigint").alias("title_rank"), "title_group")


def _anchors(s, d) -> DataFrame:
    return _links(s, d).select("from_idx", "pos", F.col("anchor").alias("title"), F.lit("").alias("context"))


@query
def it_jobs_only(s, d):
    return jobs.it_jobs_only(_anchors(s, d), ("the", "der", "ción", "für")).select("from_idx", F.col("pos").cast("bigint").alias("pos"), "title")


@query
def looks_like_posting(s, d):
    titled = T.pages(s, d).select("page_idx", "title", F.lit("").alias("context"))
    return jobs.looks_like_posting(titled, markers=("the", "que", "von", "ción"), nav=("and", "of", "la", "la")).select("page_idx", "title")


def _part_jobs(s, d) -> DataFrame:
    """Parts as openings of their brand: short names are links, full names plain rows."""
    short = F.split("p_name", " ")[1]
    return T.table(s, d, "part").select(
        F.col("p_brand").alias("domain"), F.when(F.col("p_type") == "PROMO", 1).otherwise(2).alias("phase"),
        F.when(F.col("p_type") == "PROMO", short).otherwise(F.col("p_name")).alias("title"), F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("location"), F.when(F.col("p_size") % 3 == 0, F.lit("x")).alias("employment_type"),
        F.lit(None).cast("string").alias("deadline"),
        F.concat(F.lit("https://p.example.com/"), F.when(F.col("p_size") > 10, "jobs/").otherwise(""), F.col("p_partkey").cast("string")).alias("source_url"))


@query
def dedupe_jobs(s, d):
    return jobs.dedupe_jobs(_part_jobs(s, d)).select("domain", "title", "seq")


@query
def job_fields(s, d):
    rows = jobs.job_fields(_part_jobs(s, d).drop("location", "employment_type", "deadline").withColumn(
        "context", F.concat("title", F.lit(" contract 2026-05-"), F.col("phase").cast("string"), F.lit(" in Seoul today"))),
        ("bolt", "ring", "old widget"))
    return rows.select("seq", "position", "location", "employment_type", "deadline", "description")


@query
def top_jobs(s, d):
    return jobs.top_jobs(_part_jobs(s, d), fixed.MAX_JOBS).select("domain", F.col("place").cast("bigint").alias("place"), "seq")


@query
def tech_from_jobs(s, d):
    rows = T.table(s, d, "documents").select(F.col("source").alias("domain"), F.col("lang").alias("title"), F.col("text").alias("description"))
    out = jobs.tech_from_jobs(rows, 3, ("Worthless", "Thatin", "Sich", "Mente", "Keit", "Pour", "C++"))
    return out.select("domain", F.array_join("tech", "|").alias("tech"))


@query
def keep_first(s, d):
    e = T.table(s, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return imports.keep_first(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query
def merge_existing_keys(s, d):
    keys = imports.merge_existing_keys(_existing(s, d), T.leads(s, d))
    return keys.select("k_kind", "k1", "k2")


@query
def import_anti_join(s, d):
    fresh = imports.import_anti_join(T.leads(s, d), _existing(s, d).where("email is not null"))
    return fresh.select("id", "email")


@query
def page_filter(s, d):
    """Events as fetched pages: the value gives the status, the type the content type."""
    kind = F.when(F.col("event_type") == "click", "image/png").when(F.col("event_type") == "view", "TEXT/HTML; charset=x")
    e = T.table(s, d, "events").select("event_id", (F.lit(200) + F.floor("value") * 5).alias("status"), kind.alias("content_type"))
    return P.page_filter(e).select("event_id", "status")


@query
def page_depths(s, d):
    """Link distance of the pages when every link counts as a link to the page after the next."""
    p = T.pages(s, d).select("domain", "page_idx", "depth")
    linked = _links(s, d).select("domain", "from_idx", (F.col("from_idx") + F.col("pos") * 3).alias("to_idx"))
    return K.page_depths(p, linked).select("page_idx", F.col("link_depth").cast("bigint").alias("link_depth"))


@query
def text_sources(s, d):
    src = facts.text_sources(P.footer_text(T.pages(s, d)), ("home",))
    return src.select(F.col("src.full").cast("bigint").alias("full"), F.col("src.cat").cast("bigint").alias("cat"), F.col("src.idx").alias("idx"),
                      F.md5("text").alias("text"))


@query
def company_name(s, d):
    out = facts.company_name(T.pages(s, d))
    return out.select("domain", "value", "source_url")


@query
def cf_email(s, d):
    """Every hexadecimal token of the documents read as a protected address."""
    codes = F.regexp_extract_all("text", F.lit('token = "([0-9a-f]{40})'), F.lit(1))
    codes = T.table(s, d, "documents").select("doc_id", F.posexplode(codes).alias("pos", "encoded"))
    return facts.cf_email(codes).select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("email").cast("bigint").alias("chars"), F.md5("email").alias("email"))


@query
def plausible_names(s, d):
    words = T.table(s, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(
        "text", F.lit("[A-Z][a-z]+ [A-Z]?[a-z]+"), F.lit(0))).alias("pos", "name"))
    return facts.plausible_names(words).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "name")


@query
def excluded_roles(s, d):
    turns = T.table(s, d, "conversations").select("conv_id", "turn", "text")
    return people.excluded_roles(turns, "text").select("conv_id", "turn")


@query
def in_country(s, d):
    c = T.table(s, d, "customer").join(T.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return facts.in_country(c.select("c_custkey", "n_name"), ("nation_1", "korea"), "n_name").select("c_custkey")


@query
def job_candidates(s, d):
    """Every page read as a recruitment page with words of the given languages as job words."""
    p = T.pages(s, d).withColumn("category", F.lit("recruitment"))
    words = ("the", "que", "der", "und", "that", "ción")
    c = jobs.job_candidates(p, words, markers=words, nav=("and", "of", "la"))
    return c.select("page_idx", F.col("phase").cast("bigint").alias("phase"), "title")


@query
def nested_openings(s, d):
    """Openings of pages with nested boxes: the context is the whole text of the nearest one."""
    c = jobs.job_candidates(T.nested_pages(s, d))
    return c.select("page_idx", F.col("phase").cast("bigint").alias("phase"), F.col("seq.pos").cast("bigint").alias("pos"), "title", "context", "source_url")


@query
def nested_footers(s, d):
    """The outermost footer blocks of the same pages as text."""
    blocks = F.posexplode(html.footer_blocks(F.col("html")))
    return T.nested_pages(s, d).select("page_idx", blocks).select("page_idx", F.col("pos").cast("bigint").alias("pos"), html.inline_text(F.col("col")).alias("text"))


@query
def delete_activities(s, d):
    a = T.raw_activities(s, d)
    return L.delete_activities(a, a.where("type = 'visit'").select("id")).select("id", "type")


@query
def scan_result(s, d):
    """One record per customer site from its whole pages, nested parts as JSON."""
    from ..operators.results import scan_result as result
    r = result(T.company_pages(s, d))
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"}).alias(c)
    return r.select("domain", *[F.col(f"company.{f}").alias(f) for f in (*facts.FACTS, "website")], F.col("company_sources.name").alias("name_source"),
                    json("company_hints"), json("key_contacts"), json("it_recruitment"), "it_hiring", F.array_join("sources", " ").alias("sources"),
                    "scanned_url", "pages_crawled")


# --- facts, people and uploads on customer sites ---------------------------------------------


def _sites(s, d) -> DataFrame:
    return P.footer_text(T.company_pages(s, d))


@query
def company_address(s, d):
    return facts.company_address(facts.text_sources(_sites(s, d)))


@query
def company_biz_number(s, d):
    return facts.company_biz_number(facts.text_sources(_sites(s, d)))


@query
def company_ceo(s, d):
    return facts.company_ceo(facts.text_sources(_sites(s, d)))


@query
def email_hint(s, d):
    sites = _sites(s, d)
    return facts.email_hint(sites, facts.company_email(sites))


@query
def page_priority(s, d):
    p = facts.page_priority(T.company_pages(s, d), facts.CONTACT_FIRST)
    return p.select("page_idx", F.col("page_order.cat").cast("bigint").alias("place"), F.col("page_order.idx").alias("idx"))


@query
def footer_coverage(s, d):
    return K.footer_coverage(T.company_pages(s, d).where("depth = 0").select("domain", "html", "text"))


@query
def contact_candidates(s, d):
    sites = _sites(s, d)
    found = people.contact_candidates(people.text_units(sites), people.banned_names(sites, facts.company_name(sites)))
    return found.select("domain", "name", F.col("title_rank").cast("bigint").alias("title_rank"), "position", "source_url")


@query
def key_contacts(s, d):
    """Customers as people of their nation's domain: every name, best title first, variants of a better one dropped."""
    key = F.col("c_custkey")
    names = T.table(s, d, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("domain"), F.concat(F.lit("Kim "), (key % 40).cast("string")).alias("name"),
        (key % 5).cast("int").alias("title_rank"), F.concat(F.lit("p"), (key % 5).cast("string")).alias("position"),
        F.lit("u").alias("source_url"), key.alias("seq"))
    out = people.key_contacts(names)
    return out.select("domain", F.col("place").cast("bigint").alias("place"), "name", "position", F.col("title_rank").cast("bigint").alias("title_rank"))


@query
def name_variants(s, d):
    """As many names as customers: numbers that contain each other, in both spellings, best title first."""
    key = F.col("c_custkey")
    number = (key * 7919 % 100_003).cast("string")
    names = T.table(s, d, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("domain"), F.concat(F.when(key % 3 == 0, "LEE ").otherwise("Lee "), F.right(number, (key % 4 + 1).cast("int"))).alias("name"),
        (key % 7).cast("int").alias("title_rank"), F.lit("p").alias("position"), F.lit("u").alias("source_url"), key.alias("seq"))
    out = people.key_contacts(names)
    return out.select("domain", F.col("place").cast("bigint").alias("place"), F.lower("name").alias("name"), F.col("title_rank").cast("bigint").alias("title_rank"))


@query
def decode_pages(s, d):
    """Page bodies as UTF-8, and as Latin 1 where a header says so."""
    p = T.table(s, d, "pages")
    latin = p.where("page_id % 2 = 1").select("page_id", F.encode("html", "ISO-8859-1").alias("content"), F.lit("text/html; charset=ISO-8859-1").alias("kind"))
    plain = p.where("page_id % 2 = 0").select("page_id", F.encode("html", "UTF-8").alias("content"), F.lit(None).cast("string").alias("kind"))
    out = R.decode_pages(plain.unionByName(latin), "kind")
    return out.select("page_id", F.length("html").cast("bigint").alias("chars"), F.md5("html").alias("html"))


def _upload(s, d) -> DataFrame:
    """Customers by nation, at most 10,000 keys a file, in order of their key."""
    c = T.table(s, d, "customer")
    row = F.struct("c_custkey", F.concat(F.lit('"Co, '), F.col("c_name"), F.lit('"')).alias("company"), F.floor("c_acctbal").cast("bigint").cast("string").alias("budget"))
    return c.groupBy(F.concat(F.lit("f"), F.col("c_nationkey").cast("string"), F.lit("_"), F.floor(F.col("c_custkey") / 10000).cast("string")).alias("file")).agg(F.array_sort(F.collect_list(row)).alias("rows"))


@query
def read_leads_csv(s, d):
    """Files with a quoted comma in each row and a mark in front of the header."""
    lines = F.concat_ws("\r\n", F.lit("﻿company,budget"), F.array_join(F.transform("rows", lambda r: F.concat(r["company"], F.lit(","), r["budget"])), "\r\n"))
    rows = R.leads_from_csv(_upload(s, d).select("file", F.encode(lines, "UTF-8").alias("content")))
    return rows.select("file", "row", F.col("raw")["company"].alias("company"), F.col("raw")["budget"].alias("budget"))


@query
def read_split_csv(s, d):
    """One file a nation, as lines of many splits: each record has a quoted line break and quotes, and splits end inside records."""
    c = T.table(s, d, "customer")
    company = F.concat(F.lit('"Co; '), F.col("c_name"), F.lit(' ""A""\r'))
    budget = F.concat(F.lit('of '), F.col("c_mktsegment"), F.lit('";'), F.floor("c_acctbal").cast("bigint").cast("string"), F.lit("\r"))
    rows = c.select("c_nationkey", "c_custkey", F.posexplode(F.array(company, budget, F.lit(" "))).alias("i", "text"))
    seq = F.col("c_custkey") * 3 + F.col("i")
    lines = rows.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file"), F.floor(seq / 100).alias("block"), seq.alias("seq"), F.encode("text", "UTF-8").alias("line"))
    heads = T.table(s, d, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file"), F.lit(0).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("seq"),
                                           F.encode(F.lit("\ufeffcompany;budget"), "UTF-8").alias("line"))
    out = R.leads_from_lines(lines.unionByName(heads))
    return out.select("file", "row", F.col("raw")["company"].alias("company"), F.col("raw")["budget"].alias("budget"))


@query
def decode_korean(s, d):
    """Korean bodies under a header that names a Western charset, beside true Western ones."""
    c = T.table(s, d, "customer")
    korean = F.unhex(F.lit("bfecb8aec8b8bbe720b4ebc7a5c0ccbbe720c8abb1e6b5bf20"))
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(korean, F.encode("c_name", "UTF-8"))).otherwise(F.encode(F.concat(F.lit("Café für "), "c_name"), "ISO-8859-1"))
    out = R.decode_pages(c.select("c_custkey", body.alias("content"), F.lit("text/html; charset=ISO-8859-1").alias("kind")), "kind")
    return out.select("c_custkey", "html")


@query
def read_leads_json(s, d):
    body = F.to_json(F.struct(F.transform("rows", lambda r: F.struct(r["company"].alias("company"), r["budget"].alias("budget"))).alias("leads")))
    content = F.when(F.col("file").startswith("f3_"), F.lit("{bad")).otherwise(body)
    rows, errors = R.leads_from_json(_upload(s, d).select("file", F.encode(content, "UTF-8").alias("content")))
    good = rows.select("file", "row", F.col("raw")["company"].alias("company"), F.lit(None).cast("string").alias("code"))
    return good.unionByName(errors.select("file", F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("string").alias("company"), "code"))


@query
def read_sitemaps(s, d):
    """A root index, an index per region below it, and a sitemap per nation with its suppliers."""
    n = T.table(s, d, "nation").select("n_nationkey", "n_regionkey")
    address = lambda head, c, tail: F.concat(F.lit(f"https://x.kr/{head}"), F.col(c).cast("string"), F.lit(tail))
    listed = lambda df, key, entry: df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<loc>"), entry, F.lit("</loc>")))), "").alias("body"))
    index = F.concat(F.lit("<sitemapindex>"), "body").alias("body")
    world = n.select((F.col("n_regionkey") * 0).alias("one"), "n_regionkey").distinct()
    root = listed(world, "one", address("r", "n_regionkey", ".xml")).select(address("sitemap", "one", ".xml").alias("sitemap_url"), index, F.lit(True).alias("root"))
    below = listed(n, "n_regionkey", address("n", "n_nationkey", ".xml")).select(address("r", "n_regionkey", ".xml").alias("sitemap_url"), index, F.lit(False).alias("root"))
    leaves = listed(T.table(s, d, "supplier"), "s_nationkey", address("s/", "s_suppkey", "")).select(address("n", "s_nationkey", ".xml").alias("sitemap_url"), "body", F.lit(False).alias("root"))
    return R.read_sitemaps(root.unionByName(below).unionByName(leaves).withColumn("domain", F.lit("x.kr"))).select("domain", "sitemap_url", "url")


@query
def deep_sitemaps(s, d):
    """A chain of indexes 20 deep that leads back into itself; each lists the sitemap of a nation with its suppliers."""
    n = T.table(s, d, "nation").select(F.col("n_nationkey").alias("n"))
    url = lambda head, c: F.concat(F.lit(f"https://x.kr/{head}"), c.cast("string"), F.lit(".xml"))
    loc = lambda c: F.concat(F.lit("<loc>"), c, F.lit("</loc>"))
    following = F.when(F.col("n") == 20, 3).otherwise(F.col("n") + 1)
    chain = n.select(url("i", F.col("n")).alias("sitemap_url"), F.concat(F.lit("<sitemapindex>"), loc(url("f", F.col("n"))), loc(url("i", following))).alias("body"), (F.col("n") == 0).alias("root"))
    entries = F.array_join(F.array_sort(F.collect_list(loc(F.concat(F.lit("https://x.kr/s/"), F.col("s_suppkey").cast("string"))))), "")
    leaves = T.table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(entries.alias("body")).select(url("f", F.col("n")).alias("sitemap_url"), "body", F.lit(False).alias("root"))
    out = R.read_sitemaps(chain.unionByName(leaves).withColumn("domain", F.lit("x.kr")))
    return out.select("domain", "sitemap_url", F.col("file_no").cast("bigint").alias("file_no"), "url")


@query
def deep_links(s, d):
    """Suppliers as pages of their nation's site: each links to the next and the one 50 further on, every seventh back to an earlier one."""
    key = F.col("s_suppkey")
    pages = T.table(s, d, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("domain"), key.alias("page_idx"))
    home = pages.groupBy("domain").agg(F.min("page_idx").alias("home"))
    pages = pages.join(home, "domain").select("domain", "page_idx", F.when(F.col("page_idx") == F.col("home"), 0).otherwise(1).alias("depth"))
    after = Window.partitionBy("domain").orderBy("page_idx")
    near = pages.select("domain", F.col("page_idx").alias("from_idx"), F.lead("page_idx").over(after).alias("to_idx"))
    jump = pages.select("domain", F.col("page_idx").alias("from_idx"), (F.col("page_idx") + 50).alias("to_idx"))
    back = pages.where("page_idx % 7 = 0").select("domain", F.col("page_idx").alias("from_idx"), F.floor(F.col("page_idx") / 2).alias("to_idx"))
    out = K.page_depths(pages, near.unionByName(jump).unionByName(back))
    return out.select("domain", "page_idx", F.col("link_depth").cast("bigint").alias("link_depth"))


@query
def import_leads(s, d):
    """The import of two files with the same row numbers; ids count on from the existing leads."""
    named = _import_rows(s, d).withColumn("file", F.when(F.col("row") % 2 == 0, "a.csv").otherwise("b.csv"))
    new, _, _ = imports.import_leads(named.withColumn("row", F.floor(F.col("row") / 2) + 1), _existing(s, d), T.events_as_of())
    return new.select("id", "company_name", "contact_name", "email", "status", "budget")


@query
def leads_from_scans(s, d):
    from ..operators.results import scan_result as result
    blank = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    saved = T.table(s, d, "customer").select((F.col("c_custkey") + 1).alias("id"), F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".co.kr")).alias("domain"),
                                             *blank("name", "website", "industry", "biz_number", "ceo", "phone", "email", "it_hiring"))
    out = updates.leads_from_scans(saved, result(T.company_pages(s, d)))
    return out.select("row", "domain", "company_name", "contact_name", "rank", "phone", "email", "it_hiring", "memo")


@query
def norm_mobile(s, d):
    return T.raw_leads(s, d).select("row", N.lead_phone(F.col("mobile")).alias("mobile"), N.lead_phone(F.col("phone")).alias("phone"))


@query
def find_duplicate_leads(s, d):
    """Customer rows as probes: the keys they share with leads."""
    return L.find_duplicate_leads(T.raw_leads(s, d).withColumnRenamed("row", "probe_id"), T.leads(s, d))[0]


@query
def duplicate_lead_keys(s, d):
    """The leads behind the shared keys."""
    return L.find_duplicate_leads(T.raw_leads(s, d).withColumnRenamed("row", "probe_id"), T.leads(s, d))[1]


# --- streams: the state they end in for a replay of the tables --------------------------------


def _replayed(df: DataFrame, name: str, order: str, batches: int = 4) -> DataFrame:
    """The rows as a stream of several batches, dealt by a hash of `order` and so in no order of time.

    A batch is many files, more the larger the input, so that no task writes or reads a batch whole."""
    parts = max(batches, 4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    files = rounds.written(df.repartition(parts, F.xxhash64(order)).sortWithinPartitions(order), name)
    paths = files.inputFiles()
    path = paths[0].rsplit("/", 1)[0]
    return df.sparkSession.readStream.schema(files.schema).option("maxFilesPerTrigger", -(-len(paths) // batches)).parquet(path)


def _deltas(s, d) -> str:
    history = T.scan_history(s, d).select("domain", "id", "scanned_at", "it_jobs")
    path = rounds.folder(s, "deltas")
    streams.stream_jobs_delta(_replayed(history, "scans", "id"), path, f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return path


@query
def stream_jobs_delta(s, d):
    """Openings and their change per company after its scans came in four batches without order."""
    out = streams.read_jobs_delta(s, _deltas(s, d))
    return out.select("domain", "id", "it_jobs", "prev_it_jobs", "jobs_delta")


@query
def stream_rising_alerts(s, d):
    """Alerts of the newest scans; alerts of scans that were the newest for a while are left out, as they depend on the batches."""
    path = _deltas(s, d)
    newest = streams.read_jobs_delta(s, path).where("jobs_delta > 0").select("domain", "id")
    alerts = streams.read_rising_alerts(s, path).join(newest, ["domain", "id"])
    return alerts.groupBy("domain", "id").agg(F.count("*").alias("alerts"))


@query
def stream_stage_state(s, d):
    """Current status of every lead after its history came in four batches without order."""
    stream = _replayed(_history(s, d).select("id", "lead_id", "to_status", "at"), "stages", "id")
    path = rounds.folder(s, "stage-state")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/state/batch={number}")
    streams.stream_stage_state(stream).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = s.read.parquet(f"{path}/state")
    last = rows.agg(F.max("batch").alias("last"))
    return rows.join(last, F.col("batch") == F.col("last")).select("lead_id", "status")


@query
def stream_dedupe(s, d):
    """Documents as pages fetched in order of their id, seconds apart: one of each content within the delay, which covers all."""
    docs = T.document_pages(s, d).withColumn("fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_idx")))
    stream = _replayed(docs.select("domain", "page_idx", "final_url", "text", "fetched_at"), "fetched", "page_idx")
    path = rounds.folder(s, "deduped")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    streams.stream_dedupe(stream, "60 days", by="content").writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{path}/out").groupBy("domain").agg(F.count("*").alias("pages"))
