"""The engine's tables derived from a star schema with an event stream and raw web pages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import neighbour
from ..functions.text import titled
from ..functions.urls import host, registrable
from ..operators import contracts as contract_ops
from ..operators import leads as lead_ops
from ..operators import links as link_ops
from ..operators import pages as page_ops
from ..operators import scans as scan_ops
from ..sources.readers import dealt

# tables whose rows are parsed at some cost; those of narrow rows, of which one row group holds a million, are always dealt out
COSTLY = ("pages", "documents", "orders", "customer")
NARROW = ("orders", "customer")
EVENTS_AS_OF = "2024-02-01 00:00:00"
ORDERS_AS_OF = "2001-09-01"
STATUS_OF_EVENT = {"signup": "new", "view": "contacted", "click": "meeting", "purchase": "won", "error": "lost"}


def events_as_of() -> Column:
    return F.lit(EVENTS_AS_OF).cast("timestamp_ntz")


def orders_as_of() -> Column:
    return F.lit(ORDERS_AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(df, name in NARROW) if name in COSTLY else df


# --- events: status history and scan history ----------------------------------------------


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lead is one user on one day of the month; every event moves it to a status."""
    e = table(spark, sf_dir, "events")
    moves = F.create_map(*[F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair])
    rows = e.select(
        (F.col("user_id") * 100 + F.day("ts")).cast("bigint").alias("lead_id"),
        F.col("event_id").alias("id"), F.col("ts").alias("at"),
        F.try_element_at(moves, F.col("event_type")).alias("to_status"))
    out = neighbour(rows, "lead_id", ("at", "id"), "to_status", "from_status",
                    bucket=F.date_trunc("hour", F.col("at")), step=-1)
    return out.select("id", "lead_id", "from_status", "to_status", "at")


def funnel_leads(history: DataFrame) -> DataFrame:
    """Leads that signed up; the others are the deleted leads whose history is left over."""
    return (history.groupBy(F.col("lead_id").alias("id"))
            .agg(F.max_by("to_status", F.struct("at", "id")).alias("status"), F.min("at").alias("created_at"),
                 F.bool_or(F.col("to_status") == "new").alias("_signed"))
            .where("_signed").drop("_signed"))


def scan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan per user and day; every event but an error is an opening found."""
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    jobs = F.count_if(F.col("event_type") != "error")
    has = lambda t: F.bool_or(F.col("event_type") == t)
    return (e.groupBy(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example.com")).alias("domain"),
                      F.col("user_id").alias("_user"), day.alias("_day"))
            .agg(jobs.alias("it_jobs"), F.count_if(F.col("event_type") == "signup").alias("contacts"),
                 has("click").alias("has_email"), has("purchase").alias("has_phone"))
            .select((F.col("_user") * 100000000 + F.date_format("_day", "yyyyMMdd").cast("bigint")).alias("id"), "domain",
                    F.col("_day").alias("scanned_at"), scan_ops.signal_of(F.col("it_jobs")).alias("it_hiring"),
                    "it_jobs", "contacts", "has_email", "has_phone"))


def companies(history: DataFrame) -> DataFrame:
    """Company rows as the saves of a scan history leave them."""
    saves = history.select(
        F.col("id").alias("seq"), "scanned_at", "domain",
        F.initcap(F.split("domain", r"\.")[0]).alias("name"),
        F.lit(None).cast("string").alias("address"),
        F.when(F.col("has_phone"), F.concat(F.lit("02-"), F.col("id").cast("string"))).alias("phone"),
        F.when(F.col("has_email"), F.concat(F.lit("info@"), F.col("domain"))).alias("email"),
        F.lit(None).cast("string").alias("industry"), F.lit(None).cast("string").alias("biz_number"),
        F.lit(None).cast("string").alias("ceo"), F.concat(F.lit("https://"), F.col("domain")).alias("website"),
        "it_hiring", "it_jobs", "contacts")
    return scan_ops.upsert_companies(None, saves)


# --- orders: contracts --------------------------------------------------------------------


def raw_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a contract typed by a person; team size is its number of line items."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    team = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("team"))
    step = F.element_at(F.array(*[F.lit(x) for x in (10, 400, 20, 60)]), (F.col("c_custkey") % 4 + 1).cast("int"))
    digit = F.left("o_orderpriority", F.lit(1)).cast("int")
    status = (F.when((F.col("o_orderstatus") == "F") & (digit == 5), "terminated")
              .when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "active")
              .otherwise(" renewed "))
    start = F.to_date("o_orderdate")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("dispatch", "contract", "SI", "sm", "odc")]), digit)
    site = F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(team, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("row"),
        F.when(F.col("c_nationkey") < 13, F.concat(F.lit("https://www."), site, F.lit(".co.kr/kr"))).alias("website"),
        F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")).alias("company_name"),
        F.concat(F.lit("PO-"), F.col("o_orderkey").cast("string")).alias("title"),
        F.col("o_custkey").cast("string").alias("company_id"),
        F.when(digit > 2, F.format_string("%010d", F.col("o_custkey"))).alias("biz_number"),
        kind.alias("project_type"), status.alias("status"), F.date_format(start, "yyyy.MM.dd").alias("start_date"),
        F.date_format(F.date_add(start, 365), "yyyy-MM-dd").alias("end_date"),
        (F.floor("o_totalprice") * step).cast("string").alias("amount"), F.col("team").cast("string").alias("team_size"),
        digit.cast("string").alias("satisfaction"), (digit * 30).cast("string").alias("renewal_notice_days"),
        F.concat_ws("|", titled("c_mktsegment"), F.substring("o_orderpriority", 3, 20)).alias("tech"),
        F.when(digit == 1, F.lit("urgent memo")).alias("memo"))
    missing = [f for f in contract_ops.FIELDS if f not in rows.columns]
    return rows.withColumns({f: F.lit(None).cast("string") for f in missing})


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = contract_ops.normalise_contracts(raw_contracts(spark, sf_dir))
    return valid.withColumnRenamed("row", "id")


# --- customers: leads ---------------------------------------------------------------------

LEAD_RANKS = ("부사장 겸 CTO", "Director of Engineering", "대표이사", "담당", "과장 / Manager", " cio ", "")
LEAD_BUDGET = ("₩ {n}억 5000만", "{n},000,000", "2.5억", "", "{n}만")


def raw_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lead rows the way people type them."""
    c = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    bal = F.floor(F.abs("c_acctbal")).cast("bigint")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    slug = F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))
    money = F.replace(pick(LEAD_BUDGET, nat), F.lit("{n}"), bal.cast("string"))
    tail = F.lpad((key % 10000).cast("string"), 4, "0")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 60).cast("int"))
    return c.select(
        key.alias("row"), F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")).alias("company_name"),
        F.when(F.col("n_regionkey") > 0, F.concat(F.lit("www."), slug, F.lit(".co.kr/about"))).alias("website"),
        F.when(nat > 9, F.format_string("%010d", key)).otherwise(F.lit("n/a")).alias("biz_number"),
        titled("c_mktsegment").alias("industry"),
        pick(("Enterprise", "midsize", "sme", "huge", "public"), nat).alias("company_size"),
        F.concat(F.lit("Agent "), key.cast("string")).alias("contact_name"),
        pick(LEAD_RANKS, key).alias("rank"),
        F.when(bal % 2 == 0, F.concat(F.lit("+82-2-1234-"), tail)).alias("phone"),
        F.when(bal % 3 == 0, F.concat(F.lit("0101234"), tail)).alias("mobile"),
        F.when(bal % 5 == 0, F.lit("not-an-email")).when(bal % 5 < 4, F.concat(slug, F.lit("@Mail.co.kr"))).alias("email"),
        F.when(bal % 7 == 0, F.concat(F.lit("kk"), key.cast("string"))).alias("kakao"),
        pick(("Referral", "exhibition", "website", "coldcall", "unknown"), nat).alias("source"),
        pick(("dispatch", "SI", "?"), nat).alias("project_type"),
        F.concat_ws(", ", titled("c_mktsegment"), F.lit("Java"), F.lit("java")).alias("tech"),
        money.alias("budget"), F.concat(F.lit("약 "), (bal % 6).cast("string"), F.lit("명")).alias("team_size"),
        F.concat(F.lit("2024년 "), (key % 14).cast("string"), F.lit("월")).alias("expected_start"),
        pick(("High", "medium", "low", "x"), bal).alias("it_hiring"),
        pick(("new", "contacted", "Meeting", "proposal", "negotiation", "won", "lost", "hold", ""), key).alias("status"),
        pick(("price", "schedule", "?"), nat).alias("lost_reason"),
        F.when(nat > 3, F.concat(F.lit("rep "), F.col("n_regionkey").cast("string"))).alias("assignee"),
        F.when(bal % 4 == 0, F.date_format(day, "d/M/yyyy")).alias("next_date"),
        F.when(bal % 3 == 0, F.lit("call back")).alias("next_action"),
        F.lit("2024-01-15").alias("last_contact"), F.concat(F.lit("memo "), F.col("n_name")).alias("memo"),
        day.alias("created_on"))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid leads with id, creation and update time and the score on the day of the event cut-off."""
    valid, _ = lead_ops.normalise_leads(raw_leads(spark, sf_dir))
    dated = (valid.withColumnRenamed("row", "id").withColumn("created_at", F.col("created_on").cast("timestamp_ntz"))
             .withColumn("updated_at", F.col("created_at")).drop("created_on"))
    return lead_ops.score_leads(dated, events_as_of().cast("date"))


# --- conversations: activities ------------------------------------------------------------


def raw_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "Call").when(F.col("role") == "assistant", "email").otherwise("visit")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("turn").cast("int"))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("lead_id"),
        kind.alias("type"), F.col("text").alias("note"), F.date_format(day, "yyyy/MM/dd").alias("at"))


# --- pages --------------------------------------------------------------------------------


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages with their domain."""
    raw = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("page_idx"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), "html")
    return raw.withColumn("domain", registrable(host("url")))


def page_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_idx, depth and category of each page, from the addresses alone: the first page of a domain is its home."""
    site = site_pages(spark, sf_dir).select("page_idx", "url", "domain")
    home = site.groupBy("domain").agg(F.min("page_idx").alias("_home"))
    placed = site.join(home, "domain").withColumn("depth", F.when(F.col("page_idx") == F.col("_home"), 0).otherwise(1))
    category = F.when(F.col("depth") == 0, "home").otherwise(F.coalesce(link_ops.category_of(F.col("url"), F.lit("")), F.lit("other")))
    return placed.select("page_idx", "depth", category.alias("category"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with domain, text, title, depth and category. The wide rows are joined by page, so no domain gathers its html."""
    return page_ops.build_pages(site_pages(spark, sf_dir).join(page_places(spark, sf_dir), "page_idx"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages: cut out of the html first, placed afterwards."""
    places = page_places(spark, sf_dir).select(F.col("page_idx").alias("from_idx"), "depth", F.col("category").alias("from_category"))
    return link_ops.extract_links(site_pages(spark, sf_dir)).join(places, "from_idx")


CEO_NAMES = ("박민호", "이서연", "최지훈", "정다은", "강현우", "윤서진", "한지민")
JOB_TITLES = ("자바 개발자 모집", "데이터 엔지니어 채용", "영업사원 모집", "백엔드 개발자 채용", "총무 담당자 채용")


def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as small company sites: a home page with a footer of facts, and a careers page with an entry per priority of their orders."""
    c = table(spark, sf_dir, "customer")
    jobs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.left("o_orderpriority", F.lit(1)).cast("int"))).alias("kinds"))
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    domain = F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".co.kr"))
    mail = F.when(nat % 3 == 0, F.concat(F.lit("메일: info@"), domain)).when(nat % 3 == 1, F.lit('<img src="/img/email.png" alt="이메일">')).otherwise(
        F.lit('<form><input type="email" name="reply"></form>'))
    footer = F.concat(F.lit("상호: "), F.col("c_name"), F.lit(" | 대표이사: "), pick(CEO_NAMES, key), F.lit(" | 사업자등록번호: "),
                      F.format_string("%03d-%02d-%05d", (key % 900 + 100), (key % 90 + 10), key % 100000), F.lit("<br>주소: 서울특별시 강남구 테헤란로 "),
                      (key % 500 + 1).cast("string"), F.lit("<br>전화: 02-"), F.format_string("%04d", key % 9000 + 1000), F.lit("-5678<br>"), mail)
    home = F.concat(F.lit('<html><head><title>'), F.col("c_name"), F.lit("</title></head><body><p>"), titled("c_mktsegment"), F.lit(" software</p><footer>"), footer, F.lit("</footer></body></html>"))
    entry = lambda k: F.concat(F.lit('<li><a href="/recruit/'), k.cast("string"), F.lit('">'), F.element_at(F.array(*[F.lit(t) for t in JOB_TITLES]), k), F.lit("</a> 정규직</li>"))
    careers = F.concat(F.lit("<html><body><ul>"), F.array_join(F.transform(F.coalesce("kinds", F.array().cast("array<int>")), entry), ""), F.lit("</ul></body></html>"))
    page = lambda idx, path, category, body: F.struct(F.lit(idx).alias("i"), F.lit(path).alias("path"), F.lit(category).alias("category"), body.alias("html"))
    rows = c.join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left").select(key.alias("key"), domain.alias("domain"), F.explode(F.array(
        page(0, "/", "home", home), page(1, "/recruit", "recruitment", careers))).alias("p"))
    url = F.concat(F.lit("https://"), F.col("domain"), F.col("p.path"))
    return page_ops.build_pages(rows.select("domain", (F.col("key") * 2 + F.col("p.i")).alias("page_idx"), url.alias("url"), url.alias("final_url"), F.lit(200).alias("status"),
                                            F.col("p.html").alias("html"), F.col("p.i").alias("depth"), F.col("p.category").alias("category")))


NESTED = (
    '<div>{seg} 정규직<div><p>부서 {key}</p></div><a href="/jobs/{key}">{one}</a><div>마감일: 2026-05-01</div></div>',
    "<ul><li><h3>{one}</h3> 정규직 {key}<ul><li>서울</li></ul><li>{two} 계약직</ul>",
    "<table><tr><td>{one}<td>정규직 {key}<tr><td><table><tr><td>{two}</td></tr></table> 인턴</table>",
    "</div></li><article>{seg} 정규직 <h2>{one}</h2> {key}",
    "<div><article><strong>{one}</strong> 정규직</div>{key} <strong>{two}</strong></article> 계약직",
    '<div class="a"><div class="b"><ol><li><strong>{one}</strong><li><a href="/recruit/{key}">{two}</a> 정규직</ol></div>{seg}</div>')
FOOTERS = '<div class="my-footer"><div>{seg}</div><footer>in {key}</footer>x</div><footer>a<footer>b</footer>{one}</footer><p>more</p><address>{key}'


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as recruitment pages whose elements are nested, overlap or lack end tags."""
    key = F.col("c_custkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    made = F.concat(F.lit("<html><body>"), pick(NESTED, key), F.lit(FOOTERS))
    for name, value in (("{seg}", titled("c_mktsegment")), ("{key}", key.cast("string")), ("{one}", pick(JOB_TITLES, key)), ("{two}", pick(JOB_TITLES, F.floor(key / 5)))):
        made = F.replace(made, F.lit(name), value)
    url = F.concat(F.lit("https://c"), key.cast("string"), F.lit(".co.kr/recruit"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), key.cast("string"), F.lit(".co.kr")).alias("domain"), key.alias("page_idx"), url.alias("url"),
                                                   url.alias("final_url"), F.lit("recruitment").alias("category"), made.alias("html"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as already extracted page texts; the source is the site."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("domain"), F.col("doc_id").alias("page_idx"),
        F.concat(F.lit("https://"), "source", F.lit(".example.net/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("https://"), "source", F.lit(".example.net/doc/"), F.col("doc_id").cast("string")).alias("final_url"),
        F.lit("").alias("title"), F.lit("other").alias("category"), F.lit(1).alias("depth"), "text")
