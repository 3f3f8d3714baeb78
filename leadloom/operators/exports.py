"""Labels of codes, calendar events, mail drafts and the tables written for people."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import format_krw as krw_text
from ..functions.text import empty_to_null, stripped
from .contracts import with_customer_key

COMPANY_EXPORT = ("name", "biz_number", "ceo", "address", "phone", "email", "industry", "website", "it_hiring",
                  "it_jobs", "jobs_delta", "contacts", "updated_at")
LEAD_EXPORT = ("company_name", "biz_number", "company_size", "industry", "website", "contact_name", "rank", "department",
               "phone", "mobile", "email", "kakao", "source", "project_type", "tech", "budget", "team_size",
               "expected_start", "bridge_se", "competitor", "score", "status", "lost_reason", "assignee", "next_action",
               "next_date", "last_contact", "memo", "created_at")
LEAD_LABELS = {"company_size": "size", "rank": "rank", "source": "source", "project_type": "project", "status": "status",
               "lost_reason": "lost"}
CONTRACT_EXPORT = ("company_name", "title", "contract_no", "project_type", "status", "signed_date", "start_date",
                   "end_date", "amount", "monthly_rate", "team_size", "payment_terms", "contact_name", "rank", "phone",
                   "email", "our_pm", "tech", "satisfaction", "memo")
CONTRACT_LABELS = {"project_type": "project", "status": "cstatus", "payment_terms": "payment", "rank": "rank"}


def label_table(spark: SparkSession) -> DataFrame:
    """The built-in code labels as a table (grp, code, lang, label)."""
    rows = [(grp, code, lang, label) for grp, codes in fixed.LABELS.items() for code, pair in codes.items()
            for lang, label in zip(("ko", "vi"), pair)]
    return spark.createDataFrame(rows, "grp string, code string, lang string, label string")


def label_codes(df: DataFrame, codes: DataFrame, lang: str, columns: Mapping[str, str]) -> DataFrame:
    """Codes of the given columns ({column: group}) replaced by their labels; unknown codes stay.

    The label table is joined once per column; it is small by nature and Spark broadcasts it after
    looking at its size.
    """
    out = df
    for column, grp in columns.items():
        side = codes.where((F.col("grp") == grp) & (F.col("lang") == lang)).select(
            F.col("code").alias(f"_{column}"), F.col("label").alias(f"_{column}_label"))
        out = (out.join(side, out[column] == side[f"_{column}"], "left")
               .withColumn(column, F.coalesce(f"_{column}_label", column)).drop(f"_{column}", f"_{column}_label"))
    return out


def format_krw(df: DataFrame, column: str, lang: str = "ko", out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, krw_text(F.col(column), lang))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def companies_export(trend: DataFrame, lang: str = "ko") -> DataFrame:
    """The 13 columns of the company list as text, missing facts spelled out."""
    signals = {k: v[0 if lang == "ko" else 1] for k, v in fixed.LABELS["signal"].items()}
    level = F.create_map(*[F.lit(x) for pair in signals.items() for x in pair])
    named = [F.coalesce(empty_to_null(c), F.lit(fixed.NOT_FOUND_LABEL[lang])).alias(c) for c in COMPANY_EXPORT[:8]]
    day = "yyyy. MM. dd." if lang == "ko" else "dd/MM/yyyy"
    return trend.select(
        *named, F.coalesce(F.try_element_at(level, F.coalesce("it_hiring", F.lit("None"))), "it_hiring").alias("it_hiring"),
        F.coalesce("it_jobs", F.lit(0)).cast("string").alias("it_jobs"), _text("jobs_delta").alias("jobs_delta"),
        F.coalesce("contacts", F.lit(0)).cast("string").alias("contacts"),
        F.coalesce(F.date_format("updated_at", day), F.lit("")).alias("updated_at"))


def leads_export(leads: DataFrame, codes: DataFrame, lang: str = "ko") -> DataFrame:
    """The 29 columns of the lead list as text."""
    named = label_codes(leads, codes, lang, LEAD_LABELS)
    shown = {"tech": F.array_join("tech", " | "), "bridge_se": F.when(F.col("bridge_se"), "Y").otherwise("")}
    return named.select(*[shown.get(c, _text(c)).alias(c) for c in LEAD_EXPORT])


def contracts_export(customers: DataFrame, contracts: DataFrame, codes: DataFrame | None = None, lang: str = "ko") -> DataFrame:
    """Contracts with the grade of their customer, as text."""
    rows = with_customer_key(contracts).join(customers.select("customer_key", "grade"), "customer_key")
    if codes is not None:
        rows = label_codes(rows, codes, lang, CONTRACT_LABELS)
    shown = {"tech": F.array_join("tech", " | ")}
    return rows.select("grade", *[shown.get(c, _text(c)).alias(c) for c in CONTRACT_EXPORT])


def calendar_events(leads: DataFrame, contracts: DataFrame) -> DataFrame:
    """Follow-ups of open leads; notice day and end day of active contracts."""
    add = lambda c: F.coalesce(F.concat(F.lit(" — "), empty_to_null(c)), F.lit(""))
    details = F.array_compact(F.array(empty_to_null("contact_name"), F.coalesce(empty_to_null("mobile"), empty_to_null("phone")),
                                      empty_to_null("email"), empty_to_null("memo")))
    follow = leads.where(F.col("next_date").isNotNull() & F.col("status").isin(*fixed.OPEN_STATUSES)).select(
        F.concat(F.lit("lead-"), F.col("id").cast("string")).alias("uid"), F.col("next_date").alias("date"),
        F.concat(F.lit("[CRM] "), "company_name", add("next_action")).alias("summary"),
        F.array_join(details, "\n").alias("description"))
    notice = F.coalesce(F.nullif("renewal_notice_days", F.lit(0)), F.lit(fixed.RENEWAL_NOTICE_DAYS)).cast("int")
    uid = F.concat(F.lit("contract-"), F.col("id").cast("string"))
    money = F.concat(F.lit("₩"), F.format_number(F.coalesce("amount", F.lit(0)), 0))
    body = F.concat(_text("title"), F.lit("\n만료 "), _text("end_date"), F.lit(" · "), money, F.lit("\n"),
                    _text("contact_name"), F.lit(" "), _text("phone"), F.lit(" "), _text("email"))
    event = lambda *c: F.struct(*[x.alias(n) for x, n in zip(c, ("uid", "date", "summary", "description"))])
    both = F.array(
        event(F.concat(uid, F.lit("-notice")), F.date_sub("end_date", notice),
              F.concat(F.lit("[계약 만료 "), notice.cast("string"), F.lit("일 전] "), "company_name", F.lit(" — 재계약 제안")),
              stripped(body)),
        event(F.concat(uid, F.lit("-end")), F.col("end_date"), F.concat(F.lit("[계약 만료] "), "company_name"), _text("title")))
    ends = (contracts.where("status = 'active' and end_date is not null").select(F.explode(both).alias("e")).select("e.*"))
    return follow.unionByName(ends)


def mail_drafts(leads: DataFrame, templates: Mapping[str, tuple[str, str]], signature: str = "") -> DataFrame:
    """Subject and body per lead and template; {fields} of the texts are filled in.

    `templates` maps kind to (subject, body): a handful of texts the caller holds, exploded beside each
    lead, so leads are neither joined nor shuffled.
    """
    d = fixed.MAIL_DEFAULTS
    rank = {code: pair[0] for code, pair in fixed.LABELS["rank"].items()}
    project = {code: pair[0] for code, pair in fixed.LABELS["project"].items()}
    lookup = lambda mapping, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)
    rank_ko = F.coalesce(empty_to_null(F.regexp_replace(lookup(rank, F.col("rank")), r"\s*\(.*\)$", "")), F.lit(d["rank"]))
    short = F.btrim(F.split("company_name", r"\s+[-|·]\s+")[0])
    fill = lambda text, key, c: F.replace(F.lit(text), F.lit("{" + key + "}"), c.cast("string"))
    values = {
        "company": F.coalesce(empty_to_null(short), F.col("company_name")),
        "contact": F.when(empty_to_null("contact_name").isNotNull(), F.concat("contact_name", F.lit(" "), rank_ko, F.lit(d["honorific"])))
        .otherwise(d["contact"]),
        "tech": F.coalesce(empty_to_null(F.array_join("tech", ", ")), F.lit(d["tech"])),
        "team": F.when(F.col("team_size") != 0, fill(d["team"], "count", F.col("team_size"))).otherwise(""),
        "start": F.when(empty_to_null("expected_start").isNotNull(), fill(d["start"], "month", F.col("expected_start"))).otherwise(""),
        "project": F.coalesce(lookup(project, F.col("project_type")), F.lit(d["project"])),
        "signature": F.lit(signature.strip() or d["signature"]),
    }

    def filled(c: Column) -> Column:
        for key, value in values.items():
            c = F.replace(c, F.lit("{" + key + "}"), value)
        return c

    texts = [F.struct(F.lit(kind).alias("kind"), F.lit(subject).alias("subject"), F.lit(body).alias("body"))
             for kind, (subject, body) in templates.items()]
    rows = leads.withColumn("_t", F.explode(F.array(*texts)))
    return rows.select("id", F.col("_t.kind").alias("kind"), F.col("email").alias("to"), filled(F.col("_t.subject")).alias("subject"),
                       F.regexp_replace(filled(F.col("_t.body")), r"\n{3,}", "\n\n").alias("body"))
