"""Writes to the lead and contract tables: partial updates, status changes, leads from scans."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import empty_to_null, escape
from . import contracts as contract_ops
from . import leads as lead_ops


def _as_text(df: DataFrame, name: str) -> Column:
    """A typed column the way it would be typed in."""
    kind = df.schema[name].dataType.typeName()
    return F.to_json(name) if kind == "array" else F.col(name).cast("string")


def _merged(current: DataFrame, payloads: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Every row with its payload as `_payload` (null without one) and the fields as raw text: keys present in the payload win, also when null."""
    joined = current.join(payloads.select("id", F.col("payload").alias("_payload")), "id", "left")
    p = F.col("_payload")
    pick = lambda f: F.when(F.map_contains_key(p, f), p[f]).otherwise(_as_text(current, f)).alias(f)
    keep = [c for c in current.columns if c not in fields]
    return joined.select(*keep, "_payload", *[pick(f) for f in fields], F.struct(*[F.col(f) for f in fields]).alias("_before"))


def write_leads(leads: DataFrame, payloads: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leads, status history rows, errors(id, code)) after partial updates.

    `payloads` holds one row per lead: id and a map of the fields to set (a null value clears the
    field). Updated leads are normalised and scored again; unknown ids have no effect, and a row that
    would become invalid stays as it was. One left join puts payloads beside the leads; leads, history and errors are read off its rows.
    """
    plain = [c for c in leads.columns if c not in lead_ops.FIELDS]
    told = _merged(leads, payloads, lead_ops.FIELDS).withColumn("_old", F.struct(*plain)).drop(*[c for c in plain if c != "id"])
    typed = lead_ops.score_leads(lead_ops.normalised(told), as_of.cast("date"))
    asked = F.col("_payload").isNotNull()
    good = asked & F.col("code").isNull()

    def value(c: str) -> Column:
        old = F.col("_before").getField(c) if c in lead_ops.FIELDS else F.col("_old").getField(c)
        new = as_of if c == "updated_at" else F.col(c) if c in typed.columns else old
        return F.when(good, new).otherwise(old).cast(leads.schema[c].dataType).alias(c)

    after = typed.select(*[value(c) if c != "id" else F.col("id") for c in leads.columns])
    moved = good & ~F.col("status").eqNullSafe(F.col("_before.status"))
    history = typed.where(moved).select(F.col("id").alias("lead_id"), F.col("_before.status").alias("from_status"), F.col("status").alias("to_status"), as_of.alias("at"))
    return after, history, typed.where(asked & F.col("code").isNotNull()).select("id", "code")


def change_status(leads: DataFrame, ids: DataFrame, status: str, as_of: Column,
                  lost_reason: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bulk status change; returns what `write_leads` returns."""
    fields = {"status": status, **({"lost_reason": lost_reason} if lost_reason else {})}
    payload = F.create_map(*[F.lit(x) for pair in fields.items() for x in pair])
    return write_leads(leads, ids.select("id").distinct().withColumn("payload", payload), as_of)


def create_leads(raw: DataFrame, as_of: Column, first_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leads, history, errors) of new raw rows; ids count from `first_id` by row number."""
    valid, errors = lead_ops.normalise_leads(raw)
    rows = lead_ops.score_leads(valid, as_of.cast("date")).select(
        (F.col("row") + F.lit(first_id - 1)).cast("bigint").alias("id"), "*", as_of.alias("created_at"), as_of.alias("updated_at"))
    history = rows.select(F.col("id").alias("lead_id"), F.lit(None).cast("string").alias("from_status"),
                          F.col("status").alias("to_status"), F.col("created_at").alias("at"))
    return rows.drop("row"), history, errors


def write_contracts(contracts: DataFrame, payloads: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(contracts, errors(id, code)) after partial updates, merged and normalised like leads: one left join, contracts and errors are read off its rows.

    Only rows with a payload are written out as text and normalised; the others pass by as they are.
    """
    plain = [c for c in contracts.columns if c not in contract_ops.FIELDS]
    told = _merged(contracts, payloads, contract_ops.FIELDS).withColumn("_old", F.struct(*plain)).drop(*[c for c in plain if c != "id"])
    asked = F.col("_payload").isNotNull()
    typed = contract_ops.normalised(told.withColumns({f: F.when(asked, F.col(f)) for f in contract_ops.FIELDS}))
    good = asked & F.col("code").isNull()

    def value(c: str) -> Column:
        old = F.col("_before").getField(c) if c in contract_ops.FIELDS else F.col("_old").getField(c)
        new = F.col(c) if c in contract_ops.FIELDS else as_of if c == "updated_at" else old
        return F.when(good, new).otherwise(old).cast(contracts.schema[c].dataType).alias(c)

    after = typed.select(*[value(c) if c != "id" else F.col("id") for c in contracts.columns])
    return after, typed.where(asked & F.col("code").isNotNull()).select("id", "code")


def tech_of(jobs: Column, n: int | None = None, keywords: Sequence[str] = fixed.TECH_KEYWORDS) -> Column:
    """Technologies named in an array of openings (title, description)."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    text = F.array_join(F.transform(jobs, lambda j: F.concat(blank(j["title"]), F.lit(" "), blank(j["description"]))), " ")
    hit = lambda k: text.rlike(rf"(?iU)(?<![A-Za-z0-9]){escape(k)}(?![A-Za-z0-9])")
    found = F.array_compact(F.array(*[F.when(hit(k), k) for k in keywords]))
    return F.slice(found, 1, n) if n else found


def leads_from_scans(companies: DataFrame, scans: DataFrame, max_titles: int | None = None, max_people: int | None = None) -> DataFrame:
    """Raw leads prefilled from saved companies and their scan results (joined on domain).

    The memo lists all openings and further people unless a number is given, also those of further parts of a result.
    Results without parts are whole."""
    scans = scans if "part" in scans.columns else scans.withColumn("part", F.lit(0))
    r = scans.where("part = 0").select("domain", F.struct("company", "key_contacts", "it_recruitment", F.col("it_hiring")).alias("r"))
    listed = F.array_sort(F.collect_list(F.struct("part", F.col("key_contacts").alias("p"), F.col("it_recruitment").alias("j"))))
    further = scans.where("part > 0").groupBy("domain").agg(listed.alias("l")).select("domain", F.struct(
        F.flatten(F.transform("l", lambda x: x["p"])).alias("p"), F.flatten(F.transform("l", lambda x: x["j"])).alias("j")).alias("more"))
    saved = companies.join(r, "domain", "left").join(further, "domain", "left")
    whole = lambda first, more: F.when(F.col("more").isNull(), first).otherwise(F.concat(first, more))
    c, people, jobs = F.col("r.company"), whole(F.col("r.key_contacts"), F.col("more.p")), whole(F.col("r.it_recruitment"), F.col("more.j"))
    fact = lambda f: F.coalesce(empty_to_null(c[f]), F.col(f))
    first = F.try_element_at(people, F.lit(1))
    ceo = F.coalesce(empty_to_null(c["ceo"]), empty_to_null("ceo"))
    person = lambda p: F.when(empty_to_null(p["name"]).isNotNull(), F.rtrim(F.concat(
        F.lit("담당자: "), p["name"], F.lit(" "), F.coalesce(p["position"], F.lit("")))))
    titles = F.filter(F.transform(F.slice(jobs, 1, max_titles) if max_titles else jobs, lambda j: j["title"]), lambda t: t.isNotNull() & (t != ""))
    lines = F.concat(
        F.array(F.when(empty_to_null(c["address"]).isNotNull(), F.concat(F.lit("주소: "), c["address"]))),
        F.coalesce(F.transform(F.slice(people, F.lit(2), F.lit(max_people) if max_people else F.size(people)), person), F.array().cast("array<string>")),
        F.array(F.when(F.size(jobs) > 0, F.concat(F.lit("채용: "), F.array_join(titles, ", ")))))
    return saved.select(
        F.col("id").alias("row"), F.col("id").cast("string").alias("company_id"), "domain",
        F.coalesce(empty_to_null(c["name"]), empty_to_null("name"), F.col("domain")).alias("company_name"),
        fact("website").alias("website"), fact("industry").alias("industry"), fact("biz_number").alias("biz_number"),
        F.coalesce(empty_to_null(first["name"]), ceo).alias("contact_name"),
        F.coalesce(empty_to_null(first["position"]), F.when(ceo.isNotNull(), "대표이사")).alias("rank"),
        fact("phone").alias("phone"), fact("email").alias("email"), F.lit("scanner").alias("source"),
        F.to_json(F.coalesce(tech_of(jobs), F.array().cast("array<string>"))).alias("tech"),
        F.coalesce(F.col("r.it_hiring"), F.col("it_hiring")).alias("it_hiring"),
        empty_to_null(F.array_join(F.array_compact(lines), "\n")).alias("memo"))
