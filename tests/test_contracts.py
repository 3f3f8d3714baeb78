"""Contracts and customers on literal rows (as of 2026-09-01)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from leadloom.operators import contracts as C
from leadloom.operators import exports, updates
from leadloom.operators.leads import match_leads_to_customers
from leadloom.sources import writers


def as_of():
    return F.lit("2026-09-01").cast("date")

TODAY = dt.date(2026, 9, 1)


def raw(spark, *rows):
    data = [(i + 1, *[r.get(f) for f in C.FIELDS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(["row bigint", *[f"{f} string" for f in C.FIELDS]]))


ROWS = [
    dict(company_name="하늘소프트", website="https://haneul.kr", monthly_rate="800만", team_size="5", start_date="2026-01-01", end_date="2026-12-31", title="T1", tech="Java|AWS"),
    dict(company_name="하늘소프트", domain="haneul.kr", amount="1.5억", status="completed", start_date="2025-01-01", end_date="2025-06-01", satisfaction="4", biz_number="1-2"),
    dict(company_name="곧만료", amount="30000000", start_date="2026-01-01", end_date=str(TODAY + dt.timedelta(20)), status="active", satisfaction="9"),
    dict(company_name="휴면", amount="60000000", status="completed", start_date="2024-01-01", end_date=str(TODAY - dt.timedelta(400))),
    dict(company_name="해지", amount="9억", status="terminated"),
    dict(company_name="X"), dict(company_name="X", amount="1", start_date="2026-02-01", end_date="2026-01-01"), dict(amount="1"),
]


@pytest.fixture(scope="module")
def contracts(spark):
    return C.normalise_contracts(raw(spark, *ROWS))[0].withColumnRenamed("row", "id").cache()


def test_normalise(spark, contracts):
    got = {r.id: r for r in contracts.collect()}
    assert got[1].amount == 480_000_000 and got[1].domain == "haneul.kr" and got[1].signed_date == dt.date(2026, 1, 1)
    assert got[3].satisfaction is None and got[3].renewal_notice_days == 60
    errors = C.normalise_contracts(raw(spark, *ROWS))[1].collect()
    assert {(r.row, r.code) for r in errors} == {(6, "amount_required"), (7, "dates_invalid"), (8, "company_required")}


def test_customers(contracts):
    got = {r.customer_key: r for r in C.customer_rollup(contracts, as_of()).collect()}
    toss = got["haneul.kr"]
    assert (toss.contract_count, toss.total_value, toss.grade, toss.satisfaction, toss.biz_number, toss.tech) == (2, 630_000_000, "S", 4.0, "1-2", ["AWS", "Java"])
    assert got["곧만료"].grade == "C" and got["곧만료"].expiring_count == 1
    assert got["휴면"].dormant_days >= 399 and got["해지"].total_value == 0 and got["해지"].grade == "C"
    s = C.contract_summary(contracts, as_of()).first()
    assert (s.total_value, s.expiring_count, s.expiring_value, s.customer_count) == (720_000_000, 1, 30_000_000, 4)
    assert [r.customers for r in C.grade_counts(C.customer_rollup(contracts, as_of())).collect()] == [1, 0, 1, 2]


def test_grades(spark):
    df = spark.createDataFrame([(60_000_000, 2), (60_000_000, 1), (200_000_000, 3), (500_000_000, 1), (49_999_999, 9)], "total_value bigint, live_count bigint")
    assert [r.grade for r in C.customer_grade(df).collect()] == ["A", "B", "S", "S", "C"]


def test_flags_and_events(spark, contracts):
    gone = contracts.where("id = 3").withColumn("end_date", F.lit("2026-08-01").cast("date"))
    row = C.contract_flags(gone, as_of()).first()
    assert row.expiring and row.overdue_end and row.days_left == -31
    leads = spark.createDataFrame([(1, "A", "new", dt.date(2026, 9, 9), "call", None, None, "010", None, "m")],
                                  "id bigint, company_name string, status string, next_date date, next_action string, contact_name string, mobile string, phone string, email string, memo string")
    events = {r.uid: r for r in exports.calendar_events(leads, contracts).collect()}
    assert events["lead-1"].summary == "[CRM] A — call" and events["lead-1"].description == "010\nm"
    assert str(events["contract-1-notice"].date) == "2026-11-01" and events["contract-1-end"].description == "T1"
    assert len(events) == 5 and events["contract-3-notice"].description.startswith("만료 ")


def test_lead_links(spark, contracts):
    customers = C.customer_rollup(contracts, as_of())
    memo = {r.customer_key: r.memo for r in C.resell_leads(customers, contracts).collect()}["haneul.kr"]
    assert "등급 S" in memo and "₩630,000,000" in memo and memo.index("T1 2026-01-01~2026-12-31 ₩480,000,000") < memo.index("계약 2025-01-01")
    leads = spark.createDataFrame([(1, "haneul.kr", "x"), (2, None, " 하늘소프트 "), (3, "other.kr", "휴면"), (4, None, "없음")], "id bigint, domain string, company_name string")
    got = {r.id: (r.customer_key, r.customer_grade) for r in match_leads_to_customers(leads, customers).collect()}
    assert got == {1: ("haneul.kr", "S"), 2: ("haneul.kr", "S"), 3: ("휴면", "B"), 4: (None, None)}
    found = lambda *a, **k: {r.customer_key for r in C.search_customers(customers, contracts, *a, **k).collect()}
    assert found("t1") == {"haneul.kr"} and found(quick="dormant") == {"휴면"} and found(quick="expiring") == {"곧만료"} and found(grade="C") == {"곧만료", "해지"}
    won = spark.createDataFrame([(5, "won", "2026-11", 120_000_000)], "id bigint, status string, expected_start string, budget bigint")
    for c in ("company_id", "domain", "company_name", "website", "biz_number", "project_type", "team_size", "contact_name", "rank", "department", "mobile", "phone", "email", "assignee", "tech", "memo"):
        won = won.withColumn(c, F.lit(None).cast("string"))
    draft = C.contracts_from_leads(won).first()
    assert str(draft.start_date) == "2026-11-01" and draft.amount == 120_000_000


def test_update_and_documents(spark, contracts, folder):
    payload = spark.createDataFrame([(4, {"status": "active", "amount": "7천만 70000000", "tech": "Go"})], "id bigint, payload map<string,string>")
    after, errors = updates.write_contracts(contracts, payload, as_of())
    row = {r.id: r for r in after.collect()}[4]
    assert row.status == "active" and row.tech == ["Go"] and row.company_name == "휴면" and errors.count() == 0
    docs = C.customer_documents(C.customer_rollup(contracts, as_of()), contracts)
    assert docs.count() == 5 and docs.where("position = 1").count() == docs.select("customer_key").distinct().count()
    writers.export_contracts(C.customer_rollup(contracts, as_of()), contracts, f"{folder}/c", codes=exports.label_table(spark))
    assert spark.read.option("header", True).csv(f"{folder}/c").count() == 5


def test_customers_read_the_contracts_once(spark, contracts):
    """One scan of each table, whatever is gathered; missing technologies and repeated ones leave the measures as they are."""
    from leadloom.plans.queries import QUERIES
    plan = QUERIES["customer_rollup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("FileScan") == 3
    tech = F.when(F.col("id") == 1, F.array(F.lit("Java"), F.lit(None).cast("string"), F.lit("Java"), F.lit("AWS"))).when(F.col("id") == 2, F.col("tech"))
    odd = C.customer_rollup(contracts.withColumn("tech", tech), as_of())
    got = {r.customer_key: r for r in odd.collect()}
    want = {r.customer_key: r for r in C.customer_rollup(contracts, as_of()).collect()}
    assert got == want and got["haneul.kr"].contract_count == 2 and got["해지"].tech == []


def test_updates_read_the_contracts_once(spark, contracts):
    """One join puts payloads beside the contracts; a refused update is told and leaves its row, rows without a payload stay as they are."""
    payload = spark.createDataFrame([(4, {"amount": "2.5억", "memo": None}), (1, {"company_name": " ", "memo": "x"}), (99, {"memo": "y"})], "id bigint, payload map<string,string>")
    after, errors = updates.write_contracts(contracts, payload, as_of())
    assert after._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") == 1
    before, now = ({r.id: r for r in df.collect()} for df in (contracts, after.select(*contracts.columns)))
    assert {i for i in now if now[i] != before[i]} == {4} and set(now) == set(before)
    assert now[4].amount == 250_000_000 and now[4].memo is None and now[4].tech == before[4].tech
    assert [tuple(r) for r in errors.collect()] == [(1, "company_required")]
