"""Leads, imports, updates, funnel and exports on literal rows."""
import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import exports, funnel, imports, updates
from leadloom.operators import leads as L
from leadloom.sources import readers, writers


def as_of():
    return F.lit("2026-09-15 12:00:00").cast("timestamp_ntz")


def day():
    return F.lit("2026-09-15").cast("date")



def raw(spark, *rows):
    fields = sorted({k for r in rows for k in r})
    data = [(i + 1, *[r.get(f) for f in fields]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(["row bigint", *[f"{f} string" for f in fields]]))


def stored(spark, *rows):
    valid, _ = L.normalise_leads(raw(spark, *rows))
    scored = L.score_leads(valid, day())
    return scored.withColumnRenamed("row", "id").withColumns({"created_at": as_of(), "updated_at": as_of()})


STRONG = dict(company_name="A", rank="CTO", email="a@b.kr", mobile="01012345678", kakao="k", budget="3억", source="referral",
              project_type="odc", biz_number="1208112345", it_hiring="High", team_size="5")


def test_scores(spark):
    leads = stored(spark, STRONG, dict(company_name="B"), dict(company_name="C", rank="부장", email="c@d.kr", it_hiring="medium"))
    assert [r.score for r in leads.orderBy("id").collect()] == [100, 0, 37]
    parts = leads.select("score", F.aggregate("score_breakdown", F.lit(0), lambda a, x: a + x["points"]).alias("total")).collect()
    assert all(p.score == min(100, p.total) for p in parts)
    past = stored(spark, dict(company_name="D", expected_start="2020-01"), dict(company_name="E", expected_start="2027-03"))
    assert [r.score for r in past.orderBy("id").collect()] == [8, 4]


def test_normalisation(spark):
    rows = [dict(company_name="A", status="won", lost_reason="price"), dict(company_name="A", status="LOST", lost_reason="Price"), dict(company_name=" "),
            dict(company_name="A", email="not-an-email"), dict(company_name="B", website="www.b.co.kr/x", bridge_se="필요", email=" X@Y.KR ", tech="Java, java|Go")]
    valid, errors = L.normalise_leads(raw(spark, *rows))
    got = {r.row: r for r in valid.collect()}
    assert got[1].lost_reason is None and got[2].lost_reason == "price" and got[2].status == "lost"
    assert {(r.row, r.code) for r in errors.collect()} == {(3, "company_required"), (4, "email_invalid")}
    assert got[5].domain == "b.co.kr" and got[5].bridge_se and got[5].email == "x@y.kr" and got[5].tech == ["Java", "Go"]


def test_funnel(spark):
    moves = [(1, None, "new"), (1, "new", "meeting"), (1, "meeting", "proposal"), (1, "proposal", "won"), (2, None, "contacted"), (2, "contacted", "meeting"),
             (2, "meeting", "lost"), (9, None, "won")]
    start = dt.datetime(2026, 9, 1)
    rows = [(i, lead, a, b, start + dt.timedelta(hours=12 * i)) for i, (lead, a, b) in enumerate(moves)]
    history = spark.createDataFrame(rows, "id bigint, lead_id bigint, from_status string, to_status string, at timestamp_ntz")
    leads = spark.createDataFrame([(1, "won", start), (2, "lost", start)], "id bigint, status string, created_at timestamp_ntz")
    by = {r.stage: r for r in funnel.pipeline_funnel(history, leads).collect()}
    assert by["new"].reached == 2 and by["contacted"].reached == 2 and by["proposal"].reached == 1 and by["won"].reached == 1
    assert by["meeting"].lost == 1 and by["meeting"].conversion == 50 and by["won"].now == 1 and by["won"].conversion is None
    velocity = funnel.sales_velocity(history, leads).first()
    assert velocity.won == 1 and velocity.velocity_days == 1.5
    days = {r.stage: r.avg_days for r in funnel.stage_durations(history, leads, as_of()).collect()}
    assert days["new"] == 0.5 and days["meeting"] == 0.5 and days["negotiation"] is None
    since = {r.id: r for r in funnel.lead_stage_since(leads, history, as_of()).collect()}
    assert since[2].days_in_stage == 11  # 2026-09-04 00:00 to 2026-09-15 12:00, whole days
    empty = history.where("false")
    assert funnel.sales_velocity(empty, leads).first().velocity_days is None
    assert funnel.seed_status_history(leads, empty).count() == 2


def test_duplicates(spark):
    leads = stored(spark, dict(company_name="고래상사", website="https://gorae.co.kr", email="a@gorae.co.kr"), dict(company_name="B", email="b@b.kr"),
                   dict(company_name="b", website="gorae.co.kr"))
    probes = spark.createDataFrame([(1, "고래상사", "", ""), (2, "", "", "https://www.gorae.co.kr/about"), (3, "완전새회사", "new@nowhere.kr", ""),
                                    (4, " B ", "B@b.kr", "http://gorae.co.kr")], "probe_id bigint, company_name string, email string, website string")
    asked, having = L.find_duplicate_leads(probes, leads)
    rows = [(r.probe_id, r.id, L.REASONS.index(r.reason)) for r in asked.join(having, ["reason", "key"]).collect()]
    pairs = {(p, i): L.REASONS[min(n for q, j, n in rows if (q, j) == (p, i))] for p, i, _ in rows}
    assert pairs == {(1, 1): "name", (2, 1): "domain", (2, 3): "domain", (4, 1): "domain", (4, 2): "email", (4, 3): "domain"}
    summary = {r.probe_id: (r.matches, r.reason, r.first_id) for r in L.duplicate_summary(probes, leads).collect()}
    assert summary == {1: (1, "name", 1), 2: (2, "domain", 1), 3: (0, None, None), 4: (3, "domain", 1)}


CSV = ("회사명,담당자명,직급,전화,이메일,유입경로,예산,상태,발주예정\n하늘소프트,조은별,부장,010-9876-5432,star@haneul.kr,전시회,2.5억,미팅,2026-11\n"
       "바다물류,문태오,과장,010-1234-5678,teo@bada.kr,소개,45000000,신규,\n\n,없음,,,,,,,\n")


def test_csv_import(spark, folder):
    with open(f"{folder}/leads.csv", "wb") as f:
        f.write(CSV.encode("cp949"))
    existing = stored(spark, dict(company_name="바다물류", email="Teo@bada.kr"))
    rows = readers.read_leads_csv(spark, f"{folder}/leads.csv").drop("file").cache()
    classified = imports.classify_import(rows, existing)
    report = imports.import_report(classified).first()
    assert (report.total, report.valid, report.duplicates, report.errors, report.inserted) == (3, 1, 1, 1, 0)
    assert [(r.row, r.code) for r in imports.import_errors(classified).collect()] == [(3, "company_required")]
    preview = imports.import_preview(classified).first()
    assert preview.company_name == "하늘소프트" and preview.source == "exhibition"
    new, history, report = imports.import_leads(rows, existing, as_of())
    lead = new.first()
    assert lead.budget == 250_000_000 and lead.status == "meeting" and lead.expected_start == "2026-11" and lead.id == 2
    assert history.first().to_status == "meeting" and report.first().inserted == 1


def test_two_files(spark):
    """Rows of two files with the same number and address are told apart."""
    raw = spark.createDataFrame([("a.csv", 1, {"company": "A", "email": "x@a.kr"}), ("a.csv", 2, {"company": "B", "email": "y@a.kr"}),
                                 ("b.csv", 1, {"company": "A", "email": "X@a.kr"}), ("b.csv", 2, {"company": "C", "email": "z@a.kr"})], "file string, row bigint, raw map<string,string>")
    existing = stored(spark, dict(company_name="Z"))
    new, history, report = imports.import_leads(raw, existing, as_of())
    r = report.first()
    assert (r.total, r.valid, r.duplicates) == (4, 3, 1)
    assert {(x.id, x.company_name) for x in new.collect()} == {(2, "A"), (3, "B"), (5, "C")} and history.count() == 3


@pytest.mark.parametrize("text, sep", [("﻿company;email\nA;a@a.kr\n", ";"), ('company\temail\n"A\nB"\ta@a.kr\n', "\t")])
def test_csv_dialects(spark, folder, text, sep):
    with open(f"{folder}/x.csv", "wb") as f:
        f.write(text.encode())
    rows = readers.read_leads_csv(spark, folder).collect()
    assert len(rows) == 1 and rows[0].raw["email"] == "a@a.kr" and rows[0].raw["company"].startswith("A")


def whole_records(text):
    """Records by one walk over the text."""
    out, now, quoted = [], "", False
    for c in text:
        quoted ^= c == '"'
        if c in "\r\n" and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [r for r in [*out, now] if r.strip(" ")]


@pytest.mark.parametrize("codec", ["utf-8", "utf-8-sig", "cp949"])
def test_csv_in_splits(spark, folder, codec):
    """Files read in many splits give the records of one walk: breaks and quotes inside quotes, blank lines, both kinds of line ends, splits inside a record."""
    rng = random.Random(7)
    files = {}
    for n in range(4):
        rows = ["company,memo"] + [rng.choice(['하늘 {i},x', '"a\r\nb\n\n{i}","q"', '"say ""hi""\n,{i}",y', '', '  ', 'plain {i},"\n"', '"{i}\r한글",z']).format(i=i) for i in range(300)]
        files[f"{folder}/f{n}.csv"] = "".join(r + rng.choice(["\n", "\r\n"]) for r in rows) + ('"never closed\nto the end' if n == 3 else "")
        with open(f"{folder}/f{n}.csv", "wb") as f:
            f.write(files[f"{folder}/f{n}.csv"].encode(codec))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {}
    try:
        for size in ("300b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = readers.file_lines(spark, folder)
            assert size != "300b" or lines.select("file", "block").distinct().count() > 40
            for r in readers.csv_records(lines).orderBy("file", "n").collect():
                got.setdefault((size, os.path.basename(r.file)), []).append(r.record)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for path, text in files.items():
        want = whole_records(text)
        for size in ("300b", "128m"):
            assert [r.rstrip("\n") for r in got[size, os.path.basename(path)]] == [r.rstrip("\n") for r in want]
    content = spark.createDataFrame([(p, bytearray(t.encode(codec))) for p, t in files.items()], "file string, content binary")
    a = readers.leads_from_csv(content).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "row", F.to_json("raw").alias("raw"))
    b = readers.read_leads_csv(spark, folder).select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), "row", F.to_json("raw").alias("raw"))
    assert a.count() > 500 and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_csv_without_rows(spark):
    files = spark.createDataFrame([("a.csv", bytearray(b"")), ("b.csv", bytearray(b"only,header\n")), ("c.csv", bytearray(b"\n\n \n")), ("d.csv", None)], "file string, content binary")
    assert readers.leads_from_csv(files).count() == 0
    assert [(r.file, r.n, r.record) for r in readers.csv_records(readers.content_lines(files)).collect()] == [("b.csv", 1, "only,header")]


def test_json_import(spark, folder):
    files = {"a.json": '[{"company": "LG CNS", "contact": "Park", "tech_stack": "MSA|AWS"}, 5]', "b.json": "{bad",
             "c.json": '{"leads": [{"company": "B", "tech_stack": ["Go", "AI"]}]}', "d.json": '{"company": "D"}', "e.json": '{"leads": [], "data": [{"company": "E"}]}'}
    for name, text in files.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    rows, errors = readers.read_leads_json(spark, folder)
    mapped = imports.map_import_columns(rows.withColumn("row", F.xxhash64("file")))
    typed = {r.company_name: r.tech for r in L.normalise_leads(mapped)[0].collect()}
    assert typed == {"LG CNS": ["MSA", "AWS"], "B": ["Go", "AI"], "D": [], "E": []}
    assert [os.path.basename(r.file) for r in errors.collect()] == ["b.json"]


def test_partial_update(spark):
    leads = stored(spark, STRONG, dict(company_name="B", status="new"))
    payload = spark.createDataFrame([(1, {"phone": "0212345678", "mobile": None}), (2, {"status": "lost", "lost_reason": "price"}), (7, {"memo": "x"})],
                                    "id bigint, payload map<string,string>")
    after, history, errors = updates.write_leads(leads, payload, F.lit("2026-09-16 00:00:00").cast("timestamp_ntz"))
    got = {r.id: r for r in after.collect()}
    assert len(got) == 2 and got[1].phone == "02-1234-5678" and got[1].mobile is None and got[1].tech == [] and got[1].score == 100
    assert got[1].budget == 300_000_000 and got[1].kakao == "k" and got[2].lost_reason == "price"
    assert [(r.lead_id, r.from_status, r.to_status) for r in history.collect()] == [(2, "new", "lost")] and errors.count() == 0
    broken = spark.createDataFrame([(2, {"company_name": ""})], "id bigint, payload map<string,string>")
    after, _, errors = updates.write_leads(leads, broken, as_of())
    assert errors.first().code == "company_required" and after.count() == 2


def test_activities_and_deletes(spark):
    leads = stored(spark, dict(company_name="A", last_contact="2026-05-01"), dict(company_name="B"))
    none = spark.createDataFrame([], "id bigint, lead_id bigint, type string, note string, at date")
    new = spark.createDataFrame([(1, 1, "CALL", " hi ", "2026-04-01"), (2, 2, "visit", None, None), (3, 9, "call", None, None)],
                                "id bigint, lead_id bigint, type string, note string, at string")
    after, acts = L.add_activities(leads, none, new, as_of())
    assert {r.id: str(r.last_contact) for r in after.collect()} == {1: "2026-05-01", 2: "2026-09-15"}
    assert {(r.id, r.type, r.note, str(r["at"])) for r in acts.collect()} == {(1, "call", "hi", "2026-04-01"), (2, "other", None, "2026-09-15")}
    ids = spark.createDataFrame([(1,)], "id bigint")
    history = spark.createDataFrame([(1, "new"), (2, "new")], "lead_id bigint, to_status string")
    assert [df.count() for df in L.delete_leads(after, acts, history, ids)] == [1, 1, 1]
    assert [r.id for r in L.lead_activities(leads, acts).collect()] == [1, 2]


def test_leads_from_scans(spark):
    job = "struct<title:string,description:string>"
    schema = (f"domain string, company struct<name:string,address:string,phone:string,email:string,industry:string,biz_number:string,ceo:string,website:string>, "
              f"key_contacts array<struct<name:string,position:string>>, it_recruitment array<{job}>, it_hiring string")
    scans = spark.createDataFrame([("a.kr", ("A사", "서울 어디로 1", None, None, None, None, "김철수", "https://a.kr/"), [("이영희", "CTO"), ("박민수", "CIO")],
                                    [("Java 백엔드 개발자", "Google Ads Manager"), ("Go 개발자", None)], "Medium")], schema)
    cols = "id bigint, domain string, name string, phone string, email string, industry string, biz_number string, ceo string, website string, it_hiring string"
    companies = spark.createDataFrame([(3, "a.kr", "old", "02-1", "x@a.kr", None, None, None, None, "Low"), (4, "b.kr", None, None, None, None, None, "최고", None, "None")], cols)
    valid, _ = L.normalise_leads(updates.leads_from_scans(companies, scans))
    got = {r.domain: r for r in valid.collect()}
    a, b = got["a.kr"], got["b.kr"]
    assert (a.company_name, a.contact_name, a.rank, a.tech, a.it_hiring, a.company_id) == ("A사", "이영희", "cto", ["Java", "Go"], "Medium", 3)
    assert a.memo == "주소: 서울 어디로 1\n담당자: 박민수 CIO\n채용: Java 백엔드 개발자, Go 개발자" and a.email == "x@a.kr"
    assert (b.company_name, b.contact_name, b.rank, b.memo, b.source) == ("b.kr", "최고", "ceo", None, "scanner")


def test_mail_and_exports(spark, folder):
    leads = stored(spark, dict(company_name="가람랩 - GaramLab", contact_name="이영희", rank="cto", team_size="3", expected_start="2026-11"), dict(company_name="B"))
    drafts = {(r.id, r.kind): r for r in exports.mail_drafts(leads, {"cold": ("[{company}] {tech}", "{contact}\n\n\n{team}{start}{project}\n{signature}")}).collect()}
    assert drafts[1, "cold"].subject == "[가람랩] IT 개발"
    assert drafts[1, "cold"].body == "이영희 CTO님\n\n3명 규모의 2026-11 착수 기준으로 파견·도급·ODC 전담팀\n(서명을 입력하세요)"
    assert drafts[2, "cold"].body.startswith("담당자님\n\n파견")
    writers.export_leads(leads, exports.label_table(spark), f"{folder}/csv")
    parts = [open(f"{folder}/csv/{n}", encoding="utf-8").read() for n in os.listdir(f"{folder}/csv") if n.endswith(".txt")]
    writers.write_csv(leads.where("false").select("company_name"), f"{folder}/none")
    assert [open(f"{folder}/none/{n}", encoding="utf-8").read() for n in os.listdir(f"{folder}/none") if n.endswith(".txt") and os.path.getsize(f"{folder}/none/{n}")] == ['\ufeff"company_name"\n']
    assert all(p.startswith('﻿"company_name"') for p in parts if p) and sum(p.count("GaramLab") for p in parts) == 1
    writers.export_leads(leads, exports.label_table(spark), f"{folder}/json", "json")
    lines = [json.loads(x) for n in os.listdir(f"{folder}/json") if n.endswith(".json") for x in open(f"{folder}/json/{n}", encoding="utf-8")]
    assert {x["company_name"] for x in lines} == {"가람랩 - GaramLab", "B"} and "memo" in lines[0]


def test_labels(spark):
    df = spark.createDataFrame([("won", "cto"), ("x", None)], "status string, rank string")
    out = exports.label_codes(df, exports.label_table(spark), "vi", {"status": "status", "rank": "rank"}).collect()
    assert {(r.status, r.rank) for r in out} == {("Thắng thầu", "CTO"), ("x", None)}
