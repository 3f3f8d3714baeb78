"""Readers, saves, scan history and streams."""
import datetime as dt
import os

import pytest
from pyspark.sql import Row

from leadloom.operators import scans as S
from leadloom.sources import readers
from leadloom.streaming import streams

TEXT = "<html><head>{meta}</head><body>우리회사 대표이사 홍길동</body></html>"
SAVE = ("seq bigint, scanned_at timestamp, scanned_url string, company struct<name:string,address:string,phone:string,email:string,industry:string,biz_number:string,"
        "ceo:string,website:string>, key_contacts array<string>, it_recruitment array<string>, it_hiring string")


def save(seq, day, site, jobs, phone="02-1", url=None):
    company = (site, None, phone, None, None, None, None, f"https://www.{site}/" if site else None)
    return (seq, dt.datetime(2026, 1, day), url or "", company, [], ["j"] * jobs, None)


@pytest.mark.parametrize("codec, meta, header", [("utf-8", "<meta charset=utf-8>", None), ("cp949", "<meta charset='euc-kr'>", None),
                                                 ("cp949", '<meta content="text/html; charset=ks_c_5601-1987">', None), ("cp949", "", "text/html; charset=EUC-KR"), ("cp949", "", None)])
def test_decode(spark, codec, meta, header):
    df = spark.createDataFrame([(bytearray(TEXT.format(meta=meta).encode(codec)), header)], "content binary, content_type string")
    assert "우리회사 대표이사 홍길동" in readers.decode_pages(df, "content_type").first().html


@pytest.mark.parametrize("text, codec", [("한글 회사 대표이사 홍길동", "cp949"), ("Café für Größe", "iso-8859-1")])
def test_decode_under_a_western_header(spark, text, codec):
    """Korean bytes read as Latin letters are damage; true Latin text is not."""
    df = spark.createDataFrame([(bytearray(text.encode(codec)), "text/html; charset=ISO-8859-1")], "content binary, content_type string")
    assert readers.decode_pages(df, "content_type").first().html == text


@pytest.mark.parametrize("text, codec", [("schäßpf " * 40 + "Ción", "iso-8859-1"), ("üß " * 5, "iso-8859-1"), ("株式會社 우리회사 大韓民國", "cp949")])
def test_decode_pairs_of_accents_under_a_western_header(spark, text, codec):
    """Pairs of accented letters are no Korean, even where few other accents stand beside them."""
    df = spark.createDataFrame([(bytearray(text.encode(codec)), "text/html; charset=ISO-8859-1")], "content binary, content_type string")
    assert readers.decode_pages(df, "content_type").first().html == text


def test_page_files(spark, folder):
    with open(f"{folder}/a.html", "wb") as f:
        f.write(TEXT.format(meta="").encode("cp949"))
    assert "홍길동" in readers.decode_pages(readers.read_page_files(spark, folder)).first().html


def test_url_lists(spark, folder):
    df = spark.createDataFrame([(0, "https://A.kr/ , b.kr;#c.kr"), (1, "http://a.kr\tB.KR/ d.kr/x")], "line bigint, value string")
    assert [r.url for r in readers.read_url_list(df).collect()] == ["https://A.kr/", "b.kr", "d.kr/x"]
    assert len(readers.read_url_list(df, cap=2).collect()) == 2
    text = spark.createDataFrame([(0, 'name,site\nA,"https://a.co.kr/x?y",b.kr')], "line bigint, value string")
    assert [r.url for r in readers.read_url_list(text, sniff=True).collect()] == ["https://a.co.kr/x?y", "b.kr"]
    with open(f"{folder}/u.txt", "w") as f:
        f.write("a.kr\n\n#no\n a.kr \n")
    assert readers.read_url_file(spark, f"{folder}/u.txt").count() == 2


def test_sitemaps(spark):
    loc = lambda *u: "".join(f"<loc> {x}</loc>" for x in u)
    rows = [("a.kr", "https://a.kr/sitemap.xml", "<sitemapindex>" + loc("https://a.kr/en-sitemap.xml", "https://a.kr/ko-sitemap.xml", "https://a.kr/s3.xml") + "</sitemapindex>", True),
            ("a.kr", "https://a.kr/en-sitemap.xml", loc("https://a.kr/en/jobs"), False), ("a.kr", "https://a.kr/ko-sitemap.xml", loc("https://a.kr/1", "https://a.kr/2", "https://a.kr/3"), False),
            ("a.kr", "https://a.kr/s3.xml", loc("https://a.kr/9"), False), ("a.kr", "https://a.kr/unlisted.xml", loc("https://a.kr/0"), False)]
    df = spark.createDataFrame(rows, "domain string, sitemap_url string, body string, root boolean")
    got = readers.read_sitemaps(df, max_files=3, max_locs=3).orderBy("file_no", "pos").collect()
    assert [r.url for r in got] == ["https://a.kr/1", "https://a.kr/2", "https://a.kr/3", "https://a.kr/9"]


def test_saves(spark):
    first = spark.createDataFrame([save(1, 1, "a.co.kr", 2), save(2, 1, "b.kr", 1), save(3, 1, None, 1, url="https://sub.c.kr/x"), save(4, 1, None, 1)], SAVE)
    companies = S.upsert_companies(None, S.scan_rows(first))
    assert {r.domain for r in companies.collect()} == {"a.co.kr", "b.kr", "c.kr"}
    again = spark.createDataFrame([save(5, 2, "a.co.kr", 5, phone=None)], SAVE)
    after = {r.domain: r for r in S.upsert_companies(companies, S.scan_rows(again)).collect()}
    a = after["a.co.kr"]
    assert len(after) == 3 and a.id == 1 and a.phone is None and a.it_jobs == 5 and a.created_at.day == 1 and a.updated_at.day == 2
    history = S.append_scan_history(S.scan_rows(first.unionByName(again)))
    trend = {r.domain: (r.prev_it_jobs, r.jobs_delta) for r in S.company_trend(S.upsert_companies(companies, S.scan_rows(again)), history).collect()}
    assert trend == {"a.co.kr": (2, 3), "b.kr": (None, None), "c.kr": (None, None)}
    assert [r.it_jobs for r in S.scan_history_top(history).where("domain = 'a.co.kr'").orderBy("rn").collect()] == [5, 2]


def test_stream_saves_equal_batch_saves(spark, folder):
    batches = [[save(1, 1, "a.kr", 2), save(2, 1, "b.kr", 1)], [save(3, 2, "a.kr", 5, phone=None)], [save(4, 3, "c.kr", 1), save(5, 4, "a.kr", 4)]]
    target = f"{folder}/tables"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SAVE).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(spark.createDataFrame([], SAVE).schema).parquet(f"{folder}/in")
        streams.stream_company_upsert(stream, target, f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], SAVE)
    strip = lambda df: sorted(map(str, df.drop("result").select(sorted(c for c in df.columns if c != "result")).collect()))
    assert strip(streams.read_companies(spark, target)) == strip(S.upsert_companies(None, S.scan_rows(every)))
    assert streams.read_history(spark, target).count() == 5


def history_stream(spark, folder, rows, schema):
    for i, r in enumerate(rows):
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in{i}")
    spark.createDataFrame([x for r in rows for x in r], schema).coalesce(1).write.parquet(f"{folder}/all")
    return spark.readStream.schema(schema).parquet(f"{folder}/all")


def run(spark, df, name, mode, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_delta_with_late_scans(spark, folder):
    """After every batch the table equals the newest two scans of all rows so far, whatever order they came in."""
    schema = "domain string, id bigint, scanned_at timestamp, it_jobs bigint"
    day = lambda n: dt.datetime(2026, 1, n)
    batches = [[("a", 1, day(5), 2), ("b", 2, day(1), 4)], [("a", 3, day(9), 7), ("b", 4, day(3), 1)], [("a", 5, day(7), 4), ("b", 6, day(2), 9), ("c", 7, day(1), 1)], [("a", 8, day(1), 50)]]
    seen = []
    for rows in batches:
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        streams.stream_jobs_delta(stream, f"{folder}/delta", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
        want = {}
        for d in {r[0] for r in seen}:
            newest = sorted((r[2], r[1], r[3]) for r in seen if r[0] == d)[-2:]
            want[d] = (newest[-1][1], newest[-1][2] - newest[0][2] if len(newest) > 1 else None)
        assert {r.domain: (r.id, r.jobs_delta) for r in streams.read_jobs_delta(spark, f"{folder}/delta").collect()} == want
    alerts = lambda: sorted((r.batch, r.domain, r.id, r.jobs_delta) for r in streams.read_rising_alerts(spark, f"{folder}/delta").collect())
    state = lambda: sorted(map(str, streams.read_jobs_delta(spark, f"{folder}/delta").collect()))
    before = alerts(), state()
    assert before[0] == [(1, "a", 3, 5)]        # the late scan in between changes the difference, but the newest scan has had its alert
    for name in ("3", ".3.crc"):                # the last batch was not committed: it comes again
        os.remove(f"{folder}/cp/commits/{name}")
    streams.stream_jobs_delta(stream, f"{folder}/delta", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert (alerts(), state()) == before
    spark.createDataFrame([("b", 9, day(8), 30), ("b", 9, day(8), 30)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    streams.stream_jobs_delta(stream, f"{folder}/delta", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    assert alerts() == [*before[0], (4, "b", 9, 29)]


def test_newest_two_work_on_rows():
    """A key's scans come as rows, however many, and its state is read once and written only when it changes."""
    calls = []

    class Scans:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    two = streams.NewestTwo()
    two.scans = Scans()
    given = lambda *scans: [tuple(r) for r in two.handleInputRows(("a",), (Row(at=t, id=i, it_jobs=n) for t, i, n in scans), None)]
    assert given((5, 1, 2), (9, 3, 7), (7, 5, 4), (9, 3, 7)) == [("a", 9, 3, 7, 7, 5, 4, True)]
    assert given((1, 8, 50)) == [] and given((8, 9, 6)) == [("a", 9, 3, 7, 8, 9, 6, False)]
    assert calls == ["get", "update", "get", "get", "update"]


def test_log_is_merged(spark, folder):
    """Folders stay few over many batches, also when batches and merges come twice; the newest row of a key counts."""
    want = {}
    for n in range(23):
        rows = [(k, n * 10 + k) for k in range(n % 5, 5)]
        for _ in range(2 if n % 4 in (0, 3) else 1):
            streams.append_log(spark.createDataFrame(rows, "k int, v int"), f"{folder}/log", n, "k", every=4)
        want.update(dict(rows))
        assert len(os.listdir(f"{folder}/log")) <= 6
    assert {r.k: r.v for r in streams.read_log(spark, f"{folder}/log", "k").collect()} == want
    assert streams.read_log(spark, f"{folder}/none", "k") is None


def test_stream_stage_and_dedupe(spark, folder):
    schema = "id bigint, lead_id bigint, to_status string, at timestamp"
    rows = [[(1, 1, "new", dt.datetime(2026, 1, 1)), (2, 2, "new", dt.datetime(2026, 1, 1))], [(3, 1, "won", dt.datetime(2026, 1, 2))]]
    stream = history_stream(spark, folder, rows, schema)
    got = {r.lead_id: r.status for r in run(spark, streams.stream_stage_state(stream), "stage", "complete", folder).collect()}
    assert got == {1: "won", 2: "new"}
    schema = "fetched_at timestamp, domain string, final_url string, text string"
    rows = [[(dt.datetime(2026, 1, 1, i), "a.kr", u, t) for i, (u, t) in enumerate([("https://a.kr/x", "x" * 300), ("https://www.a.kr/x/", "y" * 300), ("https://a.kr/z", "x" * 300)])]]
    stream = history_stream(spark, f"{folder}/d", rows, schema)
    assert run(spark, streams.stream_dedupe(stream, "2 days"), "urls", "append", f"{folder}/d1").count() == 2
    assert run(spark, streams.stream_dedupe(stream, "2 days", by="content"), "texts", "append", f"{folder}/d2").count() == 2
