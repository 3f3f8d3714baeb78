"""Scan results of large domains: parts, written tables, no row that holds a domain whole."""
import pytest
from pyspark.sql import functions as F

from leadloom.operators import rounds, updates
from leadloom.operators.pages import build_pages
from leadloom.operators.results import scan_result

NAMES = "김이박최정강조윤장임"


def hot_site(spark, n):
    """A domain with n pages, each with a person and an opening of its own, beside a small one."""
    rows = spark.range(n).select(
        F.lit("big.co.kr").alias("domain"), F.col("id").alias("page_idx"), F.concat(F.lit("https://big.co.kr/recruit/"), F.col("id").cast("string")).alias("final_url"),
        F.when(F.col("id") == 0, "home").otherwise("recruitment").alias("category"),
        F.concat(F.lit("<html><title>빅컴퍼니</title><body><div>정규직 <h2>자바 개발자 채용 "), F.col("id").cast("string"), F.lit("호</h2></div><p>CTO Ann"),
                 F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" Park</p><footer>전화: 02-1234-5678</footer></body></html>")).alias("html"))
    small = spark.createDataFrame([("small.kr", 0, "https://small.kr/", "home", "<html><title>스몰</title><footer>전화: 02-9999-0000</footer></html>")], "domain string, page_idx long, final_url string, category string, html string")
    return build_pages(rows.unionByName(small).withColumn("url", F.col("final_url")).withColumn("status", F.lit(200)).withColumn("depth", F.lit(0)))


N = 260


@pytest.fixture(scope="module")
def scans(spark):
    """The results of one row a domain, and those in parts of 100."""
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    found = scan_result(hot_site(spark, N)), scan_result(hot_site(spark, N), part=100)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before      # pages are not held by the executors
    return found


def test_a_large_domain_comes_in_parts(scans):
    whole = {r.domain: r for r in scans[0].collect()}
    assert set(whole) == {"big.co.kr", "small.kr"} and len(whole["big.co.kr"].sources) == N and whole["big.co.kr"].pages_crawled == N
    assert len(whole["big.co.kr"].it_recruitment) == N - 1 and whole["big.co.kr"].company.phone == "02-1234-5678" and whole["small.kr"].it_hiring == "None"
    parts = scans[1].orderBy("domain", "part").collect()
    assert [(r.domain, r.part) for r in parts] == [("big.co.kr", i) for i in range(3)] + [("small.kr", 0)]
    assert all(len(x) <= 100 for r in parts for x in (r.sources, r.key_contacts, r.it_recruitment))
    for field in ("sources", "key_contacts", "it_recruitment"):
        assert [x for r in parts if r.domain == "big.co.kr" for x in r[field]] == whole["big.co.kr"][field]
    assert parts[0].company == whole["big.co.kr"].company and all(r.company is None for r in parts[1:3])


def test_leads_read_all_parts(spark, scans):
    saved = spark.createDataFrame([(1, "big.co.kr"), (2, "none.kr")], "id long, domain string")
    saved = saved.withColumns({c: F.lit(None).cast("string") for c in ("name", "website", "industry", "biz_number", "ceo", "phone", "email", "it_hiring")})
    whole, parts = ({r.domain: r.memo for r in updates.leads_from_scans(saved, s).collect()} for s in scans)
    assert whole == parts and whole["big.co.kr"].count("호") == N - 1 and whole["none.kr"] is None


def test_written_tables_go(spark):
    table = rounds.written(spark.range(3), "gone")
    path = table.inputFiles()[0]
    rounds.release(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    assert not hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop.Path(path))
