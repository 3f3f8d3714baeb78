"""Scalar semantics on literal rows."""
import pytest
from pyspark.sql import functions as F

from leadloom.functions import columns as N
from leadloom.functions import urls as U
from leadloom.functions.text import label_value, tidy, unescape_html
from leadloom.operators import facts, jobs, links, pages, people, scans


def values(spark, inputs, expr):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_registrable_domain(spark):
    assert values(spark, ["www.company-a.co.kr", "shop.example.com", "a.b.c.example.com", "co.kr", "localhost", ""], U.registrable) == [
        "company-a.co.kr", "example.com", "example.com", "co.kr", "localhost", ""]


def test_same_domain(spark):
    urls = ["https://recruit.company-a.co.kr/jobs", "https://company-b.co.kr", "https://company-a.co.kr.evil.com", "https://blog.naver.com/company-a"]
    df = spark.createDataFrame([(u, "company-a.co.kr") for u in urls], "url string, domain string")
    assert [r.url for r in links.same_domain(df).collect()] == urls[:1]


@pytest.mark.parametrize("url, anchor, expected", [
    ("https://x.co.kr/recruit/list", "채용공고", "recruitment"), ("https://x.co.kr/about", "회사소개", "company"),
    ("https://x.co.kr/contact", "오시는길", "contact"), ("https://x.co.kr/products/a", "제품", None),
    ("https://x.co.kr/process-management", "", None), ("https://x.co.kr/team.html", "", "management"),
    ("https://x.co.kr/board.php?bo_table=recruit01", "", "recruitment"),
    ("https://x.co.kr/p", "a very long article title about careers in IT", None)])
def test_link_category(spark, url, anchor, expected):
    df = spark.createDataFrame([(url, anchor)], "url string, anchor string")
    assert df.select(links.category_of(F.col("url"), F.col("anchor"))).first()[0] == expected


@pytest.mark.parametrize("base, href, expected", [
    ("https://x.co.kr/", "mailto:a@b.c", None), ("https://x.co.kr/", "/files/brochure.pdf", None),
    ("https://x.co.kr/a/b", "../c", "https://x.co.kr/c"), ("https://x.co.kr/a/b", "c?d=1#e", "https://x.co.kr/a/c?d=1"),
    ("https://x.co.kr/a/b/", "./../c/", "https://x.co.kr/a/c/"), ("https://x.co.kr", "c", "https://x.co.kr/c"),
    ("https://x.co.kr/a/b", "..", "https://x.co.kr/"), ("https://x.co.kr/a?q=1", "?p=2", "https://x.co.kr/a?p=2"),
    ("https://x.co.kr/a", "//y.kr", "https://y.kr/"), ("https://x.co.kr/", "/login/x", None),
    ("https://x.co.kr/", "javascript:void(0)", None), ("https://x.co.kr/a/b", "../../../c", "https://x.co.kr/c")])
def test_clean_links(spark, base, href, expected):
    df = spark.createDataFrame([(base, href)], "base_url string, href string")
    assert [r.url for r in links.clean_links(df).collect()] == ([expected] if expected else [])


def test_admissible_urls(spark):
    bad = ["http://localhost", "http://127.0.0.1", "http://0.0.0.0", "http://169.254.169.254", "http://192.168.0.1", "http://10.1.2.3",
           "http://[::1]", "file:///etc/passwd", "ftp://example.com", "http://example.com:22", "", "http://[fe80::1]", "http://[2001:db8::1]",
           "http://[::ffff:10.0.0.1]", "http://224.0.0.1"]
    good = ["company.co.kr", "https://x.kr:8443/a?b#c", "http://8.8.8.8", "http://[2400:cb00::1]/", "http://[::ffff:8.8.8.8]/"]
    df = spark.createDataFrame([(u,) for u in bad + good], "url string")
    out = {r.url: r for r in links.admissible_urls(df).collect()}
    assert [u for u in bad if out[u].ok] == [] and [u for u in good if not out[u].ok] == []
    assert out["company.co.kr"].normal_url == "https://company.co.kr/" and out[good[1]].normal_url == "https://x.kr:8443/a?b"


def test_names(spark):
    good = ["홍길동", "박 한", "김 민 수", "남궁철수", "John Smith"]
    bad = ["플랫폼", "이사가", "공지사항", "변경", "About Us", "현신균\n끝", ""]
    assert values(spark, good + bad, facts.is_plausible_name) == [True] * 5 + [False] * 7


def test_emails(spark):
    mails = ["info@test.co.kr", "hr@jobs.test.co.kr", "test.company@naver.com", "nwngm@aitimes.kr"]
    assert values(spark, mails, lambda c: facts.belongs_to_company(c, F.lit("test.co.kr"))) == [True, True, True, False]
    assert values(spark, ["logo@2x.png", "noreply@test.co.kr", "a@b@c.kr", "a@.kr", "ok@test.co.kr"], facts.is_usable_email) == [False] * 4 + [True]


def test_protected_mail(spark):
    codes = ["365950505f55537659585758525b531855595b", "zzzz", "", "2f464149406f5b4a5c5b014c4001445d"]
    assert values(spark, codes, facts.decoded_cf) == ["office@onandme.com", None, None, "info@test.co.kr"]


def test_scan_phone(spark):
    phones = ["+82-2-564-8525", "+82-10-2222-3333", "031-999-8888", "1588-1234", "1997-2019"]
    assert values(spark, phones, N.scan_phone) == ["02-564-8525", "010-2222-3333", "031-999-8888", "1588-1234", ""]


def test_phone_choice(spark):
    texts = ["팩스 02-111-2222 전화 02-333-4444", "fax: 02-111-2222\n010-1234-5678 / 031-222-3333", "2010-2019 2000", "Fax 02-111-2222",
             "010-1234-5678", "tel. 1588-1234"]
    assert values(spark, texts, facts.phone_of) == ["02-333-4444", "031-222-3333", None, None, "010-1234-5678", "1588-1234"]


def test_addresses(spark):
    assert values(spark, ["서울 강남구 논현로 34", "서울특별시 강남구 논현로 34, 썬테크빌딩 5층", "세종시 한누리대로 219, 4층"], facts.place_key)[:2] == ["서울강남구논현로"] * 2
    texts = ["3F, 6 Jeongjail-ro 156beon-gil, Bundang-gu, Seongnam-si, Gyeonggi-do, Korea",
             "4303, Ask Shaikh Ali Al Hamad As Salihi Street, Al Nakheel District"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert facts.in_country(df).count() == 1


def test_jobs(spark):
    assert values(spark, ["백엔드 개발자 채용", "영업사원 모집", "회계 담당자 채용", "retail detail"], jobs.is_it_job) == [True, False, False, False]
    assert values(spark, ["백엔드 개발자 모집", "AI Infra", "Company 회사소개 연혁 CI/BI 수상 인증 인재채용 지속가능경영 제품 고객"],
                  lambda c: jobs.is_posting(c, F.lit(""))) == [True, False, False]
    assert [scans.signal_of(F.lit(n)) is not None for n in (5, 3, 1, 0)] and values(
        spark, ["5", "3", "1", "0"], lambda c: scans.signal_of(c.cast("int"))) == ["High", "Medium", "Low", "None"]


def test_title_rank(spark):
    df = spark.createDataFrame([("Director of Sales",), ("CTO / 연구소장",), ("국가대표 선수",), ("대표 홍길동",)], "title string")
    assert [r.title_group for r in people.title_rank(df).collect()] == [None, "CTO", None, "CEO"]


def test_lead_values(spark):
    assert values(spark, ["부사장 겸 CTO", "대표이사", "Director of Engineering", "담당", "", "ceo"], N.rank_code) == ["cto", "ceo", "director", "other", None, "ceo"]
    assert values(spark, ["₩ 1억 5000만", "2.5억", "150,000,000", "abc", "", "2.7"], N.budget) == [150_000_000, 250_000_000, 150_000_000, None, None, 2]
    assert values(spark, ["+82-2-1234-5678", "01012345678", "1588-1234", "0311234567"], N.lead_phone) == ["02-1234-5678", "010-1234-5678", "1588-1234", "031-123-4567"]
    assert values(spark, ["1208112345", "120 81 12345", "12"], N.biz_number) == ["120-81-12345", "120-81-12345", "12"]
    assert values(spark, ["2026년 11월", "2026-11-05", "11월", "2026-13"], N.year_month) == ["2026-11", "2026-11", None, None]
    assert [str(x) for x in values(spark, ["2026-1-5", "2026.01.05", "05/01/2026", "20260105", "2026-02-30", "soon", "2026-01-05T10:00"], N.iso_date)] == [
        "2026-01-05"] * 4 + ["None", "None", "2026-01-05"]
    assert values(spark, ['["MSA", " AWS ", "aws"]', "Java|java;Go/ C#", "", None], N.tech_list) == [["MSA", "AWS"], ["Java", "Go", "C#"], [], []]
    assert values(spark, ["12.7", "1,200", "x", "-3", None], N.whole_number) == [12, 1200, None, -3, None]


def test_money_text(spark):
    v = ["250000000", "300000000", "50000000", "900", "0", None, "1200000000"]
    assert values(spark, v, lambda c: N.format_krw(c.cast("bigint"))) == ["₩ 2.5억", "₩ 3억", "₩ 5,000만", "₩ 900", "", "", "₩ 12억"]
    assert values(spark, v, lambda c: N.format_krw(c.cast("bigint"), "vi")) == ["250 triệu ₩", "300 triệu ₩", "50 triệu ₩", "900 ₩", "", "", "1,2 tỷ ₩"]


def test_text_helpers(spark):
    assert values(spark, [" · a \n b | "], tidy) == ["a b"]
    assert values(spark, ["&lt;a&gt; &amp;lt; &#54861;&#x2014;&nbsp;", "x&#39;y&amp;amp;"], unescape_html) == ["<a> &lt; 홍— ", "x'y&amp;"]
    assert values(spark, ["상호 : (주)A | 대표 : B", "상호명：  \n 회사명 : C사", "none"], lambda c: label_value(c, ("상호명", "상호", "회사명"))) == [
        "(주)A", "회사명 : C사", None]


def test_page_text(spark):
    html = ("<!DOCTYPE html><html><head><title> T &amp; U </title><style>p{}</style><script>if (a<b) x('</p>');</script></head>"
            "<body><!-- c --><p>One <b>two</b>  </p><noscript>no</noscript><p>three\n four</p><svg><text>s</text></svg></body></html>")
    df = spark.createDataFrame([(html,)], "html string")
    row = pages.build_pages(df).first()
    assert row.text == "T & U\nOne\ntwo\nthree\n four" and row.title == "T & U"


def test_links_and_entities_are_read_once(spark):
    """A link's address is found once, however many parts are taken from it, and texts without an ampersand pass the list of entities by."""
    df = spark.createDataFrame([("https://a.kr/x/y", " ../b?q=1#z ")], "base string, href string")
    link = df.select(U.cleaned_link("base", F.regexp_replace("href", "never", "")).alias("v"))
    assert link.first().v == "https://a.kr/b?q=1"
    assert link._jdf.queryExecution().optimizedPlan().toString().count("never") == 1
    assert "Contains" in (plan := df.select(unescape_html(F.col("href")))._jdf.queryExecution().optimizedPlan().toString()) or "contains(" in plan.lower()
    assert values(spark, ["a & b", "&lt;&#65;&amp;lt;", "plain", None], unescape_html) == ["a & b", "<A&lt;", "plain", None]
    assert values(spark, ["팩스: 02-111-2222 전화: 02-333-4444", "Fax 02-111-2222", "TEL 031-555-6666", "none"], facts.phone_of) == ["02-333-4444", None, "031-555-6666", None]


def test_guards_of_tokens(spark):
    """A guard says what its pattern says; that of a whole page never misses a token."""
    from leadloom.functions import fixed
    from leadloom.functions import text as X
    tokens = [t for _, words in fixed.TITLE_GROUPS for t in words] + list(fixed.ADDRESS_LABELS) + ["k s"]
    odd = ["", None, "plain", "대표\n이사", "it\n책임자", "대 표", *[s for t in tokens for s in (t, t.upper(), f"x{t}y", t.replace("s", "ſ").replace("k", "K"), t.replace("i", "İ"), t.replace("i", "ı"))]]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for part in (tokens, fixed.ADDRESS_LABELS, fixed.KOREAN_REGIONS, ["CTO", "cto"], ["cto/연구소장", "연구소장"]):
        rows = df.select("t", F.col("t").rlike("(?iU)" + X.any_of(part)).alias("want"), X.names_any(F.col("t"), part).alias("got"), X.may_name(F.col("t"), part).alias("may")).collect()
        assert all(r.got == r.want and (r.may or not r.want) for r in rows), [r for r in rows if r.got != r.want or (r.want and not r.may)]
    assert not df.where(X.may_name(F.col("t"), ("ceo",)) & (F.col("t") == "plain")).count()


def test_costly_values_are_computed_once(spark):
    df = spark.createDataFrame([("a",)], "t string")
    for value, part in ((label_value(F.col("t"), ("주소",)), "regexp_extract("), (facts.keywords_found(F.col("t"), ("abc", "b")), "array_join("), (jobs.deadline(F.col("t")), "regexp_extract(")):
        plan = df.select(F.when(F.col("t") != "", value).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(part) == 1, plan
