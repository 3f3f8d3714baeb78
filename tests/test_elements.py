"""Element nesting, openings and footers on nested and broken pages."""
import random
import re

import pytest
from pyspark.sql import functions as F

from leadloom.functions import html as H
from leadloom.operators import elements, jobs

NAMES = ("div", "article", "ul", "li", "table", "tr", "td", "h2", "a", "strong")


def brute(page):
    """{open: (name, end, box_open, box_end)} by comparing every tag with every other."""
    tags = [(i, m[1].lower(), bool(m[0].startswith("</"))) for i, m in enumerate(re.finditer(r"(?is)</?(" + "|".join(NAMES) + r")(?=[\s/>])[^>]*>", page), 1)]
    last = len(tags) + 1
    family = lambda n: elements.FAMILIES.get(n, n)
    found = {}
    for i, name, close in tags:
        if close or name in elements.ITEMS:
            continue
        depth, end = 1, last
        for j, other, shut in tags:
            if j > i and family(other) == family(name) and other not in elements.ITEMS:
                depth += -1 if shut else 1
                if depth == 0:
                    end = j
                    break
        found[i] = (name, end)
    scopes = dict(found)
    scope_of = lambda i, f: max((o for o, (n, e) in scopes.items() if family(n) == f and n not in elements.ITEMS and o < i < e), default=0)
    for i, name, close in tags:
        if close or name not in elements.ITEMS:
            continue
        f = family(name)
        scope = scope_of(i, f) if f in ("list", "table") else 0
        enders = ("tr",) if name == "tr" else {n for n in elements.ITEMS if family(n) == f}
        nexts = [j for j, other, _ in tags if j > i and other in enders and (f not in ("list", "table") or scope_of(j, f) == scope)]
        found[i] = (name, min([*nexts, scopes[scope][1] if scope else last, last]))
    out = {}
    for i, (name, end) in found.items():
        box = max(((o, e) for o, (n, e) in found.items() if n in jobs.BOXES and o < i < e), default=(None, None))
        out[i] = (name, end, *box)
    return out


def soup(rng):
    """Tags in any order, mostly closed again."""
    out, stack = [], []
    for _ in range(rng.randrange(1, 60)):
        if stack and rng.random() < 0.45:
            out.append(f"</{stack.pop(rng.choice([-1, -1, -1, 0]))}>")
        elif rng.random() < 0.1:
            out.append(f"</{rng.choice(NAMES)}>")
        else:
            stack.append(rng.choice(NAMES))
            out.append(rng.choice(["<{}>", "<{} class='x'>", "<{}\n>"]).format(stack[-1].upper() if rng.random() < 0.1 else stack[-1]))
        out.append(rng.choice(["", "text", " <b>x</b> ", "<br>"]))
    return "".join(out)


def test_spans_and_boxes(spark):
    rng = random.Random(8)
    pages = [(f"d{i % 7}", i, soup(rng)) for i in range(400)] + [(None, None, "<div><li>x</div>"), ("d", 1000, None), ("d", 1001, ""), ("d", 1002, "no tags")]
    df = spark.createDataFrame(pages, "domain string, page_idx long, html string")
    key = ("domain", "page_idx")
    got = {}
    for r in elements.nearest(elements.spans(df, key, F.col("html"), NAMES), key, jobs.BOXES).collect():
        assert r.open not in got.setdefault(r.page_idx, {})
        got[r.page_idx][r.open] = (r.name, r.end, r.box_open, r.box_end)
    assert got == {i: b for _, i, h in pages if h and (b := brute(h))}


def openings(spark, html):
    df = spark.createDataFrame([("x.co.kr", 1, "https://x.co.kr/recruit", "recruitment", html)], "domain string, page_idx long, final_url string, category string, html string")
    return [(r.phase, r.title, r.context, r.source_url) for r in jobs.job_candidates(df).orderBy("seq").collect()]


@pytest.mark.parametrize("html, expected", [
    # the nearest box lends all its text, nested boxes before and after the entry too
    ('<div>채용 공고<div><b>정규직</b></div><a href="/jobs/7">자바 개발자</a><div>마감일: 2026-05-01</div></div>',
     [(1, "자바 개발자", "채용 공고 정규직 자바 개발자 마감일: 2026-05-01", "https://x.co.kr/jobs/7")]),
    # a list entry without an end tag ends at the next entry of its own list
    ("<ul><li><h3>자바 개발자</h3> 정규직<ul><li>서울</li></ul><li>데이터 엔지니어 채용 계약직</ul>",
     [(2, "자바 개발자 정규직 서울", "자바 개발자 정규직 서울", None), (2, "자바 개발자", "자바 개발자 정규직 서울", None), (2, "데이터 엔지니어 채용 계약직", "데이터 엔지니어 채용 계약직", None)]),
    # a row's cells; an entry in a list has the box around the list entry
    ("<table><tr><td>자바 개발자 채용<td>정규직<tr><td>총무</table>", [(2, "자바 개발자 채용", "자바 개발자 채용 정규직", None)]),
    ("<div>정규직 모집<ul><li>자바 개발자</li></ul></div>", [(2, "자바 개발자", "정규직 모집 자바 개발자", None)]),
    # a stray end tag changes nothing, an article without an end tag reaches to the end of the page
    ("</div><article>정규직 <h2>자바 개발자 채용</h2> 서울", [(2, "자바 개발자 채용", "정규직 자바 개발자 채용 서울", None)]),
])
def test_context_of_an_opening(spark, html, expected):
    assert openings(spark, html) == [(p, t, c, u or "https://x.co.kr/recruit") for p, t, c, u in expected]


@pytest.mark.parametrize("html, blocks", [
    ("<footer>a<footer>b</footer>c</footer>d", ["<footer>a<footer>b</footer>c"]),
    ("<div class='site-footer'><div>a</div><address>b</address>c</div><address>d</address><footer>e</footer>",
     ["<footer>e", "<div class='site-footer'><div>a</div><address>b</address>c", "<address>d"]),
    ("<section id=\"footer\">a<section>b</section><br class='footer'>c", ["<section id=\"footer\">a<section>b</section><br class='footer'>c"]),
    ("</footer>x<footer>a</footer><img class='footer'>", ["<footer>a"]),
    ("<p>no block</p>", []), ("", []), (None, []),
])
def test_footers_are_the_outermost_blocks(spark, html, blocks):
    df = spark.createDataFrame([(html,)], "html string")
    assert (df.select(H.footer_blocks(F.col("html")).alias("b")).first().b or []) == blocks


def test_boxes_of_entries(spark):
    """Asked for some elements only, and only of families on their page, the answers are the same."""
    rng = random.Random(9)
    pages = [("d", i, soup(rng)) for i in range(150)] + [("d", 150, "<a>x</a><h2>y</h2>")]
    key = ("domain", "page_idx")
    found = elements.spans(spark.createDataFrame(pages, "domain string, page_idx long, html string"), key, F.col("html"), NAMES)
    some = ("a", "li", "h2")
    rows = lambda df: {(r.page_idx, r.name, r.open, r.end, r.box_open, r.box_end) for r in df.collect()}
    every = rows(elements.nearest(found, key, jobs.BOXES))
    assert rows(elements.nearest(found, key, jobs.BOXES, some, NAMES)) == {r for r in every if r[1] in some}
    assert {r[1] for r in every} == set(NAMES)
