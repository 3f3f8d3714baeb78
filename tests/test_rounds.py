"""Breadth-first rounds against a walk over the edges."""
import random

import pytest

from leadloom.operators import links, rounds
from leadloom.operators.rounds import distances
from leadloom.sources import readers

EDGES = "domain string, source string, target string, place int"


def walked(starts, edges, most=None):
    out = {}
    for domain in {d for d, _ in starts}:
        level, n = {s: None for d, s in starts if d == domain and s is not None}, 0
        while level:
            out.update({(domain, node): (n, place) for node, place in level.items()})
            if most is not None and n == most:
                break
            n += 1
            after = {}
            for d, a, b, place in edges:
                if d == domain and a in level and b is not None and (domain, b) not in out:
                    after[b] = min(after.get(b, place), place)
            level = after
    return out


@pytest.mark.parametrize("most", [None, 0, 2])
def test_distances(spark, most):
    rng = random.Random(2)
    edges = [(f"d{rng.randrange(3)}", f"p{rng.randrange(60)}", f"p{rng.randrange(60)}", rng.randrange(5)) for _ in range(130)]
    edges += [("d0", f"q{i}", f"q{i + 1}", 0) for i in range(12)] + [("d0", "q12", "q0", 0), ("d0", "q3", "q3", 0), ("d0", None, "q1", 0), ("d0", "q1", None, 0)] + edges[:20]
    starts = [("d0", "p1"), ("d0", "q0"), ("d1", "p2"), ("d1", "p2"), ("d2", "unlinked"), ("d2", None)]
    got = distances(spark.createDataFrame(starts, "domain string, node string"), spark.createDataFrame(edges, EDGES), most=most).collect()
    assert {(r.domain, r.node): (r.distance, r.place) for r in got} == walked(starts, edges, most) and len({(r.domain, r.node) for r in got}) == len(got)
    assert distances(spark.createDataFrame([], "domain string, node string"), spark.createDataFrame(edges, EDGES)).count() == 0


def test_sitemaps_six_indexes_deep_and_in_a_circle(spark):
    loc = lambda *u: "".join(f"<loc>{x}</loc>" for x in u)
    rows = [("a.kr", f"https://a.kr/i{i}.xml", "<sitemapindex>" + loc(f"https://a.kr/i{(i + 1) % 7}.xml", f"https://a.kr/s{i}.xml") + "</sitemapindex>", i == 0) for i in range(7)]
    rows += [("a.kr", f"https://a.kr/s{i}.xml", loc(f"https://a.kr/{i}"), False) for i in range(8)]
    rows += [("b.kr", "https://b.kr/sitemap.xml", loc("https://b.kr/1"), True), ("b.kr", "https://a.kr/s7.xml", loc("https://b.kr/no"), False)]
    df = spark.createDataFrame(rows, "domain string, sitemap_url string, body string, root boolean")
    got = readers.read_sitemaps(df).orderBy("domain", "file_no").collect()
    assert [(r.domain, r.url) for r in got] == [("a.kr", f"https://a.kr/{i}") for i in range(7)] + [("b.kr", "https://b.kr/1")]


def test_depths_beyond_two(spark):
    pages = spark.createDataFrame([("x.kr", i, 0 if i == 0 else 1) for i in range(9)], "domain string, page_idx long, depth int")
    graph = spark.createDataFrame([("x.kr", i, i + 1) for i in range(6)] + [("x.kr", 6, 2), ("x.kr", 0, None), ("x.kr", 7, 0)], "domain string, from_idx long, to_idx long")
    assert {r.page_idx: r.link_depth for r in links.page_depths(pages, graph).collect()} == {**{i: i for i in range(7)}, 7: None, 8: None}


@pytest.mark.parametrize("block", [30, 100_000])
def test_a_long_chain_takes_as_many_rounds_as_it_has_blocks(spark, block, monkeypatch):
    edges = [("d0", f"q{i:03}", f"q{i + 1:03}", i % 3) for i in range(90)] + [("d0", f"q{i:03}", f"q{i // 2:03}", 7) for i in range(0, 90, 4)] + [("d1", "q000", "q050", 1)]
    starts = [("d0", "q000"), ("d1", "q000")]
    tables = []
    monkeypatch.setattr(rounds, "written", lambda df, name, write=rounds.written: tables.append(name) or write(df, name))
    got = distances(spark.createDataFrame(starts, "domain string, node string"), spark.createDataFrame(edges, EDGES), block=block).collect()
    assert {(r.domain, r.node): (r.distance, r.place) for r in got} == walked(starts, edges)
    assert tables.count("round") <= 3 + len(edges) // block
