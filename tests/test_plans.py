"""Plans and skew: what must hold when one key owns a large share of the rows."""
import re

import pytest
from pyspark.sql import functions as F

from leadloom.functions.ranking import neighbour
from leadloom.operators import scans
from leadloom.plans import tables as T
from leadloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["previous_scan", "scan_history_top", "crawl_plan", "top_jobs", "within_budget"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert re.search(r"WindowGroupLimit .*Partial", text)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_without_keys(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_the_columns_it_needs(spark):
    text = plan(QUERIES["hiring_signal"](spark, SF))
    assert all("value" not in s and "props" not in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text))


def test_neighbour_equals_the_window_for_a_hot_key(spark):
    from pyspark.sql import Window
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 50).alias("k"),
        (F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.lit(500_000)))).alias("t"),
        F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    for step, fn in ((1, F.lead), (-1, F.lag)):
        want = df.withColumn("n", fn("v").over(Window.partitionBy("k").orderBy("t", "id")))
        for bucket in (F.date_trunc("hour", "t"), None):
            got = neighbour(df, "k", ("t", "id"), "v", "n", bucket=bucket, step=step)
            assert got.select("id", "n").exceptAll(want.select("id", "n")).isEmpty() and got.columns == want.columns


def test_one_hot_moment_is_split(spark, monkeypatch):
    """A third of the rows are one key's within one hour, and some share their very time: ranges part them, rows stay the same."""
    from pyspark.sql import Window

    from leadloom.functions import ranking
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("id"), F.when(F.col("id") % 3 == 0, F.lit(600)).otherwise(F.lit(500_000)))).alias("t"))
    seen = []
    monkeypatch.setattr(ranking, "written", lambda rows, name: seen.append(rows_written := written(rows, name)) or rows_written)
    from leadloom.operators.rounds import written
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # small ranges would be put together
    try:
        got = neighbour(df.repartition(7), "k", ("t", "id"), "id", "n", step=1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.withColumn("n", F.lead("id").over(Window.partitionBy("k").orderBy("t", "id")))
    assert got.select("id", "n").exceptAll(want.select("id", "n")).isEmpty() and got.count() == 6000
    sizes = {r._bucket: r["count"] for r in seen[0].where("k = 1").groupBy("_bucket").count().collect()}
    assert len(sizes) > 1 and max(sizes.values()) < 0.9 * sum(sizes.values())


def test_results_do_not_depend_on_partitions(spark):
    history = T.scan_history(spark, SF)
    a = scans.company_trend(T.companies(history), history)
    b = scans.company_trend(T.companies(history.repartition(13)), history.repartition(7, "it_jobs"))
    assert a.exceptAll(b).isEmpty()


def test_duplicate_summary_with_a_hot_name(spark):
    """A third of all leads share a name; the counts still equal the comparison of every pair."""
    import random
    from leadloom.operators.leads import duplicate_summary
    rng = random.Random(3)
    some = lambda p, n, tail: f"{p}{rng.randrange(n)}{tail}" if rng.random() < 0.7 else None
    leads = [(i, some("d", 20, ".kr"), some("m", 40, "@x.kr"), "Hot Inc" if i % 3 == 0 else f"N{rng.randrange(60)}") for i in range(400)]
    probes = [(i, "hot inc" if i % 2 else f"n{rng.randrange(60)}", some("M", 40, "@x.kr"), some("www.d", 20, ".kr/a")) for i in range(60)]
    want = {}
    for pid, name, mail, site in probes:
        keys = (site and site[4:-2], mail and mail.lower(), name)
        hits = [(min(r for r, (a, b) in enumerate(zip(keys, (d, m, n.lower()))) if a and a == b), i) for i, d, m, n in leads
                if any(a and a == b for a, b in zip(keys, (d, m, n.lower())))]
        want[pid] = (len(hits), ("domain", "email", "name")[min(hits)[0]] if hits else None, min(i for _, i in hits) if hits else None)
    got = duplicate_summary(spark.createDataFrame(probes, "probe_id bigint, company_name string, email string, website string"),
                            spark.createDataFrame(leads, "id bigint, domain string, email string, company_name string"))
    assert {r.probe_id: (r.matches, r.reason, r.first_id) for r in got.collect()} == want


def test_page_copies_of_one_hot_text(spark):
    from leadloom.operators.pages import dedupe_pages
    rows = [(i, f"https://a.kr/{i % 700}", ("c" * 300) if i % 3 == 0 else f"{i % 250}" * 120, int(i > 0)) for i in range(900)]
    asked, texts, want = set(), set(), []
    for i, url, text, depth in rows:
        if url in asked:
            continue
        asked.add(url)
        if depth and text in texts:
            continue
        if depth:
            texts.add(text)
        want.append(i)
    df = spark.createDataFrame(rows, "page_idx bigint, url string, text string, depth int").withColumns({"final_url": F.col("url"), "domain": F.lit("a.kr")})
    assert sorted(r.page_idx for r in dedupe_pages(df).collect()) == want
