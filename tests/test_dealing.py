"""Files of one row group and replayed tables are dealt out over tasks."""
import re

from pyspark.sql import functions as F

from leadloom.functions.text import stripped, titled
from leadloom.plans import queries, tables
from leadloom.sources.readers import dealt


def test_customers_of_one_row_group_are_parsed_by_many_tasks(spark):
    raw = tables.raw_leads(spark, "/root/testdata/sf0.01").where("row >= 0")
    rows = raw.select(F.spark_partition_id().alias("p"), "row").collect()
    assert len({r.p for r in rows}) >= spark.sparkContext.defaultParallelism and len({r.row for r in rows}) == 1500
    assert dealt(spark.range(5)).rdd.getNumPartitions() == spark.range(5).rdd.getNumPartitions()


def test_a_replayed_batch_is_many_files(spark, folder):
    stream = queries._replayed(spark.range(20_000).withColumn("v", F.col("id") % 7), "many", "id")
    seen = []
    named = stream.withColumn("file", F.input_file_name())
    named.writeStream.foreachBatch(lambda batch, n: seen.append((batch.count(), batch.select("file").distinct().count()))).option("checkpointLocation", folder).trigger(
        availableNow=True).start().awaitTermination()
    assert sum(n for n, _ in seen) == 20_000 and len(seen) == 4
    assert min(files for _, files in seen) >= spark.sparkContext.defaultParallelism


def test_fast_ways_of_text_give_the_same(spark):
    texts = ["", " ", "a", " a ", "\u3000가\u00a0", "FURNITURE", "two words", "é", "aB-c", "a\t", "\x1fx", "~", "!b c!", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", stripped("t").alias("s"), titled("t").alias("n"), F.initcap("t").alias("i")).collect()
    assert [r.s for r in got] == [None if t is None else t.strip() for t in texts]
    assert [r.n for r in got] == [r.i for r in got]


def test_page_texts_are_read_after_the_dealing(spark):
    """No pattern is searched below the exchange that deals out customers: there one task would read all texts."""
    plan = queries.QUERIES["nested_openings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    depth = [re.search(r"[+:]- |$", line).start() for line in lines]
    dealt_at = [i for i, line in enumerate(lines) if "RoundRobinPartitioning" in line]
    below = [lines[j] for i in dealt_at for j in range(i + 1, next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines)))]
    assert below and not any("RLIKE" in line for line in below)
