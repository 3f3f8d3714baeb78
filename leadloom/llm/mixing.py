"""Mixing sources to target weights: repetition rates from token totals, then whole and drawn copies of each document."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm import common


def source_rates(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of `sized` (source, size): source, source_size, target.

    Sources by code point, null last, take the weights in turn and share `share` times the total. A target stops at `most`
    times its source's size; what is over goes to the others by weight, until none is above. In order of size to weight the
    stopped sources come first, so running sums of sizes and weights tell where the line is. The windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)) \
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    lined = weighed.withColumn("level", left / weight_left).withColumn("place", F.row_number().over(every))
    stopped = F.col("level") >= F.col("cap") / F.col("weight")
    level = F.min_by(F.when(~stopped, F.col("level")), F.when(~stopped, F.col("place"))).over(all_rows)
    return lined.withColumn("stopped", stopped).withColumn("line", level) \
        .select("source", "source_size", F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("weight") * F.col("line")).alias("target"))


def draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from the seed and the keys, the same in every run: 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(doc_id: Column, size: Column, source_size: Column, target: Column, seed: str) -> Column:
    """floor(rate) copies and one more with the rate's fraction as probability."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(draw(seed, doc_id, size) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _sized(docs: DataFrame, *columns) -> DataFrame:
    return docs.select(*columns, F.col("source").cast("string").alias("source"),
                       F.regexp_count(common.filled("text"), F.lit(common.SPACED_WORD)).cast("long").alias("size"))


def mixing_plan(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), copies, taken = size * copies.

    A null text has size 0, a null source is a source of its own. Rows of equal doc_id and size (null ids too) draw alike.
    An empty table gives no rows. Only doc_id, text and source are read.
    """
    sized = _sized(docs, "doc_id")
    rates = common.staged(source_rates(sized, **how), "rates").withColumnRenamed("source", "rate_source")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
    return joined.withColumn("copies", copies(F.col("doc_id"), F.col("size"), F.col("source_size"), F.col("target"), seed)) \
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_sources(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mixture itself: every row of `docs` with all its columns, as often as the plan says. Other columns may have any name."""
    rates = common.staged(source_rates(_sized(docs), **how), "rates").withColumnRenamed("source", "rate_source")
    sized = _sized(docs, F.struct("*").alias("row"))
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("rate_source")))
    n = copies(F.col("row.doc_id"), F.col("size"), F.col("source_size"), F.col("target"), seed)
    return joined.withColumn("copies", n).filter("copies > 0") \
        .select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
