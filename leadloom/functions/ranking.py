"""Per-key choices and neighbours that stay balanced when one key holds a large share of the rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rounds import written
from .text import col


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key. An aggregate, so every map task sends one row per key."""
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None,
                rank_col: str = "rn") -> DataFrame:
    """The first n rows of each key; Spark cuts each map partition to n rows per key before the shuffle. All rows, ranked, for None."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    return ranked.where(F.col(rank_col) <= n) if n else ranked


def neighbour(df: DataFrame, key: str, order: Sequence[str], value: str, out: str, *, step: int, bucket: Column | None = None) -> DataFrame:
    """`lead` (step=1) or `lag` (step=-1) of `value` within a key, without one task per key.

    Rows are dealt into ranges of (key, order) of about equal size and written, so that a key with a large share of the rows, also within a
    moment, has many ranges. They are windowed per (key, range); the value at the edge of the neighbouring range comes from a carry
    table with one row per (key, range). `bucket` may name ranges that are known beforehand and spares the dealing; it must not decrease along `order`.
    """
    assert step in (1, -1)
    ordering = [F.struct(*order)]
    if bucket is None:
        ranges = df.repartitionByRange(key, *order).withColumn("_bucket", F.spark_partition_id())
        df = written(ranges, "ranges")       # both uses below see the same ranges
    else:
        df = df.withColumn("_bucket", bucket)
    inner = Window.partitionBy(key, "_bucket").orderBy(*order)
    moved = F.lead if step == 1 else F.lag
    marked = df.withColumn("_near", moved(F.struct(F.col(value).alias("v"))).over(inner))
    edge = F.min_by if step == 1 else F.max_by
    edges = df.groupBy(key, "_bucket").agg(edge(F.struct(F.col(value).alias("v")), *ordering).alias("_edge"))
    outer = Window.partitionBy(key).orderBy("_bucket")
    edges = edges.withColumn("_edge", moved("_edge").over(outer))
    joined = marked.join(edges.withColumnsRenamed({key: "_key", "_bucket": "_range"}), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_range")), "left")
    return joined.withColumn(out, F.coalesce("_near", "_edge")["v"]).drop("_bucket", "_near", "_edge", "_key", "_range")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole microseconds between two timestamps (exact, so that sums do not depend on row order)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))
