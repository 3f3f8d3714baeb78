"""Fixed points in rounds: a round joins only what the round before has found, and each is a written table."""
from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below that of `spark.checkpoint.dir`, which all machines see; in a temporary one only where none is set and all runs on one machine."""
    root = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines see")
        root = "file://" + tempfile.mkdtemp(prefix="run-")
        checkpoint_dir(spark, root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/rounds-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: lineage ends here, and what reads it twice reads the same rows."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the written tables. For the end of a job: results that are still lazy read them."""
    root = checkpoint_dir(spark) or spark.sparkContext.getCheckpointDir()
    if root:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(root)
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.globStatus(hadoop.Path(top, "rounds-*")) or []:
            fs.delete(status.getPath(), True)


def _relaxed(keys: int, most: int | None):
    """A task's share of a round: shortest ways inside one block of edges from its seeds, and one step out of it."""
    def relax(group: tuple, edges: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        out = edges.groupby("source")["target"].agg(list).to_dict()
        best = dict(zip(seeds["node"].tolist(), seeds["distance"].tolist()))
        queue = [(d, i, node) for i, (node, d) in enumerate(best.items())]
        heapq.heapify(queue)
        n = len(queue)          # breaks ties, so that nodes are never compared
        while queue:
            d, _, node = heapq.heappop(queue)
            if d > best[node] or (most is not None and d >= most):
                continue
            for target in out.get(node, ()):
                if target not in best or d + 1 < best[target]:
                    best[target] = d + 1
                    heapq.heappush(queue, (d + 1, n, target))
                    n += 1
        rows = [(*group[:keys], node, d, 1 if node in out else 2) for node, d in best.items()]
        return pd.DataFrame(rows, columns=[*(f"k{i}" for i in range(keys)), "node", "distance", "news"])
    return relax


def distances(starts: DataFrame, edges: DataFrame, key: Sequence[str] = ("domain",), most: int | None = None, block: int = 100_000) -> DataFrame:
    """(key, node, distance, place) of all nodes that edges (key, source, target, place) lead to from starts (key, node), by the fewest edges.

    `place` is the smallest place of an edge that reaches the node with its distance, null for starts. Edges are dealt into written ranges of (key, source)
    of about `block` edges; a range's edges of one key are a block. A round carries the shortest ways on inside every block that got news, and one step out of
    it, so that the rounds are as many as the blocks that a shortest way comes through, not as its edges; a key of one block takes one round. News are
    nodes of other blocks that became nearer, so that a cycle ends the search. Nulls in key, source or target lead nowhere.
    Edges given twice count once; `most` bounds the distance where it is given.
    """
    key = list(key)
    told = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*key, "source", "target")])
    edges = written(edges.where(told).groupBy(*key, "source", "target").agg(F.min("place").alias("place")), "edges")
    place = edges.schema["place"].dataType
    n = edges.count() // block + 1
    ranges = written(edges.select(*key, "source", "target").repartitionByRange(n, *key, "source").withColumn("block", F.spark_partition_id()), "blocks")
    homes = ranges.select(*key, F.col("source").alias("node"), "block").distinct()
    # news: 0 what a round before knew, 1 found inside the node's own block and carried on there, 2 still to be carried on
    found = written(starts.where(F.col("node").isNotNull()).select(*key, "node").distinct().withColumns({"distance": F.lit(0), "news": F.lit(2)}), "round")
    made = StructType([*(StructField(f"k{i}", ranges.schema[c].dataType) for i, c in enumerate(key)), StructField("node", found.schema["node"].dataType),
                       StructField("distance", IntegerType()), StructField("news", IntegerType())])
    by = [*key, "block"]
    while True:
        seeds = written(found.where("news = 2").join(homes, [*key, "node"]).select(*by, "node", "distance"), "seeds")
        if seeds.isEmpty():
            break
        active = ranges.join(seeds.select(*by).distinct(), by, "left_semi")
        carried = active.groupBy(*by).cogroup(seeds.groupBy(*by)).applyInPandas(_relaxed(len(key), most), made)
        carried = carried.withColumnsRenamed({f"k{i}": c for i, c in enumerate(key)})
        every = found.withColumn("news", F.lit(0)).unionByName(carried)
        nearest = every.groupBy(*key, "node").agg(F.min(F.struct("distance", "news")).alias("best"))
        found = written(nearest.select(*key, "node", "best.*"), "round")
    near = found.select(*key, "node", "distance")
    reached = edges.join(near.withColumnsRenamed({"node": "source", "distance": "before"}), [*key, "source"]).groupBy(
        *key, F.col("target").alias("node"), (F.col("before") + 1).alias("distance")).agg(F.min("place").alias("place"))
    return near.join(reached, [*key, "node", "distance"], "left").withColumn("place", F.when(F.col("distance") > 0, F.col("place")).cast(place))
