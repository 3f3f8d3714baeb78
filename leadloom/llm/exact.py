"""Exact deduplication: a tree-merge of sorted digest runs."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

DIGEST = ("sha", "check", "length")


def digest_runs(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, the digest of the whole text (SHA-256, with an independent hash and the length to verify it), and the run of the row."""
    text = common.filled("text")
    return docs.select("doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), F.xxhash64(text).alias("check"),
                       F.octet_length(text).cast("long").alias("length")) \
        .withColumn("run", F.pmod(F.xxhash64("doc_id", "check"), F.lit(runs)))


def merge_tree(rows: DataFrame, runs: int, fan_in: int, smallest: bool) -> DataFrame:
    """Digest, keep_id and group_size of every group.

    Round 0 sorts each run by digest and merges equal neighbours, first inside every input partition, so that a frequent text leaves it
    as one row. Then runs r with the same r div fan_in are exchanged and merged: they meet in ranges of (run, digest), are sorted together, and of
    neighbours equal in all parts of the digest one stays with the winning identifier and the summed count, until one run is left. Equal
    SHA-256 with another check or length never merges. The winning identifier is kept as a struct, which Spark aggregates over sorted input only: every
    merge is by order, none by hash. A digest has at most fan_in rows in a round, so a text of a third of all documents is never gathered in one task;
    a round has as many ranges as the shuffle has partitions, so the last one is as parallel as the first.
    """
    pick = F.min if smallest else F.max
    named = F.struct(F.col("doc_id").isNotNull().alias("named"), F.col("doc_id").alias("id")) if not smallest else F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"))
    level = rows.select("run", *DIGEST, named.alias("keep"), F.lit(1).cast("long").alias("group_size"))
    merged = lambda sorted_runs: sorted_runs.groupBy("run", *DIGEST).agg(pick("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    level = merged(level)
    while runs > 1:
        runs = -(-runs // fan_in)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in))
        level = merged(level.repartitionByRange("run", "sha").sortWithinPartitions("run", *DIGEST))
    return level.select(*DIGEST, F.col("keep.id").alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, runs: int = 64, fan_in: int = 8, smallest: bool = True) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty, and empty texts form a group as any other. The smallest
    (or largest) doc_id of a group stays; null ids lose against any other, and in a group of null ids all rows are kept. Rows
    that repeat a doc_id with the same text are one document: they count in group_size and share `kept`. An empty table gives no
    rows; further columns are not read.
    """
    rows = common.staged(digest_runs(docs, runs), "digests")
    groups = common.staged(merge_tree(rows, runs, fan_in, smallest).filter("group_size > 1"), "groups")
    r, g = rows.alias("r"), groups.alias("g")
    same = [F.col(f"r.{c}") == F.col(f"g.{c}") for c in DIGEST]
    keep = F.when(F.col("g.group_size").isNull(), F.col("r.doc_id")).otherwise(F.col("g.keep_id"))
    return r.join(g, same, "left").select(
        "r.doc_id", keep.alias("keep_id"), F.coalesce("g.group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("r.doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("r.sha")).alias("text_sha256"))
