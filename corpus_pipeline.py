"""A corpus from raw documents to a training mixture: five stages, each written to the shared folder and read by the next."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import common, decontaminate, lines, mixing, ngram_join, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay; the model learns from the labelled ones among them."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text").join(labels, "doc_id"))
    return toxicity.toxicity(docs, model).filter("predicted = 0").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line passages stay in the first document that has them; every document stays, if need be with an empty text."""
    return lines.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with Jaccard similarity 0.8 on five-word shingles, the smallest doc_id stays."""
    return ngram_join.drop_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item stay."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights say."""
    return mixing.mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies),
          ("decontamination", drop_contaminated), ("mixing", mix)]

ORACLE_SQL = None       # a trained classifier is not SQL; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = common.staged(docs, name)
    return docs
