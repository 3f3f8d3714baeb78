"""Ids beyond 2**53 stay what they are, also where a null id stands beside them in one batch."""
from collections import Counter

from pyspark.sql import functions as F

from leadloom.llm import common, decontaminate, hmm, ngram_join
from tests.llm import brute

BIG = 2**60
TEXT = " ".join(f"word{i}" for i in range(40))
ROWS = [(BIG + 1, TEXT), (BIG + 3, TEXT + " end"), (None, "a b c d e f"), (BIG + 5, "other words that stand by themselves here"), (BIG + 7, ""), (-BIG - 1, "other words that stand by themselves here")]


def one_batch(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)


def test_similar_groups(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(one_batch(spark), words=4, similarity=(85, 100)).collect()}
    named = [r for r in ROWS if r[0] is not None]
    assert got == {**brute.groups(named, 4, 85, 100), None: (3, None)}
    kept = Counter(r.doc_id for r in ngram_join.drop_similar(one_batch(spark)).collect())
    assert kept == Counter([BIG + 1, None, BIG + 7, -BIG - 1])


def test_hmm_scores(spark):
    docs = one_batch(spark)
    model, words = hmm.train(docs.select(common.filled("text").alias("text")), states=2, symbols=20, known=40, rounds=1)
    assert Counter(r.doc_id for r in hmm.score(docs, model, words).collect()) == Counter(r[0] for r in ROWS)


def test_windows_are_told_apart_by_their_words(spark):
    bench = spark.createDataFrame([(BIG + 1, TEXT), (BIG + 2, " ".join(TEXT.split()[20:])), (BIG + 3, "stand by")], "item_id long, text string")
    out = {r.doc_id: r["items"] for r in decontaminate.decontaminate(one_batch(spark), bench).collect()}
    assert out == {BIG + 1: [str(BIG + 1), str(BIG + 2)], BIG + 3: [str(BIG + 1), str(BIG + 2)], None: [], BIG + 5: [str(BIG + 3)], BIG + 7: [], -BIG - 1: [str(BIG + 3)]}
    windows = decontaminate.item_windows(bench, 10, 5)
    assert windows.filter(F.col("wid") != F.array_join("words", " ")).isEmpty()
