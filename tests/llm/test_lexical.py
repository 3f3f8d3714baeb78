"""Ranked search against the scores of all pairs of items and documents."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from leadloom.llm import lexical
from tests.llm.test_corpus import LARGER, SCHEMA, odd_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score string, rank string, terms string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for key in {(i, tuple(sorted(set(terms(t))))) for i, t in items}:
        found = []
        for doc, bag in bags:
            m = 10 + (90 * sum(bag.values()) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in key[1] if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc))
        for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out.setdefault(key[0], Counter())[rank, doc, -score] += 1
    return out


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, Counter())[r["rank"], r.doc_id, r.score] += 1
    return out


def made(seed, n):
    """Short and long documents, families of copies that tie, and items that share few or many words with them."""
    rng = random.Random(seed)
    common = [f"w{int(i)}" for i in range(300)]
    pick = lambda k: " ".join(rng.choices(common, weights=[1 / (i + 1) for i in range(300)], k=k))
    texts = [pick(rng.choice([1, 3, 10, 60, 400])) for _ in range(n)]
    texts += [texts[5]] * 200 + [texts[6] + " É-1"] * 30 + [None, "", "--- !"]
    docs = list(enumerate(texts)) + [(None, texts[7]), (2**60 + 1, texts[8]), (2**60 + 3, texts[8]), (3, texts[3])]
    rng.shuffle(docs)
    items = [(i, pick(rng.choice([1, 8, 40]))) for i in range(12)] + [(50, texts[5]), (51, texts[6].upper() + " é É"), (52, None), (53, "unseen"), (None, "w0 w1"), (54, texts[9]), (54, texts[9])]
    return docs, items


@pytest.mark.parametrize("k,entries,rounds", [(10, lexical.BLOCK_ENTRIES, lexical.ROUNDS), (3, 60, (0.1, 1.0)), (500, 200, (1.0,))])
def test_search(spark, k, entries, rounds, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET", 64)
    docs, items = made(5, 700)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    i = spark.createDataFrame([(*x, "s", "r", "t") for x in items], ITEMS)
    assert got(lexical.search(d, i, k, entries, rounds)) == brute(docs, items, k)


def test_search_of_odd_rows(spark):
    odd, none = spark.createDataFrame(odd_rows(), SCHEMA), spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "alpha3 beta7 license mit is on one", "s", "r", "t")], ITEMS)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(lexical.search(odd, items)) == brute(docs, [(1, items.first().text)], 10)
    assert lexical.search(none, items).count() == 0 and lexical.search(odd, items.limit(0)).count() == 0


def test_bounds_spare_most_documents(spark):
    """On the test documents the thresholds of the longest vectors and the focus coordinates leave few documents to be scored in integers."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    block = next(lexical.item_blocks(spark.read.parquet(f"{LARGER}/benchmark.parquet")))
    rows = lexical.term_vectors(docs, block.vocabulary).toPandas()
    n_docs, n_terms = int((rows.n > 0).sum()), int(rows.n.sum())
    df = Counter(int(t) for ts in rows.terms for t in ts)
    items = lexical.weighted(block, df, n_docs)
    vectors = lexical.impact_vectors(lexical.term_vectors(docs, block.vocabulary), n_docs, n_terms).toPandas().sort_values("norm", ascending=False)
    search = lexical.Search(items, np.zeros(len(items.ids), np.int64), len(block.vocabulary), 10)
    scored = []
    rescore = search._rescore
    search._rescore = lambda item, alive, *rest: (scored.append(len(alive)), rescore(item, alive, *rest))
    for at in range(0, len(vectors), 128):
        part = vectors.iloc[at: at + 128]
        search.bucket(list(part.doc_id), np.repeat(np.arange(len(part)), part.terms.map(len)), np.concatenate(list(part.terms)).astype(np.int64),
                      np.concatenate(list(part.impacts)).astype(np.int64), part.norm.to_numpy())
    assert sum(scored) < 0.2 * len(vectors) * len(items.ids)
