"""Corpus operators against brute force, and their defined results for odd tables."""
import collections
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import common, decontaminate, exact, hmm, licenses, lines, mixing, ngram_join, pii, queries, suffix_dedup, toxicity
from tests.llm import brute

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CLASH = ("key", "row", "cls", "n", "h", "score", "size", "text_sha256", "kept", "runs", "copies", "target", "spans", "found", "doc", "words")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]) + str(rng.randrange(30)) for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(5)]
    line = "\n".join(words(rng, 12) for _ in range(4))
    texts = [None, "", "   ", "one", "one two", base[0], base[0], base[0] + " tail", base[1], base[1].upper(), base[2], base[2].replace("alpha", "ALPHA"),
             words(rng, 20_000), line, "head\n" + line + "\nend", line + "\n" + line, "\n\n\n\n", "a\n\n\nb", base[3] + " " + base[4], base[4] + " " + base[3],
             "Released under the MIT License. " + base[3], "Apache License, Version 2.0 and CC BY-NC 4.0", "x" * 200_000, "is on. " * 3000, "é" * 60 + base[0]]
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(5, base[0], "en", "s1", 1), (5, base[0], "en", "s1", 1), (None, base[0], None, None, None), (None, None, None, None, None), (None, "only here " + base[4][:30], None, None, None)]
    return [r + (f"c{i}",) * len(CLASH) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    """The smallest documents as (doc_id, text)."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def unique(df):
    """Rows with ids of their own, for brute force."""
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").filter("doc_id IS NOT NULL").distinct().collect()]


def test_exact_groups(odd, none):
    got = exact.exact_groups(odd).collect()
    assert len(got) == odd.count() and exact.exact_groups(none).count() == 0
    by_text = {}
    for r in odd.select("doc_id", "text").collect():
        by_text.setdefault(r.text or "", []).append(r.doc_id)
    for r in got:
        ids = next(v for t, v in by_text.items() if brute.sha(t) == r.text_sha256)
        smallest = min((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (smallest, len(ids), r.doc_id == smallest)


@pytest.mark.parametrize("runs,fan_in", [(1, 2), (7, 2), (64, 8)])
def test_merge_tree_is_the_same_for_any_runs(odd, runs, fan_in):
    a = exact.exact_groups(odd, runs=runs, fan_in=fan_in, smallest=False).select("doc_id", "keep_id", "group_size")
    assert a.exceptAll(exact.exact_groups(odd, smallest=False).select("doc_id", "keep_id", "group_size")).isEmpty()


def test_runs_are_merged_by_order(odd):
    """Sorted aggregates over ranges of run and digest, none by hash."""
    rows = common.staged(exact.digest_runs(odd, 64), "digests")
    plan = exact.merge_tree(rows, 64, 8, True)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and plan.count("SortAggregate") >= 3 and plan.count("rangepartitioning(run") == 2


def test_lines(odd, none):
    got = {(r.row.doc_id, r.row.text): r.kept_text for r in lines.dedup_lines(odd).collect()}
    assert lines.dedup_lines(none).count() == 0 and lines.dedup_lines(odd).count() == odd.count()
    only = odd.filter("doc_id IS NOT NULL")
    want = brute.kept_lines(unique(only))
    got = {r.row.doc_id: r.kept_text or "" for r in lines.dedup_lines(only).collect()}
    assert got == want
    assert lines.drop_repeated_lines(odd).columns == odd.columns
    length = {r.doc_id: r.n_chars for r in lines.drop_repeated_lines(only).collect()}
    assert length[15] == len(want[15]) and length[0] is None


def test_mixing(odd, none):
    rows = mixing.mixing_plan(odd).collect()
    assert len(rows) == odd.count() and mixing.mixing_plan(none).count() == 0 and mixing.mix_sources(none).count() == 0
    total = sum(r.size for r in rows)
    targets = {r.source_size: r.target for r in rows}
    assert all(t <= 2 * s for s, t in targets.items()) and all(r.taken <= 2 * r.size for r in rows)
    assert sum({(r.source_size, r.target) for r in rows} and targets.values()) <= 1.5 * total + 1e-6
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mixing_plan(odd.repartition(5)).exceptAll(mixing.mixing_plan(odd)).isEmpty()


def test_mixing_targets(spark):
    sized = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 5000)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_rates(sized).collect()}
    # weights a 5, b 2, c 1, null 5; 9165 to share: a and null stop at 200 and 20, b at 2000, c takes the rest
    assert got == {"a": 200.0, None: 20.0, "b": 2000.0, "c": 6945.0}


def test_license_base_phrases(odd, none, real, spark):
    assert licenses.scan_licenses(none).count() == 0 and licenses.scan_licenses(odd).count() == odd.count()
    df = spark.createDataFrame(real + [(9001, "under the MIT-license under the mit license"), (9002, "Under_the_MIT_License/cc by nc cc by nc sa")], "doc_id long, text string")
    text = dict(df.collect())
    for r in licenses.scan_licenses(df).collect():
        n, at, labels = brute.phrases(text[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(at), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("distributed under the terms of the Mozilla Public License Version 2.0", "mpl-2"),
    ("CC BY-NC-SA 4.0 license", "cc-by-nc,cc-by-nc-sa"),
    ("dedicated to the public domain", "public-domain"),
    ("a licence to kill by public transport", ""),
])
def test_license_rules(spark, text, labels):
    assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


def test_license_rules_are_gated():
    """Every rule's keyword stands in what it matches, and every rule passes the gate."""
    for _, keyword, pattern, *_ in licenses.rules():
        assert keyword in pattern, pattern
        assert any(g in pattern for g in licenses.GATE) or "licen[cs]e" in pattern or "cc " in pattern, pattern
    assert len(licenses.rules()) > 300


def shortest(pattern):
    """Matches of a pattern without its optional parts, one for each way through its alternatives."""
    from re import _parser

    def ways(nodes):
        out = [""]
        for op, arg in nodes:
            if str(op) == "LITERAL":
                one = [chr(arg)]
            elif str(op) == "IN":
                one = [chr(arg[0][1])]
            elif str(op) == "BRANCH":
                one = [w for branch in arg[1] for w in ways(branch)]
            elif str(op) == "SUBPATTERN":
                one = ways(arg[3])
            else:
                assert str(op) == "MAX_REPEAT" and arg[0] == 0, op
                one = [""]
            out = [a + b for a in out for b in one]
        return out
    return ways(_parser.parse(pattern))


def test_license_rules_find_their_shortest_match(spark):
    """A document that is nothing but the shortest match of a rule passes the gate and gets the rule's label."""
    rows = [(n, text, label) for n, (text, label) in enumerate(dict.fromkeys((w, r[0]) for r in licenses.rules() for w in shortest(r[2])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(8)
    got = licenses.detections(docs).filter("found").select("doc_id", "label").distinct()
    assert docs.select("doc_id", "label").exceptAll(got).join(docs, ["doc_id", "label"]).select("text", "label").collect() == []


@pytest.mark.parametrize("text,labels", [
    ("Released under the GPL 3", "gpl-3"), ("distributed under BSD 3-Clause", "bsd-3-clause"), ("available under MPL 2.0", "mpl"),
    ("Released\nunder the CC0 1.0", "cc0"), ("released under GPLv3", "gpl-3"), ("Provided under Apache v2.0", "apache-2"), ("covered under LGPLv2.1", "lgpl"),
    ("published under the MPLv2", "mpl"), ("under the Apache License v2.0", "apache-2"), ("GNU General Public License v2", "gpl-2"), ("we understand what is available", ""),
])
def test_license_statements_without_the_word(spark, text, labels):
    assert licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == labels


PII_TEXT = ("mail bob.x9@mail9.example.com or +1 (858) 555-7280, card 4111111111111111 and 4111 1111 1111 1111 bad 4111111111111112 "
            "ip 45.114.23.72 bad 999.1.1.1 ssn 123-45-6789 bad 000-12-1234\non 1999-12-31 and 12/25/1990, 25.12.1990 bad 2023-02-30 "
            "iban DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 tel +49 30 1234567. v1.2.3 9999999")


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_pseudonyms_keep_format_and_come_back(spark):
    df = spark.createDataFrame([(1, PII_TEXT), (2, "again 123-45-6789 and bob.x9@mail9.example.com")], "doc_id long, text string")
    out = pii.pseudonymise(df, "k").collect()
    found = {h.found: h.value for h in out[0].found}
    assert sorted(h.kind for h in out[0].found) == sorted(["email", "phone", "card", "card", "ip", "ssn", "date", "date", "date", "iban", "iban", "phone"])
    for old, new in found.items():
        assert old != new and re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", old))) == re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", new))) or "." in old
        assert old not in out[0].text
    assert all(luhn(v) % 10 == 0 for o, v in found.items() if o.startswith("4111"))
    assert all(x in out[0].text for x in ("4111111111111112", "999.1.1.1", "000-12-1234", "2023-02-30", "v1.2.3 9999999"))
    assert {h.found: h.value for h in out[1].found}["123-45-6789"] == found["123-45-6789"]
    back = pii.pseudonymise(pii.pseudonymise(df, "k").select("row.doc_id", "text"), "k", inverse=True)
    assert {r.row.doc_id: r.text for r in back.collect()} == dict(df.collect())
    other = pii.pseudonymise(df, "another").collect()[0].text
    assert other != out[0].text


@pytest.mark.parametrize("text,found", [
    ("4111 1111 1111 1111 12/26", ["4111 1111 1111 1111"]), ("4111 1111 1111 1111 123 x", ["4111 1111 1111 1111"]), ("4111111111111111 123", ["4111111111111111"]),
    ("5555 4111 1111 1111 1111", ["4111 1111 1111 1111"]), ("3782 822463 10005 1234", ["3782 822463 10005"]), ("4222 222 222 222 12/26", ["4222 222 222 222"]),
    ("415-555-2671 2024-05-01", ["2024-05-01", "415-555-2671"]), ("415 555 2671 94105", ["415 555 2671"]), ("415 555 2671 415 555 2672", ["415 555 2671", "415 555 2672"]),
    ("BE68 5390 0754 7034 BIC ABCDBEBB", ["BE68 5390 0754 7034"]), ("NO93 8601 1117 947 EUR", ["NO93 8601 1117 947"]), ("DE89 3704 0044 0532 0130 00 BIC", ["DE89 3704 0044 0532 0130 00"]),
    ("+49 30 1234567 94105 x", ["+49 30 1234567"]), ("4111 1111 1111 1111 4111 1111 1111 1111", ["4111 1111 1111 1111"] * 2), ("\ufdd0 123-45-6789 \ufdd3", ["123-45-6789"]),
])
def test_pseudonyms_of_adjacent_values(spark, text, found):
    """A candidate that does not validate hides neither a shorter one nor its neighbours."""
    r = pii.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert [h.found for h in r.found] == found and not any(f in r.text for f in found)
    assert re.sub("[0-9]", "9", r.text) == re.sub("[0-9]", "9", text)


def test_feistel_is_a_permutation(spark):
    df = spark.range(35).select("id", pii.feistel(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(5), F.lit(7), "t", F.lit("k"), False).alias("s"))
    assert df.select("s").distinct().count() == 35


def test_pseudonyms_of_odd_rows(odd, none):
    assert pii.pseudonymise(none, "k").count() == 0
    assert all(r.text == r.row.text for r in pii.pseudonymise(odd, "k").collect())


def test_toxicity_separates_and_locates(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        sentences = [words(rng, 8) for _ in range(6)]
        if i % 4 == 0:
            sentences[rng.randrange(6)] += f" nastyword{rng.randrange(3)} bad"
        rows.append((i, ". ".join(sentences) + ".", int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.filter("doc_id < 300"), max_documents=300)
    out = toxicity.toxicity(df.filter("doc_id >= 300"), model).collect()
    assert sum(r.predicted == r.row.toxic for r in out) >= 98
    for r in out:
        if r.predicted:
            where = [r.row.text.encode()[s.start:s.stop].decode() for s in r.spans]
            assert any("nastyword" in w for w in where) and len(where) == 1
        assert r.n_sentences == 6


def test_toxicity_of_odd_rows(spark, odd, none):
    model = toxicity.train(odd.withColumn("toxic", F.lit(1)))        # one label only
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.n_sentences >= 1 for r in rows)
    assert toxicity.toxicity(none, toxicity.train(none.withColumn("toxic", F.lit(1)))).count() == 0


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (2, 50)])
def test_similar_groups(spark, odd, real, k, num):
    rng = random.Random(k)
    base = words(rng, 100).split()
    near = []
    for i in range(150):        # a group of near copies with more and more changes
        w = list(base)
        for _ in range(i // 15):
            w[rng.randrange(100)] = f"new{rng.randrange(10_000)}"
        near.append((5000 + i, " ".join(w)))
    rows = real + near + [(d + 10_000, t) for d, t in unique(odd)]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=k, similarity=(num, 100))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.groups(rows, k, num, 100)


def test_similar_groups_of_odd_rows(odd, none):
    assert ngram_join.similar_groups(none).count() == 0 and ngram_join.drop_similar(none).count() == 0
    rows = ngram_join.similar_groups(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.component_id == r.doc_id and r.keeper for r in rows if r.n_shingles == 0)
    kept = ngram_join.drop_similar(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 4, 5, 12}
    assert {r.doc_id for r in kept.collect()} & {6, 7} == set()


def test_similar_groups_take_one_python_worker_a_core(spark, odd, monkeypatch):
    """Frequencies are counted and added up in tables, whose steps do not run beside a step on rows, and texts travel in small batches."""
    def no_rows(_):
        raise AssertionError("a second Python worker")

    texts = odd.select(common.filled("text").alias("text"))
    want = collections.Counter()
    for r in texts.collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        want.update(ngram_join._cells(ngram_join.shingle_sets(raw, np.array([0, len(raw)]), 3)[0], 10).tolist())
    with monkeypatch.context() as m:
        m.setattr(type(odd), "rdd", property(no_rows))
        got = ngram_join.document_frequencies(texts, 3, 10)
        few = ngram_join.document_frequencies(texts.limit(0), 3, 4)
    assert got.tolist() == [want[i] for i in range(1 << 10)] and few.tolist() == [0] * 16
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before, counted = spark.conf.get(name), ngram_join.document_frequencies
    monkeypatch.setattr(ngram_join, "document_frequencies", lambda *a: seen.append(spark.conf.get(name)) or counted(*a))
    assert ngram_join.similar_groups(odd).count() == odd.count()
    assert [int(x) for x in seen] == [8 << 20] and spark.conf.get(name) == before


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: find(n) for n in nodes if find(n) != n}


def test_decontaminate(spark, odd, none):
    rng = random.Random(9)
    items = [(1, words(rng, 30)), (2, "short item"), (3, ""), (4, None), (5, words(rng, 9)), (6, "Solo"), (None, words(rng, 12)), (5, words(rng, 9))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [items[0][1], "a " + items[0][1][:120].upper(), "a short-item here, SOLO", items[4][1] + " x", " ".join(items[0][1].split()[:9]), items[6][1], None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in decontaminate.decontaminate(docs, bench).collect():
        n, hit, found = brute.hits(texts[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.items) == (n, hit, sorted(str(f) for f in found if f is not None))
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, no_items).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.drop_contaminated(odd, bench).columns == odd.columns


def test_base_scores_and_likelihood(spark, odd, none, real):
    got = {r.doc_id: r for r in queries.op7_hmm_scores(spark, SF).collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    want, total = brute.unigram(real, held)
    for d, (n, known, base) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(d)) and abs(r.base_score - base) < 1e-6 * abs(base)
    tokens = sum(got[d].n_tokens for d in got if held(d))
    assert sum(r.score for r in got.values() if r.held_out) / tokens > sum(r.base_score for r in got.values() if r.held_out) / tokens
    text = odd.select(common.filled("text").alias("text"))
    model, vocabulary = hmm.train(text, states=2, symbols=20, known=40, rounds=2)
    rows = hmm.score(odd, model, vocabulary).collect()
    assert len(rows) == odd.count() and all(r.score < 0 for r in rows)
    first = [r for r in rows if r.doc_id == 5]
    assert len(first) == 3 and len({round(r.score, 6) for r in first}) == 1 and len({r.n_known for r in first}) == 1
    empty, no_words = hmm.train(none.select("text"), rounds=1)
    assert hmm.score(none, empty, no_words).count() == 0 and hmm.score(odd, empty, no_words).count() == odd.count()


def test_forward_sums_to_one():
    """All texts of two words and an end over a vocabulary of two words, and shorter ones, have at most probability one; the recursion equals the sum over paths."""
    import itertools

    import numpy as np
    rng = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(hmm.Lexicon.build(np.zeros(0, np.uint64), np.zeros(0, np.int64)), 1, norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((3, 3)), 0), 1, 1, 1, 1.0)
    texts = list(itertools.product(range(3), repeat=4))
    flat, lengths = np.array(texts).ravel(), np.full(len(texts), 4)
    got = 10 ** hmm.forward(flat, lengths, model)
    assert abs(got.sum() - 1) < 1e-9
    for text, p in list(zip(texts, got))[::9]:
        want = sum(model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:])]) * np.prod([model.emit[s, q] for s, q in zip(text, path)])
                   for path in itertools.product(range(3), repeat=4))
        assert abs(p - want) < 1e-12


def test_baum_welch_rounds_raise_the_likelihood():
    import numpy as np
    rng = np.random.default_rng(3)
    pieces = rng.integers(0, 4, (20, 30))
    pieces[15:, :10] = -1
    start, move, emit = np.full(2, .5), np.array([[.9, .1], [.2, .8]]), np.random.default_rng(1).dirichlet(np.ones(4), 2).T
    before = -np.inf
    for _ in range(5):
        total = hmm.expectations(pieces, start, move, emit)
        assert total[-2] >= before - 1e-3 and total[-1] == (pieces >= 0).sum()
        before = total[-2]
        start, move, emit = total[:2] / total[:2].sum(), total[2:6].reshape(2, 2), total[6:-2].reshape(4, 2)
        move, emit = move / move.sum(1, keepdims=True), emit / emit.sum(0)


@pytest.mark.parametrize("most", [2000, 0])
def test_suffix_dedup(spark, odd, most):
    """With `most` = 0 every minimizer is settled by window hashes."""
    rows = unique(odd)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), most=most)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got.collect()} == brute.cut_repeats(rows)


def test_suffix_dedup_of_odd_rows(odd, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert {r.n_removed for r in rows if r.doc_id == 5} == {0} and any(r.n_removed for r in rows if r.doc_id is None)


def test_suffix_dedup_drops_its_steps(spark, folder, monkeypatch):
    """A step's table and shuffle files go when nothing reads them any more, texts travel in small batches, and the session's settings come back."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{folder}")
    before = {name: spark.conf.get(name) for name in suffix_dedup.SETTINGS}
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{i} {passage} {i * i}") for i in range(20)], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).filter("n_removed > 0").count() == 19
    assert {name.split("-")[1] for name in os.listdir(folder)} == {"spans", "crowded", "windows"}
    assert {name: spark.conf.get(name) for name in suffix_dedup.SETTINGS} == before


def test_suffix_dedup_marks_reads_exactly(spark, monkeypatch):
    """However few the flags, only reads whose minimizer stands in two documents leave their task; blocks of any size give the same rows."""
    rng = random.Random(8)
    passage = words(rng, 40)
    rows = [(i, " ".join(str(rng.random()) for _ in range(60)) + (passage if i % 4 == 0 else "") + str(rng.random())) for i in range(48)]
    holders, found = collections.defaultdict(set), []
    for i, text in rows:
        m = suffix_dedup.reads(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))[0].tolist()
        found += m
        for x in m:
            holders[x].add(i)
    shared, counts, staged = sum(len(holders[x]) > 1 for x in found), {}, common.staged

    def counted(df, name):
        out = staged(df, name)
        counts[name] = out.count()
        return out
    monkeypatch.setattr(common, "staged", counted)
    want = brute.cut_repeats(rows)
    for block in (suffix_dedup.BLOCK, 3000):
        monkeypatch.setattr(suffix_dedup, "BLOCK", block)
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=8)
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in got.collect()} == want
        assert 0 < counts["reads"] <= shared < len(found) / 2


def test_suffix_dedup_holds_little(spark, monkeypatch):
    """Texts are cut while Arrow batches are small, flags need no Python workers of their own, and blocks are written in several row groups."""
    batches, staged = {}, common.staged

    def noted(df, name):
        batches[name] = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")), df.columns
        return staged(df, name)
    monkeypatch.setattr(common, "staged", noted)
    monkeypatch.setattr(common, "bitmap", None)
    passage = " ".join(f"word{i}" for i in range(60))
    got = suffix_dedup.remove_repeats(spark.createDataFrame([(i, f"{i} {passage} {i * i}") for i in range(20)], "doc_id long, text string"))
    assert got.filter("n_removed > 0").count() == 19
    assert "kept" in batches["spans"][1] and all(size <= 2 << 20 for size, _ in batches.values())
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    texts = pd.DataFrame({"doc": range(20), "key": range(20), "text": [rng.integers(97, 123, suffix_dedup.BLOCK).astype(np.uint8).tobytes().decode() for _ in range(20)]})
    blocks = suffix_dedup.blocks_of(spark.createDataFrame(texts).coalesce(1))
    assert blocks.count() == 20 and min(pq.ParquetFile(f.removeprefix("file:")).num_row_groups for f in blocks.inputFiles()) > 1


def test_flags_of_hashes(spark):
    h = np.random.default_rng(4).integers(-2**63, 2**63, 3000)
    df = spark.createDataFrame([(x,) for x in h[:1500].tolist()], "h long")
    for bits in (8, 24):
        hit = suffix_dedup._flagged(suffix_dedup._flags(df, "h", bits), h.view(np.uint64))
        assert hit.tolist() == np.isin(h.view(np.uint64) >> np.uint64(64 - bits), h[:1500].view(np.uint64) >> np.uint64(64 - bits)).tolist()


def test_sorted_suffixes():
    rng = random.Random(3)
    base = ["".join(rng.choice("ab") for _ in range(120)).encode() for _ in range(4)]
    texts = []
    for _ in range(80):
        b, i = bytearray(rng.choice(base)), rng.randrange(40)
        b[rng.randrange(120)] = rng.choice(b"abc")
        texts.append(bytes(b[i:i + rng.randrange(50, 81)]))
    want = sorted((t[len(t) - n:], i, n) for i, t in enumerate(texts) for n in range(len(t) + 1))
    for block in (1 << 18, 37):
        read, length, same = suffix_dedup.sorted_suffixes(texts, block)
        assert [texts[r][len(texts[r]) - n:] for r, n in zip(read, length)] == [w[0] for w in want]
        assert all(bool(same[k]) == (len(want[k][0]) >= 50 and want[k][0][:50] == want[k - 1][0][:50]) for k in range(1, len(want)))


def test_pipeline_stages(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "decontamination", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.staged(stage(spark, docs, LARGER), name)
        assert docs.columns == columns
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
            gone = [labels[d] for d in before.keys() - ids if d in labels]
            assert sum(gone) >= 0.6 * sum(labels.values()) and len(gone) - sum(gone) <= 0.02 * len(labels)
        elif name == "line_dedup":
            assert {r.doc_id: r.text for r in after} == brute.kept_lines([(d, r.text) for d, r in before.items()])
        elif name == "ngram_join":
            assert ids == {g for _, g in brute.groups([(d, r.text) for d, r in before.items()], 5, 80, 100).values()}
        elif name == "decontamination":
            assert ids == {d for d, r in before.items() if not brute.hits(r.text, items)[1]}
        else:
            plan = {r.doc_id: r.copies for r in mixing.mixing_plan(spark.createDataFrame(list(before.values()), "doc_id long, text string, lang string, source string, n_chars long")).collect()}
            assert sorted(r.doc_id for r in after) == sorted(d for d, n in plan.items() for _ in range(n))
