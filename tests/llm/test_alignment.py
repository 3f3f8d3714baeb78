"""Token alignment against brute force over all pairs of tokens."""
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leadloom.llm import alignment, common, queries
from tests.llm.test_corpus import SCHEMA, SF, odd_rows

ODD = ["a", " ", "é▁x", "x▁", "日本語 <|endoftext|> <s> hi\x00", "  two  \n\n lines\t", "👩‍👩‍👧 zwj", "   ", "x" * 5000, "is on. " * 400]


@pytest.fixture(scope="module")
def files():
    return alignment.read_files(*queries.TOKENIZER_FILES)


def brute(texts, t):
    """Per text (n_a, n_b, groups, links as id pairs)."""
    out = []
    for text in texts:
        a, b = (t.encode_a([text])[0].as_py(), t.encode_b([text])[0].as_py()) if text else ([], [])
        spelled = [t.bytes_a[i].as_py() for i in a], [t.bytes_b[i].as_py() for i in b]
        if not text or any(b"".join(s) != b" " + text.encode() for s in spelled):
            out.append((0, 0, [], []))
            continue
        ends = [[sum(map(len, s[:i + 1])) for i in range(len(s))] if len(s) < 3000 else _running(s) for s in spelled]
        groups, links, i, j = [([], [])], [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            ea, eb = ends[0][i], ends[1][j]
            if ea <= eb:
                groups[-1][0].append(a[i])
                i += 1
            if eb <= ea:
                groups[-1][1].append(b[j])
                j += 1
            if ea == eb:
                groups.append(([], []))
        out.append((len(a), len(b), groups[:-1], links))
    return out


def _running(spelled):
    out = [0]
    for s in spelled:
        out.append(out[-1] + len(s))
    return out[1:]


def spelled(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def expected(rows, t):
    found = brute([r[1] for r in rows], t)
    counts = Counter(link for *_, links in found for link in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return Counter((r[0], a, b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), spelled(groups))
                   for r, (a, b, groups, links) in zip(rows, found))


def got(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in df.collect())


def test_links_are_all_overlapping_pairs(files):
    t = alignment.tokenizers(files)
    text = "Naïve tokenisations — überlappen\n\n  völlig 12345 anders"
    a, b = t.encode_a([text])[0].as_py(), t.encode_b([text])[0].as_py()
    spans = []
    for ids, spelling in ((a, t.bytes_a), (b, t.bytes_b)):
        ends = _running([spelling[i].as_py() for i in ids])
        spans.append(list(zip([0, *ends], ends, ids)))
    every = [(x[2], y[2]) for x in spans[0] for y in spans[1] if max(x[0], y[0]) < min(x[1], y[1])]
    assert sorted(brute([text], t)[0][3]) == sorted(every)
    row = alignment.align_texts([text], t).to_pylist()[0]
    assert Counter(dict(zip(row["pairs"], row["times"]))) == Counter(i * len(t.bytes_b) + j for i, j in every)


def test_ranks_give_the_same_tokens(files, monkeypatch):
    """The quick encoder against the plain one, over all code points, mixed white space and long runs."""
    monkeypatch.setattr(alignment, "_loaded", {})
    quick = alignment.tokenizers(files)
    monkeypatch.setattr(alignment, "_loaded", {})
    plain = alignment.tokenizers(files._replace(ranked=False))
    texts = ["".join(f"x{chr(c)}{chr(c)}1 {chr(c)}" for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x32400, 256)]
    rng = random.Random(1)
    texts += ["".join(rng.choices([" ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "a", "Ab", "'s", "don't", "1", "!!", "e\u0301", "\u2581", "<|endoftext|>", "\x1c"], k=rng.randrange(1, 14))) for _ in range(20_000)]
    texts += [" " * 1_000_000, "x" * 100_000, "\n" * 300_000 + "a"]
    assert files.ranked and quick.encode_a(texts).equals(plain.encode_a(texts))


def test_a_file_that_merges_otherwise_is_not_ranked(files):
    spec = json.loads(files.byte_level)
    letters = alignment.byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if i != 50256}
    assert alignment.same_by_ranks(spec, ranks)
    spec["model"]["merges"][300], spec["model"]["merges"][301] = spec["model"]["merges"][301], spec["model"]["merges"][300]
    assert not alignment.same_by_ranks(spec, ranks)


@pytest.mark.parametrize("listed", [alignment.LISTED, 50, 0])
def test_alignment(spark, files, listed, monkeypatch):
    t = alignment.tokenizers(files)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-i - 1, x) for i, x in enumerate(ODD)] + [(None, rows[0][1]), (2**60 + 1, "big"), (2**60 + 3, "big"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(alignment, "PARTIAL", 1000)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 50_000)
    table = common.staged(alignment.token_groups(docs, files), "aligned")
    scores = alignment.link_scores(table, len(t.bytes_b), listed).withColumnRenamed("key", "k")
    out = table.join(scores, F.col("key") == F.col("k"), "left").fillna(0, ["n_best", "count_sum"])
    assert got(out) == expected(rows, t)


def test_alignment_of_odd_rows(spark, files):
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    out = alignment.align(odd, files)
    assert got(out) == expected(rows, alignment.tokenizers(files))
    empty = alignment.align(spark.createDataFrame([], SCHEMA), files)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
