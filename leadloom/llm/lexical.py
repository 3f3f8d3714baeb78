"""Ranked lexical search: document impact vectors in buckets of falling length, pruned by Cauchy-Schwarz and by focus coordinates, rescored in integers."""
from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, IntegerType, LongType, StructField, StructType

from leadloom.llm import common

BLOCK_ENTRIES = 200_000         # (item, term) entries of the items that are searched in one go; executors get them all
BUCKET = 2048                   # documents whose vectors are compared at a time
FOCUS = 16                      # terms of an item, heaviest first, whose coordinates are added before the bounds are drawn anew
ROUNDS = (1 / 64, 1 / 8, 1.0)   # shares of the documents, longest vectors first, after which the items' thresholds are shared
SLACK = 1 + 1e-9                # bounds are doubles: what rounding may take off is given back

NO_TERM = np.ones(256, bool)
NO_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]


class Items(NamedTuple):
    """Some items: their ids, and their distinct terms as places in the sorted vocabulary, one item after the other."""
    ids: list
    vocabulary: list[str]
    cuts: np.ndarray
    terms: np.ndarray


class Weighted(NamedTuple):
    """The same with weights, heaviest terms first; terms without weight are left out."""
    ids: list
    cuts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    norms: np.ndarray       # lengths of the items' vectors
    rest: np.ndarray        # for each term the length of what comes after it in its item


def item_blocks(items: DataFrame, entries: int = BLOCK_ENTRIES) -> Iterator[Items]:
    """Items with at least one term, in blocks of at most `entries` terms (one item at least). Rows alike in id and terms are one item."""
    words = F.array_distinct(common.words_of(common.lowered(common.filled("text")), common.PLAIN_WORD))
    rows = items.select("item_id", F.array_sort(words).alias("terms")).filter(F.size("terms") > 0).distinct()
    held, size = [], 0

    def made() -> Items:
        vocabulary = sorted({t for _, terms in held for t in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        return Items([i for i, _ in held], vocabulary, np.cumsum([0, *(len(terms) for _, terms in held)]), np.array([place[t] for _, terms in held for t in terms], np.int64))

    for r in rows.toLocalIterator():
        if held and size + len(r.terms) > entries:
            yield made()
            held, size = [], 0
        held.append((r.item_id, r.terms))
        size += len(r.terms)
    if held:
        yield made()


def term_vectors(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Per document: doc_id, n (all its terms, repeats counted), terms (places in the vocabulary, of those it has), tfs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array([t.encode() for t in shared.value], pa.binary())
        for rows in batches:
            for first, raw, offsets in common.byte_batches(rows.column("text").to_pylist()):
                start, end, of = common.blank_separated(raw, offsets, NO_TERM)
                many = len(offsets) - 1
                lengths = np.zeros(len(start) + 1, np.int32)
                np.cumsum(end - start, out=lengths[1:])
                words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(lengths), pa.py_buffer(LOWER[raw[~NO_TERM[raw]]])])
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
                have = place >= 0
                codes, tfs = np.unique(of[have] * len(known) + place[have], return_counts=True)
                cuts = np.searchsorted(codes, np.arange(many + 1) * len(known)).astype(np.int32)
                yield pa.record_batch({
                    "doc_id": rows.column("doc_id").slice(first, many), "n": pa.array(np.bincount(of, minlength=many)),
                    "terms": pa.ListArray.from_arrays(cuts, pa.array((codes % len(known)).astype(np.int32))),
                    "tfs": pa.ListArray.from_arrays(cuts, pa.array(tfs.astype(np.int64)))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def impact_vectors(vectors: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, terms, impacts, norm of all documents with a term of the vocabulary: buckets of falling norm, each partition in that order."""
    m = F.expr(f"10 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L")
    impact = F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000L * tf + 8L * m))")
    rows = vectors.filter(F.size("terms") > 0).withColumn("m", m).select("doc_id", "terms", impact.alias("impacts"))
    norm = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    rows = rows.withColumn("norm", norm).repartitionByRange(F.desc("norm"), F.xxhash64("doc_id"))
    return rows.sortWithinPartitions(F.desc("norm"))


def weighted(items: Items, df: dict[int, int], n_docs: int) -> Weighted:
    weight = np.zeros(len(items.vocabulary), np.int64)
    for term, n in df.items():
        weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1)))
    of = np.repeat(np.arange(len(items.ids)), np.diff(items.cuts))
    w = weight[items.terms]
    order = np.lexsort((items.terms, -w, of))
    order = order[w[order] > 0]
    terms, w, of = items.terms[order], w[order], of[order]
    cuts = np.searchsorted(of, np.arange(len(items.ids) + 1))
    running = np.concatenate([[0.0], np.cumsum(w.astype(np.float64) ** 2)])     # sums of squared integers, exact below 2**53
    norms = np.sqrt(running[cuts[1:]] - running[cuts[:-1]])
    return Weighted(items.ids, cuts, terms, w, norms, np.sqrt(running[cuts[of + 1]] - running[1:]))


def _postings(pointers: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all postings of `terms`, and which of them each belongs to."""
    start, many = pointers[terms], pointers[terms + 1] - pointers[terms]
    of = np.repeat(np.arange(len(terms)), many)
    return np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + start[of], of


class Search:
    """The best `k` documents of each item among the vectors of one task. `least`: scores that k documents seen elsewhere reach."""

    def __init__(self, items: Weighted, least: np.ndarray, vocabulary: int, k: int, focus: int = FOCUS) -> None:
        self.items, self.least, self.vocabulary, self.k, self.focus = items, least.copy(), vocabulary, k, focus
        self.best: list[list[tuple]] = [[] for _ in items.ids]

    def bucket(self, ids: list, of: np.ndarray, terms: np.ndarray, impacts: np.ndarray, norms: np.ndarray) -> None:
        """Documents by falling length of their vectors, as postings (document, term, impact)."""
        # Cauchy-Schwarz: no document of the bucket can reach the threshold of an item beyond the product of the lengths
        open_items = np.flatnonzero((self.items.norms > 0) & (self.items.norms * norms.max() * SLACK >= self.least))
        if not len(open_items):
            return
        order = np.argsort(terms, kind="stable")
        of, impacts = of[order], impacts[order]
        pointers = np.zeros(self.vocabulary + 1, np.int64)
        np.cumsum(np.bincount(terms, minlength=self.vocabulary), out=pointers[1:])
        squares, many = norms ** 2, len(ids)
        for item in open_items:
            cut = slice(self.items.cuts[item], self.items.cuts[item + 1])
            own, weights = self.items.terms[cut], self.items.weights[cut]
            rest, floor = self.items.rest[cut], max(self.least[item], 1)
            # some more coordinates at a time, and Cauchy-Schwarz for all that are left
            score, seen, alive = np.zeros(many), np.zeros(many), None
            for first in range(0, len(own), self.focus):
                at, which = _postings(pointers, own[first: first + self.focus])
                doc, impact = of[at], impacts[at].astype(np.float64)
                score += np.bincount(doc, impact * weights[first + which], many)
                seen += np.bincount(doc, impact ** 2, many)
                left = rest[min(first + self.focus, len(own)) - 1]
                alive = np.flatnonzero((score + left * np.sqrt(np.maximum(squares - seen, 0))) * SLACK >= floor)
                if not len(alive):
                    break
            else:
                self._rescore(item, alive, ids, of, impacts, pointers, own, weights)

    def _rescore(self, item: int, alive: np.ndarray, ids: list, of: np.ndarray, impacts: np.ndarray, pointers: np.ndarray, own: np.ndarray, weights: np.ndarray) -> None:
        """Exact scores in 64-bit integers of the documents `alive`."""
        place = np.full(len(ids), -1)
        place[alive] = np.arange(len(alive))
        at, which = _postings(pointers, own)
        doc = place[of[at]]
        mine = doc >= 0
        scores = np.zeros(len(alive), np.int64)
        np.add.at(scores, doc[mine], weights[which[mine]] * impacts[at[mine]])
        floor = max(self.least[item], 1)
        if len(alive) > self.k:     # of one bucket at most the documents that reach its own k-th score
            floor = max(floor, np.partition(scores, -self.k)[-self.k])
        found = [(int(scores[i]), ids[alive[i]]) for i in np.flatnonzero(scores >= floor)]
        best = sorted(self.best[item] + found, key=lambda x: (-x[0], x[1] is None, x[1]))[:self.k]
        self.best[item] = best
        if len(best) == self.k:
            self.least[item] = max(self.least[item], best[-1][0])


def _round(vectors: DataFrame, items: Weighted, least: np.ndarray, vocabulary: int, k: int, id_kind: DataType) -> DataFrame:
    """(item, item_id, doc_id, score): what each task finds best, at most k documents an item."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, least))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*shared.value, vocabulary, k)
        for rows in batches:
            for start in range(0, rows.num_rows, BUCKET):
                part = rows.slice(start, BUCKET)
                terms, impacts = part.column("terms"), part.column("impacts")
                search.bucket(part.column("doc_id").to_pylist(), pc.list_parent_indices(terms).to_numpy(), terms.flatten().to_numpy(),
                              impacts.flatten().to_numpy(), part.column("norm").to_numpy())
        rows = [(item, search.items.ids[item], doc, score) for item, best in enumerate(search.best) for score, doc in best]
        columns = zip(*rows) if rows else ([], [], [], [])
        yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["item", "item_id", "doc_id", "score"])

    columns = StructType([StructField("item", IntegerType()), StructField("item_id", id_kind), vectors.schema["doc_id"], StructField("score", LongType())])
    kinds = to_arrow_schema(columns).types
    return vectors.mapInArrow(made, columns)


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, entries: int = BLOCK_ENTRIES, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """The `k` highest-scoring documents of each item: item_id, rank (from 1), doc_id, score; only scores above 0.

    Terms are runs of ASCII letters (in lower case), digits and all beyond ASCII. The score is the product of two vectors: an item's
    weights, floor(1000 ln((2N + 2) / (2 df + 1))), and a document's impacts, which grow with tf and fall with its number of terms. Equal scores rank by
    ascending doc_id, null ids last. Null and empty texts have no terms and are not found; such items have no rows; items alike in id
    and terms are one item; repeated documents count and rank each. An empty table gives no rows; further columns are not read.

    Items come in blocks of bounded size, for which all documents are read. Vectors hold the block's terms only and are
    sorted by their length. The longest are searched first; the scores that k documents reach there bound the rounds after: vectors too short
    for any item are not read, a bucket of vectors is skipped for the items that it cannot reach, the coordinates of an item's heaviest terms
    and the length of what is left bound each document of the others, and only survivors are scored, in integers.
    """
    kind = items.schema["item_id"].dataType
    out = docs.sparkSession.createDataFrame([], StructType([StructField("item_id", kind), StructField("rank", IntegerType()), docs.schema["doc_id"], StructField("score", LongType())]))
    for block in item_blocks(items, entries):
        rows = common.staged(term_vectors(docs, block.vocabulary), "term-vectors")
        counted = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        df = {r.term: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}     # one row per term of the block
        wanted = weighted(block, df, counted.docs)
        vectors = common.staged(impact_vectors(rows, counted.docs, counted.terms), "impact-vectors")
        levels = vectors.agg(F.percentile_approx("norm", F.array(*[F.lit(max(0.0, 1 - share)) for share in rounds]), F.lit(1000)).alias("l")).first().l or []
        least, found, above = np.zeros(len(block.ids), np.int64), None, math.inf
        for level in [*levels[:-1], 0.0][:len(levels)]:
            reach = min((float(s) / n for s, n in zip(least, wanted.norms) if n > 0), default=0.0)
            part = vectors.filter((F.col("norm") >= max(level, reach / SLACK)) & (F.col("norm") < above))
            new = _round(part, wanted, least, len(block.vocabulary), k, kind)
            found = common.staged(_top(new if found is None else found.drop("rank").unionByName(new), k), "found")
            above = level
            for r in found.filter(F.col("rank") == k).select("item", "score").collect():     # one number per item of the block
                least[r.item] = r.score
        if found is not None:
            out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
