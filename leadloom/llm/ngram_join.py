"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, each pair verified once."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
RANGES = 64
SLICE_BITS = 6                    # the table of frequencies is added up in 64 slices
BATCH = 1 << 18                   # bytes whose sets are made at once
# texts come to Python in small Arrow batches
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of all texts and their text, sorted by both. A shorter text has its whole sequence as one."""
    start, end, text = common.blank_separated(raw, offsets)
    h = common.slice_hash(common.prefix_hash(raw, common.LOWER_CODE), start, end)
    n = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n

    def joined(at: np.ndarray, k: int) -> np.ndarray:
        total = np.full(len(at), k, np.uint64) * _ODD[63]
        for j in range(k):
            total += h[at + j] * _ODD[j]
        return common.mixed(total)

    full = np.flatnonzero(text[: len(text) - words + 1] == text[words - 1:]) if len(text) >= words else np.zeros(0, np.int64)
    hashes, of = [joined(full, words)], [text[full]]
    for k in range(1, words):
        short = np.flatnonzero(n == k)
        hashes.append(joined(first[short], k))
        of.append(short)
    hashes, of = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], of[new]


def _cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def document_frequencies(texts: DataFrame, words: int, bits: int) -> np.ndarray:
    """How many documents have a shingle, counted over all in 2**bits cells of the hash (up to 65535): the order of rarity."""
    slices = 1 << min(bits, SLICE_BITS)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.int32)
        for rows in batches:
            for _, raw, offsets in common.byte_batches(rows.text, BATCH):
                np.add.at(total, _cells(shingle_sets(raw, offsets, words)[0], bits), 1)
        yield pd.DataFrame({"slice": range(slices), "cells": [x.tobytes() for x in np.minimum(total, 65535).astype(np.uint16).reshape(slices, -1)]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for rows in batches:
            for i, cells in zip(rows.slice, rows.cells):
                total[i] = np.minimum(total.get(i, 0) + np.frombuffer(cells, np.uint16).astype(np.int32), 65535)
        for i, cells in total.items():
            yield pd.DataFrame({"slice": [i], "cells": [cells.astype(np.uint16).tobytes()]})

    # tables, not RDDs: a step on rows beside one on batches would take a second Python worker for each core
    kinds = "slice int, cells binary"
    out = np.zeros((slices, (1 << bits) // slices), np.uint16)
    for row in texts.mapInPandas(counted, kinds).repartition("slice").mapInPandas(added, kinds).collect():
        out[row.slice] = np.frombuffer(row.cells, np.uint16)
    return out.reshape(-1)


def _overlap(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection with intersection / union >= num / den for two sets of `total` elements together."""
    return -(-num * total // (num + den))


def prefixes(docs: DataFrame, shared: Broadcast, words: int, num: int, den: int) -> DataFrame:
    """Staged: doc_id, key (of the text), cls (hash of the set, null without words), n, prefix (hashes, rarest first), ranges (elements by hash range)."""
    bits = int(np.log2(len(shared.value)))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for first, raw, offsets in common.byte_batches(rows.text, BATCH):
                hashes, of = shingle_sets(raw, offsets, words)
                many = len(offsets) - 1
                n = np.bincount(of, minlength=many)
                order = np.lexsort((hashes, shared.value[_cells(hashes, bits)], of))
                cut = np.cumsum(n) - n
                length = np.where(n > 0, n - (-(-num * n // den)) + 1, 0)
                ranked = hashes[order].view(np.int64)
                running = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(common.mixed(hashes ^ _ODD[61]), out=running[1:])
                cls = common.mixed(running[cut + n] - running[cut] + n.astype(np.uint64) * _ODD[62]).view(np.int64)
                yield pd.DataFrame({
                    "doc_id": rows.doc_id.to_numpy()[first: first + many], "key": rows.key.to_numpy()[first: first + many],
                    "cls": pd.array(cls, "Int64").copy() if n.all() else pd.arrays.IntegerArray(cls.copy(), n == 0),
                    "n": n, "prefix": [ranked[a: a + b] for a, b in zip(cut, length)],
                    "ranges": list(np.bincount(of * RANGES + (hashes >> np.uint64(58)).astype(np.int64), minlength=many * RANGES).reshape(many, RANGES).astype(np.int32))})

    kind = docs.schema["doc_id"].dataType      # ids go by pandas as text: beside a null it would round large numbers
    made_of = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "key", "text").mapInPandas(made, "doc_id string, key long, cls long, n long, prefix array<long>, ranges array<int>")
    return common.staged(made_of.withColumn("doc_id", F.col("doc_id").cast(kind)), "prefixes")


def _verify(pairs: DataFrame, texts: DataFrame, shared: Broadcast, words: int, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b) those that link. Suffix filter: after the first shared element in the order, the elements left are counted in hash ranges; the ranges' minima bound the overlap. Then the sets are compared."""
    bits = int(np.log2(len(shared.value)))

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            seen = dict(zip(rows.a, rows.text_a)) | dict(zip(rows.b, rows.text_b))
            names = list(seen)
            for first, raw, offsets in common.byte_batches(seen.values(), BATCH):
                hashes, of = shingle_sets(raw, offsets, words)
                order = np.lexsort((hashes, shared.value[_cells(hashes, bits)], of))
                cuts = np.searchsorted(of, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    sets[names[first + i]] = hashes[cuts[i]: cuts[i + 1]], hashes[order[cuts[i]: cuts[i + 1]]]
            keep = np.zeros(len(rows), bool)
            for k, (a, b, i, j) in enumerate(zip(rows.a, rows.b, rows.pos_a, rows.pos_b)):
                (sorted_a, ranked_a), (sorted_b, ranked_b) = sets[a], sets[b]
                need = int(_overlap(len(sorted_a) + len(sorted_b), num, den))
                left = [np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=RANGES) for x in (ranked_a[i + 1:], ranked_b[j + 1:])]
                if 1 + np.minimum(*left).sum() >= need:
                    keep[k] = len(np.intersect1d(sorted_a, sorted_b, assume_unique=True)) >= need
            yield rows.loc[keep, ["a", "b"]]

    joined = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a") \
        .join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    return common.staged(joined.mapInPandas(links, "a long, b long"), "links")


def _candidates(left: DataFrame, right: DataFrame, num: int, den: int, extra) -> DataFrame:
    """Pairs of postings (token, cls, n, pos) that pass the length and positional filters, once for each pair with the first shared positions."""
    a, b = left.alias("x"), right.alias("y")
    na, nb, i, j = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    length = F.least(na, nb) * den >= F.greatest(na, nb) * num
    positional = (1 + F.least(na - i, nb - j) - 1) * (num + den) >= (na + nb) * num
    met = a.join(b, (F.col("x.token") == F.col("y.token")) & extra & length & positional)
    return met.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).agg(F.min("x.pos").alias("pos_a"), F.min("y.pos").alias("pos_b"))


def _within_ranges(pairs: DataFrame, shapes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose sets can overlap enough: the smaller counts of their hash ranges add up to the least overlap."""
    of = lambda c: shapes.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("ranges").alias(f"ranges_{c}"))
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    most = F.aggregate(F.zip_with("ranges_a", "ranges_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return joined.filter(most * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b", "pos_a", "pos_b")


def _texts(rows: DataFrame, pairs: DataFrame, owners: DataFrame, filter_bits: int) -> DataFrame:
    """Staged (cls, text): one text of each class in `pairs`."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    needed = common.staged(owners.join(wanted, "cls", "left_semi").select("cls", "owner.doc_id", "owner.key"), "needed")
    flags = rows.sparkSession.sparkContext.broadcast(common.bitmap(needed, "key", filter_bits))

    @F.pandas_udf("boolean")
    def maybe(keys: pd.Series) -> pd.Series:
        return pd.Series(common.flagged(flags.value, keys.to_numpy(np.int64)))

    n = needed.alias("n")
    found = rows.filter(maybe("key")).alias("r").join(n, F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("r.key") == F.col("n.key")))
    out = common.staged(found.select("n.cls", "r.text").dropDuplicates(["cls"]), "texts")
    flags.destroy()
    return out


def _similar_groups(docs: DataFrame, words: int, similarity: tuple[int, int], cell_bits: int, filter_bits: int) -> DataFrame:
    num, den = similarity
    rows = docs.select("doc_id", common.text_key(common.filled("text")).alias("key"), common.filled("text").alias("text"))
    frequencies = docs.sparkSession.sparkContext.broadcast(document_frequencies(rows.select("text"), words, cell_bits))
    sets = prefixes(rows, frequencies, words, num, den)

    postings = sets.filter("n > 0").select("cls", "n", F.posexplode_outer("prefix").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    tokens = postings.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min("pos").alias("first")).filter("low <> high")
    met = common.staged(postings.join(tokens.select("token", "first"), "token").distinct(), "postings")
    early = met.filter("pos = first")
    pivots = early.join(early.groupBy("token").agg(F.min("cls").alias("pivot")), "token").filter("cls = pivot").select("token", "cls", "n", "pos")

    owners = sets.filter("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("owner"))
    owners = common.staged(owners, "owners")
    shapes = common.staged(sets.filter("n > 0").select("cls", "n", "ranges").dropDuplicates(["cls"]), "shapes")

    def links(pairs: DataFrame) -> DataFrame:
        near = common.staged(_within_ranges(pairs, shapes, num, den), "pairs")
        return _verify(near, _texts(rows, near, owners, filter_bits), frequencies, words, num, den)

    first = links(_candidates(met, pivots, num, den, F.col("x.cls") != F.col("y.cls")))
    labels = common.components(first)
    labelled = common.staged(met.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")), "labelled")
    split = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token")
    split = common.staged(labelled.join(split, "token", "left_semi"), "split")
    apart = (F.col("x.label") != F.col("y.label")) & (F.col("x.cls") < F.col("y.cls"))
    second = links(_candidates(split, split, num, den, apart))
    frequencies.destroy()
    labels = common.components(first.unionByName(second))

    named = owners.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    groups = named.groupBy("label").agg(F.min("owner").alias("keeper"))
    classes = common.staged(named.select("cls", "label").join(groups, "label").select(F.col("cls").alias("c"), "keeper"), "classes")
    out = sets.select("doc_id", "key", "cls", "n").join(classes, F.col("cls") == F.col("c"), "left")
    alone = F.col("n") == 0
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "cls", F.when(alone, F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("component_id"),
                      (alone | (F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("key") == F.col("keeper.key")))).alias("keeper"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), cell_bits: int = 21, filter_bits: int = 24) -> DataFrame:
    """One row per document: doc_id, key (of the text), n_shingles, cls (hash of the set), component_id, keeper (whether this document stands for its group).

    Words are what stands between blanks, in lower case (A-Z). Documents with equal sets are one class; classes link when the
    Jaccard similarity of their sets reaches similarity[0] / similarity[1]. Groups are connected components; their id is the
    smallest doc_id, and the keeper the document with it (of null ids the one with the smallest key). Null texts and texts without
    words have no set and link with nothing. Rows alike in doc_id and text are one document. Empty tables give no rows; further columns are not read.

    Elements are ordered by document frequency; two similar sets share an element of their prefixes, the rarest
    n - ceil(t * n) + 1. Candidates come in two rounds, so that a large group of near copies does not meet all with all: first every
    class with the one that has fewest rarer elements before the shared one (the likely original); then, exactly, all pairs of
    postings whose classes are not yet connected. Before texts travel, the counts of a pair's elements in hash ranges must
    allow the overlap. Texts travel only for classes of such pairs; the map in front of that shuffle has 2**filter_bits flags, and the join after it is exact.
    """
    with common.settings(docs.sparkSession, SETTINGS):
        return _similar_groups(docs, words, similarity, cell_bits, filter_bits)


def drop_similar(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each group of near copies; all columns as they are, whatever their names."""
    gone = common.staged(similar_groups(docs, **how).filter("NOT keeper").select("doc_id", "key").distinct(), "similar")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), common.text_key(common.filled("text")).alias("k"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left_anti").select("row.*")
