"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

WIDTH = 1 << 17          # hashed words and stems
STEMS = (4, 6)           # bytes
PARTS = 12               # of the bounded training sample
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
STOP_BYTE = np.zeros(256, bool)
STOP_BYTE[list(b".!?\n")] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of some texts: feature (word or stem) and sentence of each feature; text, start and end of each sentence.

    Sentences end at . ! ? and line ends; only those with words count, and a text without any has one without words.
    """
    solid = WORD_BYTE[raw] if len(raw) else np.zeros(0, bool)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, solid[:-1]][: len(raw)], np.r_[solid[1:], False][: len(raw)]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    stops = np.cumsum(STOP_BYTE[raw]) if len(raw) else np.zeros(0, np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (stops[start[1:]] != stops[start[:-1]]) | (text[1:] != text[:-1])
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)][: len(first)] - 1
    of, begin, stop = text[first], start[first], end[last] if len(first) else np.zeros(0, np.int64)
    empty = np.setdiff1d(np.arange(len(offsets) - 1), of)
    of, begin, stop = np.r_[of, empty], np.r_[begin, offsets[empty]], np.r_[stop, offsets[empty]]
    prefix = common.prefix_hash(raw, common.LOWER_CODE)
    names = [common.slice_hash(prefix, start, end)]
    for cut in STEMS:                   # inflected forms share the first bytes
        names.append(np.where(end - start > cut, common.slice_hash(prefix, start, np.minimum(start + cut, end)) + np.uint64(cut), names[0]))
    word = (np.concatenate(names) % np.uint64(WIDTH)).astype(np.int64)
    return word, np.tile(sentence, len(names)), of, begin, stop


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _logits(weights: np.ndarray, bias: float, word: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    return bias + np.bincount(sentence, weights[word], minlength=n)


def gradient(block: tuple[np.ndarray, ...], weights: np.ndarray, bias: float) -> np.ndarray:
    """Sums over documents: gradient by word, by bias, loss, documents. With P = 1 - prod(1 - p) the loss of a sentence's logit passes through the sum of softplus."""
    word, sentence, of, label = block
    z = _logits(weights, bias, word, sentence, len(of))
    total = np.maximum(np.bincount(of, _softplus(z), minlength=len(label)), 1e-9)
    outer = np.where(label == 1, -1.0 / np.expm1(np.minimum(total, 500.0)), 1.0)
    dz = outer[of] / (1.0 + np.exp(-z))
    loss = np.where(label == 1, -np.log(-np.expm1(-total)), total).sum()
    return np.concatenate([np.bincount(word, dz[sentence], minlength=WIDTH), [dz.sum(), loss, len(label)]])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feature arrays of some labelled documents as one row: a word counts once in a sentence."""
    for rows in batches:
        for first, raw, offsets in common.byte_batches(rows.text):
            word, sentence, of, _, _ = features(raw, offsets)
            pairs = np.unique(sentence * WIDTH + word)
            label = rows.toxic.to_numpy()[first: first + len(offsets) - 1].astype(np.int8)
            yield pd.DataFrame({"word": [(pairs % WIDTH).astype(np.int32).tobytes()], "sentence": [(pairs // WIDTH).astype(np.int32).tobytes()],
                                "of": [of.astype(np.int32).tobytes()], "label": [label.tobytes()]})


def _unpacked(row) -> tuple[np.ndarray, ...]:
    return (*(np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("word", "sentence", "of")), np.frombuffer(row["label"], np.int8))


def _sum(parts: Iterator[np.ndarray], keep) -> Iterator[np.ndarray]:
    total = np.zeros(WIDTH + 3)
    for p in parts:
        total += p
    yield total[keep]


def train(labelled: DataFrame, max_documents: int = 20_000, steps: int = 100, rate: float = 0.1, least_documents: int = 3,
          ridge: float = 0.1, lasso: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights by word and bias from `labelled` (doc_id, text, toxic).

    A bounded sample is used: `max_documents` rows, in the order of a hash of doc_id. Each step sums the gradient over all of the
    sample's blocks on the executors; the driver adds PARTS vectors of at most WIDTH numbers. Words of fewer than `least_documents` sampled documents
    have no weight. Without rows of both labels every score is the prior's.
    """
    from pyspark import StorageLevel
    spark = labelled.sparkSession
    ids = labelled.select("doc_id").filter(F.col("toxic").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    ids = common.staged(ids, "train-ids")
    chosen = labelled.filter(F.col("toxic").isNotNull()).join(ids, "doc_id", "left_semi").select(common.filled("text").alias("text"), "toxic")
    blocks = common.staged(chosen.mapInPandas(_blocks, "word binary, sentence binary, of binary, label binary"), "blocks")
    data = blocks.repartition(PARTS).rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def presence(rows):
        for r in rows:
            word, sentence, of, label = _unpacked(r)
            seen = np.unique(of[sentence] * WIDTH + word) % WIDTH
            yield np.concatenate([np.bincount(seen, minlength=WIDTH), [len(of), label.sum(), len(label)]]).astype(float)

    # PARTS vectors come to the driver in each step: their number and length are fixed
    summed = lambda fn, keep: data.mapPartitions(lambda rows: _sum(fn(rows), keep)).reduce(lambda a, b: a + b)
    try:
        counts = summed(presence, slice(None))
        sentences, positive, n = counts[-3:]
        weights = np.zeros(WIDTH)
        bias = float(np.log(max(positive, 0.5) / max(n, 1.0)) - np.log(max(sentences / max(n, 1.0), 1.0)))
        if not 0 < positive < n:
            return weights, bias
        used = np.flatnonzero(counts[:WIDTH] >= least_documents)
        keep = np.r_[used, WIDTH, WIDTH + 1, WIDTH + 2]
        w, m, v = np.zeros(len(used)), np.zeros(len(used) + 1), np.zeros(len(used) + 1)
        for t in range(1, steps + 1):
            weights[used] = w
            shared = spark.sparkContext.broadcast((weights.astype(np.float32), bias))
            total = summed(lambda rows: (gradient(_unpacked(r), shared.value[0].astype(float), shared.value[1]) for r in rows), keep)
            shared.destroy()
            g = np.r_[total[: len(used)] + ridge * w + lasso * np.sign(w), total[len(used)]] / n
            m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.98**t)) + 1e-6)
            w, bias = w - step[:-1], bias - float(step[-1])
        weights[used] = w
        return weights, bias
    finally:
        data.unpersist()


FOUND = "score double, n_sentences int, spans array<struct<start:int,stop:int,score:double>>"


def score_column(spark, model: tuple[np.ndarray, float], least: float = 0.5):
    """A column function text -> struct(score, n_sentences, spans): spans are bytes of sentences that score `least` or more."""
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, bias = shared.value
        for texts in batches:
            scores, counts, spans = np.zeros(len(texts)), np.zeros(len(texts), np.int32), [[] for _ in range(len(texts))]
            for first, raw, offsets in common.byte_batches(texts):
                word, sentence, of, begin, stop = features(raw, offsets)
                pairs = np.unique(sentence * WIDTH + word)
                z = _logits(weights, bias, pairs % WIDTH, pairs // WIDTH, len(of))
                n = len(offsets) - 1
                scores[first: first + n] = -np.expm1(-np.bincount(of, _softplus(z), minlength=n))
                counts[first: first + n] = np.bincount(of, minlength=n)
                p = 1.0 / (1.0 + np.exp(-z))
                for i in np.flatnonzero(p >= least):
                    spans[first + of[i]].append({"start": int(begin[i] - offsets[of[i]]), "stop": int(stop[i] - offsets[of[i]]), "score": float(p[i])})
            yield pd.DataFrame({"score": scores, "n_sentences": counts, "spans": spans})
    return found


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Rows (`row`: the given row as a struct, score, predicted, n_sentences, spans). Null texts count as empty and have one sentence without words.

    The score is 1 - prod(1 - p) over the sentences, from the text alone; rows are scored one by one, so null ids, repeated rows and empty
    tables need no rule, and further columns may have any name.
    """
    scored = docs.select(F.struct("*").alias("row")) \
        .withColumn("found", score_column(docs.sparkSession, model)(common.filled("row.text")))
    return scored.select("row", F.col("found.score").alias("score"), (F.col("found.score") >= 0.5).cast("int").alias("predicted"),
                         F.col("found.n_sentences").alias("n_sentences"), F.col("found.spans").alias("spans"))
