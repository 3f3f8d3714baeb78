"""Language model scoring with a hidden Markov model: Baum-Welch counts summed over partitions, scaled forward recursion for whole texts."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

PIECE = 128              # tokens of a training sequence


@dataclass
class Lexicon:
    """The most frequent words: hashes with counts by falling count, and a table to look them up."""
    hashes: np.ndarray
    counts: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray, counts: np.ndarray) -> Lexicon:
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        bits = max(4, int(np.ceil(np.log2(max(len(hashes), 1) * 8))))
        table = np.full(1 << bits, -1, np.int32)
        slots = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        for i, slot in enumerate(slots):
            while table[slot] >= 0:
                slot = (slot + 1) % len(table)
            table[slot] = i
        return cls(hashes, counts, table)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1, np.int32)
        bits = int(np.log2(len(self.table)))
        slot = (h >> np.uint64(64 - bits)).astype(np.int64)
        found = self.table[slot]
        out = np.where((found >= 0) & (self.hashes[found] == h), found, -1)
        rest = np.flatnonzero((found >= 0) & (out < 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.table)
            found = self.table[slot[rest]]
            hit = (found >= 0) & (self.hashes[found] == h[rest])
            out[rest[hit]] = found[hit]
            rest = rest[(found >= 0) & ~hit]
        return out


@dataclass
class Model:
    """states start distribution, transitions, emissions (symbol by state); what base scores and rare words need."""
    lexicon: Lexicon
    symbols: int             # words with a symbol of their own; then the symbols of all others and of the end
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    tokens: int              # N with ends
    kinds: int               # V with the end
    ends: int
    rare_total: float        # tokens and kinds of words without a symbol, and one for what was never seen


def token_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word."""
    start, end, text = common.blank_separated(raw, offsets)
    return common.slice_hash(common.prefix_hash(raw, common.LOWER_CODE), start, end), text


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        found = [np.unique(token_hashes(raw, offsets)[0], return_counts=True) for _, raw, offsets in common.byte_batches(rows.text)]
        if found:
            h, c = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            kinds, place = np.unique(h, return_inverse=True)
            yield pd.DataFrame({"h": kinds.view(np.int64), "c": np.bincount(place, c).astype(np.int64)})


def vocabulary(texts: DataFrame) -> DataFrame:
    """Staged (h, c): hash and count of every word of `texts` (text), counted in each batch before the shuffle."""
    return common.staged(texts.mapInPandas(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")


def frequent(words: DataFrame, most: int) -> Lexicon:
    """The words above a count that at most `most` words reach. The counts are looked at in about 16 steps for each doubling."""
    step = F.floor(F.log2("c") * 16)
    steps = sorted(((r.step, r.n) for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, n in steps:
        if total + n > most:
            break
        total, least = total + n, s
    rows = words.filter(step >= least).select("h", "c").toPandas() if least is not None else pd.DataFrame({"h": np.zeros(0, np.int64), "c": np.zeros(0, np.int64)})
    return Lexicon.build(rows.h.to_numpy(np.int64).view(np.uint64), rows.c.to_numpy(np.int64))


def _ranked(lexicon: Lexicon, raw: np.ndarray, offsets: np.ndarray, symbols: int) -> tuple[np.ndarray, ...]:
    """Symbols of all texts one after the other, each with its end; text of each; and rank, hash and text of the words."""
    h, text = token_hashes(raw, offsets)
    rank = lexicon.find(h)
    n = len(offsets) - 1
    lengths = np.bincount(text, minlength=n) + 1
    stops = np.cumsum(lengths)
    out = np.full(stops[-1] if n else 0, symbols + 1, np.int32)
    out[np.arange(len(text)) + text] = np.where((rank >= 0) & (rank < symbols), rank, symbols)
    return out, lengths, rank, h, text


def _pieces(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sequences of at most PIECE tokens as columns, -1 below their ends."""
    first = np.cumsum(lengths) - lengths
    n = -(-lengths // PIECE)
    start = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * PIECE
    stop = np.minimum(start + PIECE, np.repeat(first + lengths, n))
    at = start[None, :] + np.arange(PIECE)[:, None]
    return np.where(at < stop[None, :], symbols[np.minimum(at, len(symbols) - 1)], -1)


def expectations(pieces: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Expected counts of starts, moves and emissions, and the log likelihood, in one vector.

    Longest pieces first, so that a step takes those still running. Single precision inside a piece, double for the sums.
    """
    pieces = pieces[:, np.argsort(-(pieces >= 0).sum(0), kind="stable")]
    running = (pieces >= 0).sum(1)
    states, steps = len(start), int((running > 0).sum())
    start, move, wide = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)
    alpha, seen, scale = np.zeros((steps, pieces.shape[1], states), np.float32), [], []
    loglik, a = 0.0, None
    for t, n in enumerate(running[:steps]):
        seen.append(wide[pieces[t, :n]])
        a = (np.broadcast_to(start, (n, states)) if a is None else a[:n] @ move) * seen[t]
        scale.append(a.sum(1))
        a = alpha[t, :n] = a / scale[t][:, None]
        loglik += np.log(scale[t], dtype=np.float64).sum()
    b, moves, symbols, weights = np.ones((pieces.shape[1], states), np.float32), np.zeros((states, states)), [], []
    gamma = np.zeros((0, states), np.float32)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        gamma = alpha[t, :n] * b[:n]
        gamma /= np.maximum(gamma.sum(1, keepdims=True), 1e-30)
        weights.append(gamma)
        symbols.append(pieces[t, :n])
        if t:
            e = seen[t] * b[:n] / scale[t][:, None]
            moves += alpha[t - 1, :n].T @ e
            b[:n] = e @ move.T
    flat, weight = np.concatenate([np.zeros(0, np.int64), *symbols]).astype(np.int64), np.concatenate([np.zeros((0, states), np.float32), *weights])
    emitted = np.stack([np.bincount(flat, weight[:, s], minlength=len(emit)) for s in range(states)], 1)
    return np.concatenate([gamma.sum(0, dtype=np.float64), (moves * move).ravel(), emitted.ravel(), [loglik, len(flat)]])


def _estimated(total: np.ndarray, states: int, width: int, prior: np.ndarray) -> tuple[np.ndarray, ...]:
    start = total[:states] + 0.1
    move = total[states: states + states**2].reshape(states, states) + 0.1
    emit = total[states + states**2: -2].reshape(width, states) + 20.0 * prior[:, None]
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def train(texts: DataFrame, states: int = 8, symbols: int = 8192, known: int = 131_072, rounds: int = 8, seed: int = 5) -> tuple[Model, DataFrame]:
    """The model of `texts` (text), and their vocabulary (h, c).

    Every text and token is used: the vocabulary is counted over all, and each Baum-Welch round sums the expected counts of all
    pieces. `symbols` words have a symbol of their own, all others share one; `known` bounds the list of frequent words that is sent to
    the executors (the rest meets its counts in a join).
    """
    spark = texts.sparkSession
    words = vocabulary(texts)
    ends = texts.count()
    sums = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = (sums.n or 0) + ends, sums.v + (ends > 0)
    lexicon = frequent(words, known)
    symbols = min(symbols, len(lexicon.hashes))
    width = symbols + 2
    shared = spark.sparkContext.broadcast(lexicon)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, raw, offsets in common.byte_batches(rows.text, 2_000_000):
                out, lengths, *_ = _ranked(shared.value, raw, offsets, symbols)
                yield pd.DataFrame({"symbols": [out.astype(np.int32).tobytes()], "lengths": [lengths.astype(np.int64).tobytes()]})

    data = common.staged(texts.mapInPandas(coded, "symbols binary, lengths binary"), "symbols").rdd
    own = lexicon.counts[:symbols].astype(float)
    rare_tokens = float((sums.n or 0) - own.sum())
    prior = np.r_[own, rare_tokens + 1.0, ends + 1.0]
    prior /= prior.sum()
    rng = np.random.default_rng(seed)
    start, move = np.full(states, 1 / states), np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    emit = prior[:, None] * np.exp(rng.normal(0, 1.0, (width, states)))
    emit /= emit.sum(0)

    for _ in range(rounds if tokens else 0):
        now = spark.sparkContext.broadcast((start, move, emit))

        def summed(rows) -> Iterator[np.ndarray]:
            total = np.zeros(states + states**2 + width * states + 2)
            for r in rows:
                total += expectations(_pieces(np.frombuffer(r.symbols, np.int32), np.frombuffer(r.lengths, np.int64)), *now.value)
            yield total

        total = common.reduced(data.mapPartitions(summed), lambda a, b: a + b)
        start, move, emit = _estimated(total, states, width, prior)
        now.destroy()
    rare_kinds = kinds - (ends > 0) - symbols
    return Model(lexicon, symbols, start, move, emit, tokens, kinds, ends, rare_tokens + rare_kinds + 1.0), words


def forward(symbols: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each symbol sequence, by the scaled forward recursion over its whole length; longest first, so that a step takes those still running."""
    order = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[order]
    running = np.searchsorted(-lengths[order], -np.arange(1, (lengths.max() if len(lengths) else 0) + 1), side="right")
    out, a = np.zeros(len(lengths)), None
    for t, n in enumerate(running):
        a = (np.broadcast_to(model.start, (n, len(model.start))) if a is None else a[:n] @ model.move) * model.emit[symbols[first[:n] + t]]
        scale = a.sum(1)
        a = a / scale[:, None]
        out[:n] += np.log10(scale)
    back = np.empty(len(lengths))
    back[order] = out
    return back


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, base_score, score (log10).

    Words that the executors' list does not have are looked up in `words` by a join. A word without a symbol of its own has
    the probability of their common symbol times its share of them, (c + 1) / rare_total. A null text counts as empty and has
    its end only. Rows alike in doc_id and text are one document; null ids are scored as any. Further columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = common.filled("text")
    # ids go by pandas as text: beside a null it would round large numbers
    rows = docs.select(F.xxhash64("doc_id", text).alias("key"), F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for rows in batches:
            for first, raw, offsets in common.byte_batches(rows.text, 4_000_000):
                symbols, lengths, rank, h, of = _ranked(m.lexicon, raw, offsets, m.symbols)
                n = len(offsets) - 1
                here = slice(first, first + n)
                listed = rank >= 0
                logs = np.bincount(of[listed], np.log10(m.lexicon.counts[rank[listed]] + 1.0), minlength=n)
                common_symbol = listed & (rank >= m.symbols)
                rare_logs = np.bincount(of[common_symbol], np.log10(m.lexicon.counts[rank[common_symbol]] + 1.0), minlength=n)
                order = np.lexsort((h[~listed], of[~listed]))
                ho, oo = h[~listed][order], of[~listed][order]
                new = np.ones(len(ho), bool)
                new[1:] = (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.r_[at, len(ho)])
                cuts = np.searchsorted(oo[at], np.arange(n + 1))
                ids = ho[at].view(np.int64)
                yield pd.DataFrame({
                    "key": rows.key.to_numpy()[here], "doc_id": rows.doc_id.to_numpy()[here], "n_tokens": lengths,
                    "listed": np.bincount(of[listed], minlength=n), "logs": logs, "rare_logs": rare_logs,
                    "n_rare": np.bincount(of[(rank < 0) | (rank >= m.symbols)], minlength=n), "path": forward(symbols, lengths, m),
                    "rest": [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])], "times": [times[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:])]})

    made = common.staged(rows.mapInPandas(scored, "key long, doc_id string, n_tokens long, listed long, logs double, rare_logs double, n_rare long, path double, "
                                                  "rest array<long>, times array<int>").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)), "scores")
    rest = made.select("key", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("key", F.col("r.rest").alias("h"), F.col("r.times").alias("times"))
    # never seen: log10(0 + 1) = 0 and not known, so that only rows with a count matter
    met = rest.join(words, "h").groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rest_logs"), F.sum("times").alias("rest_known"))
    from pyspark.sql import Window
    alike = F.count("*").over(Window.partitionBy("key"))
    joined = made.drop("rest", "times").withColumn("alike", alike).join(met, "key", "left")
    more, known = F.coalesce("rest_logs", F.lit(0.0)) / F.col("alike"), F.coalesce("rest_known", F.lit(0)) / F.col("alike")
    end_logs, ends = float(np.log10(model.ends + 1.0)), int(model.ends > 0)
    base = F.col("logs") + more + F.lit(end_logs) - F.col("n_tokens") * float(np.log10(model.tokens + model.kinds + 1.0))
    full = F.col("path") + F.col("rare_logs") + more - F.col("n_rare") * float(np.log10(model.rare_total))
    return joined.select("doc_id", "n_tokens", (F.col("listed") + known + ends).cast("long").alias("n_known"), base.alias("base_score"), full.alias("score"))
