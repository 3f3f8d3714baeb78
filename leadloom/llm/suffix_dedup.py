"""Removal of repeated byte strings: reads cut at minimizers, their collection sorted column by column as a Burrows-Wheeler transform.

Passages between content-defined cuts that a smaller document has too are settled first, whole: windows inside them are covered, and
every such window also stands in the smaller document, so that no other document needs them here. What is left, the edges of
passages and short repeats, is decided window by window.

Every window of WINDOW bytes belongs to the smallest scrambled hash of the GRAM-byte strings in it, so equal windows meet wherever
they stand. Neighbouring windows with the same minimizer make one read of at most 2 * WINDOW - GRAM bytes. Only reads whose minimizer
occurs in two documents leave their task. Where all reads of a minimizer are equal, the smallest document is known at once; the
others are sorted as a multi-document collection.
"""
from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

WINDOW, GRAM = 50, 35             # a longer minimizer brings together fewer reads that merely share some words
SPAN = WINDOW - GRAM + 1          # grams in a window, and windows in a read at most
LAST = 2**63 - 1                  # stands for a null doc_id: after all others
EDGE, CUT_EVERY = 20, 64          # passages are cut at strings of EDGE bytes, CUT_EVERY bytes apart on average
BATCH = 1 << 16                   # bytes whose arrays stay in a core's cache
BLOCK = 3 << 20                   # characters of texts whose hashes are sent together and marked together
ROWS = 50_000                     # rows gathered before they leave a task's Python
# texts come to Python in small Arrow batches, a block of texts by itself, not 4,096 blocks decoded at once; a step's shuffle files go when its table is written
SETTINGS = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.enableNestedColumnVectorizedReader": "false",
            "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# a writer of blocks holds one row group, which is looked at after some blocks instead of 100
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4"}


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span:]) if span < width else h


def reads(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of some texts: minimizer, text, first byte, windows, and hash of each read."""
    if len(raw) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64))
    prefix = common.prefix_hash(raw)
    down = common.powers(len(prefix))[1]
    least = _sliding_min(common.mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: len(raw) - GRAM + 1]), SPAN)
    n = len(least)                                    # windows, those over two texts included
    size = np.diff(offsets)
    inside = np.zeros(n + 1, np.int32)
    holds = size >= WINDOW
    np.add.at(inside, offsets[:-1][holds], 1)
    np.add.at(inside, (offsets[1:] - WINDOW + 1)[holds], -1)
    inside = np.cumsum(inside[:n]) > 0
    new = inside.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
    edges = offsets[:-1][holds]
    new[edges] = True
    start = np.flatnonzero(new)
    text = np.searchsorted(offsets, start, side="right") - 1
    stop = np.minimum(np.r_[start[1:], n], offsets[text + 1] - WINDOW + 1)
    pieces = -(-(stop - start) // SPAN)               # long runs occur in periodic text
    at = np.repeat(start, pieces) + (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPAN
    windows = np.minimum(np.repeat(stop, pieces) - at, SPAN)
    # minima crowd at the low end: scrambled again, the keys spread over all ranges
    return common.mixed(least[at]), np.repeat(text, pieces), at, windows, common.slice_hash(prefix, at, at + windows + WINDOW - 1)


def passages(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, text, start and stop of each passage: from a cut over the next one to the second next and the EDGE bytes that made it a cut.

    Cuts are the EDGE-byte strings whose hash ends in zeros, and the ends of the text; passages overlap and have WINDOW bytes at least.
    """
    if len(raw) < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    prefix = common.prefix_hash(raw)
    grams = common.mixed((prefix[EDGE:] - prefix[:-EDGE]) * common.powers(len(prefix))[1][: len(raw) - EDGE + 1])
    cut = np.flatnonzero(grams & np.uint64(CUT_EVERY - 1) == 0)
    text = np.searchsorted(offsets, cut, side="right") - 1
    inside = cut + EDGE <= offsets[text + 1]
    long = np.flatnonzero(np.diff(offsets) >= WINDOW)
    cut, text = np.r_[cut[inside], offsets[long], offsets[long + 1] - EDGE], np.r_[text[inside], long, long]
    order = np.lexsort((cut, text))
    cut, text = cut[order], text[order]
    start, stop = cut[:-2], cut[2:] + EDGE
    good = (text[:-2] == text[2:]) & (stop - start >= WINDOW)
    start, stop = start[good], stop[good]
    return common.slice_hash(prefix, start, stop), text[:-2][good], start, stop


def blocks_of(docs: DataFrame) -> DataFrame:
    """Staged: block, and doc, key and text (arrays) of about BLOCK characters of texts, which every later step finds together again."""
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for rows in batches:
            for row in zip(rows.doc, rows.key, rows.text):
                held.append(row)
                size += len(row[2])
                if size >= BLOCK:
                    yield whole(held)
                    held, size = [], 0
        if held:
            yield whole(held)

    def whole(held: list[tuple]) -> pd.DataFrame:
        doc, key, text = zip(*held)
        return pd.DataFrame({"block": [int.from_bytes(os.urandom(8)) >> 1], "doc": [list(doc)], "key": [list(key)], "text": [list(text)]})

    with common.settings(docs.sparkSession, ROW_GROUPS):
        return common.staged(docs.select("doc", "key", "text").mapInPandas(packed, "block long, doc array<long>, key array<long>, text array<string>"), "blocks")


def _ranged(h: np.ndarray, ranges: int) -> tuple[np.ndarray, np.uint64]:
    """Where each of `ranges` hash ranges begins in sorted hashes, and the bits below those that name a range."""
    top = np.uint64(64 - int(np.log2(ranges)))
    return np.searchsorted(h >> top, np.arange(ranges + 1, dtype=np.uint64)), top


def _among(x: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Which of `x` are among `kinds`, which are sorted."""
    at = np.searchsorted(kinds, x)
    inside = at < len(kinds)
    inside[inside] = kinds[at[inside]] == x[inside]
    return inside


def repeated(blocks: DataFrame, ranges: int, bits: int) -> tuple[DataFrame, np.ndarray]:
    """Which minimizers and passages occur in two documents, found exactly for each of `ranges` hash ranges.

    A block sends each of its hashes once, as packed numbers, so a frequent one costs a number a block. Minimizers, the many, go back as a bit for each
    hash of a block: staged rows of r, block and flags. Of passages only the flags by the top `bits` bits of their hashes, a fixed
    number of bits, come to the driver; a crowded table of flags lets more passages through and changes no result.
    """
    def packed(shift: int, block: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        h, doc = np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
        many = doc[first] != doc[np.r_[first[1:], len(h)] - 1] if len(h) else np.zeros(0, bool)
        h = h[first]
        cuts, top = _ranged(h, ranges)
        low = (h >> (top - np.uint64(32))).astype(np.uint32)
        keep = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
        return pd.DataFrame({"r": [r + shift for r in keep], "block": block, "low": [low[cuts[r]: cuts[r + 1]].tobytes() for r in keep],
                             "many": [np.packbits(many[cuts[r]: cuts[r + 1]]).tobytes() for r in keep]})

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for block, doc, texts in zip(rows.block, rows.doc, rows.text):
                held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
                for first, raw, offsets in common.byte_batches(texts, BATCH):
                    for kind, found in enumerate((reads(raw, offsets), passages(raw, offsets))):
                        held[kind].append((found[0], doc[first + found[1]]))
                yield from (packed(shift, block, found) for shift, found in zip((0, ranges), held))

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        low = [np.frombuffer(x, np.uint32) for x in rows.low]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(x)).astype(bool) for x, m in zip(low, rows.many)]
        kinds, times = np.unique(np.concatenate(low + [x[m] for x, m in zip(low, many)]), return_counts=True)
        often, r = kinds[times > 1], rows.r.iloc[0]
        if r < ranges:
            return pd.DataFrame({"r": r, "block": rows.block, "flags": [np.packbits(_among(x, often)).tobytes() for x in low]})
        part = bits - int(np.log2(ranges))
        flags = np.zeros(1 << part, bool)
        flags[often >> np.uint32(32 - part)] = True
        return pd.DataFrame({"r": [r], "block": [0], "flags": [np.packbits(flags).tobytes()]})

    out = np.zeros((ranges, 1 << (bits - int(np.log2(ranges)) - 3)), np.uint8)
    hashes = blocks.select("block", "doc", "text").mapInPandas(sent, "r int, block long, low binary, many binary")
    flags = common.staged(hashes.groupBy("r").applyInPandas(joined, "r int, block long, flags binary"), "flags")
    for row in flags.filter(F.col("r") >= ranges).select("r", "flags").toLocalIterator():
        out[row.r - ranges] = np.frombuffer(row.flags, np.uint8)
    return flags.filter(F.col("r") < ranges), out.reshape(-1)


def _flags(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """2**bits flags of the hashes in `column` by their top bits. Words of 64 flags are put together by an aggregate, so that no task holds a table of flags and no further Python workers start."""
    words = rows.select(F.expr(f"shiftrightunsigned({column}, {70 - bits})").alias("w"), F.expr(f"shiftleft(1L, cast(63 - (shiftrightunsigned({column}, {64 - bits}) & 63) as int))").alias("f"))
    found = words.groupBy("w").agg(F.bit_or("f").alias("f")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["w"].to_numpy()] = found["f"].to_numpy()
    return out.astype(">i8").view(np.uint8)


def _flagged(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(64 - (int(len(flags)).bit_length() + 2))).astype(np.int64)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _gathered(parts: Iterator[dict[str, list | np.ndarray]]) -> Iterator[pd.DataFrame]:
    """Small batches of rows put together to some of about ROWS."""
    held: list[dict[str, list | np.ndarray]] = []
    for part in parts:
        held.append(part)
        if sum(len(p["doc"]) for p in held) >= ROWS:
            yield _joined(held)
            held = []
    if held:
        yield _joined(held)


def _joined(held: list[dict[str, list | np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({c: [x for p in held for x in p[c]] if isinstance(held[0][c], list) else np.concatenate([p[c] for p in held]) for c in held[0]})


READ = "doc long, key long, pos int, windows int, m long, h long, bytes binary"


def settled_passages(blocks: DataFrame, flags: np.ndarray) -> DataFrame:
    """Staged: block, place in it, doc, key and span (start * 2**32 + stop) of passages that a smaller document has too."""
    shared = blocks.sparkSession.sparkContext.broadcast(flags)

    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        for rows in batches:
            for block, doc, key, texts in zip(rows.block, rows.doc, rows.key, rows.text):
                for first, raw, offsets in common.byte_batches(texts, BATCH):
                    found = passages(raw, offsets)
                    keep = _flagged(shared.value, found[0])
                    h, text, start, stop = (x[keep] for x in found)
                    yield {"block": np.full(len(h), block), "at": (first + text).astype(np.int32), "doc": doc[first + text], "key": key[first + text],
                           "h": h.view(np.int64), "span": (start - offsets[text] << 32) + stop - offsets[text]}

    found = common.staged(blocks.mapInPandas(lambda batches: _gathered(passed(batches)), "block long, at int, doc long, key long, h long, span long"), "passages")
    shared.destroy()
    lows = found.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("h", "low")
    lows = common.staged(lows, "lows")
    settled = common.staged(found.join(lows, "h").filter("doc > low").select("block", "at", "doc", "key", "span"), "settled")
    common.dropped(found, lows)
    return settled


def _open(found: tuple[np.ndarray, ...], first: int, offsets: np.ndarray, place: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """Which reads are not inside a settled passage of their text; `place` says which text of the block a passage is in, in order."""
    _, text, at, windows, _ = found
    keep = np.ones(len(at), bool)
    edges = np.searchsorted(text, np.arange(len(offsets)))
    cuts = np.searchsorted(place, np.arange(first, first + len(offsets)))
    for i in range(len(offsets) - 1):
        if cuts[i + 1] > cuts[i] and edges[i + 1] > edges[i]:
            spans = np.sort(settled[cuts[i]: cuts[i + 1]])
            reach, own = np.maximum.accumulate(spans & 0xFFFFFFFF), slice(edges[i], edges[i + 1])
            begin = at[own] - offsets[i]
            before = np.searchsorted(spans >> 32, begin, side="right") - 1
            keep[own] = (before < 0) | (reach[np.maximum(before, 0)] < begin + windows[own] + WINDOW - 1)
    return keep


def candidate_reads(blocks: DataFrame, settled: DataFrame, flags: DataFrame, ranges: int) -> DataFrame:
    """Staged: doc, key, pos, windows, minimizer, hash and bytes of the reads whose minimizer is flagged and that are not inside a settled passage."""
    def passed(batches: Iterator[pd.DataFrame]) -> Iterator[dict[str, list | np.ndarray]]:
        for rows in batches:
            for doc, key, texts, names, marks, place, spans in zip(*(rows[c] for c in ("doc", "key", "text", "r", "flags", "at", "span"))):
                parts = [(first, raw, offsets, reads(raw, offsets)) for first, raw, offsets in common.byte_batches(texts, BATCH)]
                kinds, kind = np.unique(np.concatenate([found[0] for *_, found in parts]), return_inverse=True)
                cuts, _ = _ranged(kinds, ranges)
                hit = np.zeros(len(kinds), bool)
                for r, mark in zip(names, marks) if names is not None else ():
                    hit[cuts[r]: cuts[r + 1]] = np.unpackbits(np.frombuffer(mark, np.uint8), count=cuts[r + 1] - cuts[r])
                keeps = np.split(hit[kind], np.cumsum([len(found[0]) for *_, found in parts])[:-1])
                for (first, raw, offsets, found), keep in zip(parts, keeps):
                    found = tuple(x[keep] for x in found)
                    if place is not None:
                        keep = _open(found, first, offsets, place, spans)
                        found = tuple(x[keep] for x in found)
                    m, text, at, windows, h = found
                    data = raw.tobytes()
                    yield {"doc": doc[first + text], "key": key[first + text], "pos": (at - offsets[text]).astype(np.int32), "windows": windows.astype(np.int32),
                           "m": m.view(np.int64), "h": h.view(np.int64), "bytes": [data[a: a + w + WINDOW - 1] for a, w in zip(at.tolist(), windows.tolist())]}

    def of(rows: DataFrame, *columns: str) -> DataFrame:
        # the texts are shuffled whatever their size: a side that is small enough for a broadcast at first would not stay so
        return rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("x")).select("block", *(F.col(f"x.{c}").alias(c) for c in columns)).hint("shuffle_hash")

    together = blocks.join(of(flags, "r", "flags"), "block", "left").join(of(settled, "at", "span"), "block", "left")
    return common.staged(together.select("doc", "key", "text", "r", "flags", "at", "span").mapInPandas(lambda batches: _gathered(passed(batches)), READ), "reads")


# --- the collection's Burrows-Wheeler transform, one symbol a read each round ---

def _blocks(path: str, kind: type, block: int) -> Iterator[np.ndarray]:
    with open(path, "rb") as f:
        while len(part := np.fromfile(f, kind, block)):
            yield part


def _by_symbol(raw: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in the order of the symbols in front of them, and how many each symbol has."""
    symbol = raw[places - 1]
    return np.argsort(symbol, kind="stable"), np.bincount(symbol, minlength=257)


def sorted_suffixes(texts: list[bytes], block: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of all texts in order: text, length, and whether it shares its first WINDOW bytes with the one before.

    Round j inserts the suffix of length j of every text: the symbol in front of each suffix that is there says where the longer one goes.
    A round reads the transform of the round before in order, twice: to count the symbols, and to put each entry at its symbol's
    cursor in the new file, which moves on only. An entry is a place in the joined texts (each behind a zero, bytes from 1 on) and a
    length. A transform of one block is sorted once and written in one piece. Common prefixes change only next to the entries of the round; they are compared once WINDOW bytes are there.
    """
    n, lengths = len(texts), np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(lengths + 1)
    data = np.frombuffer(b"".join(texts), np.uint8)
    symbols = np.flatnonzero(np.bincount(data, minlength=256))
    # the bytes that occur, numbered from 1 on, sort as the bytes do; one byte a symbol is the rule
    number = np.zeros(256, np.uint8 if len(symbols) < 256 else np.uint16)
    number[symbols] = np.arange(1, len(symbols) + 1)
    raw = np.zeros(stops[-1] + WINDOW + 1, number.dtype)
    places = np.ones(stops[-1], bool)
    places[stops - lengths - 1] = False
    raw[: stops[-1]][places] = number[data]
    columns, same = np.arange(WINDOW), np.zeros(0, bool)
    with tempfile.TemporaryDirectory(prefix="bwt-") as folder:
        name = lambda what, j: os.path.join(folder, f"{what}-{j}")
        stops.astype(np.int32).tofile(name("place", 0))
        np.zeros(n, np.uint8).tofile(name("length", 0))
        for j in range(1, int(lengths.max()) + 1):
            if os.path.getsize(name("place", j - 1)) > 4 * block:
                counts = sum(np.bincount(raw[part - 1], minlength=257) for part in _blocks(name("place", j - 1), np.int32, block))
                cursor = n + np.r_[0, 0, np.cumsum(counts[1:-1])]
                size = n + int(counts[1:].sum())
                place, length = (np.memmap(name(what, j), kind, "w+", shape=size) for what, kind in (("place", np.int32), ("length", np.uint8)))
                place[:n], length[:n] = stops, 0
                for part, long in zip(_blocks(name("place", j - 1), np.int32, block), _blocks(name("length", j - 1), np.uint8, block)):
                    order, mine = _by_symbol(raw, part)
                    order = order[mine[0]:]                       # a zero: the text is used up
                    part, long = part[order] - 1, long[order] + 1
                    at = 0
                    for s in np.flatnonzero(mine[1:]) + 1:
                        place[cursor[s]: cursor[s] + mine[s]], length[cursor[s]: cursor[s] + mine[s]] = part[at: at + mine[s]], long[at: at + mine[s]]
                        at += mine[s]
                    cursor += mine
                place, length = np.array(place), np.array(length)
            else:
                place, length = np.fromfile(name("place", j - 1), np.int32), np.fromfile(name("length", j - 1), np.uint8)
                order, mine = _by_symbol(raw, place)
                order = order[mine[0]:]
                place, length = np.r_[stops.astype(np.int32), place[order] - 1], np.r_[np.zeros(n, np.uint8), length[order] + 1]
                place.tofile(name("place", j))
                length.tofile(name("length", j))
            if j >= WINDOW:
                whole = np.flatnonzero(length >= WINDOW)
                fresh = length[whole] == j
                before, same = same, np.zeros(len(whole), bool)
                same[~fresh] = before
                near = fresh.copy()
                near[1:] |= fresh[:-1]
                near[:1] = False
                here = np.flatnonzero(near)
                side_by_side = whole[here] == whole[here - 1] + 1       # a shorter suffix in between differs before
                a, b = place[whole[here]], place[whole[here - 1]]
                equal = side_by_side & (raw[a] == raw[b]) & (raw[a + WINDOW - 1] == raw[b + WINDOW - 1])
                told = np.flatnonzero(equal)
                for k in range(0, len(told), 1 << 16):
                    t = told[k: k + (1 << 16)]
                    equal[t] = (raw[a[t, None] + columns] == raw[b[t, None] + columns]).all(1)
                same[here] = equal
            for what in ("place", "length"):
                os.remove(name(what, j - 1))
        read = np.searchsorted(stops, place, side="left")
        out = np.zeros(len(read), bool)
        out[length >= WINDOW] = same
        return read, length, out


def smallest_documents(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows of a read with one smallest document among equal windows: read, first window, end of windows, document."""
    read, length, same = sorted_suffixes(texts)
    keep = length >= WINDOW
    read, length, same = read[keep], length[keep].astype(np.int64), same[keep]
    first = np.flatnonzero(~same)
    low = np.repeat(np.minimum.reduceat(docs[read], first), np.diff(np.r_[first, len(read)]))
    window = np.array([len(t) for t in texts])[read] - length
    order = np.lexsort((window, read))
    read, window, low = read[order], window[order], low[order]
    new = np.r_[True, (read[1:] != read[:-1]) | (low[1:] != low[:-1])]
    at = np.flatnonzero(new)
    return read[at], window[at], window[np.r_[at[1:], len(read)] - 1] + 1, low[at]


def _window_runs(distinct: DataFrame, most: int) -> DataFrame:
    """m, h, first, stop, low of all reads (m, h, bytes, doc: the smallest with this read) of minimizers with several reads.

    Partitions by minimizer are sorted in collections of some ten thousand reads. A minimizer with more than `most` different
    reads (a frequent string at the edge of a repeated passage) is settled by the hashes of its windows in an aggregate instead, which
    no single key can overload.
    """
    sizes = distinct.groupBy("m").agg(F.count("*").alias("reads"))
    crowded = common.staged(sizes.filter(F.col("reads") > most).select("m"), "crowded")
    few, many = distinct.join(crowded, "m", "left_anti"), distinct.join(crowded, "m", "left_semi")
    fields = "m long, h long, first int, stop int, low long"

    def sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for rows in batches:
            held.append(rows)
            if sum(map(len, held)) >= 20_000:
                rows = pd.concat(held)
                whole = (rows.m != rows.m.iloc[-1]).to_numpy()      # the last minimizer may go on
                if whole.any():
                    yield runs(rows[whole])
                held = [rows[~whole]]
        if held and sum(map(len, held)):
            yield runs(pd.concat(held))

    def runs(rows: pd.DataFrame) -> pd.DataFrame:
        read, first, stop, low = smallest_documents(list(rows.bytes), rows.doc.to_numpy())
        return pd.DataFrame({"m": rows.m.to_numpy()[read], "h": rows.h.to_numpy()[read], "first": first.astype(np.int32), "stop": stop.astype(np.int32), "low": low})

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i, raw, offsets in common.byte_batches(rows.bytes, 1_000_000):
                n = np.diff(offsets) - WINDOW + 1
                of = np.repeat(np.arange(len(n)), n)
                first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = offsets[of] + first
                yield pd.DataFrame({"m": rows.m.to_numpy()[i + of], "h": rows.h.to_numpy()[i + of], "first": first.astype(np.int32), "doc": rows.doc.to_numpy()[i + of],
                                    "w": common.slice_hash(common.prefix_hash(raw), at, at + WINDOW).view(np.int64)})

    sorted_part = few.repartition("m").sortWithinPartitions("m").mapInPandas(sorted_runs, fields)
    each = common.staged(many.mapInPandas(windows, "m long, h long, first int, doc long, w long"), "windows")
    lows = each.groupBy("w").agg(F.min("doc").alias("low"))
    return sorted_part.unionByName(each.join(lows, "w").select("m", "h", "first", (F.col("first") + 1).alias("stop"), "low"))


def repeated_spans(docs: DataFrame, ranges: int | None = None, bits: int = 26, most: int = 20_000) -> DataFrame:
    """doc, key and `spans` (array of start * 2**32 + stop in bytes, unsorted and overlapping) of documents with strings that also start in a smaller document."""
    spark = docs.sparkSession
    if ranges is None:
        ranges = 1 << max(4, (2 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    bits = max(bits, ranges.bit_length() + 3)
    blocks = blocks_of(docs)
    minimizer_flags, passage_flags = repeated(blocks, ranges, bits)
    settled = settled_passages(blocks, passage_flags)
    found = candidate_reads(blocks, settled, minimizer_flags, ranges)
    common.dropped(blocks, minimizer_flags)
    kinds = found.groupBy("m").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("h").alias("h1"), F.max("h").alias("h2")).filter("low < high")
    kinds = common.staged(kinds.select("m", "low", (F.col("h1") != F.col("h2")).alias("mixed")), "minimizers")
    met = found.select("doc", "key", "pos", "windows", "m", "h").join(kinds, "m").filter("mixed OR doc > low")
    met = common.staged(met.select("doc", "key", "mixed", F.when(F.col("mixed"), F.col("m")).alias("m"), F.when(F.col("mixed"), F.col("h")).alias("h"), "pos", "windows"), "met")
    # bytes are shuffled only where reads differ: a bounded filter first, the exact join behind it
    open_kinds = kinds.filter("mixed").select("m")
    flags = spark.sparkContext.broadcast(_flags(open_kinds, "m", 24))

    @F.pandas_udf("boolean")
    def maybe(m: pd.Series) -> pd.Series:
        return pd.Series(_flagged(flags.value, m.to_numpy(np.int64).view(np.uint64)))

    distinct = found.filter(maybe("m")).select("m", "h", "bytes", "doc").groupBy("m", "h", "bytes").agg(F.min("doc").alias("doc")).join(open_kinds, "m", "left_semi")
    distinct = common.staged(distinct, "distinct")
    flags.destroy()
    common.dropped(found, kinds)
    runs = common.staged(_window_runs(distinct, most), "runs")
    common.dropped(distinct)
    pos = F.col("pos").cast("long")
    packed = lambda start, windows_end: F.shiftleft(start, 32) + windows_end + (WINDOW - 1)
    other = met.filter("mixed").join(runs, ["m", "h"]).filter("doc > low").select("doc", "key", packed(pos + F.col("first"), pos + F.col("stop")).alias("span"))
    spans = met.filter("NOT mixed").select("doc", "key", packed(pos, pos + F.col("windows")).alias("span")).unionByName(other)
    spans = spans.unionByName(settled.select("doc", "key", "span"))
    spans = common.staged(spans.groupBy("doc", "key").agg(F.collect_list("span").alias("spans")), "spans")
    common.dropped(settled, met, runs)
    return spans


CUT = "n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, all_spans in batches:
        out = []
        for text, spans in zip(texts, all_spans):
            raw = text.encode("utf-8", "surrogatepass")
            spans = np.sort(np.asarray(spans if spans is not None else (), np.int64))
            start, stop = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
            new = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]][: len(start)])
            begins, ends = start[new], stop[np.r_[new[1:], len(start)] - 1] if len(start) else stop
            kept = b"".join(raw[a:b] for a, b in zip([0, *ends.tolist()], [*begins.tolist(), len(raw)]))
            out.append((len(raw), len(raw) - len(kept), len(begins), kept))
        yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, filter_bits: int = 24, **how) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes that remain).

    A byte goes if a string of WINDOW bytes over it also starts in a document with a smaller doc_id; strings are judged on the whole
    input and may overlap. Null texts count as empty, null ids as larger than all and equal to each other; rows alike in doc_id
    do not affect each other. Texts below WINDOW bytes stay whole. An empty table gives no rows; further columns are not read.
    """
    text = common.filled("text")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), common.text_key(text).alias("key"), text.alias("text"))
    cut = F.pandas_udf(_cut, CUT)
    zero = F.lit(0).cast("long")
    with common.settings(docs.sparkSession, SETTINGS):
        spans = repeated_spans(rows, **how)
        flags = docs.sparkSession.sparkContext.broadcast(_flags(spans, "key", filter_bits))

        @F.pandas_udf("boolean")
        def maybe(keys: pd.Series) -> pd.Series:
            return pd.Series(_flagged(flags.value, keys.to_numpy(np.int64).view(np.uint64)))

        split = rows.withColumn("touched", maybe("key"))
        s = spans.withColumnRenamed("doc", "d").withColumnRenamed("key", "k")
        touched = split.filter("touched").join(s, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")), "left").withColumn("cut", cut("text", "spans"))
        # texts are cut here, while the small Arrow batches hold; what is left of them takes the place of the spans
        touched = common.staged(touched.select("doc_id", "cut.*"), "spans")
        common.dropped(spans)
    whole = split.filter("NOT touched").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return whole.unionByName(touched)
