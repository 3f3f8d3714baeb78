"""Cross-tokenizer alignment: the tokens of two tokenizers meet on their end offsets, as Arrow tables inside each batch."""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import common

# the pattern by which byte-level tokenizers cut a text before merging (a fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_BYTES = 2_000_000         # of text that is aligned at a time
LISTED = 1 << 18                # most frequent pairs at most that every executor gets (17 bytes each); all others are joined
PARTIAL = 1 << 20               # pairs that a task counts before it hands them on


class Files(NamedTuple):
    """The two tokenizer files as bytes: a byte-level BPE (JSON) and a piece model."""
    byte_level: bytes
    pieces: bytes
    ranked: bool = False    # the byte-level one merges by the order of its ids


class Tokenizers(NamedTuple):
    encode_a: object        # list of texts to a list array of ids
    encode_b: object
    bytes_a: pa.Array       # bytes of each token id
    bytes_b: pa.Array
    digits: pa.Array        # each id as decimal text


def read_files(byte_level: str, pieces: str) -> Files:
    """Read on the driver; executors get the contents (some MB, fixed by the files) and need no such folder."""
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        spec, model = a.read(), b.read()
    t, letters = json.loads(spec), byte_letters()
    added = {x["id"] for x in t["added_tokens"]}
    return Files(spec, model, same_by_ranks(t, {bytes(letters[c] for c in k): i for k, i in t["model"]["vocab"].items() if i not in added}))


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merged(symbols: list[bytes], ranks: dict[bytes, int], below: int) -> list[bytes]:
    """`symbols` after all merges of a rank under `below`, the lowest first."""
    while len(symbols) > 1:
        least, i = min((ranks.get(symbols[i] + symbols[i + 1], below), i) for i in range(len(symbols) - 1))
        if least >= below:
            break
        symbols = [*symbols[:i], symbols[i] + symbols[i + 1], *symbols[i + 2:]]
    return symbols


def same_by_ranks(spec: dict, ranks: dict[bytes, int]) -> bool:
    """Whether the byte-level file merges by the order of its ids, so that an encoder that knows only ids gives the same tokens.

    Tokens are numbered as their merges come, and all merges below a token's own leave just the two parts that its merge names: what is
    merged inside a stretch does not depend on what stands around it, so that no other two neighbours ever spell the token.
    """
    letters, pre = byte_letters(), spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") is not None or (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) != ("ByteLevel", True, False):
        return False
    spelled = lambda part: bytes(letters[c] for c in part)
    merges = [tuple(map(spelled, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
    if len(merges) + 256 != len(ranks) or any(ranks[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return False
    return all(merged([bytes([x]) for x in a + b], ranks, 256 + i) == [a, b] for i, (a, b) in enumerate(merges))


_loaded: dict[bytes, Tokenizers] = {}


def tokenizers(files: Files) -> Tokenizers:
    """Loaded once for each Python worker."""
    mark = hashlib.sha256(files.byte_level + files.pieces).digest()
    if mark not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_str(files.byte_level.decode())
        a.encode_special_tokens = True      # their strings in a text are ordinary text
        b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        letters, names = byte_letters(), {i: t for t, i in a.get_vocab(with_added_tokens=False).items()}
        added = {t["id"] for t in json.loads(files.byte_level)["added_tokens"]}
        spelled_a = [bytes(letters[c] for c in names[i]) if i in names and i not in added else b"" for i in range(max(names) + 1)]
        spelled_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())]

        def whole(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

        def ranked(texts: list[str]) -> list[np.ndarray]:
            out = []
            for t in texts:
                try:
                    out.append(quick.encode_to_numpy(" " + t, disallowed_special=()))
                except ValueError:      # its pattern engine gives up on very long runs of blanks
                    out.append(np.array(whole([t])[0], np.uint32))
            return out

        quick = None
        if files.ranked:
            import tiktoken
            quick = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(spelled_a) if t}, special_tokens={})

        def listed_a(texts: list[str]) -> pa.ListArray:
            if quick is None:
                return pa.array(whole(texts), pa.list_(pa.int32()))
            ids = ranked(texts)
            return pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))

        _loaded[mark] = Tokenizers(
            listed_a, lambda texts: pa.array(b.encode(texts, num_threads=1), pa.list_(pa.int32())), pa.array(spelled_a, pa.binary()), pa.array(spelled_b, pa.binary()),
            pc.cast(pa.array(range(max(len(spelled_a), len(spelled_b)))), pa.string()))
    return _loaded[mark]


def _cut(bounds: pa.Array, values: pa.Array) -> pa.ListArray:
    """`values` cut at `bounds` (the last place of each piece, in order)."""
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pc.cast(pc.add(bounds, 1), pa.int32())]), values)


def _per_text(texts: pa.Array, n: int) -> pa.Array:
    """How often each text from 0 to n - 1 stands in `texts`."""
    counts = pa.table({"t": pa.concat_arrays([texts, pa.array(np.arange(n), texts.type)])}).group_by("t", use_threads=False).aggregate([([], "count_all")]).sort_by("t")
    return pc.subtract(counts["count_all"].combine_chunks(), 1)


def align_texts(texts: list[str], t: Tokenizers) -> pa.Table:
    """One row per text (not empty): n_a, n_b, n_groups, n_links, groups (text), pairs (a id * size of B + b id, sorted), times."""
    lists = [t.encode_a(texts), t.encode_b(texts)]
    spelled = pa.array([b" " + x.encode() for x in texts], pa.binary())
    same = None
    for ids, spelling in zip(lists, (t.bytes_a, t.bytes_b)):
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, spelling.take(ids.flatten())), b"")
        equal = pc.equal(joined, spelled)
        same = equal if same is None else pc.and_(same, equal)
    zero = pa.array([0] * len(texts), pa.int64())
    at = pc.indices_nonzero(same).cast(pa.int64())
    n = len(at)
    if n == 0:
        return pa.table({c: zero for c in ("n_a", "n_b", "n_groups", "n_links")} | {"groups": pa.array([""] * len(texts)),
                        "pairs": pa.array([[]] * len(texts), pa.list_(pa.int64())), "times": pa.array([[]] * len(texts), pa.list_(pa.int32()))})
    # both tokenizers spell the same bytes, so that running sums of the token lengths are offsets in one common row of bytes
    sides = []
    for name, ids, spelling in zip("ab", lists, (t.bytes_a, t.bytes_b)):
        ids = ids.filter(same)
        flat = ids.flatten()
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(spelling.take(flat)), pa.int64()))
        sides.append(pa.table({"end": ends, name: flat, f"{name}_at": pa.array(np.arange(len(flat))), f"{name}_text": pc.cast(pc.list_parent_indices(ids), pa.int64())}))
    a, b = sides
    # one link for each end of either side: the segment before it belongs to one token of A and one of B
    ends = a.join(b.drop_columns("b_text"), keys="end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
    column = lambda c: ends[c].combine_chunks()
    shared = pc.and_(pc.is_valid(column("a")), pc.is_valid(column("b")))
    of = pc.fill_null_backward(column("a_text"))
    pair = pc.add(pc.multiply(pc.cast(pc.fill_null_backward(column("a")), pa.int64()), len(t.bytes_b)), pc.cast(pc.fill_null_backward(column("b")), pa.int64()))
    # groups end where both end
    last_a, last_b = column("a_at").filter(shared), column("b_at").filter(shared)
    listed = [pc.binary_join(_cut(last, t.digits.take(side[name].combine_chunks())), ",") for last, side, name in ((last_a, a, "a"), (last_b, b, "b"))]
    n_groups = _per_text(of.filter(shared), n)
    groups = pc.binary_join(_cut(pc.subtract(pc.cumulative_sum(n_groups), 1), pc.binary_join_element_wise(*listed, "|")), ";")
    # the distinct pairs of each text
    pairs = pa.table({"text": of, "pair": pair}).group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("text", "ascending"), ("pair", "ascending")]).combine_chunks()
    cuts = pc.subtract(pc.cumulative_sum(_per_text(pairs["text"].combine_chunks(), n)), 1)
    found = pa.table({
        "n_a": _per_text(a["a_text"].combine_chunks(), n), "n_b": _per_text(b["b_text"].combine_chunks(), n), "n_groups": n_groups, "n_links": _per_text(of, n), "groups": groups,
        "pairs": _cut(cuts, pairs["pair"].combine_chunks()), "times": _cut(cuts, pc.cast(pairs["count_all"].combine_chunks(), pa.int32()))})
    return _spread(found, at, len(texts))


def _spread(found: pa.Table, at: pa.Array, n: int) -> pa.Table:
    """The rows of `found` at the places `at` of n; zeros, empty texts and lists elsewhere."""
    place = pc.index_in(pa.array(np.arange(n)), value_set=at)
    empty = {"groups": "", "pairs": [], "times": []}
    out = {}
    for name in found.column_names:
        held = found[name].combine_chunks()
        held = pa.concat_arrays([held, pa.array([empty.get(name, 0)], held.type)])
        out[name] = held.take(pc.fill_null(place, len(held) - 1))
    return pa.table(out)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def token_groups(docs: DataFrame, files: Files) -> DataFrame:
    """One row per row of `docs`: key (of the row), doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    A encodes a blank and the text, B the text (it adds the blank itself). Where a token of A and one of B end at the same byte a
    group ends; `groups` lists them as `a1,a2|b1;a3|b2`. A link is a pair of tokens, one of each, that share a byte; `pairs`
    has the distinct ones (a id * size of B + b id) and `times` how often they occur. Null and empty texts, and texts whose tokens do not
    spell them exactly (A's or B's), have no tokens: zeros, an empty text, empty lists. Rows that repeat are rows of their own; null ids stay null;
    an empty table gives no rows; further columns are not read. Texts are never cut: a batch holds at least one whole text.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(files)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(shared.value)
        for rows in batches:
            texts = ["" if x is None else x for x in rows.column("text").to_pylist()]
            start = size = 0
            for i, x in enumerate([*texts, None]):
                if i > start and (x is None or size + len(x) > BATCH_BYTES):
                    part = [k for k in range(start, i) if texts[k]]
                    found = align_texts([texts[k] for k in part], t) if part else None
                    here = rows.slice(start, i - start).select(["key", "doc_id"])
                    if found is None:
                        found = pa.table({c: pa.array([], k) for c, k in EMPTY})
                    found = _spread(found, pa.array([k - start for k in part], pa.int64()), i - start)
                    table = pa.Table.from_batches([here])
                    for name in found.column_names:
                        table = table.append_column(name, found[name])
                    yield from table.combine_chunks().to_batches()
                    start, size = i, 0
                size += 0 if x is None else len(x)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(made, f"key long, doc_id {kind}, {ALIGNED}")


EMPTY = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()),
         ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n: links of the whole corpus that are this pair, best: no pair of the same B id has more).

    Tasks count what they hold by Table.group_by and hand the counts on as soon as they have many; Spark adds them up.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = pa.table({"pair": batch.column("pairs").flatten(), "n": pc.cast(batch.column("times").flatten(), pa.int64())})
            new = new if held is None else pa.concat_tables([held, new])
            held = new.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["pair", "n"])
            if len(held) > PARTIAL:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    counts = common.staged(rows.select("pairs", "times").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = (F.col("pair") % size_b).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return common.staged(counts.select("*", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def frequent(counts: DataFrame, most: int = LISTED) -> pa.Table:
    """The pairs from some count on, at most `most` of them; the count is read off a histogram with 8 steps per doubling."""
    step = F.floor(F.log2("n") * 8).cast("long")
    total, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):     # at most 8 * 64 rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    picked = counts.filter(step >= least) if least is not None else counts.limit(0)
    return picked.toArrow()


def link_scores(rows: DataFrame, size_b: int, listed: int = LISTED) -> DataFrame:
    """Per key of `rows` (a written table of `token_groups`): n_best (links whose pair is its B id's most frequent, ties included), count_sum (counts over links).

    Frequent pairs are looked up in a list of bounded size that every executor has; all others are joined, a
    pair of which has at most as many rows as the least frequent listed one, so that no pair is hot in the join.
    """
    counts = pair_counts(rows, size_b)
    shared = rows.sparkSession.sparkContext.broadcast(frequent(counts, listed))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.combine_chunks()
        pairs, n, best = (known[c].combine_chunks() if len(known) else pa.array([], k) for c, k in (("pair", pa.int64()), ("n", pa.int64()), ("best", pa.bool_())))
        for batch in batches:
            keys, lists = batch.column("key"), batch.column("pairs")
            flat, times = lists.flatten(), pc.cast(batch.column("times").flatten(), pa.int64())
            key = keys.take(pc.list_parent_indices(lists))
            place = pc.index_in(flat, value_set=pairs)
            sums = pa.table({"key": key, "best": pc.multiply(times, pc.cast(pc.fill_null(best.take(place), False), pa.int64())), "sum": pc.multiply(times, pc.fill_null(n.take(place), 0))}) \
                .group_by("key", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")])
            none = pa.nulls(len(sums), pa.int64())
            # a row of sums has a pair of its own that no other row has, so that such rows spread evenly in the join
            yield pa.record_batch({"key": sums["key"].combine_chunks(), "pair": pc.subtract(-1, sums["key"].combine_chunks()), "times": none, "n_best": sums["best_sum"].combine_chunks(), "count_sum": sums["sum_sum"].combine_chunks()})
            rest = pc.is_null(place)
            left = key.filter(rest)
            none = pa.nulls(len(left), pa.int64())
            yield pa.record_batch({"key": left, "pair": flat.filter(rest), "times": times.filter(rest), "n_best": none, "count_sum": none})

    parts = rows.select("key", "pairs", "times").mapInArrow(scored, "key long, pair long, times long, n_best long, count_sum long")
    met = parts.join(counts, "pair", "left")
    return met.groupBy("key").agg(
        F.sum(F.coalesce("n_best", F.when(F.col("best"), F.col("times")).otherwise(0))).alias("n_best"),
        F.sum(F.coalesce("count_sum", F.col("times") * F.col("n"))).alias("count_sum"))


def align(docs: DataFrame, files: Files) -> DataFrame:
    """`token_groups` with n_best and count_sum in place of the pairs; `groups` stays whole."""
    rows = common.staged(token_groups(docs, files), "aligned")
    return with_scores(rows, files)


def with_scores(rows: DataFrame, files: Files) -> DataFrame:
    size_b = len(tokenizers(files).bytes_b)
    scores = link_scores(rows, size_b).select(F.col("key").alias("k"), "n_best", "count_sum")
    joined = rows.drop("pairs", "times").join(scores, F.col("key") == F.col("k"), "left").drop("k", "key")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
