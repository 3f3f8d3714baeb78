"""Chat formatting: logs of chat events, folded into final messages and rendered under a reversible template with a loss mask."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructType

BLOCK_BITS = 10                 # a block has the messages of 1024 turns
CHUNK_CHARS = 2_000_000         # a chunk is handed on once it has so many characters
RESETS = ("edit", "regenerate")
KINDS = ("start", "delta", *RESETS)
LEARNED = "assistant"

# --- the template: a turn is `### role:`, its text, `</turn>`, each on lines of its own ---

CONTROL = re.compile(r"(\\*)(###|</turn>)")
TURN = re.compile(r"### ([^\n:]*):\n(.*?)\n</turn>\n", re.DOTALL)
ROLE = re.compile(r"[%:\n\r#<\\]")


def escape(text: str) -> str:
    """A backslash before every control string, so that one with n backslashes before it has n + 1."""
    return CONTROL.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1][1:] + m[2], text)


def _role(role: str) -> str:
    return ROLE.sub(lambda m: f"%{ord(m[0]):02X}", role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its escaped text begins and ends in it."""
    head, inner = f"### {_role(role)}:\n", escape(text)
    return f"{head}{inner}\n</turn>\n", len(head), len(head) + len(inner)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, from the formatted text alone."""
    at = 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        at = m.end()
        yield re.sub("%([0-9A-F]{2})", lambda h: chr(int(h[1], 16)), m[1]), unescape(m[2])
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")


# --- events to messages ---

class Event(NamedTuple):
    conv_id: object
    block: int
    carry: bool
    place: int
    message: object
    seq: int
    kind: str
    role: str | None
    text: str | None
    blocks: int | None


LOWEST = -2**63


def fold(events: Iterator[Event]) -> Iterator[tuple]:
    """Messages (conv_id, block, blocks, role, text) of events sorted by conversation, block, turn, message and sequence.

    `since` is the last reset of the turns before, `own` that of the message too: what happened earlier is gone. Only one message is held.
    """
    group = message = last = None
    since = turn_reset = own = LOWEST
    blocks, role, parts = 1, None, None

    def done() -> Iterator[tuple]:
        if parts is not None:
            yield *group, blocks, role or "", "".join(parts)

    for e in events:
        if (e.conv_id, e.block) != group or (e.place, e.message) != message:
            yield from done()
            if (e.conv_id, e.block) != group:
                group, since, turn_reset, blocks = (e.conv_id, e.block), LOWEST, LOWEST, 1
            elif message is None or message[0] != e.place:
                since = max(since, turn_reset)
            message, own, role, parts = (e.place, e.message), since, None, None
        if e.carry:         # what the blocks before this one have reset
            since, blocks, message = e.seq, e.blocks, None
            continue
        if e == last or e.seq < own:        # given twice, or undone
            continue
        last = e
        if e.kind in RESETS:
            own, turn_reset = max(own, e.seq), max(turn_reset, e.seq)
        if e.kind != "delta":
            parts, role = [], e.role if e.role is not None else role
        parts = [] if parts is None else parts
        role = e.role if role is None else role
        parts.append(e.text or "")
    yield from done()


CHUNK = "block long, part int, whole boolean, n_turns long, formatted string, loss array<struct<start:int,end:int>>"


def chunks_of(messages: Iterator[tuple], most: int = CHUNK_CHARS) -> Iterator[tuple]:
    """(conv_id, block, part, whole, n_turns, formatted, loss spans): the messages of a block, cut after `most` characters."""
    group, part, blocks, held, size, loss = None, 0, 1, [], 0, []
    for conv_id, block, n, role, text in messages:
        if (conv_id, block) != group:
            if held:
                yield *group, part, part == 0 and blocks == 1, len(held), "".join(held), loss
            group, part, held, size, loss = (conv_id, block), 0, [], 0, []
        elif size > most:
            yield *group, part, False, len(held), "".join(held), loss
            part, held, size, loss = part + 1, [], 0, []
        blocks = n
        turn, start, end = render(role, text)
        if role == LEARNED:
            loss.append({"start": size + start, "end": size + end})
        held.append(turn)
        size += len(turn)
    if held:
        yield *group, part, part == 0 and blocks == 1, len(held), "".join(held), loss


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in rows:
        held.append(row)
        size += weight(row)
        if size > most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _arrow(df: DataFrame, columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType([df.schema["conv_id"], *StructType.fromDDL(columns).fields]))


def _ddl(df: DataFrame, columns: str) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {columns}"


def format_chats(log: DataFrame, block_bits: int = BLOCK_BITS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of formatted conversations: conv_id, block, part, whole (the conversation has no other chunk), n_turns, formatted, loss.

    `log` has one event per row: conv_id, turn, message (which message of the turn; any type that sorts), seq, kind, role, text.
    `start` opens a message with its role and first text, `delta` appends, `edit` gives it a new text, `regenerate` begins
    it anew; both undo all that was said before them (in seq) in their own message and in later turns. Conversations have their messages
    by turn and message; the chunks in order of block and part make the conversation. `loss` are spans of `formatted`, in code points:
    the escaped text of each message of the assistant.

    A null text is empty, a null role is empty unless another event of the message has one, a null turn or seq comes before all others,
    rows with a null conv_id are one conversation. An event given twice counts once. Rows of other kinds, and a null kind, are no chat events. An empty
    table gives no rows; further columns are not read.

    A conversation of many turns is cut into blocks of turns, dealt out one by one: of a block, only the last reset in all earlier blocks has
    to be known, which a narrow aggregate brings along. A task holds one message and one chunk.
    """
    place = F.coalesce(F.col("turn").cast("long"), F.lit(LOWEST))
    events = log.filter(F.col("kind").isin(*KINDS)).select(
        "conv_id", F.shiftright(place, block_bits).alias("block"), F.lit(False).alias("carry"), place.alias("place"), "message",
        F.coalesce(F.col("seq").cast("long"), F.lit(LOWEST)).alias("seq"), "kind", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.lit(None).cast("int").alias("blocks"))
    blocks = events.groupBy("conv_id", "block").agg(F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).alias("reset"))
    of = Window.partitionBy("conv_id")
    before = of.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("conv_id", "block", F.coalesce(F.max("reset").over(before), F.lit(LOWEST)).alias("seq"), F.count("*").over(of).cast("int").alias("blocks")).filter("blocks > 1")
    carry = carry.select("conv_id", "block", F.lit(True).alias("carry"), F.lit(LOWEST).alias("place"), F.lit(None).cast(log.schema["message"].dataType).alias("message"), "seq",
                         F.lit("carry").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "blocks")
    dealt = events.unionByName(carry).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.desc("carry"), "place", "message", "seq", "kind", "role", "text")
    schema = _arrow(log, CHUNK)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(map(Event, *(b.column(c).to_pylist() for c in Event._fields)) for b in batches)
        return _batches(chunks_of(fold(rows), chunk_chars), schema, lambda r: len(r[5]) + 100)
    return dealt.select(*Event._fields).mapInArrow(made, _ddl(log, CHUNK))


# --- what is read back from the formatted text ---

class Digest:
    """Running digests of a conversation, fed with its chunks in order."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, formatted: str, loss: list[dict]) -> Digest:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in loss:
            text = unescape(formatted[span["start"]: span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        return self

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
WAITING = f"{DIGEST}, block long, part int, formatted string, loss array<struct<start:int,end:int>>"


def chat_digests(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read back from its chunks: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation of one chunk is done where the chunk is. Chunks of longer ones are put in order by conversation; a digest runs over them
    one after the other (SHA-256 cannot be put together from parts), holding one at a time.
    """
    first, last = _arrow(chunks, WAITING), _arrow(chunks, DIGEST)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for r in b.to_pylist():
                    if r["whole"]:
                        yield r["conv_id"], *Digest().add(r["formatted"], r["loss"]).row(), None, None, None, None
                    else:
                        yield r["conv_id"], None, None, None, None, None, r["block"], r["part"], r["formatted"], r["loss"]
        return _batches(rows(), first, lambda r: len(r[8] or "") + 300)

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, state = None, None
            for r in chain.from_iterable(b.to_pylist() for b in batches):
                if state is not None and (r["n_turns"] is not None or r["conv_id"] != conv):
                    yield conv, *state.row()
                    state = None
                if r["n_turns"] is not None:
                    yield tuple(r[f.name] for f in last)
                    continue
                conv, state = r["conv_id"], (state or Digest()).add(r["formatted"], r["loss"])
            if state is not None:
                yield conv, *state.row()
        return _batches(rows(), last, lambda r: 300)

    waiting = chunks.mapInArrow(single, _ddl(chunks, WAITING))
    return waiting.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part").mapInArrow(running, _ddl(chunks, DIGEST))


def table_log(table: DataFrame, piece: int = 256) -> DataFrame:
    """The log of a table of finished turns (conv_id, turn, role, text): a start for each row, and the assistant's text as deltas of `piece` code points.

    Rows of one turn are messages of their own, in the order of a hash of role and text; rows that are alike in all are too.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.col("role").cast("string")
    event = lambda seq, kind, r, t: F.struct(F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), r.alias("role"), t.alias("text"))
    pieces: Column = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    streamed = F.concat(F.array(event(0, "start", role, F.lit(""))), F.transform(pieces, lambda t, i: event(i + 1, "delta", F.lit(None).cast("string"), t)))
    # the row's number is taken before its events are dealt out: beside a generator it would count events
    rows = table.select("conv_id", "turn", "role", "text", F.struct(F.xxhash64(role, text).alias("hash"), F.monotonically_increasing_id().alias("row")).alias("message"))
    events = F.when(role == LEARNED, streamed).otherwise(F.array(event(0, "start", role, text)))
    return rows.select("conv_id", "turn", "message", F.explode(events).alias("e")).select("conv_id", "turn", "message", "e.*")
