"""Chat logs folded and rendered, against brute force over all pairs of events."""
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import chat

SCHEMA = "conv_id long, turn long, message string, seq long, kind string, role string, text string, block string, place string, carry string"
PIECES = ["\\", "#", "###", "### assistant:\n", "</turn>", "\n", "</", "turn>", "a", "é", "👩‍👧", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES)).map("".join), st.lists(st.sampled_from([*PIECES, "%", ":", "assistant"])).map("".join))))
def test_rendering_is_reversible(turns):
    rendered = [chat.render(role, text) for text, role in turns]
    assert list(chat.parse("".join(r[0] for r in rendered))) == [(role, text) for text, role in turns]
    for (text, _), (formatted, start, end) in zip(turns, rendered):
        assert chat.unescape(formatted[start:end]) == text


def test_text_that_is_no_chat_is_refused():
    with pytest.raises(ValueError):
        list(chat.parse("### user:\nhi\n</turn>\nstray"))


def brute(events):
    """{conv_id: [(role, text)]} by comparing every event with every reset."""
    out = {}
    low = lambda x: chat.LOWEST if x is None else x
    for conv in {e[0] for e in events if e[4] in chat.KINDS}:
        own = {e[:7] for e in events if e[0] == conv and e[4] in chat.KINDS}
        resets = [(low(e[1]), low(e[3])) for e in own if e[4] in chat.RESETS]
        live = [e for e in own if not any(t < low(e[1]) and s > low(e[3]) for t, s in resets)]
        said = {}
        for e in sorted(live, key=lambda e: (low(e[1]), e[2] or "", low(e[3]), e[4], e[5] or "", e[6] or "")):
            message = said.setdefault((low(e[1]), e[2] or ""), [None, ""])
            message[1] = (message[1] if e[4] == "delta" else "") + (e[6] or "")
            if e[4] != "delta":
                message[0] = e[5] if e[5] is not None else message[0]
            message[0] = e[5] if message[0] is None else message[0]
        if said:
            out[conv] = [(r or "", t) for r, t in said.values()]
    return out


def expected(events):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for conv, turns in brute(events).items():
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), sum(len(chat.render(r, t)[0]) for r, t in turns))
    return out


def got(chunks):
    return {r.conv_id: tuple(r)[1:] for r in chat.chat_digests(chunks).collect()}


def made_log(seed=3):
    """Streams, edits and regenerations; one conversation has most of the events; rows given twice, nulls, strange kinds."""
    rng = random.Random(seed)
    events = []
    for conv, turns in [(1, 3), (2, 1), (None, 6), (2**60 + 1, 2), (2**60 + 3, 2), (9, 300)]:
        seq = 0
        for _ in range(turns * 4):
            seq += rng.randrange(1, 3)
            turn = rng.randrange(turns) if rng.random() < 0.2 else min(seq // 8, turns - 1)
            kind = rng.choices(["start", "delta", "edit", "regenerate", "ping", None], [4, 10, 1 if turns > 100 and turn < 250 else 2, 1, 1, 1])[0]
            if kind in chat.RESETS and turns > 100 and turn < 60 and rng.random() < 0.9:
                kind = "delta"
            events.append((conv, rng.choice([turn, turn, turn, None]) if turns < 10 else turn, rng.choice(["a", "b"]) if turn % 7 == 0 else None, seq, kind,
                           rng.choice(["user", "assistant", "system", "tool: x\n", None]), "".join(rng.choices(PIECES, k=rng.randrange(5))) or None))
    events += rng.sample(events, 40) + [(5, None, None, None, "start", None, None), (6, 0, None, 0, "ping", "user", "x")]
    rng.shuffle(events)
    return events


@pytest.mark.parametrize("block_bits,chunk_chars", [(10, 2_000_000), (2, 60), (0, 1)])
def test_fold_and_render(spark, block_bits, chunk_chars):
    events = made_log()
    log = spark.createDataFrame([(*e, "c", "c", "c") for e in events], SCHEMA).repartition(5)
    chunks = chat.format_chats(log, block_bits, chunk_chars)
    assert got(chunks) == expected(events)
    if block_bits == 0:
        parts = [r for r in chunks.collect() if r.conv_id == 9]
        assert len(parts) > 50 and not any(r.whole for r in parts)
        text = "".join(r.formatted for r in sorted(parts, key=lambda r: (r.block, r.part)))
        assert list(chat.parse(text)) == brute(events)[9]


def test_chats_of_odd_rows(spark):
    assert chat.chat_digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, None, None, None), (None, 1, "assistant", "é" * 3000), (3, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = got(chat.format_chats(chat.table_log(table)))
    assert {k: v[0] for k, v in out.items()} == {1: 3, None: 2, 3: 1}
    assert out[None][2] == 3000 and out[None][3] == hashlib.sha256(("é" * 3000).encode()).hexdigest()
    log = chat.table_log(table).filter("conv_id IS NULL AND kind = 'delta'")
    assert max(len(r.text) for r in log.collect()) <= 256 and log.count() == 12


def test_spans_of_the_loss(spark):
    table = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "### a\\</turn>"), (1, 2, "assistant", "b" * 700)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(chat.table_log(table)).first()
    assert [chat.unescape(r.formatted[s.start:s.end]) for s in r.loss] == ["### a\\</turn>", "b" * 700]
