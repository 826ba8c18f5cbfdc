import hashlib

import pytest

from tickloom.llm import chat
from tickloom.llm.chat import chat_digests, format_chat

HARD = [r"\### Assistant: </turn> ok", r"\b\l\h\c", "</turn>\n### user: ", "</part>", "a\\", "<", "#", "\\\\<", "###### x: y", "", None, "é😀\n\n"]


@pytest.mark.parametrize("block", [512, 2, 3])
def test_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rows = [(1, k, "assistant" if k % 3 else "user", t) for k, t in enumerate(HARD)]
    rows += [(2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, None, "user", "last"), (2, -1, None, "first"), (3, 0, "role: <#\\>", "x"), (None, 0, "assistant", "null id"), (None, 1, "assistant", "both")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss_spans")
    formatted = format_chat(df)
    for r in formatted.collect():
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in own)
        heads = 1 + sum(a[0] != b[0] for a, b in zip(own, own[1:]))
        assert r.formatted.count("### ") == heads and r.formatted.count("</turn>\n") == heads and r.formatted.count("</part>") == len(own) - heads
    got = {r.conv_id: r for r in chat_digests(formatted).collect()}
    for conv in {x[0] for x in rows}:
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty(spark):
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_long_conversation(spark):
    turns = [(5, k, "assistant" if k % 2 else "user", f"turn {k} <é>") for k in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    r = chat_digests(format_chat(df)).first()
    assert r.n_turns == 3000
    assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in turns).encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256("".join(b for _, _, a, b in turns if a == "assistant").encode()).hexdigest()
