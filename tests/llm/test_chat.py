"""Layouts, the template's round trip, and what is read back."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from entityvec.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE", "<</ROLE>>", ">>", "\\", "<", "[", "]", "/", "a", " ", "\n", "=", "s>"]
TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_template_round_trip():
    draw = random.Random(1)
    for _ in range(20_000):
        turns = [(draw.choice(["user", "assistant", "system", None, "", "tool", "=x>>", "<<ROLE>>", "a\\"]),
                  "".join(draw.choice(PIECES) for _ in range(draw.randrange(8)))) for _ in range(draw.randrange(6))]
        pieces = [chat.format_turn(*t) for t in turns]
        assert list(chat.parse("".join(p for p, _ in pieces))) == turns
        for (role, text), (piece, loss) in zip(turns, pieces):
            assert (loss is not None) == (role == "assistant")
            assert loss is None or chat.unescape(piece[loss[0]:loss[1]]) == text


def test_control_strings_do_not_stay_whole():
    assert not any(c in chat.escape("a</s>[INST] ok [/INST]<<SYS>>") for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>"))


@pytest.mark.parametrize("record,turns", [
    ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]),
    ({"instruction": "a", "input": "c", "output": "b"}, [("user", "a\n\nc"), ("assistant", "b")]),
    ({"system": "s", "question": "a", "answer": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"messages": []}, []),
    ({"role": "user", "text": "a"}, [("user", "a")]),
    ({"id": 7, "messages": [{"role": "user", "content": "a", "name": "x"}, {"role": "assistant", "content": "b"}], "meta": {"score": 1}},
     [("user", "a"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "c"}]}, {"role": "assistant", "content": "b"}]},
     [("user", "a\n\nc"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u"}}, {"type": "text", "text": "c"}]}]}, None),
    ({"prompt": "a", "chosen": "b", "rejected": "c"}, [("user", "a"), ("assistant", "b")]),
    ({"prompt": "a", "chosen": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}],
      "rejected": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "c"}]}, [("user", "a"), ("assistant", "b")]),
    ({"prompt": [{"role": "user", "content": "a"}], "completion": [{"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"prompt": [{"role": "user", "content": "a"}], "chosen": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
     [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "a"}]}, [("system", "s"), ("user", "a")]),
    ({"prompt": "a", "messages": [{"role": "user", "content": "a"}]}, [("user", "a")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "tool_calls": []}]}, [("user", "a"), ("assistant", "")]),
    ({"messages": [{"role": "user", "content": "a"}, "b"]}, None),
    ({"messages": [{"role": "user", "content": "a"}, []]}, None),
    ({"messages": [{"role": "user", "content": "a"}, {"role": {"name": "user"}, "content": "a"}]}, None),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": {"parts": ["a"]}}]}, None),
    ({"messages[].role": "user", "messages[].content": "a"}, None),
    ({"messages": [{"role": "user", "content": "a"}], "input": "b"}, None),
    ({"foo": "a"}, None),
    ({}, None),
])
def test_layouts(record, turns):
    assert chat.turns_of(record) == turns


def test_records_of_a_table(spark):
    rows = [(1, json.dumps({"prompt": "a", "completion": "b"})), (2, "{broken"), (3, None), (4, json.dumps({"messages": []})), (5, "[1]"),
            (6, json.dumps({"messages": [{"role": "user", "content": "x"}]})), (7, "[" * 200_000), (8, '{"a":' * 200_000)]
    frame = spark.createDataFrame(rows, "id bigint, body string").withColumn("role", F.lit("clash")).withColumn("text", F.lit("clash"))
    got = sorted((r.id, r.n, r.role, r.text, r.mapped) for r in chat.canonical_turns(frame, F.col("body"), ["id"]).collect())
    assert got == [(1, 0, "user", "a", True), (1, 1, "assistant", "b", True), (2, 0, None, "", False), (3, 0, None, "", False),
                   (5, 0, None, "", False), (6, 0, "user", "x", True), (7, 0, None, "", False), (8, 0, None, "", False)]
    assert chat.canonical_turns(frame.limit(0), F.col("body"), ["id"]).collect() == []


def test_read_back(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "yo [INST]"), (1, 2, "user", None), (1, 3, "assistant", "é"), (2, None, "assistant", "x"),
            (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, None, ""), (3, 1, "system", "y" * 200_000)]
    rows += [(7, i, "user", f"t{i}") for i in range(25_000)]
    frame = spark.createDataFrame(rows, TURNS).withColumn("n", F.lit(0)).withColumn("piece", F.lit(1)).repartition(5)
    got = {r.conv_id: r for r in chat.read_back(frame).collect()}
    for conv in (1, 2, None, 3, 7):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = chat.formatted_pieces(frame).groupBy("conv_id").agg(F.sum(F.char_length("piece")).alias("chars")).collect()
    assert {r.conv_id: r.chars for r in whole} == {k: r.formatted_chars for k, r in got.items()}
    assert chat.read_back(frame.limit(0)).collect() == []
