import hashlib
import json

import pytest
from pyspark.sql import functions as F

from seriata.llm import chat

TURNS = [
    (1, 1, "assistant", "second"), (1, 0, "user", "first"), (2, 0, "user", None), (2, None, "system", "early"), (3, 0, None, "who"),
    (4, 0, "assistant", chat.START + "user\n" + chat.END + "\n" + chat.ESCAPE + "A" + chat.ESCAPE), (4, 0, "odd\n" + chat.ESCAPE + "nrole", "".join(chat.CONTROLS) + "\n"),
    (5, 3, "assistant", "dup"), (5, 3, "assistant", "dup"), (None, 0, "assistant", "no id"), (6, 0, "assistant", "é␛0" * 20000), (7, 0, "user", ""),
]


def want(rows):
    """Turns by conversation. TURNS has one row without an id, which is a conversation by itself."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in by.items()}


def test_round_trip_and_loss(spark):
    df = spark.createDataFrame([(*r, "x") for r in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_turns(chat.table_turns(df))
    back = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), chat.turns_digest(chat.read_turns(F.col("formatted"))).alias("sha"), "formatted")
    got = {r.conv_id: r for r in back.collect()}
    expected = want(TURNS)
    assert {c: [(t.role, t.text) for t in r.t] for c, r in got.items()} == expected
    for c, turns in expected.items():
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
        assert got[c].sha == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        bare = got[c].formatted
        assert bare.count(chat.START) == bare.count(chat.END) == len(turns) and "[INST]" not in bare


def test_json_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"turns": [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}]}, {"completion": "b", "prompt": "a"}, {"prompt": "a", "response": "b"},
        {"question": "a", "answer": "b"}, {"output": "b", "instruction": "a"}, {"instruction": "a", "input": "c", "output": "b"}, {"system": "s", "instruction": "a", "output": "b"},
        {"unknown": 1}, {"prompt": None, "completion": "b"},
        {"id": 7, "source": {"prompt": 1}, "messages": [{"role": "user", "content": "a", "name": "x", "meta": {"role": "no", "deep": [{"content": 1}]}}, {"role": "assistant", "content": "b"}]},
        {"messages": []}, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}]}]}, {"messages": [{"role": "user", "content": None}, {"role": "gpt"}]},
        {"messages": [{"role": "user"}]}, {"prompt": "a", "completion": "b", "messages": []}, [1], {"turns": [{"role": "user", "text": "a"}, {"role": "assistant", "text": "b"}], "lang": "en"},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(99, "not json"), (98, None)], "i int, j string")
    got = {r.i: None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in chat.record_turns(df, "j").collect()}
    pair = [("user", "a"), ("assistant", "b")]
    assert all(got[i] == pair for i in range(7))
    assert got[7] == [("user", "a"), ("user", "c"), ("assistant", "b")] and got[8] == [("system", "s"), *pair]
    assert got[9] is got[98] is got[99] is None and got[10] == [("user", ""), ("assistant", "b")]
    assert got[11] == got[18] == pair and got[12] == [] and json.loads(got[13][0][1]) == [{"type": "text", "text": "a"}] and got[14] == [("user", ""), ("assistant", "")]
    assert got[15] is got[16] is got[17] is None
    assert [sorted(r.i for r in x.collect()) for x in chat.unmatched(chat.record_turns(df, "j"))][1] == [9, 15, 16, 17, 98, 99]


def test_typed_layouts(spark):
    pairs = chat.table_turns(spark.createDataFrame([(1, "a", None)], "conv_id long, prompt string, response string")).first().turns
    assert [(t.role, t.text) for t in pairs] == [("user", "a"), ("assistant", "")]
    nested = chat.table_turns(spark.createDataFrame([(1, [("user", "a", 0)])], "conv_id long, turns array<struct<role:string,text:string,x:int>>")).first().turns
    assert [(t.role, t.text) for t in nested] == [("user", "a")]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(chat.table_turns(df)).count() == 0


def test_rows_without_an_id_stay_apart(spark):
    df = spark.createDataFrame([(None, k % 2, "user", f"t{k % 3}") for k in range(6)] + [(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id is None, [t.text for t in r.turns]) for r in chat.table_turns(df).collect())
    assert got == [(False, ["x"]), *[(True, [f"t{k}"]) for k in (0, 0, 1, 1, 2, 2)]]


def test_table_layouts_are_told_by_their_fields(spark):
    told = lambda schema: chat.table_layout(spark.createDataFrame([], schema).schema)
    assert told("conv_id long, turn long, role string, text string, lang string") == "turn_rows"
    assert told("turns array<struct<role:string,text:string,at:long>>, conv_id long") == "nested_turns" and told("conv_id long, prompt string, response string, x int") == "pairs"
    for schema in ("conv_id long, text string", "conv_id long, turn long, role string, text string, prompt string", "a int"):
        with pytest.raises(ValueError, match="no layout"):
            told(schema)
