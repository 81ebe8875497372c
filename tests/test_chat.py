from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import chat


def reply(*turns):
    return json.dumps({"messages": [{"role": r, "content": c} for r, c in turns]})


GOOD = reply(("user", " hi "), ("assistant", "yo"))
CASES = [
    (GOOD, 2),
    (f"```json\n{GOOD}\n```", 2),
    (f"```json\n{GOOD}", 2),
    (f"Sure: {GOOD} there you go", 2),
    (reply(("assistant", "yo")), None),
    (reply(("robot", "x"), ("assistant", "yo")), None),
    (reply(("user", None), ("assistant", "yo")), None),
    (reply(("user", 5), ("assistant", "yo")), None),
    (reply(("user", "a"), ("user", "b")), None),
    (reply(("user", ""), ("assistant", "yo")), 1),
    (GOOD + " " + GOOD, None),
    (GOOD + ", " + GOOD, None),
    ("no braces", None),
    ("}{", None),
    ("", None),
    (None, None),
    ('{"messages": "x"}', None),
    ('{"messages": ["x", "y"]}', None),
    ('{"messages": [{"role": "user", "content": "broken', None),
    ("```json\n" + reply(("user", "use ```py``` here"), ("assistant", "ok")) + "\n```", None),
    (reply(("user", "use ```py``` here"), ("assistant", "ok")), 2),
]


def test_parsed(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, reply string")
    got = {r.i: r.m for r in df.select("i", chat.parsed(F.col("reply")).alias("m")).collect()}
    assert [None if got[i] is None else len(got[i]) for i in range(len(CASES))] == [n for _, n in CASES]
    assert [(m.role, m.content) for m in got[0]] == [("user", "hi"), ("assistant", "yo")]


def test_parsed_without_fences_keeps_fenced_contents(spark):
    df = spark.createDataFrame([("```json\n" + reply(("user", "use ```py``` here"), ("assistant", "ok")) + "\n```",)], "reply string")
    assert len(df.select(chat.parsed(F.col("reply"), fences=False).alias("m")).first().m) == 2


CALL = '<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>'
TOOLS = [
    ([("assistant", CALL)], True),
    ([("assistant", "no call")], False),
    ([("assistant", CALL), ("assistant", "<tool_call>{oops</tool_call>")], False),
    ([("assistant", '<tool_call>{"name": "f", "arguments": "x"}</tool_call>')], False),
    ([("assistant", '<tool_call>{"name": "f", "arguments": "x"}</tool_call>'), ("assistant", CALL)], True),
    ([("user", CALL)], False),
    ([("assistant", CALL + "<tool_call>{oops</tool_call>")], True),
    ([], False),
]


def test_tool_calls(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(TOOLS)], f"i int, m {chat.MESSAGES}")
    got = {r.i: r.ok for r in df.select("i", chat.tool_calls_valid(F.col("m")).alias("ok")).collect()}
    assert [got[i] for i in range(len(TOOLS))] == [ok for _, ok in TOOLS]


def test_rendering(spark):
    turns = [("user", " Q\u0085"), ("tool", "t"), ("robot", "x"), ("assistant", "A"), ("system", " \x1c\t"), ("user", None)]
    df = spark.createDataFrame([(turns,)], f"m {chat.MESSAGES}")
    r = df.select(chat.chat_lite(F.col("m")).alias("lite"), chat.rendered(F.col("m")).alias("full"), F.size(chat.clean(F.col("m"))).alias("n")).first()
    assert r.lite == "<|user|>\nQ\n<|assistant|>\nA<|end|>"
    assert r.n == 3 and "<|im_start|>tool\nt<|im_end|>" in r.full


@pytest.mark.parametrize(("row", "want"), [(("i", "c", "r"), "i\n\nc"), (("i", " ", "r"), "i"), ((" ", "c", "r"), None), (("i", "c", None), None)])
def test_instruction(spark, row, want):
    df = spark.createDataFrame([row], "i string, c string, r string")
    m = df.select(chat.instruction_messages(F.col("i"), F.col("c"), F.col("r")).alias("m")).first().m
    assert (m and m[0].content) == want
