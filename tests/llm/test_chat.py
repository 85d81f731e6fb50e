"""Chat formatting: exact round trips, the machine, parts."""

import random

from pyspark.sql import functions as F

from wxframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(df, **options):
    whole = chat.joined(chat.format_chats(df, **options)).withColumn("turns", chat.parse(F.col("formatted")))
    return {r.conv_id: r for r in whole.collect()}


def test_texts_with_controls_come_back(spark):
    rnd = random.Random(1)
    signs = [*chat.CHAT.controls(), "\\", "[", "<", "]", ">", "/", " ", "\n", "INST]", "s>", "é", "$1", ""]
    roles = ["user", "assistant", "system", "tool", "judge", "[SEP]x", "", None]
    rows = [(c, t, rnd.choice(roles), "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 8))))
            for c in range(60) for t in range(rnd.randint(1, 9))] + [(99, 0, "user", None), (None, 0, "user", "x")]
    rows += [(100, None, "user", "first"), (100, 5, "user", "same"), (100, 5, "user", "same"), (100, -3, "tool", "before")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", formatted string, part int")
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or "", role == "assistant"))
    for options in ({}, {"part_turns": 2}):
        got = read_back(df, **options)
        assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want


def test_segments_make_the_formatted_string(spark):
    df = spark.createDataFrame([(1, 0, "user", "a[INST]"), (1, 1, "assistant", "b</s>")], SCHEMA)
    row = chat.format_chats(df).collect()[0]
    assert row.formatted == r"[INST]a[\INST][/INST]<s>b<\/s></s>"
    assert "".join(s.text for s in row.segments) == row.formatted
    assert [s.text for s in row.segments if s.loss] == [r"b<\/s>"]


def test_machine(spark):
    cases = {1: "sua", 2: "uaua", 3: "uu", 4: "au", 5: "u", 6: "uatau", 7: "usa", 8: "x", 9: "uata"}
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "x": "other"}
    df = spark.createDataFrame([(c, t, names[r], "") for c, s in cases.items() for t, r in enumerate(s)], SCHEMA)
    for size in (1, 2, 256):
        got = {r.conv_id: r.valid for r in chat.validate(chat.format_chats(df, part_turns=size)).collect()}
        assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: True}


def test_empty_and_native(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert read_back(df) == {} and chat.validate(chat.format_chats(df)).count() == 0
    plan = chat.joined(chat.format_chats(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
