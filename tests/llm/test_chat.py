import hashlib
import json

import pytest
from pyspark.sql import functions as F
from quillspace.llm import chat as c

NASTY = ["", "plain", r"\### Assistant: </turn> ok", "\n</turn>\n<turn role=\"user\">\n", "\\", "\\\\</turn", "<\\turn", "<turn", 'say "hi"', "\\n", "$1 \\1", "\U0001f600é"]


def test_template_round_trips(spark):
    roles = ["user", "assistant", 'odd "role"', "it's", "\\", "\\'", "<turn", ""]
    turns = [{"role": roles[i % len(roles)], "text": x} for i, x in enumerate(NASTY * 3)]
    rows = [(1, turns), (2, []), (3, [{"role": "assistant", "text": x} for x in NASTY])]
    df = spark.createDataFrame(rows, f"conv_id long, turns {c.TURNS}")
    out = c.formatted(df).withColumn("back", c.parsed(F.col("formatted"))).withColumn("under", c.loss_text(F.col("formatted"), F.col("loss"))).collect()
    for r, (_, turns) in zip(sorted(out, key=lambda r: r["conv_id"]), rows, strict=True):
        assert [(t["role"], t["text"]) for t in r["back"]] == [(t["role"], t["text"]) for t in turns]
        assert r["under"] == "".join(t["text"] for t in turns if t["role"] == "assistant")
        assert r["formatted"].count("</turn>") == len(turns)


def test_layouts_of_json(spark):
    said = [("user", "q"), ("assistant", "a")]
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]}, "messages", said),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
        ([{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}], "bare_messages", said),
        ({"response": "a", "prompt": "q"}, "prompt_response", said),
        ({"prompt": "q", "completion": "a"}, "prompt_completion", said),
        ({"question": "q", "answer": "a"}, "question_answer", said),
        ({"instruction": "q", "output": "a"}, "instruction_output", said),
        ({"instruction": "q", "input": "x", "output": "a"}, "instruction_input", [("user", "q\n\nx"), ("assistant", "a")]),
        ({"system": "s", "instruction": "q", "output": "a"}, "system_instruction", [("system", "s"), *said]),
        ({"unknown": 1}, None, []),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _, _) in enumerate(records)] + [(97, "no json"), (98, None)]
    out = {r["i"]: r for r in c.canonical_json(spark.createDataFrame(rows, "i int, record string"), "record").collect()}
    for i, (_, layout, turns) in enumerate(records):
        assert (out[i]["layout"], [(t["role"], t["text"]) for t in out[i]["turns"]]) == (layout, turns)
    assert out[97]["fingerprint"] is None and out[98]["turns"] == []


def test_layouts_of_tables(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "q"), (1, None, None, "first"), (2, 0, "user", "x"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in c.canonical_table(rows.withColumn("turns", F.lit(1))).collect()}
    assert got == {1: [("", "first"), ("user", "q"), ("assistant", "")], 2: [("user", "x"), ("user", "x")]}
    pair = spark.createDataFrame([(1, "q", None)], "conv_id long, prompt string, response string")
    assert [tuple(t) for t in c.canonical_table(pair).first()["turns"]] == [("user", "q"), ("assistant", "")]
    listed = spark.createDataFrame([(1, [("human", "q")])], "conv_id long, messages array<struct<role: string, content: string>>")
    assert [tuple(t) for t in c.canonical_table(listed).first()["turns"]] == [("user", "q")]
    with pytest.raises(ValueError):
        c.canonical_table(spark.range(1))
    assert c.digests(c.formatted(c.canonical_table(rows.limit(0)))).count() == 0


def test_tables_are_selected_by_hash(spark, monkeypatch):
    kind = spark.createDataFrame([], "text string, turn long, conv_id long, role string").schema
    assert c.table_mapping(kind).name == "turn_rows"
    wide = spark.createDataFrame([], "prompt string, response string, conv_id long, text string, role string, turn long, extra int").schema
    assert c.table_mapping(wide).name == "turn_rows"
    assert c.table_fingerprint(["b", "a"]) == c.table_fingerprint(["a", "b"]) != c.table_fingerprint(["a", "c"])
    monkeypatch.setattr(c, "table_fingerprint", lambda paths: "one")
    assert c.table_mapping(kind).name == c.TABLES[-1].name  # nothing but the hash selects


def test_long_conversation_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", f"<turn {i} \\ </turn>", 1, 2, "x") for i in range(20_000)], "conv_id long, turn long, role string, text string, _pieces int, _turns int, formatted string")
    got = c.digests(c.formatted(c.canonical_table(rows))).first()
    loss = "".join(f"<turn {i} \\ </turn>" for i in range(1, 20_000, 2))
    assert got["n_turns"] == 20_000 and got["loss_chars"] == len(loss)
    assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
