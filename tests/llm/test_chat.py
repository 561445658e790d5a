import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from storyloom.llm import chat

SF = "/root/testdata/sf0.001"


def turns_df(spark, rows):
    return spark.createDataFrame(rows, chat.TURNS)


def plain_digests(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is None, t or 0, r is not None, r or "", x is not None, x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for *_, r, _, x in turns if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, _, x in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def digests(df):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(2)
    bits = ["<", "[", "\\", "|turn|>", "|text|>", "|end|>", "/s>", "s>", "INST]", "/INST]", "<|turn|>", "<|end|>\n", "<\\|end|>", "[\\\\/INST]", "a", "\n", "$1", "é😀", "<<s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "<|text|>", "", None]), "".join(rng.choices(bits, k=rng.randrange(8))) if rng.random() < 0.95 else None) for c in range(60) for t in range(rng.randrange(1, 7))]
    pieces = chat.formatted(turns_df(spark, rows))
    assert digests(chat.read_back(pieces)) == plain_digests(rows)
    for r in chat.conversations(pieces).collect():
        loss = "".join(chat.unescape(r["text"][s["start"] : s["start"] + s["length"]]) for s in r["loss"])
        assert hashlib.sha256(loss.encode()).hexdigest() == plain_digests(rows)[r["conv_id"]][3]


def test_edges(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (1, None, "assistant", "late"), (None, 1, None, None), (2, 5, "assistant", "y" * 300_000)]
    assert digests(chat.read_back(chat.formatted(turns_df(spark, rows)))) == plain_digests(rows)
    assert chat.read_back(chat.formatted(turns_df(spark, []))).count() == 0
    extra = turns_df(spark, rows).selectExpr("*", "'z' as piece", "1 as loss_start")
    assert digests(chat.read_back(chat.formatted(chat.turns_of_table(extra)))) == plain_digests(rows)


def test_a_long_conversation_spans_batches(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(20_000)] + [(8, 0, "user", "x")]
    assert digests(chat.read_back(chat.formatted(turns_df(spark, rows)))) == plain_digests(rows)


RECORDS = [
    ({"id": 1, "prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
    ({"id": 2, "instruction": "i", "output": "o", "extra": {"a": 1}}, "instruction", [("user", "i"), ("assistant", "o")]),
    ({"id": 3, "instruction": "i", "input": "n", "output": None}, "instruction_input", [("user", "i"), ("user", "n"), ("assistant", None)]),
    ({"id": 4, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
    ({"id": 5, "conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
    ({"data": {"id": 6, "messages": [{"role": "user", "content": "u"}]}}, "nested_messages", [("user", "u")]),
    ({"id": 7, "unknown": 1}, None, []),
    ([1], None, []),
]


def test_layouts_of_records(spark):
    lines = [(json.dumps(r),) for r, *_ in RECORDS] + [(None,), ("not json",)]
    got = [(r["layout"], [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.read_records(spark.createDataFrame(lines, "line string")).coalesce(1).collect()]
    assert got == [(n, t) for _, n, t in RECORDS] + [(None, []), (None, [])]
    assert len({chat.fingerprint(x) for x in chat.NEEDED.values()}) == len(chat.LAYOUTS)


def test_further_fields_of_known_names_do_not_matter(spark):
    extras = {k: "z" for k in ("id", "input", "text", "system", "role", "turn")}
    for record, name, turns in RECORDS[:2] + RECORDS[3:5]:
        own = {k: v for k, v in extras.items() if not (name == "instruction" and k == "input") and not (name == "prompt_response" and k == "system")}
        got = chat.turns_of_record(json.dumps(own | record))
        assert (got["layout"], [(t["role"], t["text"]) for t in got["turns"]], got["conv_id"], got["error"]) == (name, turns, record["id"], None)
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", "y")]
    for extra in ("id", "input", "prompt", "output", "instruction", "system", "messages"):
        df = turns_df(spark, rows).withColumn(extra, F.lit("clash"))
        assert digests(chat.read_back(chat.formatted(chat.turns_of_table(df)))) == plain_digests(rows)
    every = turns_df(spark, rows).select("*", *[F.lit("clash").alias(c) for c in ("id", "prompt", "response", "instruction", "input", "output", "system", "completion")])
    assert digests(chat.read_back(chat.formatted(chat.turns_of_table(every)))) == plain_digests(rows)


def test_malformed_records_are_rows_with_an_error(spark):
    message = {"role": "user", "content": "u"}
    deep = "[" * 5000 + "]" * 5000
    lines = [
        (json.dumps({"id": 1, "messages": [message, None]}), None, "message 1 is no object"),
        (json.dumps({"id": 2, "messages": [{"role": ["a"], "content": "u"}]}), [('["a"]', "u")], None),
        (json.dumps({"id": 3, "messages": [{"role": 5, "content": {"x": 1}}]}), [("5", '{"x": 1}')], None),
        (json.dumps({"id": 2**70, "messages": [message]}), [("user", "u")], None),
        ('{"id": 5, "messages": [{"role": "user", "content": "a\\ud800b"}]}', [("user", "a\ufffdb")], None),
        (f'{{"id": 6, "prompt": "p", "response": {deep}}}', None, "nested too deeply"),
        (deep, None, None),
        ('{"id": 8, "messages": []}', None, "no layout has these fields"),
        ('{"id": 9, "messages": null}', None, "no layout has these fields"),
        ("{", None, "no JSON"),
        ("", None, "no JSON"),
        ("7", None, "no object"),
        (None, None, "no object"),
        ('{"id": 1' + "0" * 5000 + "}", None, "no layout has these fields"),
        (json.dumps({"id": "a-b", "prompt": "p", "response": "r"}), [("user", "p"), ("assistant", "r")], None),
        (json.dumps({"prompt": "p", "response": "r"}), [("user", "p"), ("assistant", "r")], None),
        (json.dumps({"prompt": "q", "response": "r"}), [("user", "q"), ("assistant", "r")], None),
    ]
    df = spark.createDataFrame([(x,) for x, *_ in lines], "line string").coalesce(1)
    rows = chat.read_records(df).collect()
    assert len(rows) == len(lines)
    for r, (line, turns, error) in zip(rows, lines, strict=True):
        assert [(t["role"], t["text"]) for t in r["turns"]] == (turns or []), line
        assert (r["error"] is None) == (turns is not None) and (error is None or r["error"] == error), line
    ids = [r["conv_id"] for r in rows if not r["error"]]
    assert None not in ids and len(set(ids)) == len(ids) and {2, 3, 5} <= set(ids)
    assert chat.turns_of_records(df).count() == sum(len(t) for _, t, _ in lines if t)


def test_layouts_of_tables(spark):
    df = spark.createDataFrame([(1, [("human", "h"), ("gpt", "g")])], "id int, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in chat.turns_of_table(df).collect()] == [(1, 0, "user", "h"), (1, 1, "assistant", "g")]
    df = spark.createDataFrame([(1, "p", "c")], "id long, prompt string, completion string")
    assert [tuple(r) for r in chat.turns_of_table(df).collect()] == [(1, 0, "user", "p"), (1, 1, "assistant", "c")]
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1,)], "a int"))


def test_names_that_look_like_paths_are_no_paths(spark):
    lines = [
        {"messages[].role": 1, "messages[].content": 2},
        {"data.messages[].role": 1, "data.messages[].content": 2, "id": 3},
        {"": {"messages": [{"role": "user", "content": "x"}]}},
        {"messages": {"role": "user", "content": "x"}, "messages[].role": 1, "messages[].content": 2},
        {"id": 7, "messages": [{"role": "user", "content": "x"}], "a.b": {"[]": [1]}},
    ]
    long = '{"id": ' + "9" * 5000 + ', "prompt": "p", "response": ' + "8" * 5000 + "}"
    rows = [chat.turns_of_record(json.dumps(x)) for x in lines] + [chat.turns_of_record(long)]
    assert [r["error"] for r in rows] == ["no layout has these fields"] * 4 + [None, None]
    assert rows[4]["conv_id"] == 7 and rows[5]["turns"][1]["text"] == "8" * 5000
    assert [r["error"] for r in chat.read_records(spark.createDataFrame([(json.dumps(x),) for x in lines], "x string")).collect()].count(None) == 1
