import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bondweave.llm import chat

PIECES = [*chat.CONTROL, "<", "[", "\\", "|", "s>", "INST]", " ok ", "\n", "é", ""]


def formatted(spark, convs):
    rows = [(i, json.dumps({"messages": [{"role": r, "text": t} for r, t in c]})) for i, c in enumerate(convs)]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    return chat.read_back(chat.format_turns(chat.canonical_turns(df)))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "</s>\\"]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), min_size=1, max_size=4), min_size=20, max_size=40))
def test_round_trip(spark, convs):
    for r in formatted(spark, convs).orderBy("conv_id").collect():
        want = convs[r.conv_id]
        assert [(t.role, t.text) for t in r.turns_back] == want
        assert list(r.loss_back) == [t for role, t in want if role == "assistant"]
        for s in r.loss_spans:
            assert chat.CLOSE not in r.formatted[s.start : s.end] and r.formatted[s.end :].startswith(chat.CLOSE)


RECORDS = [
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"id": 7, "prompt": "p", "response": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"instruction": "do", "input": "", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"system": "be", "question": "q", "answer": "a"}, [("system", "be"), ("user", "q"), ("assistant", "a")]),
    ({"system": "", "question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": None}]}, [("user", "x"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "x"}, {"from": "gpt", "value": "y", "weight": 1.5}]}, [("user", "x"), ("assistant", "y")]),
    ({"foo": "bar"}, None),
    ({"messages": "no list"}, None),
]


def test_layouts(spark):
    rows = [(i, json.dumps(r), "clash") for i, (r, _) in enumerate(RECORDS)] + [(90, None, "c"), (91, "{broken", "c"), (92, "[]", "c")]
    df = spark.createDataFrame(rows, "conv_id long, record string, turns string")
    got = {r.conv_id: r for r in chat.canonical_turns(df).collect()}
    assert len(got) == len(rows)
    for i, (_, want) in enumerate(RECORDS):
        assert (None if got[i].turns is None else [tuple(t) for t in got[i].turns]) == want, RECORDS[i]
    assert all(got[i].turns is None and got[i].layout == "unknown" for i in (8, 9, 90, 91, 92))


def test_rows_to_records(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x" * 300_000), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1))
    got = chat.chat_digest(chat.format_turns(chat.canonical_turns(chat.records_of_rows(df)))).collect()
    assert {r.conv_id: r.n_turns for r in got} == {1: 3, 2: 1, None: 1}
    assert {r.conv_id: r.loss_chars for r in got} == {1: 1, 2: 0, None: 0}
    assert chat.records_of_rows(df.limit(0)).collect() == []


def test_no_python(spark):
    df = spark.createDataFrame([(1, "{}")], "conv_id long, record string")
    plan = chat.read_back(chat.format_turns(chat.canonical_turns(df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprint_ignores_order_and_types(spark):
    df = spark.createDataFrame([('{"prompt": "a", "completion": "b"}',), ('{"completion": 1.5, "score": 2, "prompt": null}',)], "record string")
    a, b = [r[0] for r in df.select(chat.fingerprint(F.col("record"))).collect()]
    assert a == b
    with pytest.raises(AssertionError):
        assert a == spark.createDataFrame([('{"prompt": "a"}',)], "record string").select(chat.fingerprint(F.col("record"))).first()[0]


def digest(spark, df):
    return chat.chat_digest(chat.format_turns(chat.canonical_turns(df)), df.columns[0]).collect()


def test_texts_beyond_the_parsers_own_limit(spark):
    """One turn of 25 million characters, as rows and as a JSON record."""
    n = 123 * 200_000
    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit('a"\n<s>' + "words " * 19 + "end"), (F.col("id") + 200_000).cast("int")).alias("text"))
    (a,) = digest(spark, chat.records_of_rows(rows))
    json_record = rows.select("conv_id", F.to_json(F.struct(F.array(F.struct("role", "text")).alias("messages"))).alias("record"))
    (b,) = digest(spark, json_record)
    assert a == b and (a.n_turns, a.loss_chars, a.layout) == (1, n, "messages.role.text")
    (c,) = digest(spark, rows.select("conv_id", F.to_json(F.struct(F.lit("p").alias("prompt"), F.col("text").alias("completion"))).alias("record")))
    assert (c.n_turns, c.loss_chars, c.loss_sha256) == (2, n, a.loss_sha256)


def test_many_turns_take_time_in_proportion(spark):
    import time

    rows = spark.range(60_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <s> "), F.col("id").cast("string")).alias("text"))
    began = time.perf_counter()
    (r,) = digest(spark, chat.records_of_rows(rows))
    assert r.n_turns == 60_000 and r.loss_chars == sum(len(f"text <s> {i}") for i in range(1, 60_000, 2))
    assert time.perf_counter() - began < 30


def test_structs_of_other_layouts(spark):
    df = spark.createDataFrame([(1, ("be", "q", "a", 3)), (2, None)], "conv_id long, record struct<system:string,question:string,answer:string,score:int>")
    got = {r.conv_id: r for r in chat.canonical_turns(df).collect()}
    assert [tuple(t) for t in got[1].turns] == [("system", "be"), ("user", "q"), ("assistant", "a")]
    assert got[2].layout == "unknown" and got[2].turns is None
    other = spark.createDataFrame([(1, ("x",))], "conv_id long, record struct<foo:string>")
    assert chat.canonical_turns(other).first().layout == "unknown"


def test_each_row_is_fingerprinted(spark):
    """Rows of one struct column in many layouts, and the hash in the plan."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", ""), (2, 0, "user", ""), (2, 1, "assistant", "b"), (3, 0, "user", "<s>"), (3, 1, "assistant", "d"), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "v")]
    rows += [(5, 0, "system", ""), (5, 1, "user", "u"), (5, 2, "assistant", "v"), (6, 0, "assistant", "x"), (7, 0, "user", "y"), (8, 0, "tool", None), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(chat.in_many_layouts(chat.records_of_rows(df)))
    assert "xxhash64" in turns._jdf.queryExecution().optimizedPlan().toString()
    got = {r.conv_id: r for r in turns.collect()}
    assert {i: r.layout for i, r in got.items()} == {
        1: "answer+question", 2: "instruction+output", 3: "completion+prompt", 4: "answer+question+system", 5: "conversations.from.value", 6: "messages.role.text", 7: "turns.role.content", 8: "conversations.from.value", None: "messages.role.text",
    }
    for i, r in got.items():
        assert [tuple(t) for t in r.turns] == [(role, text or "") for c, _, role, text in sorted(rows, key=str) if c == i]


def test_nulls_of_structs_and_clashing_names(spark):
    df = spark.createDataFrame([(1, ("p", None), 5, 6, 7), (2, (None, None), 5, 6, 7), (3, None, 5, 6, 7)], "conv_id long, record struct<prompt:string,completion:string>, _got int, _fp int, _m int")
    out = chat.format_turns(chat.canonical_turns(df)).collect()
    assert [(r._got, r._fp, r._m) for r in out] == [(5, 6, 7)] * 3
    assert [[tuple(t) for t in r.turns] if r.turns else None for r in out] == [[("user", "p"), ("assistant", "")], [("user", ""), ("assistant", "")], None]
