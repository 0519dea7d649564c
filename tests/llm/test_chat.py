import json

from pyspark.sql import functions as F

from kindred.llm import chat

HARD = ["</s>[INST] ok [/INST]", "<|end|>", "\\<|turn|>\\\\", "[\\INST]", "<<SYS>> <</SYS>>", "<", "", "é\n<|says|>"]


def records(spark, objects):
    rows = [(i, json.dumps(o) if o is not None else None, 1, "x") for i, o in objects]
    df = spark.createDataFrame(rows, "id long, j string, turn long, turns string")
    return df.withColumn("record", F.try_parse_json("j"))


def turns(df):
    return {r.id: [(t.role, t.text) for t in r.turns] for r in df.collect()}


def test_layouts(spark):
    objects = [
        (1, {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant", "x": 1}]}),
        (2, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": "q"}),
        (3, {"instruction": "do", "input": "it", "output": "done"}),
        (4, {"instruction": "do", "input": "", "output": None, "meta": {"n": 1.5}}),
        (5, {"prompt": "p", "completion": "c"}),
        (6, {"prompt": "p", "response": "r"}),
        (7, {"question": "q", "context": "c", "answer": "a"}),
        (8, {"turn": 1, "role": "assistant", "text": "second"}),
        (8, {"turn": 0, "role": "user", "text": None}),
        (8, {"turn": None, "role": None, "text": "zero"}),
        (9, {"unknown": 1}),
        (10, None),
        (11, {"messages": []}),
        (None, {"prompt": "p", "completion": "c"}),
        (12, {"messages": [{"role": "user", "content": None}]}),
    ]
    assert turns(chat.canonical_turns(records(spark, objects), "id")) == {
        1: [("user", "a"), ("assistant", "b")],
        2: [("user", "a"), ("assistant", "b")],
        3: [("user", "do\n\nit"), ("assistant", "done")],
        4: [("user", "do"), ("assistant", "")],
        5: [("user", "p"), ("assistant", "c")],
        6: [("user", "p"), ("assistant", "r")],
        7: [("user", "q\n\nc"), ("assistant", "a")],
        8: [("", "zero"), ("user", ""), ("assistant", "second")],
        None: [("user", "p"), ("assistant", "c")],
        12: [("user", "")],
    }


def test_fields_count_where_they_stand(spark):
    message = {"role": "user", "content": "a"}
    odd = {"role": "user", "attachments": [{"name": "f", "size": {"kb": 1}}], "content": "b", "z": {"role": 1}}
    objects = [
        (1, {"x": {"messages": [message]}, "prompt": "p", "completion": "c"}),
        (2, {"messages": [odd, message], "tail": [[{"q": 1}], []]}),
        (3, {"messages": [{"role": "user", "content": [{"type": "text", "text": "t"}, {"type": "image"}, {"text": "u"}]}]}),
        (4, {"messages": [{"role": "user", "content": [{"text": "t"}]}, {"role": "assistant", "content": "s"}]}),
        (5, {"a b": {"<messages: ARRAY<": 1}, "prompt": "p", "response": "r", "x`y": [1.5]}),
        (6, {"y": {"prompt": "p", "completion": "c"}}),
        (7, {"prompt": {"text": "p"}, "completion": "c"}),
        (8, {"messages": {"role": "user", "content": "no list"}}),
        (9, {"messages": [{"x": message}]}),
        (10, {"y": {"prompt": "other", "completion": None}}),
        (11, None),
        (12, {}),
    ]
    df = records(spark, objects)
    assert turns(chat.canonical_turns(df, "id")) == {
        1: [("user", "p"), ("assistant", "c")],
        2: [("user", "b"), ("user", "a")],
        3: [("user", "t\n\nu")],
        4: [("user", "t"), ("assistant", "s")],
        5: [("user", "p"), ("assistant", "r")],
    }
    left = chat.unmatched(df).collect()
    assert sorted(r.records for r in left) == [1, 1, 1, 1, 1, 2]
    assert len({r.fingerprint for r in left}) == 6


def test_key_named_as_the_record(spark):
    df = records(spark, [(1, {"prompt": "p", "completion": "c"})])
    named = df.select(F.col("record").alias("said"), F.col("id").alias("record"))
    got = chat.canonical_turns(named, "record", "said").collect()
    assert [(r.record, len(r.turns)) for r in got] == [(1, 2)]


def test_fingerprints(spark):
    same = [(1, {"prompt": "a", "completion": "b"}), (2, {"completion": 5, "prompt": None}), (3, {"prompt": "a"})]
    marks = {r.id: r._fingerprint for r in chat.with_layout(records(spark, same)).collect()}
    assert marks[1] == marks[2] != marks[3]


def test_round_trip(spark):
    said = [{"role": r, "content": t} for r in ("user", "assistant", "a\n<|says|>") for t in HARD]
    long = {"messages": [{"role": "assistant", "content": "word <s> " * 20000}] * 3}
    df = chat.formatted(chat.canonical_turns(records(spark, [(1, {"messages": said}), (2, long)]), "id"))
    text = chat.whole_text(F.col("segments"))
    rows = df.select("id", text.alias("t"), chat.read_back(text).alias("back"), chat.loss_text(F.col("segments")).alias("loss"))
    by = {r.id: r for r in rows.collect()}
    assert [(t.role, t.text) for t in by[1].back] == [(m["role"], m["content"]) for m in said]
    assert by[1].loss == "".join(HARD)
    assert by[1].t.count(chat.CLOSE) == len(said)
    assert "[INST]" not in by[1].t and "<s>" not in by[2].t
    assert by[2].loss == "word <s> " * 60000


def test_empty(spark):
    assert chat.formatted(chat.canonical_turns(records(spark, []), "id")).count() == 0
