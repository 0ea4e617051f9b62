import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.llm import chat

CONTROL = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    random.seed(1)
    bits = [*CONTROL, "\\", "<", "[", "<\\", "[\\\\", "s>", "INST]", "a", " ", "\n", "$1", "é", "😀", "|", "im_end|>"]
    texts = ["", *CONTROL, *("".join(random.choices(bits, k=random.randint(1, 12))) for _ in range(3000))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    for r in df.withColumn("b", chat.unescape(F.col("e"))).collect():
        assert r["b"] == r["t"]
        assert not any(c in r["e"] for c in CONTROL)


def test_every_layout(spark):
    pair = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in "system prompt completion response instruction input output question answer extra".split()]
        + [T.StructField("messages", pair)]
        + [T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])))]
    )
    cases = [
        ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "response": "c", "extra": "x"}, "prompt_response", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction_input", [("user", "i"), ("assistant", "o")]),
        ({"system": "s", "prompt": "p", "response": "c"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
        ({"question": "q", "answer": "a"}, "question_answer", [("user", "q"), ("assistant", "a")]),
        ({"messages": [("tool", None), (None, "x")]}, "messages", [("tool", ""), ("", "x")]),
        ({"messages": []}, "messages", []),
        ({"conversations": [("human", "h"), ("gpt", "g")]}, "conversations", [("user", "h"), ("assistant", "g")]),
        ({"prompt": "only"}, None, None),
        ({}, None, None),
        (None, None, None),
    ]
    rows = [(k, None if c is None else tuple(c.get(f.name) for f in schema)) for k, (c, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("n", T.LongType()), T.StructField("record", schema)]))
    df = df.withColumns({"turns": F.lit("other"), "layout": F.lit("other"), "formatted": F.lit("other")})
    out = chat.formatted(chat.canonical_turns(df))
    out = out.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    for r in out.collect():
        _, layout, turns = cases[r["n"]]
        assert r["layout"] == layout
        assert (None if r["turns"] is None else [tuple(t) for t in r["turns"]]) == turns
        if turns is not None:
            assert [tuple(t) for t in r["back"]] == turns
            assert r["loss"] == "".join(t for role, t in turns if role == "assistant")


def test_messy_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", None), (2, None, None, "<|im_end|>"), (None, 1, "user", "x"), (3, 1, "a\nb<|im_sep|>", ""), (4, 1, "user", "é😀" * 50_000), (4, 1, "user", "é😀" * 50_000), (4, 1, "assistant", "tie")]
    out = chat.formatted(chat.canonical_turns(chat.conversations(spark.createDataFrame(rows, schema))))
    out = out.withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask")))
    got = {r["conv_id"]: ([tuple(t) for t in r["back"]], r["loss"]) for r in out.collect()}
    assert got[1] == ([("user", ""), ("assistant", "b</s>")], "b</s>")
    assert got[2] == ([("", "<|im_end|>")], "")
    assert got[3] == ([("a\nb<|im_sep|>", "")], "")
    assert got[None] == ([("user", "x")], "")
    assert len(got[4][0]) == 3 and got[4][1] == "tie"
    assert chat.formatted(chat.canonical_turns(chat.conversations(spark.createDataFrame([], schema)))).count() == 0
