import json

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text, tools
from loomwright.operators import align


def chats(messages):
    return [(m.role, m.content) for m in messages]


def test_alpaca(spark):
    rows = spark.createDataFrame([("s", "i", "x", "o", [["a", "b"]]), (None, "i", "", None, None)], "system string, instruction string, input string, output string, history array<array<string>>")
    attr = align.dataset_attr({"columns": {"prompt": "instruction", "query": "input", "response": "output", "system": "system", "history": "history"}})
    a, b = align.align_dataset(rows, attr).collect()
    assert chats(a._prompt) == [("user", "a"), ("assistant", "b"), ("user", "i\nx")] and chats(a._response) == [("assistant", "o")] and a._system == "s"
    assert chats(b._prompt) == [("user", "i")] and b._response == []
    only = align.align_dataset(rows, align.dataset_attr({"columns": {"prompt": "instruction"}})).first()
    assert chats(only._prompt) == [("user", "i")] and only._response == []


def test_kto_and_ranking(spark):
    rows = spark.createDataFrame([("q", "r", True), ("q", "r", False)], "instruction string, output string, good boolean")
    yes, no = align.align_dataset(rows, align.dataset_attr({"columns": {"prompt": "instruction", "response": "output", "kto_tag": "good"}})).collect()
    assert [m.content for m in yes._response] == ["r", ""] and [m.content for m in no._response] == ["", "r"]
    as_int = rows.withColumn("good", F.col("good").cast("int"))
    assert len(align.align_dataset(as_int, align.dataset_attr({"columns": {"prompt": "instruction", "response": "output", "kto_tag": "good"}})).first()._response) == 1
    pairs = spark.createDataFrame([("q", "c", "r")], "instruction string, chosen string, rejected string")
    (p,) = align.align_dataset(pairs, align.dataset_attr({"ranking": True, "columns": {"prompt": "instruction", "chosen": "chosen", "rejected": "rejected"}})).collect()
    assert [m.content for m in p._response] == ["c", "r"]


def test_sharegpt(spark):
    kind = "conversations array<struct<from: string, value: string>>"
    rows = spark.createDataFrame([([("system", "s"), ("human", "a"), ("gpt", "b")],), ([("gpt", "b"), ("human", "a")],), ([("human", "a")],), ([("human", "a"), ("function_call", "f"), ("observation", "o"), ("gpt", "z")],)], kind)
    a, b, c, d = align.align_dataset(rows, align.DatasetAttr(formatting="sharegpt")).collect()
    assert (chats(a._prompt), chats(a._response), a._system) == ([("user", "a")], [("assistant", "b")], "s")
    assert b._prompt == b._response == c._prompt == []
    assert [m.role for m in d._prompt] == ["user", "function", "observation"]
    assert align.valid_sft(align.align_dataset(rows, align.DatasetAttr(formatting="sharegpt"))).count() == 2


def test_openai(spark):
    kind = "messages array<struct<role: string, content: string, tool_calls: array<struct<function: struct<name: string, arguments: string>>>>>, tools string"
    call = [(("f", '{"a": 1}'),)]
    rows = spark.createDataFrame(
        [([("user", "q", None), ("assistant", None, call), ("tool", "x", None), ("tool", "y", None), ("assistant", "z", None)], None), ([("user", "q", None), ("assistant", None, call), ("tool", "x", None)], "[]")], kind
    )
    attr = align.dataset_attr({"formatting": "openai", "columns": {"messages": "messages", "tools": "tools"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "observation_tag": "tool", "function_tag": "function", "system_tag": "system"}})
    a, b = align.align_dataset(rows, attr).collect()
    assert [m.role for m in a._prompt] == ["user", "function", "observation"] and a._prompt[2].content == f"x{align.JOINT}y" and a._system == "detailed thinking off"
    assert json.loads(a._prompt[1].content) == [{"name": "f", "arguments": '{"a": 1}'}]
    assert [m.role for m in b._prompt + b._response] == ["user", "function"] and b._system == ""  # the last tool message is lost


def test_v1(spark):
    rows = spark.createDataFrame([("i", "n", "o")], "instruction string, input string, output string")
    m = align.v1_convert(rows, "d", "alpaca").first()
    assert [(x.role, x.content[0].value, x.loss_weight) for x in m.messages] == [("user", "in", 0.0), ("assistant", "o", 1.0)] and m._dataset_name == "d"
    with pytest.raises(ValueError):
        align.v1_convert(rows, "d", "none")


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(text.tag(F.lit("<REASONING> a\nb </reasoning><final> n </final>"), "reasoning")) == "a\nb" and get(text.tag(F.lit("<Final> n </final>"), "final")) == "n"
    assert [get(text.extract_answer(F.lit(x))) for x in (r"x \boxed{3} y \boxed{4}", "The Answer is FORTY two.", "a\nb")] == ["4", "forty two", "b"]
    assert get(text.normalize_answer(F.lit(r" $\text{cm}$ "))) == "cm"
    assert get(text.pyjson(F.lit('{"b":1,"a":[1,"é"]}'))) == '{"b": 1, "a": [1, "é"]}'
    cases = {(30, 20, 40): None, (3000, 2000, 1000): (600, 400), (2000, 3000, 1000): (400, 600), (1000, 100, 1000): (900, 100), (100, 1000, 1000): (100, 900), (100, 500, 1000): (100, 500), (500, 100, 1000): (500, 100), (10, 10, 10): (5, 5)}
    for (s, t, c), want in cases.items():
        got = one.select(*[x.alias(n) for x, n in zip(text.infer_seqlen(F.lit(s), F.lit(t), c), "st", strict=True)]).first()
        assert want is None or tuple(got) == want, (s, t, c, got)
    assert get(text.edges_json(F.array(F.array(F.lit('a"'), F.lit("b"), F.lit("CALLS"))))) == '[["a\\"", "b", "CALLS"]]'
    assert get(text.code_snippet(F.lit("p.py"), F.lit("a\nb\nc\n"), F.lit(2), F.lit(9))) == "File: p.py:2-3\n```python\nb\nc\n\n```"
    assert [get(text.is_public_url(F.lit(u))) for u in ("http://example.com/x", "https://127.0.0.1/", "http://[::1]/", "ftp://x")] == [True, False, False, False]
    assert get(text.duration(F.lit(3725.9))) == "1:02:05" and get(text.best_choice(F.array(F.lit(0.1), F.lit(0.7)))) == "B"


SPEC = {"name": "t", "description": "d", "parameters": {"type": "object", "properties": {"foo": {"type": "string", "description": "the foo"}, "n": {"type": "number", "description": ""}}, "required": ["foo"]}}


@pytest.mark.parametrize("name", sorted(tools.FORMATS))
def test_tool_round_trip(name):
    form = tools.tool_format(name)
    assert "t" in form.tools([SPEC])
    one = [("t", '{"foo": "bar", "n": 10}')]
    written = form.calls(one)
    if name != "glm4_moe":  # its reader is not the inverse of its writer
        assert form.extract(written) == one
        if name not in ("glm4",):
            assert form.extract(form.calls(one * 2)) == one * 2
    assert form.extract("plain") == ([] if name == "seed_oss" else "plain")


def test_tool_columns(spark):
    row = spark.createDataFrame([(json.dumps([SPEC]), '<think>\nhm\n</think>\n\n{"name": "t", "arguments": {"foo": 1}}')], "tools string, calls string")
    got = row.select(tools.tool_column(F.col("tools"), "default").alias("t"), tools.call_column(F.col("calls"), "qwen").alias("c")).first()
    assert "  - foo (string, required): the foo\n" in got.t and got.c == '<think>\nhm\n</think>\n\n<tool_call>\n{"name": "t", "arguments": {"foo": 1}}\n</tool_call>'
