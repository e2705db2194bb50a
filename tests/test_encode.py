import pytest
from pyspark.sql import functions as F

from loomwright.operators import encode, templates

MESSAGES = "m array<struct<role: string, content: string>>"


def test_chatml(spark):
    row = spark.createDataFrame([([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")],)], MESSAGES)
    t = templates.get_template("chatml")
    got = row.select(templates.render(F.col("m"), t, "s").alias("x"), templates.turn_pairs(F.col("m"), t).alias("p")).first()
    assert got.x == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n<|im_start|>assistant\nd<|im_end|>\n"
    assert [p.target for p in got.p] == ["b<|im_end|>\n", "d<|im_end|>\n"]
    fused = row.select(templates.render(F.col("m"), templates.get_template("llama2"), "s").alias("x")).first().x
    assert fused == "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\na [/INST]b</s><s>[INST] c [/INST]d</s>"
    with pytest.raises(ValueError):
        templates.get_template("none")
    assert "<|im_start|>" in templates.jinja(t) and 'PARAMETER stop "<|im_end|>"' in templates.modelfile(t)


@pytest.mark.parametrize("thinking,thought,prompt_end,response", [(True, True, False, "T"), (True, False, False, "E"), (False, True, True, ""), (False, False, True, ""), (None, True, False, "T"), (None, False, True, "")])
def test_thinking(spark, thinking, thought, prompt_end, response):
    said = "<think>\nhm\n</think>\n\nb" if thought else "b"
    row = spark.createDataFrame([([("user", "a"), ("assistant", "<think>\nold\n</think>\n\nx"), ("user", "c"), ("assistant", said)],)], MESSAGES)
    t = templates.get_template("qwen3", enable_thinking=thinking)
    got = row.select(templates.one_turn(F.col("m"), t).alias("x")).first().x
    empty = "<think>\n\n</think>\n\n"
    assert "old" not in got.prompt and got.prompt.endswith(empty) == prompt_end
    assert got.response == {"T": "<think>\nhm\n</think>\n\n", "E": empty, "": ""}[response] + "b<|im_end|>\n"
    many = row.select(templates.turn_pairs(F.col("m"), t).alias("x")).first().x
    assert ("old" in many[0].target) == (thinking is not False)


def test_media(spark):
    row = spark.createDataFrame([([("user", "<image>x<image>"), ("assistant", "<image>")], [2, 1, 3])], MESSAGES + ", n array<int>")
    got = row.select(templates.expand_media(F.col("m"), "qwen2_vl", image=F.col("n")).alias("x")).first().x
    pad = lambda k: "<|vision_start|>" + "<|image_pad|>" * k + "<|vision_end|>"
    assert [m.content for m in got] == [f"{pad(2)}x{pad(1)}", pad(3)]


def pairs(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "p array<struct<source: array<int>, target: array<int>>>")


def test_labels(spark):
    rows = pairs(spark, [[([1, 2], [3]), ([4], [5, 6])]])
    get = lambda **k: rows.select(encode.sft_labels(F.col("p"), k.pop("cutoff", 100), **k).alias("e")).first().e
    assert list(get().labels) == [-100, -100, 3, -100, 5, 6] and list(get().input_ids) == [1, 2, 3, 4, 5, 6]
    assert list(get(train_on_prompt=True).labels) == [1, 2, 3, 4, 5, 6]
    assert list(get(mask_history=True).labels) == [-100, -100, -100, -100, 5, 6]
    assert list(get(efficient_eos=9).labels) == [-100, -100, 3, 9, 5, 6, 9]
    assert list(get(cutoff=3).input_ids) == [1, 2, 3] and list(get(cutoff=5).input_ids)[:4] == [1, 2, 3, 4]
    assert templates.pairs_ids(rows.select(F.lit(1)).withColumn("p", F.array(F.struct(F.lit("a").alias("source"), F.lit("bc").alias("target")))), "p").first().p[0].target == [98, 99]


def test_knapsacks():
    assert encode.knapsacks([1, 2, 3, 5], 6) == [[5, 1], [3, 2]] and encode.knapsacks([9], 6) == []


def test_packing(spark):
    rows = spark.createDataFrame([(0, 0, [1, 1], [1, 1]), (0, 1, [2, 2], [2, 2]), (0, 2, [3], [3]), (0, 3, [7] * 9, [7] * 9)], "batch long, rn long, input_ids array<int>, labels array<int>")
    (one,) = encode.pack_sft(rows, 5, pad_id=0, neat=True).collect()
    assert (one.input_ids, one.attention_mask, one.position_ids, one.labels) == ([2, 2, 1, 1, 3, 0], [1, 1, 2, 2, 3, 0], [0, 1, 0, 1, 0, 0], [2, 2, 1, 1, 3, -100])
    assert encode.pack_sft(rows, 5).first().attention_mask == [1] * 6


def test_blocks_and_pairs(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4, 5])], "batch long, rn long, ids array<int>")
    assert [r.input_ids for r in encode.pretrain_blocks(rows, "ids", 3, 9).orderBy("block").collect()] == [[1, 2, 3], [9, 4, 5]]
    assert [r.input_ids for r in encode.pretrain_blocks(rows, "ids", 3, 9, bos_id=8).orderBy("block").collect()] == [[8, 2, 3], [8, 4, 5]]
    two = spark.createDataFrame([([1], [2], [3, 4])], "p array<int>, c array<int>, r array<int>")
    got = encode.encode_pairs(two, "p", "c", "r", 100).first()
    assert got.chosen_input_ids == [1, 2] and got.rejected_labels == [-100, 3, 4]


def test_feedback(spark):
    rows = spark.createDataFrame([(0, i, [0], [10 + i], i > 0) for i in range(3)], "batch long, rn long, p array<int>, r array<int>, ok boolean")
    got = encode.encode_feedback(rows, "p", "r", "ok", 100)
    assert [r.kl_labels[-1] for r in got.orderBy("rn").collect()] == [12, 10, 11]
    assert tuple(encode.feedback_balance(got).first()) == (2, 1, False)


def test_collate(spark):
    rows = spark.createDataFrame([(0, [0, 1, 2, 3, 4, 5], [1] * 6, [-100, -100, 2, 3, 4, 5]), (0, [6, 7], [1, 1], [-100, 7])], "batch long, input_ids array<int>, attention_mask array<int>, labels array<int>")
    a, b = sorted(encode.sft_collate(rows).collect(), key=lambda r: r.input_ids)
    assert a.input_ids == [0, 1, 2, 3, 4, 5, 0, 0] and b.labels == [-100, 7] + [-100] * 6 and b.attention_mask == [1, 1] + [0] * 6
    m = spark.createDataFrame([([1, 1, 2, 0],)], "s array<int>").select(encode.block_causal_mask(F.col("s")).alias("m")).first().m
    assert m == [[True, False, False, False], [True, True, False, False], [False, False, True, False], [False] * 4]
    masks = spark.createDataFrame([(0, 0, [1, 1, 2, 2, 2, 0]), (0, 1, [1, 2, 2, 3, 3, 3])], "batch long, rn long, attention_mask array<int>")
    got = encode.unpad_data(masks).first()
    assert (got.seqlens, got.indices, got.cu_seqlens, got.max_seqlen) == ([2, 3, 1, 2, 3], [0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11], [0, 2, 5, 6, 8, 11], 3)


def test_unpad(spark):
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = lambda *x: F.array(*map(F.lit, x))
    assert get(encode.unpad_query(arr(0, 0, 5, 6), 0)) == [5, 6]
    assert get(encode.unpad_response(arr(5, 6, 0, 0), 0, 9)) == [5, 6] and get(encode.unpad_response(arr(5, 6, 0, 0), 0, 0)) == [5, 6, 0] and get(encode.unpad_response(arr(0, 0), 0, 9)) == [0]
    assert get(encode.rotate_padding(arr(-100, 0, 5, 6), 0)) == [5, 6, 0, 0]


def test_batch_numbers(spark):
    rows = spark.range(2500).select((F.lit(5000) - F.col("id")).alias("k"))
    got = encode.batch_numbers(rows, "k").orderBy("k").collect()
    assert [r.rn for r in got] == list(range(2500)) and [r.batch for r in got] == [i // 1000 for i in range(2500)]
