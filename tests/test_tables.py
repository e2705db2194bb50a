"""Mixing, statistics, sources, sinks, streams and options."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text
from loomwright.operators import align, annotate, metrics, mixing
from loomwright.options import DataOptions, check_training
from loomwright.sources import files, sinks
from loomwright.streaming import logs


def test_interleave(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "part string, k int")
    show = lambda u: [f"{r.part}{r.k}" for r in mixing.interleave(rows, "part", "k", u).orderBy("position").collect()]
    assert show("first") == ["a1", "b1"] and show("last") == ["a1", "b1", "a2", "b1", "a3", "b1"]
    got = mixing.interleave_by_chance(rows, "part", "k", {"a": 3, "b": 1}, 400).groupBy("part").count().collect()
    n = {r.part: r["count"] for r in got}
    assert sum(n.values()) == 400 and 250 < n["a"] < 350


def test_samples_and_splits(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert mixing.sample_to(rows, "k", 25).count() == 25 and mixing.sample_to(rows, "k", 4).select("k").distinct().count() == 4
    assert {r.split: r["count"] for r in mixing.split_train(rows, "k", 3).groupBy("split").count().collect()} == {"validation": 3, "train": 7}
    assert [r.k for r in mixing.select_rows(rows, "k", [-1, 0, 0]).orderBy("position").collect()] == [9, 0, 0]
    assert [r.k for r in mixing.select_rows(rows, "k", slice(2, 6, 2)).orderBy("position").collect()] == [2, 4]
    assert [r.k for r in mixing.page(rows, "k", 1).collect()] == [2, 3]
    parts = mixing.split_stream(rows, "k", 4)
    assert parts["validation"].count() == 4 and parts["train"].count() == 6
    assert mixing.dataset_index({"x": rows, "y": rows}, "k").count() == 20
    shots = mixing.few_shot(spark.createDataFrame([("s",)], "subject string"), rows.withColumn("subject", F.lit("s")), "subject", "k", 3).first().shots
    assert len(shots) == 3
    assert list(mixing.eval_parts(mixing.eval_names({"a": rows}))) == ["a"]


def test_statistics(spark):
    one = metrics.ema(spark.createDataFrame([("r", 1, 1.0), ("r", 2, 0.0)], "run string, step int, loss double"), "run", "step", "loss").orderBy("step").collect()
    assert [round(r.smoothed, 10) for r in one] == [1.0, round(0.04496253746, 10)]
    assert spark.range(1).select(metrics.learning_rate(2048, 16, 0.5).alias("x")).first().x == pytest.approx(1.92e-5, rel=0.02)
    rows = spark.createDataFrame([([1, 2, 3], [-100, 1, 9])], "p array<int>, l array<int>")
    assert metrics.token_accuracy(rows, "p", "l").first().accuracy == 0.5
    s = spark.createDataFrame([("a b c d e", "a b c d e"), ("", "a"), ("x y", "a b")], "p string, g string").select(metrics.text_similarity(F.col("p"), F.col("g")).alias("s")).collect()
    assert tuple(s[0].s) == (100.0, 100.0, 100.0, 100.0) and tuple(s[1].s) == tuple(s[2].s) == (0.0,) * 4
    logp = spark.createDataFrame([([-1.0, -1.0, -3.0], [-100, 5, 6])], "p array<double>, l array<int>")
    assert metrics.perplexity(logp, "p", "l").first().perplexity == pytest.approx(math.e)
    loss = lambda k, *a: spark.range(1).select(metrics.preference_loss(k, *map(F.lit, a)).alias("x")).first().x
    assert loss("sigmoid", -1.0, -2.0, -1.0, -2.0) == pytest.approx(math.log(2)) and loss("ipo", 0.0, 0.0, 0.0, 0.0) == pytest.approx(25)
    assert loss("simpo", -1.0, -1.0) == pytest.approx(math.log1p(math.exp(0.5)))
    assert metrics.model_flops(8, 2, 100, 16, 2, 1, 10, 10) > 0 and 0 < metrics.utilisation(1e12, 1, "A100") < 1
    results = spark.createDataFrame([("m", {"gsm8k": {"exact_match,flexible-extract": "0.5", "x_stderr": "0.1", "alias": "gsm8k"}, "mmlu_a": {"acc,none": "0.2"}, "mmlu_b": {"acc,none": "0.4"}}, {"math_verify_accuracy": "0.1"})], "model string, results map<string, map<string, string>>, metrics map<string, string>")
    flat = metrics.flat_metrics(results)
    assert {r.benchmark: round(r.value, 6) for r in metrics.benchmark_scores(flat).collect()} == {"GSM8K": 0.5, "MMLU": 0.3, "MATH-500": 0.1}
    assert {r.task: r.metric for r in metrics.main_metric(flat).collect()}["mmlu_a"] == "acc,none"


def test_files(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "a.json").write_text(json.dumps([{"x": 1}, {"x": 2}]))
    (tmp_path / "b.jsonl").write_text('{"x": 3}\n\n')
    assert sorted(r.x for r in files.read_files(spark, str(tmp_path)).collect()) == [1, 2, 3]
    (tmp_path / "t").mkdir()
    with pa.OSFile(str(tmp_path / "t" / "c.arrow"), "wb") as f, pa.ipc.new_file(f, pa.schema([("x", pa.int64())])) as w:
        w.write_table(pa.table({"x": [7, 8]}))
    assert sorted(r.x for r in files.read_files(spark, str(tmp_path / "t")).collect()) == [7, 8]
    (tmp_path / "t" / "d.csv").write_text("x\n1\n")
    with pytest.raises(ValueError):
        files.read_files(spark, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "blank.jsonl") if (tmp_path / "blank.jsonl").write_text('{"x": 1}\n  \n') else "", "x INT", strict=True)
    assert files.has_tokenized(str(tmp_path)) and not files.has_tokenized(str(tmp_path / "none"))
    made = files.tokenized_or(spark, str(tmp_path / "tok"), lambda: spark.range(3))
    assert made.count() == 3 and files.tokenized_or(spark, str(tmp_path / "tok"), lambda: 1 / 0).count() == 3


def test_registry(spark, tmp_path):
    registry = {"a": {"file_name": "a.json", "ranking": True}, "b": {"hf_hub_url": "x/b", "file_name": "b.json"}, "c": {"file_name": "c.json", "columns": {"prompt": "text"}}}
    (tmp_path / "dataset_info.json").write_text(json.dumps(registry))
    (tmp_path / "c.json").write_text('[{"text": "hi"}]')
    known = files.read_registry(str(tmp_path / "dataset_info.json"))
    a, b, c = files.lookup(["a", "b", "c"], known)
    assert (a.load_from, b.load_from, c.query, c.response) == ("file", "hf_hub", None, None)
    assert files.load_dataset(spark, c, str(tmp_path)).first().text == "hi" and files.datasets_for(known, True) == ["a"]
    with pytest.raises(ValueError):
        files.lookup(["none"], known)
    with pytest.raises(NotImplementedError):
        files.load_dataset(spark, b, str(tmp_path))
    with pytest.raises(ValueError):
        files.check_stage("sft", a)
    (tmp_path / "s.yaml").write_text("one:\n  file_name: x.jsonl\n  converter: alpaca\n")
    assert files.resolve_source("s.yaml", str(tmp_path)) == {"one": {"file_name": "x.jsonl", "converter": "alpaca"}}
    assert files.resolve_source("u/d", str(tmp_path)) == {"default": {"hf_hub_url": "u/d"}}


def test_repositories(spark):
    rows = [("a", "Python", 500, 900, False, False, ["web"]), ("b", "Python", 900, 900, True, False, []), ("c", "Python", 800, 900, False, False, ["tutorial"]), ("d", "Go", 999, 900, False, False, []), ("e", "Python", 600, 900, False, False, None)]
    t = spark.createDataFrame(rows, "name string, language string, stars int, size int, archived boolean, fork boolean, topics array<string>")
    assert [r.name for r in files.candidate_repos(t, 10).collect()] == ["e", "a"]


def test_sinks(spark, tmp_path):
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([("a", "Module", "é", None, ["x"])], "id string, node_type string, name string, path string, decorators array<string>")
    edges = spark.createDataFrame([("a", "b", ["CALLS", "DEFINES"])], "src string, dst string, etypes array<string>")
    sinks.write_graph_json(nodes, edges, str(tmp_path / "g.json"))
    got = json.loads((tmp_path / "g.json").read_text())
    assert got["directed"] and got["nodes"][0]["name"] == "é" and got["edges"] == [{"source": "a", "target": "b", "etype": ["CALLS", "DEFINES"]}]
    sinks.write_graphml(nodes, edges, str(tmp_path / "g.graphml"))
    assert ElementTree.parse(tmp_path / "g.graphml").getroot().tag.endswith("graphml")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g"))[1].count() == 1
    stats = sinks.write_routed(spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, ok boolean"), F.col("ok"), str(tmp_path / "good"), str(tmp_path / "bad")).first()
    assert (stats.kept, stats.rejected) == (1, 2) and spark.read.json(str(tmp_path / "bad")).count() == 2
    assert sinks.shown_graph(nodes, edges)[0].first().color == sinks.COLOURS["Module"]
    with pytest.raises(Exception):
        sinks.write_tokens(nodes, str(tmp_path / "good"))


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"current_steps": 1, "loss": 2.0}\n{"current_steps": 5, "loss": 1.0}\n')
    seen = []
    for k in (5, 9):
        logs.follow_log(logs.read_log_stream(spark, str(folder)), str(tmp_path / "state"), lambda r: seen.append((r.current_steps, r.loss)), once=True).awaitTermination(60)
        (folder / "2.jsonl").write_text('{"current_steps": 9, "loss": 0.5}\n')
    assert seen == [(5, 1.0), (9, 0.5)]


def test_annotate(spark):
    q = spark.createDataFrame([("q1", "which?", ["a"], (["m", "a"], [["m", "a", "CALLS"]]))], "id string, question string, answer array<string>, graph_support struct<path: array<string>, edges: array<array<string>>>")
    (r,) = annotate.annotate(q, lambda: annotate.Echo("<reasoning> so </reasoning><final> a </final>")).collect()
    assert (r.cot, r.final_pred, r.is_correct) == ("so", "a", True)
    chat = q.select(text.reasoning_chat(F.col("question"), F.col("graph_support.path"), F.lit("a"), F.lit(None).cast("string"), "s").alias("c")).first().c
    assert [t["from"] for t in chat] == ["system", "user", "assistant"] and "1. Follow graph node: m\n2. Follow graph node: a" in chat[2].value and text.NO_CODE in chat[1].value
    assert "edges" not in annotate.without_edges(q).schema["graph_support"].dataType.names


def test_options():
    assert DataOptions(packing=True).cutoff_len == 2047 and DataOptions(dataset="a, b").dataset == ["a", "b"] and DataOptions(neat_packing=True).packing and DataOptions().packs("pt")
    for bad in ({"val_size": 0.1}, {"streaming": True, "dataset": "a", "val_size": 0.1}, {"streaming": True, "max_samples": 3}, {"mask_history": True, "train_on_prompt": True}, {"interleave_probs": "0.5", "dataset": "a"}, {"dataset": "a,b", "mix_strategy": "interleave_under", "interleave_probs": "1"}):
        with pytest.raises(ValueError):
            DataOptions(**bad)
    with pytest.raises(ValueError):
        check_training(DataOptions(streaming=True), "sft")


def test_requests(spark):
    kind = "m array<struct<role: string, content: string>>"
    rows = spark.createDataFrame([([("system", "s"), ("user", "a")],), ([("user", "a"), ("assistant", "b")],), ([("user", "a"), ("assistant", "b"), ("tool", "c")],), ([],)], kind)
    assert [r.x for r in rows.select(align.valid_request(F.col("m")).alias("x")).collect()] == [True, False, True, False]
