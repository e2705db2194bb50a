"""Statistics of datasets, training logs and evaluation."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import duration, percent


def kept_ratio(rows: DataFrame, kept: str, *by: str) -> DataFrame:
    """n, n_kept and kept_ratio for each level of a rollup; the ratio of no rows is 0."""
    out = rows.rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(kept).cast("long")), F.lit(0)).alias("n_kept"))
    return out.withColumn("kept_ratio", F.col("n_kept") / F.greatest("n", F.lit(1)))


def valid_token_ratio(rows: DataFrame) -> DataFrame:
    """valid, total, ratio of labels (batch, labels): total counts each batch as its rows times its longest row."""
    per = rows.groupBy("batch").agg(F.sum(F.size(F.filter("labels", lambda x: x != -100))).alias("v"), (F.max(F.size("labels")) * F.count(F.lit(1))).alias("t"))
    return per.agg(F.sum("v").alias("valid"), F.sum("t").alias("total")).withColumn("ratio", F.col("valid") / F.col("total"))


def learning_rate(cutoff: Column | int, batch: Column | int, ratio: Column | float, small: bool = False) -> Column:
    """A base rate times the root of the tokens in a batch over the base batch of 4 million; a sixth of it for some model families."""
    cutoff, batch, ratio = (F.lit(x) if not isinstance(x, Column) else x for x in (cutoff, batch, ratio))
    rate = 3e-4 * F.sqrt(cutoff * batch * ratio / 4e6)
    return rate / 6 if small else rate


def tokens_per_second(rows: DataFrame, ids: str, epochs: float, seconds: float, devices: int = 1) -> DataFrame:
    return rows.agg((F.sum(F.size(ids)) * epochs / seconds / devices).alias("tokens_per_second"))


def token_accuracy(rows: DataFrame, predicted: str, labels: str) -> DataFrame:
    """Mean over rows of the share of labels that the prediction of the place before has, without ignored ones."""
    pairs = F.filter(F.arrays_zip(F.slice(predicted, F.lit(1), F.size(predicted) - 1).alias("p"), F.slice(labels, F.lit(2), F.size(labels)).alias("l")), lambda x: x["l"] != -100)
    right = F.size(F.filter(pairs, lambda x: x["p"] == x["l"])) / F.nullif(F.size(pairs), F.lit(0))
    return rows.select(right.alias("a")).agg(F.avg("a").alias("accuracy"))


def preference_accuracy(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    return rows.agg(F.avg((F.col(chosen) > F.col(rejected)).cast("double")).alias("accuracy"))


# ---- similarity of texts


def ngrams(words: Sequence[str], n: int) -> Counter:
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def f_score(hit: int, a: int, b: int) -> float:
    return 2 * hit / (a + b) if hit else 0.0


def longest_common(a: Sequence[str], b: Sequence[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def bleu4(words: Sequence[str], gold: Sequence[str]) -> float:
    """With the third smoothing: an order without a match counts half of what the one before it did."""
    logs, k = 0.0, 1
    for n in range(1, 5):
        got, want = ngrams(words, n), ngrams(gold, n)
        hit, total = sum((got & want).values()), max(1, sum(got.values()))
        if n == 1 and not hit:
            return 0.0
        if not hit:
            share = 1 / (2**k * total)
            k += 1
        else:
            share = hit / total
        logs += math.log(share) / 4
    short = 1.0 if len(words) > len(gold) else math.exp(1 - len(gold) / max(1, len(words)))
    return short * math.exp(logs)


def text_similarity(prediction: Column, gold: Column, tokenize: Callable[[str], list[str]] = str.split) -> Column:
    """rouge_1, rouge_2, rouge_l, bleu_4 times 100; all 0 where either has no words."""
    names = ("rouge_1", "rouge_2", "rouge_l", "bleu_4")

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in names]))
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(p.fillna(""), g.fillna(""), strict=True):
            x, y = tokenize(a), tokenize(b)
            if not x or not y:
                out.append((0.0,) * 4)
                continue
            one, two = (f_score(sum((ngrams(x, n) & ngrams(y, n)).values()), max(0, len(x) - n + 1), max(0, len(y) - n + 1)) for n in (1, 2))
            out.append(tuple(round(100 * v, 4) for v in (one, two, f_score(longest_common(x, y), len(x), len(y)), bleu4(x, y))))
        return pd.DataFrame(out, columns=list(names))

    return score(prediction, gold)


# ---- evaluation


def category_accuracy(rows: DataFrame, category: str, right: str) -> DataFrame:
    """category (Average for all rows), n, accuracy in per cent with two decimals; categories without rows do not appear."""
    out = rows.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(right).cast("long")).alias("hits"))
    all_ = out.agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit("Average").alias("category"), "n", "hits")
    return out.unionByName(all_).where("n > 0").select("category", "n", F.round(100 * F.col("hits") / F.col("n"), 2).alias("accuracy"))


def answer_accuracy(rows: DataFrame, exact: Column, equal: Column) -> DataFrame:
    """total, exact_accuracy, verified_accuracy; 0 for no rows."""
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("total"), share(exact).alias("exact_accuracy"), share(equal).alias("verified_accuracy"))


def flat_metrics(rows: DataFrame) -> DataFrame:
    """model, key (task::metric), value of evaluation results in either shape; numbers only, truth values count as 0 and 1."""
    number = lambda c: F.coalesce(F.expr(f"try_cast({c} AS double)"), F.when(F.lower(F.col(c)) == "true", 1.0).when(F.lower(F.col(c)) == "false", 0.0))
    nested = rows.select("model", F.explode("results").alias("task", "m")).select("model", "task", F.explode("m").alias("metric", "raw"))
    flat = rows.select("model", F.lit("MATH500_DIRECT").alias("task"), F.explode("metrics").alias("metric", "raw"))
    return nested.union(flat).select("model", F.concat_ws("::", "task", "metric").alias("key"), number("raw").alias("value")).where("value IS NOT NULL AND key NOT LIKE '%stderr%'")


# What is reported for each benchmark, and which metric stands for a task, best first.
BENCHMARKS = (("DROP", "drop::f1,none"), ("WinoGrande", "winogrande::acc,none"), ("GSM8K", "gsm8k::exact_match,flexible-extract"), ("MATH-500", "MATH500_DIRECT::math_verify_accuracy"))
PRIORITY = ("acc,none", "acc_norm,none", "exact_match,none", "exact_match,flexible-extract", "exact_match,strict-match", "f1,none", "em,none", "math_verify,none", "pass@1,create_test", "bleu,none", "rouge1,none")


def benchmark_scores(metrics: DataFrame) -> DataFrame:
    """model, benchmark, value: one metric for each benchmark; MMLU is the mean over its subjects."""
    name = F.when(F.col("key").rlike("^mmlu_.*::acc,none$"), "MMLU")
    for bench, key in BENCHMARKS:
        name = F.when(F.col("key") == key, bench).otherwise(name)
    return metrics.withColumn("benchmark", name).where("benchmark IS NOT NULL").groupBy("model", "benchmark").agg(F.avg("value").alias("value"))


def main_metric(metrics: DataFrame) -> DataFrame:
    """model, task, metric, value: the first of the priorities that a task has, else its first by name."""
    order = F.array(*map(F.lit, PRIORITY))
    parts = metrics.withColumn("task", F.substring_index("key", "::", 1)).withColumn("metric", F.expr("substring(key, instr(key, '::') + 2)"))
    rank = F.coalesce(F.nullif(F.array_position(order, F.col("metric")), F.lit(0).cast("long")), F.lit(99))
    return parts.groupBy("model", "task").agg(F.min_by(F.struct("metric", "value"), F.struct(rank, "metric")).alias("m")).select("model", "task", "m.*")


def compare_models(scores: DataFrame, models: list[str]) -> DataFrame:
    """benchmark and a column of per cent for each model, N/A where one has no value."""
    wide = scores.groupBy("benchmark").pivot("model", models).agg(F.first("value"))
    return wide.select("benchmark", *[percent(F.col(f"`{m}`")).alias(m) for m in models])


# ---- training logs


def ema(rows: DataFrame, series: str, step: str, value: str) -> DataFrame:
    """series, step, smoothed: an average whose weight grows with the length of the series."""
    # One array for each series: a training log's points.
    points = rows.groupBy(series).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("v")))).alias("p"))
    n = F.size("p")
    weight = 1.8 * (1 / (1 + F.exp(-0.05 * n)) - 0.5)
    start = F.struct(F.get("p", F.lit(0))["v"].alias("last"), F.array().cast("array<double>").alias("out"))

    def go(acc: Column, x: Column) -> Column:
        new = acc["last"] * F.col("weight") + (1 - F.col("weight")) * x["v"]
        return F.struct(new.alias("last"), F.concat(acc["out"], F.array(new)).alias("out"))

    smooth = points.withColumn("weight", weight).withColumn("out", F.aggregate("p", start, go)["out"])
    return smooth.select(series, F.explode(F.arrays_zip(F.transform("p", lambda x: x["s"]).alias("s"), F.col("out").alias("v"))).alias("z")).select(series, F.col("z.s").alias(step), F.col("z.v").alias("smoothed"))


def running_meter(rows: DataFrame, value: Column, weight: Column, *window: str) -> DataFrame:
    """Weighted mean of each logging window."""
    return rows.groupBy(*window).agg((F.sum(value * weight) / F.sum(weight)).alias("mean"))


def progress(rows: DataFrame, done: str, total: str, seconds: str) -> DataFrame:
    """Adds percentage (100 where there is nothing to do), elapsed_time and remaining_time."""
    d, t, s = F.col(done), F.col(total), F.col(seconds)
    left = F.when(d > 0, (t - d) * s / d).otherwise(0.0)
    return rows.withColumns({"percentage": F.when(t > 0, F.round(100.0 * d / t, 2)).otherwise(100.0), "elapsed_time": duration(s), "remaining_time": duration(left)})


def preference_metrics(rows: DataFrame, beta: float = 0.1) -> DataFrame:
    """Means over rows of log-probabilities (policy_ and reference_ chosen and rejected): rewards, margins, accuracies."""
    reward = {k: beta * (F.col(f"policy_{k}") - F.col(f"reference_{k}")) for k in ("chosen", "rejected")}
    return rows.agg(
        F.avg(reward["chosen"]).alias("rewards_chosen"), F.avg(reward["rejected"]).alias("rewards_rejected"), F.avg((reward["chosen"] > reward["rejected"]).cast("double")).alias("rewards_accuracies"),
        F.avg(reward["chosen"] - reward["rejected"]).alias("rewards_margins"), F.avg("policy_chosen").alias("logps_chosen"), F.avg("policy_rejected").alias("logps_rejected"),
    )


def feedback_metrics(rows: DataFrame, reward: str, desired: str) -> DataFrame:
    """Mean reward of desired and of other rows, each over its own count, and their margin."""
    side = lambda c: F.sum(F.when(c, F.col(reward))) / F.count(F.when(c, F.lit(1)))
    out = rows.agg(side(F.col(desired)).alias("rewards_chosen"), side(~F.col(desired)).alias("rewards_rejected"))
    return out.withColumn("rewards_margins", F.col("rewards_chosen") - F.col("rewards_rejected"))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-F.abs(x))) + F.least(x, F.lit(0.0))


def preference_loss(kind: str, chosen: Column, rejected: Column, ref_chosen: Column | None = None, ref_rejected: Column | None = None, beta: float = 0.1, gamma: float = 0.5, delta: float = 0.0) -> Column:
    """Loss of a pair from its log-probabilities: sigmoid, ipo and bco_pair against a reference; orpo and simpo without (mean log-probabilities)."""
    if kind == "simpo":
        return -log_sigmoid(beta * (chosen - rejected - gamma / beta))
    if kind == "orpo":
        odds = (chosen - rejected) - (F.log1p(-F.exp(chosen)) - F.log1p(-F.exp(rejected)))
        return -chosen + beta * -log_sigmoid(odds)
    if ref_chosen is None or ref_rejected is None:
        raise ValueError(f"{kind} needs a reference")
    a, b = chosen - ref_chosen, rejected - ref_rejected
    if kind == "sigmoid":
        return -log_sigmoid(beta * (a - b))
    if kind == "ipo":
        return (a - b - 1 / (2 * beta)) ** 2
    if kind == "bco_pair":
        return -log_sigmoid(beta * a - delta) - log_sigmoid(-(beta * b - delta))
    raise ValueError(f"unknown loss {kind}")


def sequence_logp(logps: Column, labels: Column, mean: bool = False) -> Column:
    """Sum (or mean) of the log-probabilities of labels that are not ignored; labels are shifted by one."""
    pairs = F.filter(F.arrays_zip(logps.alias("p"), F.slice(labels, F.lit(2), F.size(labels)).alias("l")), lambda x: F.coalesce(x["l"], F.lit(-100)) != -100)
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["p"])
    return total / F.nullif(F.size(pairs), F.lit(0)) if mean else total


def perplexity(rows: DataFrame, logps: str, labels: str) -> DataFrame:
    """Mean over rows of exp of the mean negative log-probability."""
    return rows.select(F.exp(-sequence_logp(F.col(logps), F.col(labels), mean=True)).alias("p")).agg(F.avg("p").alias("perplexity"))


def model_flops(hidden: int, layers: int, vocabulary: int, intermediate: int, heads: int, kv_heads: int, tokens: int, length: int, recompute: bool = False) -> float:
    """Floating-point operations of one forward and backward pass over so many tokens of sequences of a length."""
    projections = 2 * hidden * hidden + 2 * hidden * (hidden // heads * kv_heads)
    block = projections + 3 * hidden * intermediate
    weights = layers * block + hidden * vocabulary
    attention = 2 * layers * length * hidden
    return float((4 if recompute else 3) * 2 * tokens * (weights + attention))


# Peak rates of devices for half precision.
PEAK_FLOPS = {"H100": 989e12, "H800": 989e12, "A100": 312e12, "A800": 312e12, "V100": 125e12, "4090": 98e12}


def utilisation(flops: float, seconds: float, device: str, devices: int = 1) -> float:
    return flops / seconds / (PEAK_FLOPS[device] * devices)
