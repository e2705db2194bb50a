"""Dataset operators on long tables of turns and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MESSAGES


def conversations(rows: DataFrame, who: str = "role", what: str = "content") -> DataFrame:
    """conv_id, messages of turns (conv_id, turn, role, text), in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias(who), F.col("text").alias(what))))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t[who].alias(who), t[what].alias(what))).alias("messages"))


def valid_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, valid: without a leading system turn the roles alternate from user and their number is even."""
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    roles = F.when(F.get(roles, F.lit(0)) == "system", F.slice(roles, F.lit(2), F.size(roles))).otherwise(roles)
    turns = turns.withColumn("r", roles)
    right = F.transform("r", lambda x, i: F.when(i % 2 == 0, x.isin("user", "observation")).otherwise(x.isin("assistant", "function")))
    return turns.select("conv_id", F.size("r").cast("long").alias("n_turns"), ((F.size("r") > 0) & (F.size("r") % 2 == 0) & F.forall(right, lambda x: x)).alias("valid"))


def dedup_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key, equal keys being added up before they are dealt out; null is a value of its own."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*[f"_r.{c}" if c in rest else c for c in rows.columns])


def length_histogram(rows: DataFrame, width: int) -> DataFrame:
    """bucket, n, share of the rows up to and with the bucket."""
    n = rows.groupBy((F.floor(F.length("text") / width) * width).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    # One row for each bucket only.
    up = F.sum("n").over(Window.orderBy("bucket"))
    return n.withColumn("up", up).join(F.broadcast(total)).select("bucket", "n", (F.col("up") / F.col("total")).alias("share"))


def turn_pairs(rows: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, response: an assistant's turn with the turn before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = rows.withColumn("prompt", F.lag("text").over(w)).withColumn("before", F.lag("role").over(w))
    return out.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "prompt", F.col("text").alias("response"))


def unique_sequence(c):
    """An array with each item once, at its first place."""
    return F.array_distinct(c)


__all__ = ["MESSAGES", "conversations", "dedup_first", "length_histogram", "turn_pairs", "unique_sequence", "valid_conversations"]
