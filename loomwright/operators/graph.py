"""Typed edges of a graph and questions with a unique answer over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_by_type(edges: DataFrame) -> DataFrame:
    """etype, n of an edge table (src, dst, etype); repeated edges count once."""
    return edges.distinct().groupBy("etype").agg(F.count(F.lit(1)).alias("n"))


def coalesce_edges(edges: DataFrame) -> DataFrame:
    """One row for each (src, dst) with its sorted types."""
    return edges.groupBy("src", "dst").agg(F.array_join(F.sort_array(F.collect_set("etype")), ",").alias("etypes"))


def unique_hops(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Distinct paths of the join on ``mid`` whose key has exactly one."""
    paths = left.distinct().join(right.distinct(), "mid")
    return paths.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("answer").alias("answer")).where("n = 1").drop("n")
