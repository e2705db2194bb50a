"""Putting datasets together, limits, samples and splits.

Order comes from columns, never from how files were read. Where a reference order depends on a random generator's stream, a
hash of a key and a seed takes its place: counts and shares are exact, the single draws differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .encode import batch_numbers


def concat(parts: list[DataFrame]) -> DataFrame:
    """All rows with ``dataset``, the number of their part."""
    return reduce(DataFrame.unionByName, [p.withColumn("dataset", F.lit(k)) for k, p in enumerate(parts)])


def ranked(rows: DataFrame, part: str, order: str) -> DataFrame:
    """Adds rank, from 1 within each part in order; ranges of (part, order) are counted, so that no part is sorted in one task."""
    return _ranked(rows, part, order).withColumnRenamed("_rank", "rank")


def _ranked(rows: DataFrame, part: str, order: str) -> DataFrame:
    numbered = batch_numbers(rows.withColumn("_key", F.struct(F.col(part), F.col(order))), "_key").drop("batch", "_key")
    first = numbered.groupBy(part).agg(F.min("rn").alias("_first"))
    keys = first.withColumnRenamed(part, "_part_key")
    out = numbered.join(keys, numbered[part].eqNullSafe(keys["_part_key"]))
    return out.withColumn("_rank", (F.col("rn") - F.col("_first") + 1).cast("int")).drop("rn", "_first", "_part_key")


def part_sizes(rows: DataFrame, part: str) -> DataFrame:
    """part, size and place (from 0, by name)."""
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("size"))
    # One row for each part.
    return sizes.withColumn("place", F.row_number().over(Window.orderBy(part)) - 1)


def interleave(rows: DataFrame, part: str, order: str, until: str = "first") -> DataFrame:
    """Rows of all parts in turn with ``position``; until the first part is used up, or the last, with the others from their begin again."""
    sizes = part_sizes(rows, part)
    bound = sizes.agg((F.min if until == "first" else F.max)("size").alias("bound"), F.count(F.lit(1)).alias("parts"))
    known = ranked(rows, part, order).join(sizes.withColumnRenamed(part, "_p"), F.col(part).eqNullSafe(F.col("_p"))).drop("_p").join(F.broadcast(bound))  # bound is one row
    if until == "first":
        known = known.where(F.col("rank") <= F.col("bound")).withColumn("round", F.col("rank") - 1)
    else:
        known = known.withColumn("round", F.explode(F.sequence(F.col("rank").cast("long") - 1, F.col("bound") - 1, F.col("size"))))
    return known.withColumn("position", F.col("round") * F.col("parts") + F.col("place")).drop("size", "place", "bound", "parts", "round")


def uniform(*key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def interleave_by_chance(rows: DataFrame, part: str, order: str, shares: dict[str, float], slots: int, seed: int = 42) -> DataFrame:
    """``slots`` rows with position: each slot draws a part by its share, and takes that part's next row, from the begin again where it ends."""
    total, bounds, draw = sum(shares.values()), [], F.lit(None).cast("string")
    for name, share in shares.items():
        bounds.append(((bounds[-1][0] if bounds else 0.0) + share / total, name))
    u = uniform(F.col("position"), seed=seed)
    for top, name in reversed(bounds):
        draw = F.when(u < top, name).otherwise(draw)
    drawn = rows.sparkSession.range(slots).withColumnRenamed("id", "position").withColumn("_draw", F.coalesce(draw, F.lit(bounds[-1][1])))
    turns = _ranked(drawn, "_draw", "position")
    sizes = part_sizes(rows, part).select(F.col(part).alias("_draw"), "size")
    turns = turns.join(sizes, "_draw").select("position", "_draw", (F.pmod(F.col("_rank") - 1, F.col("size")) + 1).cast("int").alias("_turn"))
    return turns.join(ranked(rows, part, order), (F.col("_draw") == F.col(part)) & (F.col("_turn") == F.col("rank"))).drop("_draw", "_turn", "rank")


def first_rows(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows in order; a limit is what is asked for."""
    return rows.orderBy(order).limit(n)


def page(rows: DataFrame, order: str, number: int, size: int = 2) -> DataFrame:
    return rows.orderBy(order).offset(number * size).limit(size)


def sample_to(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows: all in a random order first, then draws with replacement; with ``draw``, the number of the draw."""
    numbered = batch_numbers(rows.withColumn("_u", F.struct(uniform(F.col(key), seed=seed).alias("u"), F.col(key))), "_u").drop("_u", "batch")
    size = numbered.count()
    if n <= size or size == 0:
        return numbered.where(F.col("rn") < n).withColumnRenamed("rn", "draw")
    draws = rows.sparkSession.range(size, n).select(F.col("id").alias("draw"), F.floor(uniform(F.col("id"), seed=seed + 1) * size).cast("long").alias("rn"))
    return numbered.withColumn("draw", F.col("rn")).unionByName(numbered.join(draws, "rn")).drop("rn")


def split_train(rows: DataFrame, key: str, held: float | int, seed: int = 42) -> DataFrame:
    """Adds split: exactly the given share (below 1) or number of rows is validation, by the order of a hash."""
    numbered = batch_numbers(rows.withColumn("_u", F.struct(uniform(F.col(key), seed=seed).alias("u"), F.col(key))), "_u").drop("_u", "batch")
    n = F.lit(int(held)) if held >= 1 else F.ceil(F.lit(held) * F.lit(numbered.count()))
    return numbered.withColumn("split", F.when(F.col("rn") < n, "validation").otherwise("train")).drop("rn")


def split_stream(rows: DataFrame, order: str, held: int) -> dict[str, DataFrame]:
    """The first rows as validation, the others as train, without counting."""
    ordered = rows.orderBy(order)
    return {"validation": ordered.limit(held), "train": ordered.offset(held)}


def eval_names(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {f"validation_{k}": v for k, v in parts.items()}


def eval_parts(named: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {k.removeprefix("validation_"): v for k, v in named.items() if k.startswith("validation")}


def select_rows(rows: DataFrame, order: str, which: int | slice | list[int]) -> DataFrame:
    """By number, range or list of numbers (negative from the end; repeats and order of a list stay), with ``position``."""
    numbered = batch_numbers(rows, order).drop("batch")
    if isinstance(which, int):
        which = [which]
    size = numbered.count()
    picks = list(range(*which.indices(size))) if isinstance(which, slice) else [i + size if i < 0 else i for i in which]
    if any(not 0 <= i < size for i in picks):
        raise IndexError("row number out of range")
    wanted = rows.sparkSession.createDataFrame(list(enumerate(picks)), "position long, rn long")
    return numbered.join(wanted, "rn").drop("rn")


def shuffled(rows: DataFrame, key: str, seed: int = 42, disable: bool = False) -> DataFrame:
    return rows if disable else rows.orderBy(uniform(F.col(key), seed=seed), key)


def few_shot(test: DataFrame, support: DataFrame, subject: str, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Each test row with ``shots``: up to n support rows of its subject, drawn once for each subject."""
    columns = [c for c in support.columns if c != subject]
    w = Window.partitionBy(subject).orderBy(uniform(F.col(key), seed=seed), key)
    drawn = support.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).groupBy(subject).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*columns).alias("s")))), lambda x: x["s"]).alias("shots"))
    return test.join(drawn, subject, "left")


def dataset_index(parts: dict[str, DataFrame], order: str) -> DataFrame:
    """dataset_name, sample_index of all rows of all datasets."""
    return reduce(DataFrame.union, [batch_numbers(v, order).select(F.lit(k).alias("dataset_name"), F.col("rn").alias("sample_index")) for k, v in parts.items()])
