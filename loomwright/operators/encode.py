"""Token rows for training: labels, truncation, packing, pretraining blocks, preference pairs, collation.

Ids arrive as arrays; everything here is arithmetic on arrays. Batches are those of a given column ``batch``, numbered from the rows'
order by ``batch_numbers`` without one task for all rows; whatever looks at a batch looks at no more than that.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import infer_seqlen
from ..lineage import cut

IGNORE = -100
INTS = "array<int>"


def batch_numbers(rows: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """Adds rn (from 0 over all rows in order) and batch; ranges are sorted apart and counted, so that no task sorts all rows."""
    parts = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    parts = cut(parts)
    least = parts.groupBy("_part").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # One row for each range of rows.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = parts.join(least.withColumn("_before", before), "_part").withColumn("rn", F.col("_at") - F.col("_low") + F.col("_before"))
    return out.withColumn("batch", F.floor(F.col("rn") / size)).drop("_part", "_at", "_low", "_n", "_before")


def repeated(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), n).cast(INTS)


def first_of(ids: Column, n: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(n, F.lit(0)))


def sft_labels(pairs: Column, cutoff: int, train_on_prompt: bool = False, mask_history: bool = False, efficient_eos: int | None = None) -> Column:
    """(input_ids, labels) of (source, target) id pairs: each turn gets what is left of cutoff, and none follows when it is full.

    With mask_history turns go from the last to the first, and only the last is trained.
    """
    if train_on_prompt and efficient_eos is not None:
        raise ValueError("efficient ends are not for training on prompts")
    turns = F.reverse(pairs) if mask_history else pairs
    start = F.struct(F.array().cast(INTS).alias("ids"), F.array().cast(INTS).alias("labels"), F.lit(1 if efficient_eos is not None else 0).alias("total"), F.lit(0).alias("k"))

    def step(acc: Column, turn: Column) -> Column:
        n, m = infer_seqlen(F.size(turn["source"]), F.size(turn["target"]), F.lit(cutoff) - acc["total"])
        source, target = first_of(turn["source"], n), first_of(turn["target"], m)
        hidden = repeated(IGNORE, n)
        if train_on_prompt:
            asked = source
        elif efficient_eos is not None:
            asked = F.when((acc["k"] > 0) & (n > 0), F.concat(F.array(F.lit(efficient_eos)), repeated(IGNORE, n - 1))).otherwise(hidden)
        else:
            asked = hidden
        said = F.when(acc["k"] > 0, repeated(IGNORE, m)).otherwise(target) if mask_history else target
        ids, labels = F.concat(source, target), F.concat(asked, said)
        put = (lambda old, new: F.concat(new, old)) if mask_history else F.concat
        new = F.struct(put(acc["ids"], ids).alias("ids"), put(acc["labels"], labels).alias("labels"), (acc["total"] + n + m).alias("total"), (acc["k"] + 1).alias("k"))
        return F.when(acc["total"] >= cutoff, acc).otherwise(new)

    out = F.aggregate(turns, start, step)
    if efficient_eos is None:
        return F.struct(out["ids"].alias("input_ids"), out["labels"].alias("labels"))
    end = F.array(F.lit(efficient_eos))
    return F.struct(F.concat(out["ids"], end).alias("input_ids"), F.concat(out["labels"], end).alias("labels"))


def encode_sft(rows: DataFrame, pairs: str, cutoff: int, **how) -> DataFrame:
    """input_ids, attention_mask, labels in place of pairs."""
    out = rows.withColumn("_e", sft_labels(F.col(pairs), cutoff, **how)).withColumns({"input_ids": F.col("_e.input_ids"), "labels": F.col("_e.labels")})
    return out.withColumn("attention_mask", repeated(1, F.size("input_ids"))).drop("_e", pairs)


def knapsacks(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins filled greedily with the longest that fits; items longer than the capacity are left out."""
    left: list[int] = []
    for n in lengths:
        if n <= capacity:
            insort(left, n)
    out = []
    while left:
        room, taken = capacity, []
        while (k := bisect_right(left, room)) > 0:
            taken.append(left.pop(k - 1))
            room -= taken[-1]
        out.append(taken)
    return out


def pack_sft(rows: DataFrame, cutoff: int, pad_id: int = 0, neat: bool = False) -> DataFrame:
    """Rows of (batch, rn, input_ids, labels) packed by batch to cutoff + 1 tokens, with position_ids that begin anew for each row.

    The attention mask numbers the rows of a pack and is 0 for padding where ``neat``, else 1 throughout.
    """

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("rn")
        where = defaultdict(list)
        for i, ids in enumerate(t["input_ids"]):
            where[len(ids)].append(i)
        ids, labels, out = list(t["input_ids"]), list(t["labels"]), []
        for k, bin_ in enumerate(knapsacks([len(x) for x in ids], cutoff)):
            picks = [where[n].pop() for n in bin_]  # equal lengths: the last first
            pad = cutoff + 1 - sum(bin_)
            out.append(
                (
                    int(t["batch"].iloc[0]), k,
                    [x for i in picks for x in ids[i]] + [pad_id] * pad,
                    [x for j, i in enumerate(picks) for x in [j + 1 if neat else 1] * len(ids[i])] + [0 if neat else 1] * pad,
                    [x for i in picks for x in range(len(ids[i]))] + [0] * pad,
                    [x for i in picks for x in labels[i]] + [IGNORE] * pad,
                )
            )
        return pd.DataFrame(out, columns=["batch", "pack", "input_ids", "attention_mask", "position_ids", "labels"])

    kept = rows.where(F.size("input_ids").between(1, cutoff)).select("batch", "rn", "input_ids", "labels")
    return kept.groupBy("batch").applyInPandas(pack, f"batch long, pack int, input_ids {INTS}, attention_mask {INTS}, position_ids {INTS}, labels {INTS}")


def pretrain_rows(rows: DataFrame, ids: str, cutoff: int, eos_id: int, bos_id: int | None = None) -> DataFrame:
    """Without packing: each text's ids and an end, cut off."""
    every = F.concat(*([F.array(F.lit(bos_id))] if bos_id is not None else []), F.col(ids), F.array(F.lit(eos_id)))
    return rows.withColumn("input_ids", first_of(every, F.lit(cutoff)))


def pretrain_blocks(rows: DataFrame, ids: str, size: int, eos_id: int, bos_id: int | None = None) -> DataFrame:
    """batch, block, input_ids: a batch's texts with ends put together and cut into whole blocks; the rest is dropped.

    With a begin id it takes the place of each block's first token.
    """
    one = F.struct("rn", F.concat(F.col(ids), F.array(F.lit(eos_id))).alias("ids"))
    joined = rows.groupBy("batch").agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["ids"])).alias("all"))
    n = F.floor(F.size("all") / size).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice("all", k * size + 1, size))
    out = joined.where(n > 0).select("batch", F.posexplode(cuts).alias("block", "input_ids"))
    return out if bos_id is None else out.withColumn("input_ids", F.concat(F.array(F.lit(bos_id)), F.slice("input_ids", 2, size)))


def encode_unsupervised(rows: DataFrame, source: str, target: str, cutoff: int) -> DataFrame:
    """input_ids of the prompt, labels of the reply."""
    n, m = infer_seqlen(F.size(source), F.size(target), cutoff)
    return rows.withColumns({"input_ids": first_of(F.col(source), n), "labels": first_of(F.col(target), m)}).withColumn("attention_mask", repeated(1, F.size("input_ids")))


def encode_pairs(rows: DataFrame, prompt: str, chosen: str, rejected: str, cutoff: int, eos_id: int | None = None) -> DataFrame:
    """chosen_ and rejected_ input_ids, attention_mask, labels: one prompt, and the longer reply sets the lengths."""
    end = F.array() if eos_id is None else F.array(F.lit(eos_id))
    sides = {k: F.concat(F.col(c), end.cast(INTS)) for k, c in (("chosen", chosen), ("rejected", rejected))}
    n, m = infer_seqlen(F.size(prompt), F.greatest(*[F.size(x) for x in sides.values()]), cutoff)
    out = rows.withColumn("_n", n).withColumn("_m", m)
    for k, ids in sides.items():
        asked, said = first_of(F.col(prompt), F.col("_n")), first_of(ids, F.col("_m"))
        out = out.withColumns({f"{k}_input_ids": F.concat(asked, said), f"{k}_labels": F.concat(repeated(IGNORE, F.size(asked)), said)})
        out = out.withColumn(f"{k}_attention_mask", repeated(1, F.size(f"{k}_input_ids")))
    return out.drop("_n", "_m")


def shift_within_batch(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the column of the row before, and for a batch's first row that of its last."""
    w = Window.partitionBy("batch").orderBy("rn")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn(out, F.when(F.lag("rn").over(w).isNull(), F.last(column).over(every)).otherwise(F.lag(column).over(w)))


def encode_feedback(rows: DataFrame, prompt: str, reply: str, desired: str, cutoff: int, eos_id: int | None = None) -> DataFrame:
    """SFT columns, kl_ columns with the reply of the row before in the batch, and kto_tags; rows have batch and rn."""
    rows = shift_within_batch(rows, reply, "_kl")
    end = (F.array() if eos_id is None else F.array(F.lit(eos_id))).cast(INTS)
    for lead, c in (("", reply), ("kl_", "_kl")):
        ids = F.concat(F.col(c), end)
        n, m = infer_seqlen(F.size(prompt), F.size(ids), cutoff)
        asked, said = first_of(F.col(prompt), n), first_of(ids, m)
        rows = rows.withColumns({f"{lead}input_ids": F.concat(asked, said), f"{lead}labels": F.concat(repeated(IGNORE, F.size(asked)), said)})
        rows = rows.withColumn(f"{lead}attention_mask", repeated(1, F.size(f"{lead}input_ids")))
    return rows.withColumn("kto_tags", F.col(desired)).drop("_kl")


def feedback_balance(rows: DataFrame) -> DataFrame:
    """desired, undesired, one_sided (a warning when either is none)."""
    n = rows.agg(F.count_if("kto_tags").alias("desired"), F.count_if(~F.col("kto_tags")).alias("undesired"))
    return n.withColumn("one_sided", (F.col("desired") == 0) | (F.col("undesired") == 0))


def choose_encoder(stage: str, packing: bool = False, generate: bool = False):
    """The encoder of a training stage."""
    if stage == "pt":
        return pretrain_blocks if packing else pretrain_rows
    if stage == "sft" and not generate:
        return pack_sft if packing else encode_sft
    return {"rm": encode_pairs, "kto": encode_feedback}.get(stage, encode_unsupervised)


# ---- collation


def pad_batch(rows: DataFrame, multiple: int = 8, left: bool = False, **pads: int) -> DataFrame:
    """Columns of arrays padded to the longest of their batch, rounded up; ``pads`` has the value for each column."""
    w = Window.partitionBy("batch")
    for c, value in pads.items():
        rows = rows.withColumn("_to", (F.ceil(F.max(F.size(c)).over(w) / multiple) * multiple).cast("int"))
        fill = repeated(value, F.col("_to") - F.size(c))
        rows = rows.withColumn(c, F.concat(fill, F.col(c)) if left else F.concat(F.col(c), fill))
    return rows.drop("_to")


def sft_collate(rows: DataFrame, pad_id: int = 0, multiple: int = 8) -> DataFrame:
    return pad_batch(rows, multiple, input_ids=pad_id, attention_mask=0, labels=IGNORE)


def block_causal_mask(segments: Column) -> Column:
    """Whether place i may see place j: same segment, not padding (0), not later."""
    return F.transform(segments, lambda a, i: F.transform(segments, lambda b, j: (a == b) & (a != 0) & (j <= i)))


def pair_collate(rows: DataFrame, pad_id: int = 0, multiple: int = 8) -> DataFrame:
    """A batch's chosen rows, then its rejected ones: batch, side, rn and the padded columns."""
    parts = [rows.select("batch", F.lit(k).alias("side"), "rn", *[F.col(f"{c}_{x}").alias(x) for x in ("input_ids", "attention_mask", "labels")]) for k, c in enumerate(("chosen", "rejected"))]
    return sft_collate(parts[0].unionByName(parts[1]), pad_id, multiple)


def feedback_collate(rows: DataFrame, pad_id: int = 0, multiple: int = 8) -> DataFrame:
    return pad_batch(sft_collate(rows, pad_id, multiple), multiple, kl_input_ids=pad_id, kl_attention_mask=0, kl_labels=IGNORE)


def unpad_query(ids: Column, pad_id: int) -> Column:
    """Ids without padding on the left."""
    first = F.array_position(F.transform(ids, lambda x: x != pad_id), F.lit(True))
    return F.when(first > 0, F.slice(ids, first.cast("int"), F.size(ids))).otherwise(F.slice(ids, F.size(ids), F.lit(1)))


def unpad_response(ids: Column, pad_id: int, eos_id: int) -> Column:
    """Ids without padding on the right; where the end is the padding one of it stays, and at least one id does."""
    kept = F.size(ids) - F.coalesce(F.nullif(F.array_position(F.reverse(F.transform(ids, lambda x: x != pad_id)), F.lit(True)), F.lit(0)) - 1, F.size(ids))
    return F.slice(ids, F.lit(1), F.least(F.greatest(kept + (1 if eos_id == pad_id else 0), F.lit(1)), F.size(ids)).cast("int"))


def rotate_padding(ids: Column, pad_id: int) -> Column:
    """Padding on the left moved to the end; ignored labels become padding."""
    ids = F.transform(ids, lambda x: F.when(x == IGNORE, pad_id).otherwise(x))
    first = F.array_position(F.transform(ids, lambda x: x != pad_id), F.lit(True)).cast("int")
    return F.when(first > 1, F.concat(F.slice(ids, first, F.size(ids)), F.slice(ids, F.lit(1), first - 1))).otherwise(ids)


def unpad_data(rows: DataFrame) -> DataFrame:
    """seqlens, indices, cu_seqlens, max_seqlen of packing masks (rn, attention_mask): one row for each batch."""
    lengths = F.transform(F.filter(F.sequence(F.lit(1), F.array_max("attention_mask")), lambda s: F.lit(True)), lambda s: F.size(F.filter("attention_mask", lambda x: x == s)))
    lengths = F.when(F.array_max("attention_mask") > 0, lengths).otherwise(F.array().cast(INTS))
    places = F.filter(F.transform("attention_mask", lambda x, i: F.when(x != 0, F.col("row") * F.size("attention_mask") + i)), lambda x: x.isNotNull())
    w = Window.partitionBy("batch").orderBy("rn")
    per = rows.withColumn("row", F.row_number().over(w) - 1).select("batch", "row", lengths.alias("l"), places.alias("p"))
    joined = per.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("row", "l", "p"))).alias("r"))
    out = joined.select("batch", F.flatten(F.transform("r", lambda x: x["l"])).alias("seqlens"), F.flatten(F.transform("r", lambda x: x["p"])).alias("indices"))
    sums = F.transform(F.sequence(F.lit(0), F.size("seqlens")), lambda k: F.aggregate(F.slice("seqlens", F.lit(1), k), F.lit(0), lambda a, x: a + x))
    return out.withColumns({"cu_seqlens": sums, "max_seqlen": F.array_max("seqlens")})
