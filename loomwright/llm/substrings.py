"""Substring dedup: FM-indexes by shard find windows of words that an earlier document has too.

1. Every window of ``k`` words has a minimizer, the least hash of its shorter word grams. Equal windows have equal
   minimizers, so only runs of windows whose minimizer stands in two documents or more go on, each as a snippet
   (the words under the run, fewer than 2 k). Equal snippets are one, with the least doc_id.
2. Snippets go to shards by minimizer: all that hold a window are together. A shard's FM-index is a wavelet matrix over the
   Burrows-Wheeler transform of its snippets, sorted to 2 k symbols, with bits packed and counted by blocks. One backward pass over each
   streamed snippet, a step for each word, gives the place of what begins at each word among the sorted suffixes; there, marks where
   neighbours share fewer than ``k`` symbols cut the match to ``k``, and each cut interval has its least doc_id.
3. Documents drop the words under windows whose least doc_id is smaller than their own.

Null, empty and short texts lose nothing. Rows of one doc_id are the same document: they lose nothing to each other. Rows with a
null doc_id lose nothing, and no others lose anything to them. Other columns are ignored. An empty table gives none. A shard holds distinct
snippets only, so copies of one passage do not add to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import gram_hashes, hashed_words, pieces
from .common import discard, stash, table

#: Words in the snippets of one shard, on average.
SHARD_WORDS = 150_000


def minimizers(bounds: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' word hashes: text, key, first and last start (in the text) of each run of windows with one minimizer."""
    short = k // 2
    grams, wide = gram_hashes(h, short), k - short + 1
    if len(h) < k:
        return (np.zeros(0, np.int64),) * 4
    # The least gram of each window by the leading bits of its hash, then by place: minima over 1, 2, 4, ... grams.
    low = (grams & np.uint64(0xFFFFFF0000000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < wide:
        low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
    at = (low & np.uint64(0xFFFFFFFFFF)).astype(np.int64)
    own = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(own[: len(at)] == own[k - 1 :])
    at, text = at[start], own[start]
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:] - 1, len(at) - 1)
    base = bounds[text[first]]
    return text[first], grams[at[first]], start[first] - base, start[last] - base


def joined(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of words with a space after each, and where each word begins."""
    size = end - first + 1
    at = np.cumsum(size) - size
    if not len(size):
        return np.zeros(0, np.uint8), at
    out = data[np.minimum(np.repeat(first - at, size) + np.arange(size.sum()), len(data) - 1)]
    out[at + size - 1] = 32
    return out, at


class FMIndex:
    """Backward search in a text of small integers that is sorted to ``2 k`` symbols, and the least owner by first ``k`` symbols."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, k: int):
        n = len(text)

        def then(rank: np.ndarray, other: np.ndarray, step: int) -> np.ndarray:
            """Ranks by one rank, then by another ``step`` places on."""
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = other[step : n] + 1
            return np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)

        rank, step, window, done = np.unique(text, return_inverse=True)[1].astype(np.int64), 1, None, 0
        while step < 2 * k:
            if k & step:
                window, done = (rank, step) if window is None else (then(rank, window, step), done + step)
            rank = then(rank, rank, step) if step < n else rank
            step *= 2
        order = np.argsort(rank, kind="stable")
        groups = window[order]
        self.group = np.concatenate([[0], np.cumsum(groups[1:] != groups[:-1])]).astype(np.int32)
        self.least = np.minimum.reduceat(owner[order], np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])))
        symbols = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=int(text.max()) + 1))])
        self.levels = []
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            packed = np.packbits(np.concatenate([ones, np.zeros(64 + -n % 64, bool)]), bitorder="little").view(np.uint64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))])[:-1].astype(np.int32)
            self.levels.append((bit, packed, counts, n - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first suffix that begins with the symbol and then what the suffix at ``at`` begins with."""
        low, upto = np.zeros_like(at), at
        for bit, packed, counts, zeros in self.levels:
            up = (symbol >> bit & 1).astype(bool)

            def ones(i, packed=packed, counts=counts):
                return counts[i >> 6] + np.bitwise_count(packed[i >> 6] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

            a, b = ones(low), ones(upto)
            low, upto = np.where(up, zeros + a, low - a), np.where(up, zeros + b, upto - b)
        return self.before[symbol] + upto - low


def search_shard(contents: pa.Array, lows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The least doc_id that has each window of each snippet, one after another, and how many windows each has."""
    bounds, h, _ = hashed_words(contents)
    lengths = np.diff(bounds)
    text = np.zeros(len(h) + len(lengths), dtype=np.int64)
    starts = bounds[:-1] + np.arange(len(lengths))
    inside = np.ones(len(text), dtype=bool)
    inside[starts + lengths] = False
    text[inside] = np.unique(h, return_inverse=True)[1] + 1
    index = FMIndex(text, np.repeat(lows, lengths + 1), k)
    counts = lengths - k + 1
    begin = np.cumsum(counts) - counts
    least = np.empty(int(counts.sum()), dtype=np.int64)
    # Snippets in step, from their last words on; longer ones first, so that those that are done fall off the end.
    order = np.argsort(-lengths, kind="stable")
    at = np.zeros(len(order), dtype=np.int64)
    for j in range(int(lengths.max())):
        order = order[: np.searchsorted(-lengths[order], -j, side="left")]
        at = index.step(text[starts[order] + lengths[order] - 1 - j], at[: len(order)])
        if j >= k - 1:
            least[begin[order] + lengths[order] - 1 - j] = index.least[index.group[at]]
    return least, counts


def remove_repeats(docs: DataFrame, k: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by a space), kept_sha256."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text"))
    known = rows.where("doc_id IS NOT NULL")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                bounds, h, _ = hashed_words(b.column("text"))
                text, key, first, last = minimizers(bounds, h, k)
                ids = [b.column(c).take(pa.array(text)) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(key.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["doc_id", "row", "key", "first", "last"])

    found = known.mapInArrow(runs, "doc_id long, row long, key long, first int, last int")
    # Added up before the shuffle, and written first, so that a small table of keys spares the runs theirs.
    shared = stash(found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key"), "shared")
    kept = found.join(shared, "key").groupBy("doc_id", "row").agg(F.collect_set(F.struct("key", "first", "last")).alias("runs"))

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                bounds, _, (data, first, end) = hashed_words(b.column("text"))
                raw, at = joined(data, first, end)
                raw, at = raw.tobytes(), np.append(at, len(raw))
                every = b.column("runs")
                n = pc.list_value_length(every).to_numpy(zero_copy_only=False)
                run = every.flatten()
                key, begin, last = (run.field(c) for c in ("key", "first", "last"))
                own = np.repeat(np.arange(len(b)), n)
                x, y = at[bounds[own] + begin.to_numpy()].tolist(), at[bounds[own] + last.to_numpy() + k].tolist()
                content = pa.array([raw[i : j - 1].decode("utf-8", "replace") for i, j in zip(x, y, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(own)) for c in ("doc_id", "row")], key, begin, content], names=["doc_id", "row", "key", "first", "content"])

    held = known.join(kept, ["doc_id", "row"]).mapInArrow(snippets, "doc_id long, row long, key long, first int, content string")
    held = stash(held.withColumn("sid", F.md5(F.col("content").cast("binary"))), "snippets")
    discard(shared)
    distinct = stash(held.groupBy("key", "content", "sid").agg(F.min("doc_id").alias("low")), "distinct")
    size = distinct.agg(F.sum(F.size(F.split("content", " ")))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, size // SHARD_WORDS + 1)

    def search(t: pa.Table) -> pa.Table:
        least, counts = search_shard(t.column("content").combine_chunks(), t.column("low").to_numpy(), k)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.table({"sid": t.column("sid"), "least": pa.ListArray.from_arrays(offsets, pa.array(least))})

    least = distinct.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(search, "sid string, least array<long>")
    # Only snippets with a window of an earlier document matter for a document.
    starts = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull())
    gone = held.select("doc_id", "row", "first", "sid").distinct().join(least, "sid").select("doc_id", "row", starts.alias("s")).where("size(s) > 0")
    gone = stash(gone.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("s")).alias("starts")), "gone")
    discard(held)
    discard(distinct)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch):
                bounds, _, (data, first, end) = hashed_words(b.column("text"))
                every = b.column("starts")
                own = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(every), 0).to_numpy(zero_copy_only=False))
                begin = bounds[own] + every.flatten().to_numpy()
                edge = np.bincount(begin, minlength=len(first) + 1)[: len(first) + 1] - np.bincount(begin + k, minlength=len(first) + 1)[: len(first) + 1]
                keep = np.cumsum(edge)[:-1] == 0
                count = np.concatenate([[0], np.cumsum(keep)])[bounds]
                raw, at = joined(data, first[keep], end[keep])
                at = np.append(at, len(raw))[count]
                raw = raw.tobytes()
                texts = [raw[i : max(i, j - 1)] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(n - np.diff(count), pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return rows.join(gone, ["doc_id", "row"], "left").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op7(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
