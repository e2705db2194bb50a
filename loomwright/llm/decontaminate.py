"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased (A-Z) with one space between words. An item is one pattern; a long one has several
overlapping windows besides, so that parts of it are found. A pattern of m characters found with at most e edits
shares m - q + 1 - q * e q-grams with the text, on diagonals of one band; bands twice as wide overlap, so that one
holds them all. Bands that meet the bound are verified by a banded alignment. Where the bound would fall below 1, a
pattern has shorter q-grams.

Null and empty texts match nothing; null, empty and repeated items add nothing. Repeated documents are judged alike.
Columns of the input pass through; ``contaminated``, ``item_ids`` and ``spans`` of the input are replaced. Without items
all documents are clean. The items go to the executors in blocks of a bounded size, with a pass for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import hashed_words, mix64, pieces
from .common import get_object, put_object, stash, table

Q, EDITS, LONGEST = 12, 0.05, 240
#: Characters of items in one block.
BLOCK_CHARS = 2_000_000
_LOWER_CASE = np.arange(256, dtype=np.uint8)
_LOWER_CASE[65:91] += 32


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all q-grams, put together from those of 1, 2, 4, ... characters."""
    n, out, done, h, width = len(c) - q + 1, None, 0, mix64(c.astype(np.uint64) + np.uint64(1)), 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    while done < q:
        if q & width:
            part = h[done : done + n]
            out = part.copy() if out is None else (out * np.uint64(0x9E3779B97F4A7C15) ^ (out >> np.uint64(29))) + part
            done += width
        h = (h[:-width] * np.uint64(0xC2B2AE3D27D4EB4F) ^ (h[:-width] >> np.uint64(31))) + h[width:] if 2 * width <= q else h
        width *= 2
    return mix64(out)


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts, lower-cased with one space between words and a line feed after each text; where each text begins and ends."""
    bounds, _, (data, first, end) = hashed_words(texts, lower=True)
    n = np.diff(bounds)
    # Each word and one byte after it; the byte is a space, or a line feed after a text's last word. Empty texts have only that.
    size = end - first + 1
    out_at = np.cumsum(size) - size
    src = np.repeat(first - out_at, size) + np.arange(size.sum())
    out = _LOWER_CASE[data[np.minimum(src, max(len(data) - 1, 0))]] if len(size) else np.zeros(0, np.uint8)
    stop = out_at + size - 1
    out[stop] = 32
    last = bounds[1:][n > 0] - 1
    out[stop[last]] = 10
    c = codes(out.tobytes().decode("utf-8", "replace"))
    place = np.concatenate([[0], np.flatnonzero(c == 10) + 1])
    begin = place[np.cumsum(n > 0) - (n > 0)]
    stop = np.where(n > 0, place[np.cumsum(n > 0)] - 1, begin)
    return c, begin, stop


def budget(m: int) -> int:
    """Edits allowed in a pattern of m characters."""
    return int(m * EDITS)


def gram_size(m: int) -> int:
    """Q, or the longest q that keeps the lemma's bound at 1 or more."""
    return min(Q, m // (budget(m) + 1))


class Patterns:
    """Patterns of items and for each q the sorted table of their q-grams, behind a bit table."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.code, self.short = [], [], []
        for item_id, s in items:
            c = codes(s)
            if 0 < len(c) < Q:
                self.short.append((item_id, s))
            elif len(c):
                parts = {(0, len(c)), *((a, a + LONGEST) for a in [*range(0, len(c) - LONGEST, LONGEST // 2), len(c) - LONGEST] if a >= 0)}
                self.item.extend([item_id] * len(parts))
                self.code.extend(c[a:b] for a, b in sorted(parts))
        size = np.array([gram_size(len(c)) for c in self.code], dtype=np.int64)
        self.edits = np.array([budget(len(c)) for c in self.code], dtype=np.int64)
        self.need = np.array([len(c) for c in self.code], dtype=np.int64) - size + 1 - size * self.edits
        self.tables = [(int(q), *self.table(int(q), np.flatnonzero(size == q))) for q in np.unique(size)]

    def table(self, q: int, which: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pattern and place of each q-gram, sorted by hash; the distinct hashes, where each begins, how many it has; a table of their leading bits."""
        every = [grams(self.code[i], q) for i in which]
        h = np.concatenate(every)
        order = np.argsort(h, kind="stable")
        pattern = np.repeat(which, [len(e) for e in every])[order]
        at = np.concatenate([np.arange(len(e)) for e in every])[order].astype(np.int64)
        keys, first, count = np.unique(h[order], return_index=True, return_counts=True)
        bits = np.zeros(1 << min(24, max(16, int(len(keys)).bit_length() + 4)), dtype=bool)
        bits[keys >> np.uint64(64 - int(len(bits)).bit_length() + 1)] = True
        return pattern, at, keys, first, count, bits


def banded(patterns: list[np.ndarray], texts: np.ndarray, edits: int) -> np.ndarray:
    """Where in its row of texts each pattern ends with at most so many edits, or -1: least edits, free ends of the text.

    A row begins at the first diagonal of the band and has as many characters more than its pattern as the band has diagonals, less
    one. Only cells of the band are computed: one vector of diagonals for each character of the pattern, for all patterns at once.
    """
    size = np.array([len(p) for p in patterns])
    longest = int(size.max())
    width = texts.shape[1] - longest + 1
    chars = np.full((len(patterns), longest), 0xFFFFFFFE, dtype=np.uint32)
    for row, p in zip(chars, patterns, strict=True):
        row[: len(p)] = p
    cost, steps, out = np.zeros((len(patterns), width), dtype=np.int32), np.arange(width, dtype=np.int32), np.full(len(patterns), -1)
    for i in range(longest):
        new = cost + (texts[:, i : i + width] != chars[:, i : i + 1])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
        for k in np.flatnonzero(size == i + 1):
            if cost[k].min() <= edits:
                out[k] = i + 1 + int(cost[k].argmin())
    return out


def find_in(p: Patterns, c: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item_id, begin, end) in the normalised texts; begin is of the region, end of the alignment."""
    out = []
    if p.short:
        for k, (a, b) in enumerate(zip(begin.tolist(), stop.tolist(), strict=True)):
            s = c[a:b].tobytes().decode("utf-32-le", "surrogatepass")
            out.extend((k, item, s.find(t), s.find(t) + len(t)) for item, t in p.short if f" {t} " in f" {s} ")
    # Empty texts begin where the next one does.
    held = np.flatnonzero(stop > begin)
    for t in p.tables:
        out.extend(find_near(p, t, c, begin, stop, held))
    return out


def find(p: Patterns, s: str) -> list[tuple[int, int, int]]:
    """What find_in gives, for one normalised text."""
    return [x[1:] for x in find_in(p, *normal(pa.array([s])))]


def find_near(p: Patterns, table: tuple, c: np.ndarray, begin: np.ndarray, stop: np.ndarray, held: np.ndarray) -> list[tuple[int, int, int, int]]:
    """What find_in gives, for the patterns of one table."""
    q, patterns, places, keys, first, count, bits = table
    h = grams(c, q)
    hit = np.flatnonzero(bits[h >> np.uint64(64 - int(len(bits)).bit_length() + 1)])
    if not len(hit):
        return []
    slot = np.minimum(np.searchsorted(keys, h[hit]), len(keys) - 1)
    hit, slot = hit[keys[slot] == h[hit]], slot[keys[slot] == h[hit]]
    if not len(hit):
        return []
    n = count[slot]
    where = np.repeat(first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pattern, at, pos = patterns[where], places[where], np.repeat(hit, n)
    text = held[np.searchsorted(begin[held], pos, side="right") - 1]
    # Two overlapping bands for each hit, of twice the stride's width; a q-gram of the pattern counts once in a band.
    band = (pos - begin[text] - at) // (p.edits[pattern] + 1)
    both = np.unique(np.stack([np.tile(text, 2), np.tile(pattern, 2), np.concatenate([band, band - 1]), np.tile(at, 2)]), axis=1)
    edge = np.flatnonzero(np.concatenate([[True], (both[:3, 1:] != both[:3, :-1]).any(axis=0)]))
    enough = np.diff(np.append(edge, both.shape[1])) >= p.need[both[1, edge]]
    text, pattern, band = both[:3, edge[enough]]
    out, done = [], set()
    for e in np.unique(p.edits[pattern]):
        rows = np.flatnonzero(p.edits[pattern] == e)
        for k in range(0, len(rows), 1024):
            r = rows[k : k + 1024]
            low = band[r] * (e + 1) - e + begin[text[r]]
            longest = max(len(p.code[i]) for i in pattern[r])
            spot = low[:, None] + np.arange(longest + 4 * e + 2)
            inside = (spot >= begin[text[r]][:, None]) & (spot < stop[text[r]][:, None])
            region = np.where(inside, c[np.clip(spot, 0, len(c) - 1)], np.uint32(0xFFFFFFFF))
            ends = banded([p.code[i] for i in pattern[r]], region, int(e))
            for i, end in zip(np.flatnonzero(ends >= 0), ends[ends >= 0], strict=True):
                a, t, x, k = int(begin[text[r[i]]]), int(text[r[i]]), int(pattern[r[i]]), int(band[r[i]])
                if (t, x, k - 1) in done:  # the band before overlaps this one
                    continue
                done.add((t, x, k))
                out.append((t, p.item[x], max(0, int(low[i]) - a), min(int(stop[text[r[i]]]) - a, int(low[i]) - a + int(end))))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with ``contaminated``, ``item_ids`` and ``spans`` (item_id, begin, end in the normalised text)."""
    spark = docs.sparkSession
    docs = docs.drop("contaminated", "item_ids", "spans")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).where("item_id IS NOT NULL AND item IS NOT NULL").distinct()
    blocks = (items.agg(F.sum(F.length("item"))).first()[0] or 0) // BLOCK_CHARS + 1
    schema = spark.createDataFrame([], docs.schema).withColumn("spans", F.array().cast("array<struct<item_id:long,begin:long,end:long>>")).schema
    out = docs.withColumn("spans", F.array().cast("array<struct<item_id:long,begin:long,end:long>>"))
    span = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())]))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()  # bounded by BLOCK_CHARS on average
        c, begin, stop = normal(pa.array([r.item for r in block], pa.string()))
        path = put_object(spark, Patterns([(r.item_id, c[a:b].tobytes().decode("utf-32-le", "surrogatepass")) for r, a, b in zip(block, begin, stop, strict=True)]))

        def search(batches: Iterator[pa.RecordBatch], path=path) -> Iterator[pa.RecordBatch]:
            p = get_object(path)
            for batch in batches:
                for b in pieces(batch, size=1 << 20):
                    i = b.schema.get_field_index("spans")
                    got = [list(old) for old in b.column(i).to_pylist()]
                    for t, x, y, z in find_in(p, *normal(b.column("text"))):
                        got[t].append({"item_id": x, "begin": y, "end": z})
                    yield b.set_column(i, b.schema.field(i).with_type(span), pa.array(got, span))

        out = out.mapInArrow(search, schema)
        if k < blocks - 1:
            out = stash(out, "spans")
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item_id"])))
    return out.withColumns({"contaminated": F.size("spans") > 0, "item_ids": ids})


def op4(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate(docs.select("doc_id", "text"), items).select("doc_id", "contaminated", "item_ids", F.size("spans").cast("long").alias("n_spans"))
