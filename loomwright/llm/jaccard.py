"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

1. Each text becomes its row of the incidence, the set of its word n-grams (64-bit hashes). Equal rows are one class with
   one 64-bit number; a sketch of fixed size counts how many documents have an n-gram of each of its cells.
2. Columns are ordered by the sketch, rare ones first, and equal cells by hash: one order for all rows, whatever its quality. Two
   rows can only meet the bound if they share one of their first ``n - least overlap + 1`` columns, so the product is
   formed on these columns alone, in blocks of a column each; columns with one row drop out.
3. An entry at place ``p`` of a row of ``n`` that is the first shared one leaves an overlap of at most ``n - p``.
   Entries whose bound on either side is below the overlap that both sizes need are discarded unseen.
4. Of columns with the very same rows the first is kept. In each column one row, the one with the most left, is multiplied
   with the others: first each row with the best of its columns, then with all of them. Links are folded into components
   after each step, and at last all entries whose rows still lie in different components are multiplied. Copies of one
   text thus meet in stars, not in pairs.
5. The product of the pairs that are left adds up overlap counts over sorted n-grams for a block of pairs at a time; pairs with
   ``100 * overlap < percent * union`` are discarded.

Returned are components and set sizes. Every pair that links lies in one component; links inside a component are not listed.
Null, empty and blank texts have an empty set and link with nothing; they are components of their own. Texts with fewer
words than n have the whole sequence as their one n-gram. Rows that repeat a doc_id, null among them, count as one document: the
one with most n-grams. Other columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import hashed_words, mix64, pieces, text_grams
from .common import discard, get_object, put_object, remove_object, stash, table

#: Cells of the sketch, sent in so many parts; so many parts of tasks are added up at once.
CELLS, PARTS, FAN_IN = 1 << 21, 8, 32
#: N-grams of both sides in one block of pairs.
BLOCK_GRAMS = 2_000_000
#: Bits of the mask of ids whose texts are read again.
MASK_BITS = 1 << 22


def cell(grams: np.ndarray) -> np.ndarray:
    return (grams & np.uint64(CELLS - 1)).astype(np.int64)


def incidence(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each distinct n-gram, sorted; the rows' sizes and numbers (0 for empty ones)."""
    bounds, h, _ = hashed_words(texts, lower=True)
    own, grams = text_grams(bounds, h, n)
    order = np.lexsort((grams, own))
    own, grams = own[order], grams[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (grams[1:] != grams[:-1])
    own, grams = own[new], grams[new]
    size = np.bincount(own, minlength=len(texts))
    number = np.zeros(len(texts), dtype=np.uint64)
    if len(own):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        number[own[first]] = mix64(np.add.reduceat(mix64(grams + np.uint64(0x51ED270B)), first) + size[own[first]].astype(np.uint64))
    return own, grams, size, number.view(np.int64)


def least_overlap(a, b, percent: int):
    """The least o with 100 * o >= percent * (a + b - o), for arrays of sizes."""
    return -(-percent * (a + b) // (100 + percent))


def read_sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, node of each row; besides, for each task, its sketch in parts (part, no, counts)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = ["doc_id", "n_shingles", "node", "part", "no", "counts"], np.zeros(CELLS, dtype=np.uint32)
        for batch in batches:
            for b in pieces(batch):
                _, grams, size, number = incidence(b.column("text"), n)
                seen += np.bincount(cell(grams), minlength=CELLS).astype(np.uint32)
                none = [pa.nulls(len(b), t) for t in (pa.int32(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(number), *none], names=names)
        for k, part in enumerate(np.split(np.minimum(seen, 65535).astype(np.uint16), PARTS)):
            row = [pa.nulls(1, pa.int64())] * 3 + [pa.array([k], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)])]
            yield pa.RecordBatch.from_arrays(row, names=names)

    return docs.mapInArrow(make, "doc_id long, n_shingles long, node long, part int, no long, counts binary")


def add_sketches(parts: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches, FAN_IN at a time; its cells hold logarithms, a byte each."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CELLS // PARTS, dtype=np.uint64)
        for c in t.column("counts").to_pylist():
            raw = zlib.decompress(c)
            total += np.frombuffer(raw, np.uint16 if len(raw) < 4 * len(total) else np.uint64)
        return pa.table({"part": t.column("part").slice(0, 1), "no": t.column("into").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)])})

    n, old = (parts.agg(F.max("no")).first()[0] or 0) + 1, None
    while True:
        into = parts.withColumn("into", F.floor(F.col("no") / FAN_IN).cast("long"))
        level = stash(into.groupBy("part", "into").applyInArrow(add, "part int, no long, counts binary"), "sketch")
        if old is not None:
            discard(old)
        n = -(-n // FAN_IN)
        if n <= 1:
            break
        parts = old = level
    out = np.zeros(CELLS, dtype=np.uint64)
    for r in level.collect():  # PARTS rows of fixed size
        out[r.part * (CELLS // PARTS) : (r.part + 1) * (CELLS // PARTS)] = np.frombuffer(zlib.decompress(r.counts), np.uint64)
    discard(level)
    return np.minimum(np.log2(out + 1) * 8, 255).astype(np.uint8)


def entries(docs: DataFrame, sketch: str, n: int, percent: int) -> DataFrame:
    """key, node, n, p: the first columns of each row in the common order; a task gives those of equal rows once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, done = get_object(sketch), np.zeros(0, dtype=np.int64)
        for batch in batches:
            for b in pieces(batch):
                own, grams, size, number = incidence(b.column("text"), n)
                fresh = np.zeros(len(b), dtype=bool)
                fresh[np.unique(number, return_index=True)[1]] = True
                fresh &= (size > 0) & ~np.isin(number, done)
                done = np.concatenate([done, number[fresh]])
                use = fresh[own]
                own, grams = own[use], grams[use]
                order = np.lexsort((grams, often[cell(grams)], own))
                own, grams = own[order], grams[order]
                kept = np.flatnonzero(fresh)
                begin = np.zeros(len(b), dtype=np.int64)
                begin[kept] = np.cumsum(size[kept]) - size[kept]
                place = np.arange(len(own)) - begin[own]
                first = place < size[own] + 1 + -percent * size[own] // 100
                yield pa.RecordBatch.from_arrays([pa.array(grams[first].view(np.int64)), pa.array(number[own[first]]), pa.array(size[own[first]].astype(np.int32)), pa.array(place[first].astype(np.int32))], names=["key", "node", "n", "p"])

    return docs.select("text").mapInArrow(make, "key long, node long, n int, p int")


def components(links: DataFrame) -> DataFrame:
    """node, component: least node reachable, for all nodes of links (a, b); in rounds of least neighbours and of pointer doubling."""
    edges = stash(links.union(links.select("b", "a")).distinct().toDF("a", "b"), "edges")
    state = stash(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).select(F.col("a").alias("node"), "c"), "component")
    while True:
        near = edges.join(state, edges["b"] == state["node"]).groupBy("a").agg(F.min("c").alias("m"))
        step = state.join(near, state["node"] == near["a"]).select("node", F.least("c", "m").alias("c"), F.col("c").alias("was"))
        up = step.select(F.col("node").alias("p"), F.col("c").alias("pc"))
        new = stash(step.join(up, step["c"] == up["p"]).select("node", F.least("c", "pc").alias("c"), "was"), "component")
        discard(state)
        if new.where("c <> was").isEmpty():
            discard(edges)
            return new.select("node", F.col("c").alias("component"))
        state = new.drop("was")


def overlaps(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Overlap counts of pairs of rows: equal neighbours in the sorted n-grams of both, added up by pair."""
    rows = [np.frombuffer(x, np.uint64) for pair in zip(left, right, strict=True) for x in pair]
    which = np.repeat(np.arange(len(rows)) // 2, [len(r) for r in rows])
    grams = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    order = np.lexsort((grams, which))
    which, grams = which[order], grams[order]
    both = (grams[1:] == grams[:-1]) & (which[1:] == which[:-1])
    return np.bincount(which[1:][both], minlength=len(left))


def first_of_equal(members: DataFrame) -> DataFrame:
    """key: of columns with the very same rows the first in the common order, which is the first that any two of them share."""
    rows = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"), F.sum(F.col("p").cast("long")).alias("p"))
    return rows.groupBy("rows", "x", "y").agg(F.min(F.struct("p", "key")).alias("first")).select("first.key")


def rows_as_sets(rows: DataFrame, pairs: DataFrame, reps: DataFrame, n: int) -> tuple[DataFrame, str, DataFrame]:
    """node, s (sorted n-grams) of the rows in pairs, dealt by node; besides, the object and the table to delete after its use.

    A mask of fixed size spares most other texts; it only passes more where it is full. The sets are not written: both sides
    of the product read the one shuffle that gathers them.
    """
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = stash(nodes.join(reps, "node").select("node", "rep"), "wanted")
    bit = F.pmod(F.xxhash64("rep"), F.lit(MASK_BITS))
    found = wanted.groupBy(F.floor(bit / 32).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(xxhash64(rep), {MASK_BITS}) % 32 as int)))").alias("bits")).toArrow()  # at most MASK_BITS / 32 rows
    mask = np.zeros(MASK_BITS // 32, dtype=np.uint32)
    mask[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    path = put_object(rows.sparkSession, zlib.compress(mask.tobytes(), 1))

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.frombuffer(zlib.decompress(get_object(path)), np.uint32)
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            for b in pieces(batch.filter(pa.array((mask[bit // 32] >> (bit % 32).astype(np.uint32)) & 1 == 1))):
                _, grams, size, number = incidence(b.column("text"), n)
                cut = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array([grams[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "s"])

    sets = rows.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(MASK_BITS)).alias("bit")).mapInArrow(as_sets, "node long, s binary")
    return sets.join(wanted.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), path, wanted


def multiply(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that meet the bound."""
    # Merged at any size, so that a small run shows what a large one does.
    left, right = sets.toDF("a", "sa").hint("merge"), sets.toDF("b", "sb").hint("merge")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [np.array([len(x) // 8 for x in batch.column(c).to_pylist()], dtype=np.int64) for c in ("sa", "sb")]
            which = np.cumsum(size[0] + size[1]) // BLOCK_GRAMS
            for k in np.unique(which):
                i, j = np.searchsorted(which, [k, k + 1])
                both = overlaps(*(batch.column(c).slice(i, j - i).to_pylist() for c in ("sa", "sb")))
                ok = 100 * both >= percent * (size[0][i:j] + size[1][i:j] - both)
                yield batch.select(["a", "b"]).slice(i, j - i).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def left_of(n: str, p: str, m: str, percent: int) -> Column:
    """Whether what a row of size n has from place p on meets the overlap that it needs with a row of size m."""
    return (F.col(n) - F.col(p)) * (100 + percent) >= percent * (F.col(n) + F.col(m))


def join_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = stash(read_sets(rows, n), "sets")
    sketch = put_object(docs.sparkSession, add_sketches(read.where("part IS NOT NULL").select("part", "no", "counts")))
    ids = read.where("part IS NULL").groupBy("doc_id").agg(F.max(F.struct("n_shingles", "node")).alias("s")).select("doc_id", "s.*")
    reps = stash(ids.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")

    found = stash(entries(rows, sketch, n, percent), "entries")
    remove_object(sketch)
    # Written first, so that a small table of them spares the entries a shuffle.
    shared = stash(found.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key"), "shared")
    every = stash(found.join(shared, "key").distinct().join(reps.select("node"), "node", "left_semi").select("key", "node", "n", "p"), "members")
    discard(found)
    discard(shared)
    members = stash(every.join(first_of_equal(every), "key"), "members")
    discard(every)

    def product(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that meet the bound; only rows in a pair are read as sets."""
        pairs = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        sets, path, wanted = rows_as_sets(rows, pairs, reps, n)
        out = stash(multiply(pairs, sets, percent), "links")
        remove_object(path)
        for done in (pairs, wanted):
            discard(done)
        return out

    # In each column the row with the most left is the hub of the others; a row goes to its best hub.
    hub = F.min(F.struct("p", "n", F.col("node").alias("hub"))).alias("h")
    hubs = members.groupBy("key").agg(hub).select("key", F.col("h.p").alias("hp"), F.col("h.n").alias("hn"), "h.hub")
    meets = left_of("n", "p", "hn", percent) & left_of("hn", "hp", "n", percent)
    near = members.join(hubs, "key").where((F.col("node") != F.col("hub")) & meets)
    links = product(near.groupBy("node").agg(F.min(F.struct(F.expr("p + hp").alias("o"), "hub")).alias("h")).select(F.col("node").alias("a"), F.col("h.hub").alias("b")))
    state = components(links)

    def apart(state: DataFrame) -> DataFrame:
        """Members in columns of more than one component, with their component c."""
        labelled = members.join(state, "node", "left").select("key", "node", "n", "p", F.coalesce("component", "node").alias("c"))
        mixed = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
        return labelled.join(mixed, "key")

    def fold(pairs: DataFrame) -> None:
        nonlocal links, state
        more = product(pairs)
        if not more.isEmpty():
            links = links.union(more)
            state = components(links)

    # Then every row meets the hub of each of its columns, while they lie in different components.
    open_ = apart(state)
    hubs = open_.groupBy("key").agg(F.min(F.struct("p", "n", F.col("node").alias("hub"), F.col("c").alias("hc"))).alias("h")).select("key", F.col("h.p").alias("hp"), F.col("h.n").alias("hn"), "h.hub", "h.hc")
    fold(open_.join(hubs, "key").where((F.col("c") != F.col("hc")) & meets).select(F.col("node").alias("a"), F.col("hub").alias("b")))

    # What lies in different components after that.
    a, b = (apart(state).toDF("key", *[f"{c}_{k}" for c in ("node", "n", "p", "c")]) for k in "ab")
    rest = a.join(b, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("c_a") != F.col("c_b")) & left_of("n_a", "p_a", "n_b", percent) & left_of("n_b", "p_b", "n_a", percent))
    fold(rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    discard(members)
    named = reps.join(state, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "c").select("node", "component_id")
    # Documents without a set meet no class; spread apart, as they all have the same node.
    return ids.where("n_shingles > 0").join(named, "node").select("doc_id", "n_shingles", "component_id").union(ids.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op9(spark, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents"), n=3, percent=90)


SQL = None
