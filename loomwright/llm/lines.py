"""Line dedup by an exact set-similarity join, in built-in functions only.

A line's tokens are its distinct words (A-Z lower-cased), as 64-bit hashes. Two lines match when their Jaccard similarity is at
least ``percent`` / 100. Equal token sets are one class with its first place (doc_id, text, line number). Tokens are ordered by
rarity, taken from counts of a fixed number of cells over all lines; equal cells are ordered by hash, so that all
lines have one order. Classes that share a token of their prefixes, pass the length and the positional filter and whose signatures differ in few
enough bits are verified. First each class meets, for each of its prefix tokens, the earliest class, and of those with the most left in one of them the
best, so that large groups of near copies meet in stars; the later of two that match is removed. What is left then meets all classes that
share a prefix token, where the smaller of two sets only needs the prefix that sets of no lesser size ask for, by token and bucket of sizes. A line is
removed when any line that matches it stands before it, removed or not, so the order of these steps does not matter.

Blank lines have no tokens, match nothing and stay. Null texts have no lines and stay null. Null ids come before all others. Ties
in doc_id are ordered by the text's hash, and whole repeated rows are numbered, so that the first of them keeps its lines. Other
columns are ignored. An empty table gives none.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, stash, table

#: Cells that count tokens, and the bits of a token's hash that stay beside its count.
CELLS, BITS = 1 << 18, 44
#: Parts of the keys, and of the classes, that are joined one after the other.
PARTS = 4
#: Cells that tell which classes are in a pair, before their lines are moved.
STAMPS = 1 << 22
#: Token hashes repeat often, but the writer's own dictionary of 1 MB is too small for a task's distinct ones.
WORDBOOK = {"parquet.dictionary.page.size": str(16 << 20)}


def clean(line: Column) -> Column:
    """Lower-cased with spaces for all gaps; the dear way only where it is needed."""
    plain = F.octet_length(line) == F.length(line)
    low = F.when(plain, F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.when(odd, F.translate(low, "\t\r\x0b\x0c", "    ")).otherwise(low)


def row_key() -> Column:
    """Tells rows with other ids or texts apart; whole repeats have the same."""
    return F.xxhash64("doc_id", "text")


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no, id, n, s (sorted hashes of the tokens); n is 0 for the lines that have none.

    These are for the reader to leave out, as a condition on s here would make it twice.
    """
    rows = docs.select("doc_id", row_key().alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.where(F.length("line") > 0).select("doc_id", "row", "line_no", F.split(clean(F.col("line")), " ").alias("w"))
    hashes = F.array_remove(F.array_distinct(F.transform("w", lambda x: F.xxhash64(x))), F.xxhash64(F.lit("")))
    return rows.select("doc_id", "row", "line_no", F.sort_array(hashes).alias("s")).select("doc_id", "row", "line_no", F.xxhash64("s").alias("id"), F.size("s").alias("n"), "s")


def place() -> Column:
    """Where a line stands: null ids first, then by id, text and line."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.col("row"), F.col("line_no"))


def rarity(lines: DataFrame) -> Column:
    """How many tokens fall into each cell, as a constant array of fixed size."""
    cells = lines.select(F.explode("s").alias("t")).groupBy(F.pmod("t", F.lit(CELLS)).alias("cell")).agg(F.least(F.count(F.lit(1)), F.lit((1 << (63 - BITS)) - 1)).alias("n"))
    found = cells.toArrow().to_pydict()  # at most CELLS rows
    counts = [0] * CELLS
    for cell, n in zip(found["cell"], found["n"], strict=True):
        counts[cell] = n
    return F.from_json(F.lit(str(counts)), "array<bigint>")


def meets(n: str, at: str, m: str, percent: int) -> Column:
    """Whether what a class of n tokens has from place ``at`` on suffices for one of m tokens."""
    return (F.col(n) - F.col(at)) * (100 + percent) >= percent * (F.col(n) + F.col(m))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, with both first places."""
    side = lambda k: sets.select(F.col("id").alias(k), F.col("s").alias(f"s{k}"), F.col("first").alias(f"first_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b", "first_a", "first_b")


def signature(word: int) -> Column:
    """64 of 128 bits, each the parity of the tokens that fall on it; two sets differ in as many tokens as signatures in bits, or more."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(t, 58).cast("int"))
    return F.aggregate("s", F.lit(0).cast("long"), lambda x, t: F.when(t.bitwiseAND(F.lit(1)) == word, x.bitwiseXOR(bit(t))).otherwise(x))


def alike(n: str, sig: str, m: str, other: str, percent: int) -> Column:
    """Whether signatures differ in no more bits than sets of n and m tokens that match may differ in tokens."""
    bits = sum(F.bit_count(F.col(f"{sig}{i}").bitwiseXOR(F.col(f"{other}{i}"))) for i in range(2))
    return bits * (100 + percent) <= (F.col(n) + F.col(m)) * (100 - percent)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def bucket(n: Column, percent: int) -> Column:
    """Sizes whose ratio may be that of sets that match fall into one bucket or into two."""
    return F.floor(F.log(n) / math.log(100 / min(percent, 99))).cast("int")


def class_entries(lines: DataFrame, percent: int) -> DataFrame:
    """A row for each class: id, n, signature, first place, early (its doc_id) and its prefix (key)."""
    cells = rarity(lines)
    order = F.sort_array(F.transform("s", lambda x: F.shiftleft(F.get(cells, F.pmod(x, F.lit(CELLS)).cast("int")), BITS) + x.bitwiseAND(F.lit((1 << BITS) - 1))))
    length = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    rows = lines.select("id", "n", signature(0).alias("sig0"), signature(1).alias("sig1"), F.slice(order, F.lit(1), length.cast("int")).alias("key"), place().alias("first"))
    rows = rows.groupBy("id").agg(*(F.first(c).alias(c) for c in ("n", "sig0", "sig1", "key")), F.min("first").alias("first"))
    return stash(rows.withColumn("early", F.when(F.col("first.known"), F.col("first.doc")).otherwise(F.lit(-(1 << 63)))), "entries", **WORDBOOK)


def later(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """b: of each pair that matches, the class that comes later. Only tokens of lines in a pair are gathered."""
    pairs = stash(pairs, "pairs")
    wanted = stash(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    seen = stamp(wanted)
    sets = []
    for part in range(PARTS):
        own = F.pmod("id", F.lit(PARTS)) == part
        rows = lines.where(own & seen).join(wanted.where(own), "id", "left_semi")
        sets.append(stash(rows.groupBy("id").agg(F.first("s").alias("s"), F.min(place()).alias("first")), "sets"))
    found = verified(pairs, union(sets), percent)
    out = stash(found.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), "later")
    for done in (pairs, wanted, *sets):
        discard(done)
    return out


def stamp(wanted: DataFrame) -> Column:
    """Holds for all wanted ids, and for few others while these are few: a bit for each of a fixed number of cells."""
    cell = F.pmod("id", F.lit(STAMPS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)).cast("int"))
    got = wanted.groupBy(F.shiftright(cell, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_pydict()  # at most STAMPS / 64 rows
    words = [0] * (STAMPS // 64)
    for word, bits in zip(got["word"], got["bits"], strict=True):
        words[word] = bits
    return F.get(F.from_json(F.lit(str(words)), "array<bigint>"), F.shiftright(cell, 6).cast("int")).bitwiseAND(bit) != 0


def earlier_matches(lines: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """b: the classes with a match whose first place is before their own."""

    def near(n: str, at: str, sig: str, m: str, at_m: str, other: str) -> Column:
        return meets(n, at, m, percent) & meets(m, at_m, n, percent) & alike(n, sig, m, other, percent)

    def dealt(e: DataFrame, part: int) -> DataFrame:
        """By parts of the keys, so that shuffles hold one part at a time."""
        return e.select(*(c for c in e.columns if c not in ("key", "first")), F.posexplode("key").alias("at", "key")).where(F.pmod("key", F.lit(PARTS)) == part)

    stars = []
    for part in range(PARTS):
        own = dealt(entries, part)
        # The earliest class of each key, and the one with the most left. No structs, whose minimum would be found by sorting.
        left = F.col("at").cast("long") * (1 << 31) + F.col("n")
        hub = [F.min_by(c, by).alias(f"{k}_{c}") for k, by in (("early", F.col("early")), ("best", left)) for c in ("id", "n", "at", "sig0", "sig1")]
        common = stash(own.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("early").alias("least"), *hub).where("low < high").drop("low", "high"), "common")
        met = own.join(common, "key")
        other = lambda k: F.when((F.col("id") != F.col(f"{k}_id")) & near("n", "at", "sig", f"{k}_n", f"{k}_at", f"{k}_sig"), F.col(f"{k}_id"))
        met = met.select("key", "id", (F.col("at") + F.col("best_at")).alias("o"), other("early").alias("early"), other("best").alias("best"))
        stars.append(stash(met.where("early IS NOT NULL OR best IS NOT NULL"), "members"))
        discard(common)
    ordered = [F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")]
    best = union(stars).where("best IS NOT NULL").groupBy("id").agg(F.min_by("best", "o").alias("a"))
    pairs = best.select(*ordered).union(union(stars).where("early IS NOT NULL").withColumnRenamed("early", "a").select(*ordered))
    gone = later(pairs.distinct(), lines, percent)
    for done in stars:
        discard(done)
    # What stays meets all others. The smaller of two sets only needs a shorter prefix.
    entries = stash(entries.drop("first").join(gone, entries["id"] == gone["b"], "left").withColumn("open", F.col("b").isNull()).drop("b"), "entries", **WORDBOOK)
    short = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    lengths = F.sequence(bucket(F.col("n"), percent), bucket(F.floor(100 * F.col("n") / percent), percent))
    tries = []
    for part in range(PARTS):
        own = dealt(entries, part).withColumn("bucket", bucket(F.col("n"), percent))
        small = dealt(entries.withColumn("key", F.slice("key", F.lit(1), short.cast("int"))), part)
        small = small.select("key", F.explode(lengths).alias("bucket"), *(F.col(c).alias(f"{c}_a") for c in ("id", "n", "at", "early", "open")), *(F.col(f"sig{i}").alias(f"sig_a{i}") for i in range(2)))
        once = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("id_a") < F.col("id")))
        use = (F.col("open") & (F.col("early_a") <= F.col("early"))) | (F.col("open_a") & (F.col("early") <= F.col("early_a")))
        met = own.join(small, ["key", "bucket"]).where(once & use & near("n", "at", "sig", "n_a", "at_a", "sig_a"))
        tries.append(stash(met.withColumnRenamed("id_a", "a").select(*ordered).distinct(), "tries"))
    discard(entries)
    more = later(union(tries).distinct(), lines, percent)
    out = stash(gone.union(more).distinct(), "matched")
    for done in (*tries, gone, more):
        discard(done)
    return out


def removed_lines(docs: DataFrame, percent: int) -> DataFrame:
    """row, nos: the numbers of the lines to remove, in the first of equal rows."""
    lines = stash(split_lines(docs), "lines", **WORDBOOK).where("n > 0")
    entries = class_entries(lines, percent)
    late = earlier_matches(lines, entries, percent)
    known = entries.join(late, entries["id"] == late["b"], "left").select("id", "first", F.col("b").isNotNull().alias("late"))
    gone = lines.select("id", "row", "line_no", place().alias("place")).join(known, "id").where(F.col("late") | (F.col("first") < F.col("place")))
    out = stash(gone.groupBy("row").agg(F.collect_set("line_no").alias("nos")), "removed")
    for done in (lines, entries, late):
        discard(done)
    return out


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_lines, n_removed, text (the lines that stay)."""
    docs = docs.select("doc_id", "text")
    gone = removed_lines(docs, percent)
    # The window numbers whole repeats; it is dealt as the join is.
    out = docs.withColumn("row", row_key()).join(gone, "row", "left").withColumn("copy", F.row_number().over(Window.partitionBy("row").orderBy("row")))
    every = F.split("text", "\n")
    nos = F.coalesce("nos", F.array().cast("array<int>"))
    # Repeats of a whole row lose all lines that have a word.
    kept = F.when(F.col("copy") > 1, F.filter(every, lambda x: ~x.rlike(r"[^\x20\x09-\x0D]"))).otherwise(F.filter(every, lambda x, i: ~F.array_contains(nos, i)))
    return out.select("doc_id", every.alias("every"), kept.alias("kept"), "text").select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("every")).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("every") - F.size("kept")).cast("long").alias("n_removed"),
        F.when(F.col("text").isNotNull(), F.array_join("kept", "\n")).alias("text"),
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
