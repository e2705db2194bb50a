"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate; a hash of seed and doc_id, read as a uniform number, inverts the
Poisson distribution with that mean; each document is exploded by its count and all copies are dealt
out and ordered by a hash.

The rates keep the total number of characters and give each source its share: rate = weight * all / own.
Without weights all sources weigh the same. Null sources are one source of their own; null texts have no
characters; sources without characters have rate 0; repeated rows of one doc_id get the same count. Other
columns pass through; ``copy``, ``rate`` and ``shuffle_key`` of the input are replaced. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, table

#: One hash inverts a mean of at most this; a larger mean is a sum of equal parts with a hash each.
PART = 32
#: Terms of the distribution that are looked at for one part; the mass beyond is far below 2**-32.
TERMS = 160


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 32 bits, the same in Spark and in SQL engines with md5."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def poisson_part(u: Column, rate: Column) -> Column:
    """How many of the cumulated probabilities are at most u, by adding up terms."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("total"), F.lit(0).alias("k"))

    def step(acc, k):
        term = acc["term"] * rate / k
        return F.when(acc["total"] <= u, F.struct(term.alias("term"), (acc["total"] + term).alias("total"), k.cast("int").alias("k"))).otherwise(acc)

    # Past the mean by many deviations the sum is 1 but for rounding; the walk is short for small means.
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(TERMS), F.ceil(rate * 4).cast("int") + 24)), start, step)["k"]


def poisson_count(seed: str, key: Column, rate: Column) -> Column:
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    first = poisson_part(uniform(seed, key), rate / parts)
    more = F.aggregate(F.sequence(F.lit(1), parts - 1), F.lit(0), lambda acc, i: acc + poisson_part(uniform(seed, key, i), rate / parts))
    return F.when(rate > 0, F.when(parts > 1, first + more).otherwise(first)).otherwise(0)


def rates(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """source, rate: one row for each source."""
    own = docs.groupBy("source").agg(F.sum(F.length("text")).alias("own"))
    total = own.agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.lit(1.0) / F.col("n")
    else:
        whole = float(sum(weights.values()))
        weight = F.coalesce(*[F.when(F.col("source") == k, F.lit(v / whole)) for k, v in weights.items()], F.lit(0.0))
    return own.join(F.broadcast(total)).select("source", F.when(F.col("own") > 0, weight * F.col("total") / F.col("own")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict | None = None, seed: str = "mix") -> DataFrame:
    """The documents with ``copy`` (from 0), ``rate`` and ``shuffle_key``, in the order of the key."""
    docs = docs.drop("copy", "rate", "shuffle_key")
    by = rates(docs, weights).withColumnRenamed("source", "_source")
    out = docs.join(by, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    n = poisson_count(seed, F.col("doc_id"), F.col("rate"))
    out = out.withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    out = out.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col("doc_id").cast("string"), F.col("copy").cast("string")).cast("binary")))
    return out.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def op1(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "text", "copy", "shuffle_key")


SQL = r"""
WITH RECURSIVE own AS (SELECT source, sum(length(text)) AS own FROM documents GROUP BY source),
r AS (SELECT source, coalesce(CASE WHEN own > 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM own) * (SELECT sum(own) FROM own) / own END, 0) AS rate FROM own),
p AS (SELECT source, greatest(CAST(ceil(rate / 32) AS INTEGER), 1) AS parts, rate / greatest(CAST(ceil(rate / 32) AS INTEGER), 1) AS rate FROM r WHERE rate > 0),
cdf AS (SELECT source, parts, rate, 0 AS k, exp(-rate) AS term, exp(-rate) AS total FROM p
  UNION ALL SELECT source, parts, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) FROM cdf WHERE k < least(160, ceil(rate * 4) + 24)),
u AS (SELECT doc_id, d.source, text, i, p.rate, ('0x' || substr(md5('mix:' || doc_id || CASE WHEN i > 0 THEN ':' || i ELSE '' END), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(p.parts)) AS i)),
n AS (SELECT doc_id, u.source, text, count(*) FILTER (cdf.total <= u.u) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source
  AND cdf.k < least(160, ceil(cdf.rate * 4) + 24) GROUP BY ALL),
c AS (SELECT doc_id, source, text, unnest(range(n)) AS copy FROM n)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, md5('mix:order:' || doc_id || ':' || copy) AS shuffle_key FROM c
"""
