"""A training-data pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import common, decontaminate, jaccard, mixing, quality, tokens


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.apply_rules(docs).where("kept").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one with the least doc_id. Empty texts are no copies.

    Rows are told apart by doc_id and text, so null and repeated ids with other texts stay; a null id counts as the greatest.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    worded = F.coalesce(F.col("text").rlike(common.WORD), F.lit(False))
    classes = jaccard.join_classes(keyed.where(worded).select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least")
    first = keyed.where(worded).select("_row", "doc_id").join(classes, "_row").groupBy("component_id").agg(least).select("least._row")
    kept = keyed.where(worded).join(first, "_row", "left_semi").dropDuplicates(["_row"])
    return kept.select(*docs.columns).union(docs.where(~worded))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).where("NOT contaminated").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents, as many as bring each source to its weight."""
    return mixing.mix(docs).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files; a row for each document read back from them."""
    return tokens.encode_to_files(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token files", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: Tokens, alignments and components are not expressible; the stages are tested against brute force.
ORACLE_SQL = None
