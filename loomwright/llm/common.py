"""Shared helpers: words, the shared folder, tables that cut lineage."""

from __future__ import annotations

import pickle
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space and the ASCII controls 9 to 13.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one under /tmp/checkpoints only where it is unset."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/loomwright-{what}-{uuid.uuid4().hex}"


def stash(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and outlives executors.

    Shuffle files behind the written table are of no more use and go at once. Options are those of the writer.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def put_object(spark: SparkSession, what) -> str:
    """Write to the shared folder once; in a closure each executor would store it."""
    path = fresh_path(spark, "object")
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        pickle.dump(what, out, protocol=5)
    return path


def get_object(path: str):
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at) as f:
        return pickle.loads(f.read())


def remove_object(path: str) -> None:
    store, at = fs.FileSystem.from_uri(path)
    store.delete_file(at)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Few rows in each Arrow batch, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
