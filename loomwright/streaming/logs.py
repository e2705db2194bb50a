"""A trainer's log as a stream: an append-only folder of JSON lines, of which the latest row is kept up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import TRAINER_LOG
from ..sources.files import latest_log


def read_log_stream(spark: SparkSession, folder: str, schema: str = TRAINER_LOG) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def follow_log(log: DataFrame, checkpoint: str, seen: Callable[[Row], None], every: str = "2 seconds", once: bool = False) -> StreamingQuery:
    """Call ``seen`` with the latest row of each batch that has one; one row at a time goes to the driver."""

    def batch(rows: DataFrame, _: int) -> None:
        last = latest_log(rows).where("current_steps IS NOT NULL").first()
        if last is not None:
            seen(last)

    writer = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def latest_stream(log: DataFrame) -> DataFrame:
    """The latest row as a streaming aggregate (complete or update mode)."""
    return log.groupBy().agg(F.max_by(F.struct(*log.columns), "current_steps").alias("latest")).select("latest.*")


def dataset_stream(spark: SparkSession, folder: str, schema: str, kind: str = "json") -> DataFrame:
    """Files of a folder as they arrive, for datasets that are read once."""
    return spark.readStream.schema(schema).format(kind).load(folder)
