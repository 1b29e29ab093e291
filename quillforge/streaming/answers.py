"""Teacher answers as a stream of files: late and repeated deliveries, windowed counts, and the last state of each item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, status string, answered_at timestamp, batch_idx bigint"


def answers(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """JSON-line files as they arrive, some at a time."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder)


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each delivery of an item's answer once; repeats within the watermark are dropped, so the state stays bounded."""
    return stream.withWatermark("answered_at", delay).dropDuplicatesWithinWatermark(["id", "status", "batch_idx"])


def counts(stream: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Answers by window and status."""
    return stream.withWatermark("answered_at", delay).groupBy(F.window("answered_at", window), "status").agg(F.count("*").alias("answers"))


def into_table(stream: DataFrame, table: str, checkpoint: str):
    """Append every micro-batch to a parquet table, under the batch's number: a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The last status of each item."""
    return table.groupBy("id").agg(F.max_by("status", F.struct("answered_at", "batch_idx", "status")).alias("status"))
