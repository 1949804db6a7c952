"""The call log as a stream: hourly counts with a watermark, and an append sink by micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.roles import of_events

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_calls(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return of_events(rows)


def hourly(calls: DataFrame, late: str = "2 hours") -> DataFrame:
    windows = calls.withWatermark("at", late).groupBy(F.window("at", "1 hour"), "surface").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"))
    return windows.select(F.unix_timestamp("window.start").alias("hour_start"), "surface", "calls", "errors")


def append(calls: DataFrame, path: str, checkpoint: str):
    """Appends the stream to a table partitioned by micro-batch and day; restarts go on from the checkpoint.

    A batch that is tried again overwrites its own partitions, so that no call is stored twice. The queue is the source: what is
    not taken yet waits there (maxFilesPerTrigger bounds a batch), and nothing is dropped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumns({"batch": F.lit(batch_id), "day": F.to_date("at")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path)

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_bounded(calls: DataFrame, path: str, checkpoint: str, size: Column, most: int):
    """As append(), of the calls whose size is at most `most`; what is dropped is counted by batch in the table path-admission.

    The counts are observed metrics of the very write that stores a batch, so that they cost no second reading of it: (batch, seen,
    dropped). A null size counts as 0. Batches that are tried again replace their counts too.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        told = Observation(f"admission-{batch_id}")
        over = F.coalesce(size, F.lit(0)) > most
        rows = batch.observe(told, F.count(F.lit(1)).alias("seen"), F.count_if(over).alias("dropped")).where(~over)
        rows = rows.withColumns({"batch": F.lit(batch_id), "day": F.to_date("at")})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(path)
        counts = batch.sparkSession.createDataFrame([(told.get["seen"], told.get["dropped"], batch_id)], "seen long, dropped long, batch long")
        counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}-admission")

    return calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
