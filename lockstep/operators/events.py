"""Call-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import KEEP_DAYS, KEEP_ROWS
from .coupling import as_of_epoch, epoch


def since(calls: DataFrame, as_of: str, hours: int) -> DataFrame:
    return calls.where(epoch("at") >= as_of_epoch(as_of) - hours * 3600)


def _percentile(p: float):
    value = F.percentile("duration_ms", p)
    return F.when(F.count("duration_ms") > 1, F.round(value, 1)).otherwise(F.min("duration_ms"))


def summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("surface", "status").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("client").alias("clients"), _percentile(0.5).alias("p50"), _percentile(0.95).alias("p95"), F.max(epoch("at")).alias("last_at"))


def by_name(calls: DataFrame, limit: int = 50) -> DataFrame:
    rows = calls.groupBy("surface", "name").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.avg("duration_ms"), 1).alias("avg_ms"))
    return rows.orderBy(F.desc("calls"), "surface", "name").limit(limit)


def timeline(calls: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Counts by hour, 1 to 168 hours up to that of as_of, hours without calls as 0."""
    hours = max(1, min(hours, 168))
    last = (as_of_epoch(as_of) / 3600).cast("long")
    spine = calls.sparkSession.range(hours).select((last - F.col("id")).alias("hour"))
    seen = calls.groupBy((epoch("at") / 3600).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"))
    return spine.join(seen, "hour", "left").select((F.col("hour") * 3600).alias("hour_start"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("errors", F.lit(0)).alias("errors"))


def recent(calls: DataFrame, limit: int = 100) -> DataFrame:
    return calls.orderBy(F.desc("at"), F.desc("id")).limit(limit)


def pruned(calls: DataFrame, as_of: str, keep_days: int = KEEP_DAYS, keep_rows: int = KEEP_ROWS) -> DataFrame:
    """What retention keeps: calls of the last keep_days that are no older than the keep_rows-th newest by id.

    The threshold is the least of the keep_rows largest ids, a top-k of one column, so that no task ranks all rows.
    """
    fresh = calls.where(epoch("at") >= as_of_epoch(as_of) - keep_days * 86400)
    least = calls.select("id").orderBy(F.desc("id")).limit(keep_rows).agg(F.min("id").alias("least"))
    return fresh.join(F.broadcast(least), F.col("id") >= F.col("least")).drop("least")  # one row


def sessions(calls: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    before = F.lag(epoch("at")).over(Window.partitionBy("client").orderBy("at", "id"))
    rows = calls.withColumn("starts", F.when(before.isNull() | (epoch("at") - before > gap_seconds), 1).otherwise(0))
    return rows.groupBy("client").agg(F.sum("starts").alias("sessions"), F.count(F.lit(1)).alias("calls"))
