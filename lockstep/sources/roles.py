"""Binds the star schema's tables to the roles of a change history.

A customer segment is a repository, an order a commit, its customer the author, a supplier (or a part) a file; an
order of status P stands for a replayed commit, and a line's quantity and number for lines added and removed. A
file's path is type/brand/name of the part. Each line is also a version bump of the supplier's nation in the
customer's nation. Events are calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-12-01"
EVENTS_AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their segment; customers are a dimension, whose side Spark broadcasts while it is small."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("committed_at"), "o_orderstatus")
    segment = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("repo"), F.col("c_nationkey").alias("nation"))
    return orders.join(segment, orders.o_custkey == segment.c_custkey)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    rows = _orders(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select("repo", F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author_id"), "committed_at", F.lit(False).alias("is_merge"), (F.col("o_orderstatus") == "P").alias("is_replay"), F.coalesce("n", F.lit(0)).alias("n_files"))


def changes(spark: SparkSession, sf_dir: str, item: str = "l_suppkey") -> DataFrame:
    """One row for each commit and file; lines that repeat a file in one commit are added up, the first tells the type."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col(item).alias("file_id")).agg(F.sum("l_quantity").alias("insertions"), F.sum("l_linenumber").cast("double").alias("deletions"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_returnflag")).alias("change_type"))
    repo = _orders(spark, sf_dir).select("repo", "o_orderkey")
    return lines.join(repo, F.col("l_orderkey") == F.col("o_orderkey")).select("repo", F.col("o_orderkey").alias("commit_id"), "file_id", "insertions", "deletions", "change_type")


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_events(table(spark, sf_dir, "events"))


def of_events(events: DataFrame) -> DataFrame:
    surface = F.when(F.col("event_type").isin("view", "click"), "http").otherwise("mcp")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), surface.alias("surface"), F.col("event_type").alias("name"), status.alias("status"), F.col("value").alias("duration_ms"), F.col("user_id").cast("string").alias("client"))


def bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bump a line: the customer's nation takes a new version of the supplier's."""
    lines = table(spark, sf_dir, "lineitem")
    names = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dep_key"))
    rows = lines.join(_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(names.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("consumer")), "nation")
    rows = rows.join(names.select(F.col("n_nationkey").alias("dep_key"), F.col("n_name").alias("dep")), "dep_key")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "consumer", "dep", F.col("l_shipdate").cast("timestamp").alias("consumer_at"), F.col("committed_at").alias("upstream_at"), F.col("l_partkey").cast("string").alias("version"), "l_quantity", "l_discount", "l_returnflag", "l_orderkey", "l_linenumber")


def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations declare those of the same region with the next larger key as dependencies."""
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(x), F.col("n_regionkey").alias(f"r{x}"), F.col("n_nationkey").alias(f"k{x}")) for x in ("consumer", "dep"))
    return a.join(b, (F.col("rconsumer") == F.col("rdep")) & (F.col("kconsumer") < F.col("kdep"))).select("consumer", "dep", F.lit("nation").alias("manifest"))
