"""The largest ordinal below a bound among what was there by a time: two bounds at once, for keys of any size.

A key's points are numbered by their ordinals; a request's bound becomes a number too, that of the points below it. What is
asked for is then the last point before that number whose time is not later than the request's. Over the points stands a
tree of WIDTH children a node, whose nodes hold the earliest times of their children; it has a level for each factor of
WIDTH, and one row for each node. A request climbs until it meets a node, before its own place, that is early enough, and
descends in it to the last early point: at each step it is joined with one node, so that requests and points are never
repeated, however many of them share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.steps import discard, step
from .running import running

WIDTH = 64


def _levels(points: DataFrame) -> list[DataFrame]:
    """For each level the rows (key, node, times): the earliest time in each child of a node, in order."""
    out, below = [], points.select("key", F.col("r").alias("place"), F.col("at").alias("time"))
    while True:
        rows = below.groupBy("key", F.floor(F.col("place") / WIDTH).alias("node")).agg(F.sort_array(F.collect_list(F.struct("place", "time"))).alias("_c"))
        out.append(step(rows.select("key", "node", F.transform("_c", lambda c: c["time"]).alias("times")), f"level-{len(out)}"))
        if out[-1].where("node > 0").isEmpty():
            return out
        below = out[-1].select("key", F.col("node").alias("place"), F.array_min("times").alias("time"))


def _last(until: Column) -> Column:
    """The last child before until whose earliest time is not after at."""
    return F.array_max(F.transform("times", lambda t, j: F.when((j < until) & (t <= F.col("at")), j)))


def latest_below(requests: DataFrame, points: DataFrame) -> DataFrame:
    """requests (id, key, at, below, ...) with ordinal: the largest one below `below` of the points (key, ordinal, at) not after at.

    Null without such a point and for a request of which key, at or below is null; points with a null count for nothing. Repeated
    points count once; ids may repeat. Ordinals may be of any type that has an order, times of any numeric or time type.
    """
    given = step(requests.withColumn("_id", F.monotonically_increasing_id()), "requests")
    points = points.where("key is not null and ordinal is not null and at is not null").groupBy("key", "ordinal").agg(F.min("at").alias("at"))
    asked = given.where("key is not null and at is not null and below is not null")
    both = points.select("key", F.col("ordinal").alias("value"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("_id"), "at")
    both = both.unionByName(asked.select("key", F.col("below").alias("value"), F.lit(0).alias("kind"), "_id", "at"))
    # ranges of (key, value) instead of keys: one key may hold most of the rows
    ranges = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = step(both.repartitionByRange(ranges, "key", "value", "kind").withColumn("_range", F.spark_partition_id()), "order")
    both = step(running(placed, ["key"], F.col("_range"), ["value", "kind"], F.col("kind"), "r"), "numbers")
    discard(placed)
    points = both.where("kind = 1").select("key", "value", "at", "r")
    levels = _levels(points)

    node = lambda k: levels[k].withColumnRenamed("node", "_node")
    climbs, met, climbing = [], [], both.where("kind = 0").select("_id", "key", "at", F.col("r").alias("place"))
    for k in range(len(levels)):
        rows = climbing.withColumn("_node", F.floor(F.col("place") / WIDTH)).join(node(k), ["key", "_node"], "left")
        rows = step(rows.select("_id", "key", "at", "_node", _last(F.pmod("place", F.lit(WIDTH))).alias("_child")), "climb")
        climbs.append(rows)
        met.append(rows.where("_child is not null").select("_id", "key", "at", (F.col("_node") * WIDTH + F.col("_child")).alias("place")))
        climbing = rows.where("_child is null").select("_id", "key", "at", F.col("_node").alias("place"))
    found = met[-1]
    for k in range(len(levels) - 2, -1, -1):
        down = found.withColumnRenamed("place", "_node").join(node(k), ["key", "_node"])
        found = down.select("_id", "key", "at", (F.col("_node") * WIDTH + _last(F.lit(WIDTH))).alias("place")).unionByName(met[k])
    found = step(found.join(points.select("key", F.col("r").alias("place"), F.col("value").alias("ordinal")), ["key", "place"]).select("_id", "ordinal"), "found")
    for table in (both, *levels, *climbs):
        discard(table)
    return given.join(found, "_id", "left").drop("_id")
