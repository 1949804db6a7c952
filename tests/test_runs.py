import datetime as dt

from pyspark.sql import functions as F

from lockstep.streaming.runs import expired_calls, idle_runs

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def events(*rows):
    return [(k, key, START + dt.timedelta(minutes=m)) for k, key, m in rows]


def batches(spark, tmp_path, make, parts):
    """What the stream gives when each part comes as a file of its own, one a batch."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "id long, run string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/p{k}")
    rows = spark.readStream.schema("id long, run string, at timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))
    found = make(rows)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.schema(found.schema).parquet(out)


def minute(ms):
    return round((ms / 1000 - START.timestamp()) / 60)


def test_runs_that_fall_silent(spark, tmp_path):
    """Timers fire where nothing more comes; a silence inside a batch and one between batches end a run too."""
    parts = [
        events((1, "a", 0), (2, "a", 100), (3, "a", 90), (4, "b", 5), (5, "c", 0), (6, "c", 200)),
        events((7, "a", 150), (8, "b", 300), (9, None, 300)),
        events((10, "d", 600)),
    ]
    got = batches(spark, tmp_path, lambda rows: idle_runs(rows, "run", 120, "10 minutes"), parts)
    assert sorted((r.id or "", minute(r.last_ms), r.beats) for r in got.collect()) == [("", 300, 1), ("a", 150, 4), ("b", 5, 1), ("b", 300, 1), ("c", 0, 1), ("c", 200, 1)]


def test_calls_out_of_retention(spark, tmp_path):
    day = 1440
    parts = [events((1, "a", 0), (2, "a", 10), (3, "b", day + 5)), events((4, "a", 3 * day), (5, None, 10)), events((6, "b", 6 * day + 200))]
    got = batches(spark, tmp_path, lambda rows: expired_calls(rows, "run", 2, "10 minutes").withColumn("day", F.col("expired_ms") / 86_400_000), parts)
    found = {r.id: minute(r.expired_ms) // day for r in got.collect()}
    # 5 comes late, but before its own end; 6 is kept
    assert found == {1: 2, 2: 3, 3: 4, 4: 5, 5: 3}
