import random

from pyspark.sql import functions as F

from lockstep.operators import trigrams


def test_as_by_contains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "PART_IDS", 40)
    rng = random.Random(2)
    rows = [(k, "/".join("".join(rng.choice("abAé%_") for _ in range(rng.randint(0, 6))) for _ in range(3))) for k in range(300)] + [(900, None), (901, ""), (902, "ab")]
    table, path = spark.createDataFrame(rows, "file_id long, path string"), str(tmp_path / "index")
    trigrams.write_index(table, path)
    for needle in ("aba", "ABA", "a/b", "é%_", "b", "", "aaaaaaaaa", "%", "abab/"):
        got = sorted(r.file_id for r in trigrams.search(table, path, needle).collect())
        assert got == [k for k, text in rows if text is not None and needle.lower() in text.lower()], needle
    assert spark.read.parquet(path).groupBy("gram").count().agg(F.max("count")).first()[0] > 1


def test_only_the_needles_buckets_are_opened(spark, tmp_path):
    path = str(tmp_path / "index")
    trigrams.write_index(spark.range(500).select(F.col("id").alias("file_id"), F.format_string("src/%d/core.go", F.col("id") * 7919).alias("path")), path)
    found = trigrams.postings_of(spark, path, "CORE.go")
    opened = {r[0].split("bucket=")[1].split("/")[0] for r in found.select(F.input_file_name()).distinct().collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(opened) <= 5 and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
