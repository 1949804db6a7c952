"""Substring search by a stored index of trigrams: only postings of the needle's own trigrams are read, then verified.

A posting is (gram, part, ids): the rows that hold a trigram, in parts by their id, so that a common trigram is many bounded rows.
The table is partitioned by a hash of the gram; a search names the buckets of its grams, so that others are not opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Ids of one posting row, on average, for a gram that every row has.
PART_IDS = 50_000

_SCHEMA = "gram string, part long, ids array<long>, bucket int"


def grams(text: Column) -> Column:
    """The distinct stretches of three characters of a text in lower case; none of a shorter text."""
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, path: str, text: str = "path", key: str = "file_id") -> None:
    """Stores the postings of rows (key, text), key a distinct long. Null and short texts have none."""
    parts = max(1, rows.count() // PART_IDS)
    postings = rows.select(F.col(key).cast("long").alias("id"), F.explode(grams(F.col(text))).alias("gram")).where("id is not null")
    postings = postings.groupBy("gram", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    postings.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def postings_of(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The stored postings of a needle's trigrams; its buckets are named in the plan."""
    low = needle.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    names = spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket")).collect()
    return spark.read.schema(_SCHEMA).parquet(path).where(F.col("bucket").isin(*{r.bucket for r in names}) & F.col("gram").isin(*wanted))


def search(rows: DataFrame, path: str, needle: str, text: str = "path", key: str = "file_id") -> DataFrame:
    """The rows whose text holds needle, whatever the case, by the index stored at path.

    A row is a candidate if it is in the postings of every trigram of the needle; candidates are then compared. A needle of
    fewer than three characters has no trigram and is looked for in all rows.
    """
    low = needle.lower()
    holds = F.contains(F.lower(F.col(text)), F.lit(low))
    if len(low) < 3:
        return rows.where(holds)
    found = postings_of(rows.sparkSession, path, needle)
    n = len({low[i : i + 3] for i in range(len(low) - 2)})
    ids = found.select("gram", F.explode("ids").alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).select("_id")
    return rows.join(ids, F.col(key) == F.col("_id"), "left_semi").where(holds)
