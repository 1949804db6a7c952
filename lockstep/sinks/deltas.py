"""Pair counts, margins and populations kept up to date by signed changes: commits that came count +1, those that went -1.

The stored baskets tell what a commit that went had counted for. A batch of changes touches the repositories of its commits, and of
pairs and margins the buckets of its items; only these partitions are read and written. A batch is first worked out into
steps, then noted as due, then copied into the tables partition by partition, and then forgotten; whatever fails in between,
the next call first finishes what is due, and copying twice gives the same, so that a batch counts once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coupling import basket_pairs
from ..schemas import MIN_PAIR_SUPPORT
from .steps import step
from .tables import reset, stored

BUCKETS = 16
#: Partitions that a batch names one by one; a batch of more reads the whole table, with the same result.
NAMED = 2000

BASKETS = "commit_id long, committed_at timestamp, author_id long, items array<long>, repo string, bucket int"
_TABLES = {
    "pairs": ("a", ["a", "b"], "n_ab", "a long, b long, n_ab long, repo string, bucket int"),
    "margins": ("file_id", ["file_id"], "pair_change_count", "file_id long, pair_change_count long, repo string, bucket int"),
    "population": ("repo", [], "n_total", "n_total long, repo string, bucket int"),
}


def _bucket(key: str) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _touched(table: DataFrame, delta: DataFrame) -> DataFrame:
    """The partitions of a stored table that delta (repo, bucket) names."""
    names = delta.select("repo", "bucket").distinct().limit(NAMED + 1).collect()
    if len(names) > NAMED:
        return table.join(delta.select("repo", "bucket").distinct(), ["repo", "bucket"], "left_semi")
    chosen = F.lit(False)
    for repo in {r.repo for r in names}:
        chosen = chosen | ((F.col("repo") == repo) & F.col("bucket").isin(*[r.bucket for r in names if r.repo == repo]))
    return table.where(chosen)


def _write(rows: DataFrame, path: str) -> None:
    rows.repartition("repo", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "bucket").parquet(path)


def _delta(signed: DataFrame, name: str) -> DataFrame:
    """The changes of one table's counts, from signed baskets."""
    key, columns, count, _ = _TABLES[name]
    if name == "pairs":
        sign = signed.select("repo", "commit_id", "sign")
        rows = basket_pairs(signed).join(sign, ["repo", "commit_id"])
    else:
        rows = signed.select("repo", "sign", F.explode("items").alias("file_id")) if columns else signed
    return rows.groupBy("repo", *columns).agg(F.sum("sign").alias(count)).withColumn("bucket", _bucket(key))


def _due(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, f"{folder}/due", "name string, path string, batch string")


def finish(spark: SparkSession, folder: str) -> None:
    """Copies what is due of an earlier call into the tables."""
    due = _due(spark, folder).collect()
    for row in due:
        schema = BASKETS if row.name == "baskets" else _TABLES[row.name][3]
        _write(spark.read.schema(schema).parquet(row.path), f"{folder}/{row.name}")
    reset(spark, [f"{folder}/due", *(row.path for row in due)])


def prepare(spark: SparkSession, folder: str, came: DataFrame, gone: DataFrame) -> bool:
    """Works out a batch and notes it as due; False if it changes nothing."""
    tables = f"{folder}/baskets"
    new = came.select("repo", "commit_id", "committed_at", "author_id", "items").dropDuplicates(["repo", "commit_id"]).withColumn("bucket", _bucket("commit_id"))
    lost = gone.select("repo", "commit_id").distinct().withColumn("bucket", _bucket("commit_id"))
    new = new.join(lost, ["repo", "commit_id"], "left_anti")
    old = stored(spark, tables, BASKETS)
    held = _touched(old, step(new.select("repo", "bucket").unionByName(lost.select("repo", "bucket")), "named"))
    columns = ["repo", "bucket", "commit_id", "committed_at", "author_id", "items"]
    added = new.join(held.select("repo", "commit_id"), ["repo", "commit_id"], "left_anti").select(*columns).withColumn("sign", F.lit(1))
    removed = held.join(lost, ["repo", "bucket", "commit_id"], "left_semi").select(*columns).withColumn("sign", F.lit(-1))
    signed = step(added.unionByName(removed), "signed")
    if signed.isEmpty():
        return False
    base, due = f"{folder}/steps/{uuid.uuid4().hex}", []
    for name, (_, keys, count, schema) in _TABLES.items():
        delta = step(_delta(signed, name), "delta")
        before = _touched(stored(spark, f"{folder}/{name}", schema), delta).where(F.col(count) > 0)
        # a count that falls to 0 stays as 0 until its partition is next written, so that no partition is left without a row
        rows = before.unionByName(delta.select(*before.columns)).groupBy("repo", "bucket", *keys).agg(F.sum(count).alias(count))
        _write(rows, f"{base}/{name}")
        due.append((name, f"{base}/{name}", base))
    kept = held.join(signed.where("sign < 0"), ["repo", "bucket", "commit_id"], "left_anti").select(*columns).unionByName(signed.where("sign > 0").drop("sign"))
    emptied = signed.select("repo", "bucket").distinct().join(kept.select("repo", "bucket").distinct(), ["repo", "bucket"], "left_anti")
    nothing = emptied.select("repo", "bucket", F.lit(None).cast("long").alias("commit_id"), F.lit(None).cast("timestamp").alias("committed_at"), F.lit(None).cast("long").alias("author_id"), F.array().cast("array<long>").alias("items"))
    _write(_touched(kept.unionByName(nothing), signed).where("commit_id is not null or size(items) = 0"), f"{base}/baskets")
    due.append(("baskets", f"{base}/baskets", base))
    spark.createDataFrame(due, "name string, path string, batch string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/due")
    return True


def apply_changes(spark: SparkSession, folder: str, came: DataFrame, gone: DataFrame) -> bool:
    """Counts the baskets that came (repo, commit_id, committed_at, author_id, items) and takes back commits that went (repo, commit_id).

    What is stored already doesn't count again, and what isn't can't be taken back, so a batch may be given twice. A commit in
    both went. True if anything changed.
    """
    finish(spark, folder)
    changed = prepare(spark, folder, came, gone)
    finish(spark, folder)
    return changed


def counts(spark: SparkSession, folder: str, name: str, least: int = 1) -> DataFrame:
    """A table's counts of least and more: pairs, margins or population."""
    _, keys, count, schema = _TABLES[name]
    return stored(spark, f"{folder}/{name}", schema).where(F.col(count) >= max(least, 1)).select("repo", *keys, count)


def pair_counts(spark: SparkSession, folder: str, min_support: int = MIN_PAIR_SUPPORT) -> DataFrame:
    return counts(spark, folder, "pairs", min_support)
