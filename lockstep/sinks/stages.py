"""Stages with stored state: each knows the content that it last saw of its inputs and rebuilds only what a change can alter.

For every stage and input the table `meta` holds a fingerprint by repository. A run compares them with the inputs as they are;
where none differs the stage does no work. Else it is built for the repositories that differ, or for those that its own rule
names as affected, and only their partitions are replaced. The fingerprints are stored after the table, so that a run that
fails in between does its work again, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .steps import discard, step
from .tables import replace, reset, stored

_META = "input string, repo string, n long, print long, total long, stage string"
_PRINT = ["n", "print", "total"]


class Stage(NamedTuple):
    """build gives the stage's rows (repo, ...) of its inputs for the repositories (repo) given; affected names those to build
    for a change of the repositories (repo) given, which are the same if it is None."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[[dict[str, DataFrame], DataFrame], DataFrame]
    affected: Callable[[dict[str, DataFrame], DataFrame], DataFrame] | None = None


def fingerprints(rows: DataFrame, name: str) -> DataFrame:
    """(input, repo, n, print, total): what tells the content of each repository, in whatever order; repeated rows count."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    found = rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("print"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"))
    return found.select(F.lit(name).alias("input"), "repo", *_PRINT)


def _restrict(rows: DataFrame, repos: DataFrame) -> DataFrame:
    return rows.join(repos.select("repo"), "repo", "left_semi")


def _differing(now: DataFrame, before: DataFrame) -> DataFrame:
    same = now.select("input", "repo", *_PRINT).intersect(before.select("input", "repo", *_PRINT))
    every = now.select("input", "repo").unionByName(before.select("input", "repo"))
    return every.join(same.select("input", "repo"), ["input", "repo"], "left_anti").select("repo").distinct()


def run_stages(spark: SparkSession, folder: str, stages: list[Stage], tables: dict[str, DataFrame]) -> dict[str, int]:
    """Brings all stages below folder up to date with tables, in order; a stage is an input of later ones by its name.

    Gives for each stage how many repositories were rebuilt. Inputs have a column repo, not null. A repository that is no more in any
    input is taken out of the stage.
    """
    done, tables = {}, dict(tables)
    for stage in stages:
        inputs, path = {name: tables[name] for name in stage.inputs}, f"{folder}/{stage.name}"
        prints = [fingerprints(rows, name) for name, rows in inputs.items()]
        now = prints[0]
        for more in prints[1:]:
            now = now.unionByName(more)
        now = step(now, "prints")
        before = stored(spark, f"{folder}/meta", _META).where(F.col("stage") == stage.name)
        changed = step(_differing(now, before), "changed")
        if not changed.isEmpty():
            repos = changed if stage.affected is None else step(stage.affected(inputs, changed).select("repo").distinct(), "affected")
            rows = step(_restrict(stage.build(inputs, repos), repos), stage.name)
            names = [r.repo for r in repos.collect()]  # names of repositories that changed
            left = {r.repo for r in rows.select("repo").distinct().collect()}
            replace(rows, path)
            reset(spark, [_partition(spark, path, name) for name in names if name not in left])
            replace(now.withColumn("stage", F.lit(stage.name)), f"{folder}/meta", "stage")
            done[stage.name], schema = len(names), rows.schema
            discard(rows)
            tables[stage.name] = spark.read.schema(schema).parquet(path)
        else:
            done[stage.name] = 0
            tables[stage.name] = spark.read.parquet(path)
    return done


def _partition(spark: SparkSession, path: str, repo: str) -> str:
    """The folder of a repository's partition, its name escaped as Spark does."""
    return f"{path}/repo={spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(repo)}"
