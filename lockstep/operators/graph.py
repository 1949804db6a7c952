"""Dependency bumps, impact edges, chains, as-of and prefix joins, cross-repository pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import MAX_FILES_PER_SIDE, MAX_PAIRS_PER_BUMP
from .coupling import as_of_epoch, epoch
from .dominance import latest_below


def resolved(bumps: DataFrame) -> DataFrame:
    """Adds possible and adoption_seconds: a bump whose upstream is later than its consumer is impossible."""
    possible = F.col("upstream_at") <= F.col("consumer_at")
    return bumps.withColumns({"possible": possible, "adoption_seconds": F.when(possible, epoch("consumer_at") - epoch("upstream_at"))})


def edge_scores(declared: DataFrame, bumps: DataFrame, as_of: str) -> DataFrame:
    """(source, target, is_declared, bump_count, median_days, score, rank): source publishes, target consumes."""
    told = declared.select(F.col("dep").alias("source"), F.col("consumer").alias("target")).distinct().withColumn("is_declared", F.lit(True))
    seen = resolved(bumps).groupBy(F.col("dep").alias("source"), F.col("consumer").alias("target")).agg(F.count(F.lit(1)).alias("bump_count"), F.percentile(F.col("adoption_seconds") / 86400.0, 0.5).alias("median_days"), F.max("consumer_at").alias("last_at"))
    rows = told.join(seen, ["source", "target"], "full").where("source <> target").fillna(0, ["bump_count"]).fillna(False, ["is_declared"])
    age = as_of_epoch(as_of) - epoch("last_at")
    recency = F.when(age < 90 * 86400, 0.2).when(age < 365 * 86400, 0.1).otherwise(0.0)
    score = F.least(F.lit(1.0), F.when(F.col("is_declared"), 0.5).otherwise(0.2) + F.least(F.lit(0.3), F.col("bump_count") * 0.02) + recency)
    rows = rows.withColumn("score", F.round(score, 6))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target")))


def chains(edges: DataFrame, start: str, max_depth: int = 3, min_score: float = 0.5, limit: int = 40) -> DataFrame:
    """Simple paths of 2 to max_depth edges from start: one join a hop; only paths that still grow are kept."""
    edges = edges.where(F.col("score") >= min_score).select("source", "target", "score")
    step = edges.where(F.col("source") == start).select(F.array("source", "target").alias("path"), F.col("score").alias("path_score"))
    found = None
    for _ in range(max(1, min(max_depth, 5)) - 1):
        step = step.join(edges, F.element_at("path", -1) == F.col("source")).where(~F.array_contains("path", F.col("target")))
        step = step.select(F.concat("path", F.array("target")).alias("path"), (F.col("path_score") * F.col("score")).alias("path_score"))
        found = step if found is None else found.unionByName(step)
    out = found.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("depth"), F.round("path_score", 4).alias("path_score"))
    return out.orderBy(F.desc("path_score"), "depth", "path").limit(limit)


def upstream(edges: DataFrame) -> DataFrame:
    """The edges turned round, for walks from consumers to publishers."""
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "score")


def asof_ceiling(requests: DataFrame, releases: DataFrame) -> DataFrame:
    """Requests (id, key, at, below) with the largest ordinal below the bound of the releases (key, ordinal, tagged_at) at or before at."""
    points = releases.select("key", "ordinal", F.col("tagged_at").alias("at"))
    return latest_below(requests.select("id", "key", "at", "below"), points)


def unique_match(requests: DataFrame, tags: DataFrame) -> DataFrame:
    """Requests (id, key, version) with the target of tags (key, version, target) where the version names just one."""
    one = tags.groupBy("key", "version").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")
    return requests.join(one, ["key", "version"], "left")


def prefix_match(requests: DataFrame, commits: DataFrame, width: int = 12) -> DataFrame:
    """Requests (id, prefix) with the smallest sha of commits that starts with it; joined on the first width characters."""
    rows = requests.join(commits.withColumn("head", F.substring("sha", 1, width)), F.substring("prefix", 1, width) == F.col("head")).where(F.col("sha").startswith(F.col("prefix")))
    return requests.join(rows.groupBy("id").agg(F.min("sha").alias("sha")), "id", "left")


def owning_module(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(file_id, module): the longest module that is the path or a directory above it, as an equi-join on ancestors."""
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    rows = files.select("file_id", F.explode(above).alias("module")).join(modules.select("module").distinct(), "module")
    return rows.groupBy("file_id").agg(F.max_by("module", F.length("module")).alias("module"))


def cross_pairs(bumps: DataFrame, upstream_files: DataFrame, consumer_files: DataFrame, per_side: int = MAX_FILES_PER_SIDE, most: int = MAX_PAIRS_PER_BUMP) -> DataFrame:
    """(upstream_file, consumer_file, n_bumps, first_at, last_at, version) over bumps (id, at, version).

    Files are (id, file_id), the smallest per_side of a bump's side; bumps with more than most pairs are left out.
    """
    side = lambda rows, name: rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("file_id")), 1, per_side).alias(name))
    rows = bumps.join(side(upstream_files, "up"), "id").join(side(consumer_files, "down"), "id").where(F.size("up") * F.size("down") <= most)
    rows = rows.select("id", "at", "version", F.explode("up").alias("upstream_file"), "down").select("*", F.explode("down").alias("consumer_file"))
    return rows.groupBy("upstream_file", "consumer_file").agg(F.count_distinct("id").alias("n_bumps"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max_by("version", F.struct("at", "id")).alias("version"))
