"""Statistics of clusters and ranked views of drift and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_stats(labels: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, file_id, cluster_id, cluster_size, cohesion, dirs_spanned) of clusters of two files or more.

    labels: (repo, node, label); edges: (repo, a, b, weight); files: (file_id, path). cluster_id counts labels in their order
    within the repository, cohesion is the share of a node's weight that stays in its cluster, dirs_spanned counts top directories.
    """
    known = labels.select("repo", "label").distinct().withColumn("cluster_id", F.row_number().over(Window.partitionBy("repo").orderBy("label")) - 1)
    both = edges.select("repo", F.col("a").alias("node"), F.col("b").alias("peer"), "weight").unionByName(edges.select("repo", F.col("b").alias("node"), F.col("a").alias("peer"), "weight"))
    of = lambda node, label: labels.select("repo", F.col("node").alias(node), F.col("label").alias(label))
    inside = F.sum(F.when(F.col("label") == F.col("peer_label"), F.col("weight")).otherwise(0.0))
    cohesion = both.join(of("node", "label"), ["repo", "node"]).join(of("peer", "peer_label"), ["repo", "peer"]).groupBy("repo", "node").agg((inside / F.sum("weight")).alias("cohesion"))
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    rows = labels.join(files.select(F.col("file_id").alias("node"), top.alias("top")), "node", "left").withColumn("top", F.coalesce("top", F.lit("")))
    sizes = rows.groupBy("repo", "label").agg(F.count(F.lit(1)).alias("cluster_size"), F.count_distinct("top").alias("dirs_spanned")).where("cluster_size >= 2")
    out = labels.join(sizes, ["repo", "label"]).join(known, ["repo", "label"]).join(cohesion, ["repo", "node"], "left")
    return out.select("repo", F.col("node").alias("file_id"), "cluster_id", "cluster_size", F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "dirs_spanned")


def cross_directory_modules(clusters: DataFrame, files: DataFrame, limit: int = 20, least: int = 3, samples: int = 6) -> DataFrame:
    """Clusters of at least `least` files over several top directories, largest first, with their most changed files.

    files: (repo, file_id, path, change_count). Only the samples most changed files of a cluster are gathered.
    """
    rows = clusters.where((F.col("dirs_spanned") > 1) & (F.col("cluster_size") >= least)).join(files.select("repo", "file_id", "path", "change_count"), ["repo", "file_id"])
    top = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1)).otherwise("")
    key = ["repo", "cluster_id", "cluster_size", "dirs_spanned"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("change_count"), "file_id"))
    best = rows.withColumn("place", place).where(F.col("place") <= samples).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("best"))
    told = rows.groupBy(*key).agg(F.round(F.avg(F.coalesce("cohesion", F.lit(0.0))), 3).alias("avg_cohesion"), F.sort_array(F.collect_set(top)).alias("directories"))
    out = told.join(best, key).withColumn("sample_files", F.transform("best", lambda x: x["path"])).drop("best")
    return out.orderBy(F.desc("cluster_size"), "repo", "cluster_id").limit(limit)


def drifting_pairs(drift: DataFrame, live: DataFrame, trend: str = "emerging", limit: int = 25, deleted: bool = False) -> DataFrame:
    """Pairs of one trend whose files (repo, file_id in live) are still there: the strongest rise first, or the strongest fall."""
    rows = drift.where(F.col("trend") == trend)
    if not deleted:
        for side in ("a", "b"):
            rows = rows.join(live.select("repo", F.col("file_id").alias(side)), ["repo", side], "left_semi")
    return rows.orderBy(F.desc("delta") if trend == "emerging" else F.asc("delta"), "repo", "a", "b").limit(limit)


def top_authors(owners: DataFrame) -> DataFrame:
    """(repo, file_id, top_author): the author of most commits, ties to the smaller id."""
    return owners.groupBy("repo", "file_id").agg(F.max_by("author_id", F.struct("n_commits", -F.col("author_id"))).alias("top_author"))


def risky_files(risk: DataFrame, live: DataFrame, owners: DataFrame, limit: int = 25, least: int = 5, deleted: bool = False) -> DataFrame:
    rows = risk.where(F.col("change_count") >= least)
    if not deleted:
        rows = rows.join(live.select("repo", "file_id"), ["repo", "file_id"], "left_semi")
    top = rows.withColumn("risk", F.coalesce("risk", F.lit(0.0))).orderBy(F.desc("risk"), "repo", "file_id").limit(limit)
    return top.join(top_authors(owners), ["repo", "file_id"], "left").orderBy(F.desc("risk"), "repo", "file_id")


def overview(clusters: DataFrame, drift: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, from one row of each table."""
    c = clusters.select("repo", "cluster_id", "dirs_spanned").groupBy("repo", "cluster_id").agg(F.count(F.lit(1)).alias("n"), F.max("dirs_spanned").alias("d"))
    c = c.agg(F.count(F.lit(1)).alias("modules"), F.coalesce(F.sum("n"), F.lit(0)).alias("clustered_files"), F.count_if(F.col("d") > 1).alias("cross_dir_modules"))
    d = drift.agg(*[F.count_if(F.col("trend") == t).alias(t) for t in ("emerging", "decaying", "stable")])
    e = edges.agg(F.count(F.lit(1)).alias("impact_edges"), F.count_if("is_declared").alias("declared_edges"), F.count_if(F.col("bump_count") > 0).alias("bump_edges"))
    return c.join(F.broadcast(d)).join(F.broadcast(e))  # one row each
