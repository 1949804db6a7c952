"""Derived tables as Parquet, partitioned by repository: idempotent loads, replacement by repository, merges and sweeps.

A repository is a partition. A rebuild overwrites just the partitions of the repositories it was run for, so that a
retried job gives the same table; loads skip what is stored by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalised, version_key
from ..operators.ancestry import ancestry, reached
from ..operators.coupling import as_of_epoch, epoch
from .steps import discard, step


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one where nothing is stored yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str, by: str = "repo") -> None:
    """Writes df in place of the stored partitions that it has rows of; others stay."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str, by: str = "repo") -> None:
    df.write.mode("append").partitionBy(by).parquet(path)


def reset(spark: SparkSession, paths: list[str]) -> None:
    """Deletes the tables at these paths."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def new_commits(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Commits of parsed (repo, sha, ...) that are not in known, each once: a load that is run again adds nothing."""
    return parsed.dropDuplicates(["repo", "sha"]).join(known.select("repo", "sha"), ["repo", "sha"], "left_anti")


def new_changes(parsed: DataFrame, added: DataFrame) -> DataFrame:
    """Changes (repo, sha, nr, path, ...) of the commits added; of a path repeated in a commit the first by nr stays."""
    first = F.row_number().over(Window.partitionBy("repo", "sha", "path").orderBy("nr"))
    rows = parsed.join(added.select("repo", "sha"), ["repo", "sha"], "left_semi")
    return rows.withColumn("_first", first).where("_first = 1").drop("_first")


def unreachable(commits: DataFrame, reachable: DataFrame) -> DataFrame:
    """Commits whose sha no ref of the repository reaches any more; repositories without any row in reachable are left alone."""
    read = reachable.select("repo").distinct()
    return commits.join(read, "repo", "left_semi").join(reachable.select("repo", "sha"), ["repo", "sha"], "left_anti")


def sweep(commits: DataFrame, reachable: DataFrame) -> DataFrame:
    """commits without the unreachable ones."""
    return commits.join(unreachable(commits, reachable).select("repo", "sha"), ["repo", "sha"], "left_anti")


def stale_repos(repos: DataFrame, mark: str, manifests: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Repositories to be done again: enabled, not being ingested, and with a head other than the one in column mark.

    manifests (repo): if given, only repositories in it. A null head is never up to date.
    """
    done = F.lit(False) if force else F.coalesce(F.col(mark) == F.col("head_sha"), F.lit(False))
    rows = repos.where(F.col("is_enabled") & (F.coalesce("ingest_status", F.lit("")) != "ingesting") & ~done)
    return rows if manifests is None else rows.join(manifests.select("repo").distinct(), "repo", "left_semi")


def beyond_tips(commits: DataFrame, tips: DataFrame, parents: DataFrame) -> DataFrame:
    """Commits (repo, sha) not reachable from the stored ref tips (repo, sha), by parents (repo, child_sha, parent_sha)."""
    return commits.join(reached(tips, ancestry(parents)), ["repo", "sha"], "left_anti")


# Columns that a plain clone knows nothing of, and columns that a null never overwrites.
HOST_ONLY = (
    "visibility", "is_private", "is_fork", "is_archived", "is_template", "is_disabled", "disk_usage_kb", "stargazers", "watchers", "forks_count", "open_issues",
    "host_created_at", "host_updated_at", "host_pushed_at",
)
KEPT_IF_NULL = ("description", "primary_language", "license_spdx", "account_id")


def merge_repos(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the records of new by (host, full_name), a full outer join; both have the same columns, provider and raw among them.

    A record of provider git leaves HOST_ONLY columns as they were, a null leaves KEPT_IF_NULL, an empty raw the stored one.
    """
    key = ["host", "full_name"]
    rows = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full")
    out = []
    for c in old.columns:
        if c in key:
            out.append(F.col(c))
            continue
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        keeps = F.col("_new").isNull()
        if c in HOST_ONLY:
            keeps = keeps | (F.col("_old").isNotNull() & (F.col("n.provider") == "git"))
        if c in KEPT_IF_NULL:
            keeps = keeps | (F.col("_old").isNotNull() & n.isNull())
        if c == "raw":
            keeps = keeps | (F.col("_old").isNotNull() & F.coalesce(n, F.lit("{}")).isin("{}", ""))
        out.append(F.when(keeps, o).otherwise(n).alias(c))
    return rows.select(*out)


def load_tags(tags: DataFrame, commits: DataFrame) -> DataFrame:
    """tags (repo, name, commit_sha, main_sha, tagged_at) with commit_id and main_commit_id, null where not stored, and version_key."""
    ids = commits.select("repo", F.col("sha"), "commit_id")
    at = lambda sha, name: ids.select("repo", F.col("sha").alias(sha), F.col("commit_id").alias(name))
    return tags.join(at("commit_sha", "commit_id"), ["repo", "commit_sha"], "left").join(at("main_sha", "main_commit_id"), ["repo", "main_sha"], "left").withColumn("version_key", version_key(F.col("name")))


def replays(commits: DataFrame, branch: DataFrame) -> DataFrame:
    """commits (repo, sha, patch_id) with is_replay: off the branch (repo, sha), while a commit on it has the same patch."""
    on = commits.join(branch.select("repo", "sha").withColumn("_on", F.lit(True)), ["repo", "sha"], "left")
    known = on.where("_on and patch_id is not null").select("repo", "patch_id").distinct().withColumn("_known", F.lit(True))
    return on.join(known, ["repo", "patch_id"], "left").withColumn("is_replay", F.col("_on").isNull() & F.col("_known").isNotNull()).drop("_on", "_known")


def file_identity(changes: DataFrame) -> DataFrame:
    """(repo, nr, path, old_path, file) of changes (repo, nr, path, old_path): files keep their identity through renames.

    A file is named by the first path it had. Which file a path is of is settled by the first change of the path, by nr: that of
    the old path where this is a rename from a path that was changed before, else a file of its own. So paths point to older
    paths, and a file is the end of such a chain, found by doubling the pointers. A rename onto a path that another file holds is
    a change of that file; the two are not merged.
    """
    rows = changes.select("repo", "nr", "path", "old_path")
    first = rows.groupBy("repo", "path").agg(F.min("nr").alias("_nr"), F.min_by(F.struct("old_path"), "nr").alias("_from"))
    first = step(first.select("repo", "path", "_nr", F.col("_from.old_path").alias("_old")), "paths")
    older = first.select("repo", F.col("path").alias("_old"), F.col("_nr").alias("_before"))
    links = step(first.where("_old <> path").join(older, ["repo", "_old"]).where("_before < _nr").select("repo", "path", F.col("_old").alias("file")), "links")
    while True:
        further = links.select("repo", F.col("path").alias("file"), F.col("file").alias("_further"))
        longer = step(links.join(further, ["repo", "file"], "left").select("repo", "path", F.coalesce("_further", "file").alias("file"), F.col("_further").isNotNull().alias("_moved")), "links")
        discard(links)
        links = longer.select("repo", "path", "file")
        if longer.where("_moved").isEmpty():
            break
    return rows.join(links, ["repo", "path"], "left").withColumn("file", F.coalesce("file", "path"))


def aliases(resolved: DataFrame) -> DataFrame:
    """(repo, old_path, file): the first file that left each path by a rename."""
    rows = resolved.where("old_path is not null and old_path <> path")
    return rows.groupBy("repo", "old_path").agg(F.min_by("file", "nr").alias("file"))


def current_paths(resolved: DataFrame) -> DataFrame:
    """(repo, file, path): the path each file had last."""
    return resolved.groupBy("repo", "file").agg(F.max_by("path", "nr").alias("path"))


def resolve_paths(asked: DataFrame, paths: DataFrame, old: DataFrame) -> DataFrame:
    """asked (repo, path) with file: that of the current path, else of a path it once had, else null."""
    rows = asked.withColumn("path", normalised(F.col("path")))
    rows = rows.join(paths.select("repo", "path", F.col("file").alias("_now")), ["repo", "path"], "left").join(old.select("repo", F.col("old_path").alias("path"), F.col("file").alias("_then")), ["repo", "path"], "left")
    return rows.withColumn("file", F.coalesce("_now", "_then")).drop("_now", "_then")


def stale_runs(runs: DataFrame, as_of: str, idle_minutes: int = 120, hours: int = 6) -> DataFrame:
    """Runs (id, status, started_at, heartbeat_at) still marked running without a heartbeat for idle_minutes, or older than hours without any."""
    idle = as_of_epoch(as_of) - F.coalesce(epoch("heartbeat_at"), epoch("started_at"))
    return runs.where((F.col("status") == "running") & (idle > F.when(F.col("heartbeat_at").isNull(), hours * 3600).otherwise(idle_minutes * 60)))


def failure_summary(runs: DataFrame, by: str = "run_id") -> DataFrame:
    """The commonest first line of the errors of each run, and how many failed; ties go to the first by name."""
    rows = runs.where("error is not null").withColumn("line", F.substring_index(F.trim("error"), "\n", 1))
    counts = rows.groupBy(by, "line").agg(F.count(F.lit(1)).alias("n"))
    top = Window.partitionBy(by).orderBy(F.desc("n"), "line")
    return counts.withColumn("_r", F.row_number().over(top)).withColumn("failed", F.sum("n").over(Window.partitionBy(by))).where("_r = 1").select(by, "line", "n", "failed")


def upsert_feedback(old: DataFrame, reports: DataFrame) -> DataFrame:
    """old with reports (fingerprint, kind, severity, detail, at) merged by fingerprint.

    Both are summed up by fingerprint: occurrences add up, first and last times widen, the newest words stay, and a
    fingerprint that was closed opens again when it is reported.
    """
    fresh = reports.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("occurrences"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), *[F.max_by(c, "at").alias(c) for c in ("kind", "severity", "detail")])
    o, n = old.alias("o"), fresh.alias("n")
    rows = o.join(n, "fingerprint", "full")
    both = lambda f, c: f(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    kept = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("kind", "severity", "detail")]
    count = (F.coalesce("o.occurrences", F.lit(0)) + F.coalesce("n.occurrences", F.lit(0))).alias("occurrences")
    status = F.when(F.col("n.occurrences").isNotNull(), "open").otherwise(F.col("o.status")).alias("status")
    return rows.select("fingerprint", *kept, count, both(F.least, "first_at"), both(F.greatest, "last_at"), status)


def feedback_summary(rows: DataFrame) -> DataFrame:
    """Totals by severity: all, open, and closed (fixed or not to be fixed)."""
    closed = F.col("status").isin("fixed", "wontfix")
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(closed).alias("closed"))
