"""The read layer: listings, searches, lookups and ranked views over the derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.judgement import is_auxiliary, is_noise
from ..functions.text import directory, module_path
from ..schemas import clamp_limit

#: What listings may be ordered by; any other key falls back to the first.
REPO_ORDERS = ("commit_count", "file_count", "author_count", "pair_count", "name", "full_name", "last_commit_at", "first_commit_at", "stargazers", "disk_usage_kb", "primary_language")
FILE_ORDERS = ("change_count", "path", "pair_change_count", "author_count", "last_at")


def allowed(key: str | None, keys: tuple[str, ...]) -> str:
    return key if key in keys else keys[0]


def holds(col: Column | str, term: str) -> Column:
    """Substring search regardless of case; the term's own % and _ are plain characters."""
    return F.contains(F.lower(col), F.lit(term.lower()))


def ordered(rows: DataFrame, key: str, descending: bool, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first(), *ties)


def list_repos(repos: DataFrame, search: str | None = None, language: str | None = None, status: str | None = None, order_by: str | None = None, descending: bool = True, limit: int = 500, offset: int = 0, account: int | None = None, include_paused: bool = False) -> DataFrame:
    """Repositories by name or description; paused ones only where asked for or within an account."""
    rows = repos
    if search:
        rows = rows.where(holds("full_name", search) | F.coalesce(holds("description", search), F.lit(False)))
    if language is not None:
        rows = rows.where(F.col("primary_language") == language)
    if status is not None:
        rows = rows.where(F.col("ingest_status") == status)
    if account is not None:
        rows = rows.where(F.col("account_id") == account)
    elif not include_paused:
        rows = rows.where("is_enabled")
    return ordered(rows, allowed(order_by, REPO_ORDERS), descending, "full_name").offset(offset).limit(clamp_limit(limit))


def get_repo(repos: DataFrame, name: str) -> DataFrame:
    """The repository of this full name, else the only one of this name."""
    rows = repos.where((F.col("full_name") == name) | (F.col("name") == name)).withColumn("_exact", F.col("full_name") == name)
    best = Window.partitionBy(F.lit(0))  # at most as many rows as repositories of one name
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(best), "_any": F.max("_exact").over(best)})
    return rows.where("_exact or (not _any and _n = 1)").drop("_exact", "_n", "_any")


def search_files(files: DataFrame, term: str | None = None, repo: str | None = None, extension: str | None = None, min_changes: int = 0, order_by: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    rows = files.where(F.col("change_count") >= max(min_changes, 0))
    if term:
        rows = rows.where(holds("path", term))
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    if extension is not None:
        rows = rows.where(F.col("extension") == extension.lower().lstrip("."))
    key = allowed(order_by, FILE_ORDERS)
    return ordered(rows, key, key != "path", "repo", "file_id").offset(offset).limit(clamp_limit(limit))


def select_repos(records: DataFrame, tracked: DataFrame, only: tuple[str, ...] = (), skip: tuple[str, ...] = (), private: bool = False, forks: bool = False, archived: bool = False) -> DataFrame:
    """The discovered records (name, full_name, is_disabled, is_private, is_fork, parent_full_name, is_archived) to take.

    A list of names alone decides where there is one. Else skipped, disabled, and, unless wanted, private and archived ones
    go, and forks of what is tracked (full_name) or among the records itself.
    """
    named = lambda names: F.lower("name").isin(*map(str.lower, names)) | F.lower("full_name").isin(*map(str.lower, names))
    if only:
        return records.where(named(only))
    rows = records.where(~F.col("is_disabled"))
    if skip:
        rows = rows.where(~named(skip))
    if not private:
        rows = rows.where(~F.col("is_private"))
    if not archived:
        rows = rows.where(~F.col("is_archived"))
    if not forks:
        present = tracked.select(F.lower("full_name").alias("_parent")).unionByName(records.where(~F.col("is_fork")).select(F.lower("full_name").alias("_parent"))).distinct()
        rows = rows.withColumn("_parent", F.when(F.col("is_fork"), F.lower("parent_full_name"))).join(present, "_parent", "left_anti").drop("_parent")
    return rows


def hotspots(files: DataFrame, partners: DataFrame, limit: int = 25, min_changes: int = 0, deleted: bool = False, overfetch: int = 8) -> DataFrame:
    """The most changed files, source before documentation and CI, noise left out, with their number of partners.

    files: (repo, file_id, path, change_count, is_deleted). As many as overfetch times the limit are looked at, so that a
    list full of noise can come out shorter; overfetch 0 looks at all.
    """
    rows = files.where(F.col("change_count") >= min_changes)
    if not deleted:
        rows = rows.where(~F.col("is_deleted"))
    if overfetch:
        rows = rows.orderBy(F.desc("change_count"), "repo", "file_id").limit(max(limit * overfetch, limit + 1))
    rows = rows.where(~is_noise(F.col("path"))).withColumn("auxiliary", is_auxiliary(F.col("path")))
    top = rows.orderBy("auxiliary", F.desc("change_count"), "repo", "file_id").limit(max(limit, 1))
    rows = top.join(partners, ["repo", "file_id"], "left").withColumn("partner_count", F.coalesce("partners", F.lit(0))).drop("partners")
    return rows.orderBy("auxiliary", F.desc("change_count"), "repo", "file_id")


def directories(rows: DataFrame, repo: str, limit: int = 200) -> DataFrame:
    return rows.where(F.col("repo") == repo).orderBy(F.desc("change_count"), "dir_path").limit(max(limit, 1))


def directory_tree(dirs: DataFrame, files: DataFrame, path: str = "", limit: int = 1000) -> DataFrame:
    """(kind, path): the directory itself, the directories right below it and the files in it."""
    p = F.col("dir_path")
    prefix = f"{path.rstrip('/')}/" if path else ""
    level = prefix.count("/")
    below = p.startswith(prefix) & (p != "") & (p != path) & (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) == level)
    rows = dirs.where(below).select(F.lit("directory").alias("kind"), p.alias("path"))
    own = dirs.where((p == path) & F.lit(path != "")).select(F.lit("self").alias("kind"), p.alias("path"))
    held = files.where(directory(F.col("path")) == path).orderBy("path").limit(max(limit, 1)).select(F.lit("file").alias("kind"), "path")
    return own.unionByName(rows).unionByName(held)


def module_context(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked (id, repo, path) with owning_module, declares and declared_by, from rows (repo, consumer_module, dep_module)."""
    names = rows.select("repo", F.explode(F.array("consumer_module", "dep_module")).alias("owning_module")).where("owning_module <> ''").distinct()
    asked = asked.withColumn("path", module_path(F.trim("path")))
    parts = F.split("path", "/")
    above = asked.select("id", "repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("owning_module"))
    own = above.join(names, ["repo", "owning_module"]).groupBy("id").agg(F.max_by("owning_module", F.length("owning_module")).alias("owning_module"))
    listed = lambda by, of, name: rows.groupBy("repo", F.col(by).alias("owning_module")).agg(F.sort_array(F.collect_set(of)).alias(name))
    out = asked.join(own, "id", "left").join(listed("consumer_module", "dep_module", "declares"), ["repo", "owning_module"], "left").join(listed("dep_module", "consumer_module", "declared_by"), ["repo", "owning_module"], "left")
    none = F.array().cast("array<string>")
    return out.select("id", "owning_module", F.coalesce("declares", none).alias("declares"), F.coalesce("declared_by", none).alias("declared_by"))


def coupled_across(pairs: DataFrame, asked: Column, limit: int = 12, min_support: int = 2) -> DataFrame:
    """(direction, other, n_bumps, last_at, version): the partners of a file in other repositories, both ways.

    pairs: (upstream_file, consumer_file, n_bumps, last_at, version). Each side gives its own best, and of both the best stay.
    """
    rows = pairs.where(F.col("n_bumps") >= min_support)
    keep = ["n_bumps", "last_at", "version"]

    def side(name: str, own: str, other: str) -> DataFrame:
        found = rows.where(F.col(own) == asked).select(F.lit(name).alias("direction"), F.col(other).alias("other"), *keep)
        return found.orderBy(F.desc("n_bumps"), "other").limit(limit)

    both = side("upstream", "consumer_file", "upstream_file").unionByName(side("downstream", "upstream_file", "consumer_file"))
    return both.orderBy(F.desc("n_bumps"), "direction", "other").limit(limit)


def impact_of(edges: DataFrame, side: str, repo: Column, limit: int = 20, declared_only: bool = False, min_score: float = 0.0) -> DataFrame:
    """Edges of a publisher (side source) or of a consumer (side target), declared ones first, then by score."""
    rows = edges.where((F.col(side) == repo) & (F.col("score") >= min_score))
    if declared_only:
        rows = rows.where("is_declared")
    return rows.orderBy(F.desc("is_declared"), F.desc("score"), "target" if side == "source" else "source").limit(limit)


def impact_graph(edges: DataFrame, min_score: float = 0.4, limit: int = 400) -> DataFrame:
    return edges.where(F.col("score") >= min_score).orderBy(F.desc("score"), "source", "target").limit(max(limit, 1))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(clamp_limit(limit))


def run_detail(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """runs (id, ...) with counts of their parts (run_id, repo, status)."""
    told = parts.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("repos"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"))
    return runs.join(told, "id", "left").fillna(0, ["repos", "succeeded", "failed"])


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A uniform sample of n rows that depends on keys and seed alone: those of the smallest hashes."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)
