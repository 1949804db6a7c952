"""Dependency stages: bumps from manifest revisions, transitive entries, name resolution, version resolution, modules.

Every stage is joins and aggregates over all repositories at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounds, directory, ordinal, repo_ref, version_key
from ..sinks.steps import release, step
from ..sources.manifests import PATH_ECOSYSTEMS
from .coupling import epoch
from .dominance import latest_below

#: What a declared string that is a floor begins with.
FLOOR_SIGNS = ("^", "~", ">", "<", "=")
MAX_VERSION = 200
#: Versions that one commit alone is tagged with are broadcast up to so many.
MAX_BROADCAST = 500_000


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order that is to be total."""
    return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_first = 1").drop("_first")


def snapshot_changes(revisions: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries that are new or changed against the manifest's revision before.

    revisions: (repo, manifest, sha, at), every revision, also those without entries; entries: (repo, manifest, sha, name,
    raw, ...), a name once a revision. A name that was absent from the revision before counts as new again.
    """
    nr = F.row_number().over(Window.partitionBy("repo", "manifest").orderBy("at", "sha"))
    numbered = entries.join(revisions.select("repo", "manifest", "sha", "at", nr.alias("nr")), ["repo", "manifest", "sha"])
    by_name = Window.partitionBy("repo", "manifest", "name").orderBy("nr")
    before, raw = F.lag("nr").over(by_name), F.lag("raw").over(by_name)
    rows = numbered.withColumns({"_new": before.isNull() | (before < F.col("nr") - 1) | ~raw.eqNullSafe(F.col("raw"))})
    return rows.where("_new").drop("_new", "nr")


def bumps(changed: DataFrame, locked: DataFrame) -> DataFrame:
    """Changed entries as bumps with version and tier, the repository's own name left out.

    locked: (repo, dir, sha, ecosystem, name, version), names in lower case. Where a lock file beside the manifest tells the exact
    version, that is the version and the tier is locked; else the declared string and declared.
    """
    own = repo_ref(F.col("repo"))[1]
    rows = changed.where(repo_ref(F.col("name"))[1] != own).withColumns({"_dir": directory(F.col("manifest")), "_name": F.lower("name")})
    exact = locked.groupBy(F.col("repo"), F.col("dir").alias("_dir"), F.col("sha"), F.col("ecosystem"), F.col("name").alias("_name")).agg(F.max("version").alias("_exact"))
    rows = rows.join(exact, ["repo", "_dir", "sha", "ecosystem", "_name"], "left")
    version = F.substring(F.coalesce("_exact", "raw"), 1, MAX_VERSION)
    rows = rows.withColumns({"version": version, "tier": F.when(F.col("_exact").isNull(), "declared").otherwise("locked")})
    return keep_first(rows.drop("_dir", "_name", "_exact"), ["repo", "sha", "name", "version"], ["manifest"])


def transitive(locked: DataFrame, declared: DataFrame) -> DataFrame:
    """Entries of lock files that the manifests beside them do not declare: (repo, dir, sha, ecosystem, name, version, tier)."""
    said = declared.select("repo", directory(F.col("manifest")).alias("dir"), "sha", "ecosystem", F.lower("name").alias("name")).distinct()
    return locked.join(said, ["repo", "dir", "sha", "ecosystem", "name"], "left_anti").withColumn("tier", F.lit("transitive"))


def claims(published: DataFrame) -> DataFrame:
    """(ecosystem, name, repo) of published (repo, ecosystem, name): only names that a single repository claims."""
    rows = published.groupBy("ecosystem", F.lower("name").alias("name")).agg(F.count_distinct("repo").alias("n"), F.min("repo").alias("repo"))
    return rows.where("n = 1").drop("n")


def resolve_names(rows: DataFrame, repos: DataFrame, claimed: DataFrame) -> DataFrame:
    """rows (name, ecosystem, ...) with dep_repo, the tracked repository that the name speaks of, or null.

    First a package claim of the ecosystem; then, in ecosystems that name repositories by path (or none), owner and name, or
    a bare name that only one repository has. repos: (repo, owner, name).
    """
    owner, name = repo_ref(F.col("name"))
    by_path = F.coalesce(F.col("ecosystem"), F.lit("")).isin("", *PATH_ECOSYSTEMS)
    rows = rows.withColumns({"_claim": F.lower(F.trim("name")), "_owner": F.when(by_path, owner), "_name": F.when(by_path & (name != ""), name)})
    rows = rows.join(claimed.select(F.col("ecosystem"), F.col("name").alias("_claim"), F.col("repo").alias("_by_claim")), ["ecosystem", "_claim"], "left")
    full = repos.groupBy(F.lower("owner").alias("_owner"), F.lower("name").alias("_name")).agg(F.max("repo").alias("_by_path"))
    bare = repos.groupBy(F.lower("name").alias("_name")).agg(F.count_distinct("repo").alias("_n"), F.min("repo").alias("_by_name")).where("_n = 1").drop("_n")
    rows = rows.join(full, ["_owner", "_name"], "left").join(bare, "_name", "left")
    found = F.coalesce("_by_claim", F.when(F.col("_owner").isNotNull(), F.col("_by_path")).otherwise(F.col("_by_name")))
    return rows.withColumn("dep_repo", found).drop("_claim", "_owner", "_name", "_by_claim", "_by_path", "_by_name")


def declared_dependencies(entries: DataFrame, repos: DataFrame, claimed: DataFrame) -> DataFrame:
    """(repo, name, manifest, ecosystem, version, dep_repo) declared at head, each (repo, name, manifest) once and never of oneself."""
    rows = entries.where(repo_ref(F.col("name"))[1] != repo_ref(F.col("repo"))[1])
    rows = keep_first(rows.select("repo", "name", "manifest", "ecosystem", F.substring("raw", 1, MAX_VERSION).alias("version")), ["repo", "name", "manifest"], ["version", "ecosystem"])
    rows = resolve_names(rows, repos, claimed)
    return rows.withColumn("dep_repo", F.when(F.col("dep_repo") != F.col("repo"), F.col("dep_repo")))


def modules(entries: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, consumer_module, dep_module, manifest, version): dependencies within a repository of several go modules.

    A name that holds the repository's own as a segment speaks of the module that follows it.
    """
    go = entries.where(F.col("ecosystem") == "go")
    several = go.groupBy("repo").agg(F.count_distinct("manifest").alias("n")).where("n >= 2").select("repo")
    rows = go.join(several, "repo", "left_semi").join(repos.select("repo", F.lower(F.col("name")).alias("_key")), "repo")
    parts = F.split("name", "/")
    at = F.array_position(F.transform(parts, lambda p: F.lower(p)), F.col("_key"))
    dep = F.when(at > 0, F.array_join(F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at, F.lit(0)).cast("int")), "/"))
    rows = rows.select("repo", directory(F.col("manifest")).alias("consumer_module"), dep.alias("dep_module"), "manifest", F.substring("raw", 1, MAX_VERSION).alias("version"))
    return keep_first(rows.where("dep_module <> '' and dep_module <> consumer_module"), ["repo", "consumer_module", "dep_module", "manifest"], ["version"])


def with_version_key(rows: DataFrame) -> DataFrame:
    """Adds version_key (null for a range with only a ceiling) and limit, the ordinal below which such a range wants a release."""
    low, high = bounds(F.col("version"))
    only = high.isNotNull() & low.isNull()
    key = F.when(~only, version_key(F.coalesce(low, F.col("version"))))
    return rows.withColumns({"version_key": key, "limit": F.when(only, ordinal(version_key(high)))})


def resolve_versions(rows: DataFrame, tags: DataFrame, commits: DataFrame, width: int = 12) -> DataFrame:
    """rows with dep_commit_id, resolution and adoption_seconds.

    rows: (id, consumer_at, dep_repo, version, dep_sha); tags: (repo, version_key, commit_id, tagged_at); commits: (repo,
    sha, commit_id, committed_at). Tried in this order: the commit whose sha begins with dep_sha (the smallest, if several);
    the one commit that tags of the version's key name (tag, or floor for a version that begins with a sign); the newest
    release below a ceiling, tagged at or before consumer_at. An upstream commit later than the consumer resolves nothing.
    """
    spark = rows.sparkSession
    rows = step(with_version_key(rows), "bumps")
    release(spark)
    found = F.struct("commit_id", F.col("committed_at").alias("at"))
    heads = commits.select(F.col("repo").alias("_repo"), "sha", found.alias("_sha"))
    has_sha = F.coalesce(F.length("dep_sha") >= width, F.lit(False))
    same = (F.col("dep_repo") == F.col("_repo")) & (F.substring("dep_sha", 1, width) == F.substring("sha", 1, width)) & F.col("sha").startswith(F.col("dep_sha"))
    pinned = step(rows.where(has_sha).select("id", "dep_repo", "dep_sha").join(heads, same).groupBy("id").agg(F.min_by("_sha", "sha").alias("_sha")), "pinned")
    known = tags.where("version_key is not null and commit_id is not null").select("repo", "version_key", "commit_id", "tagged_at")
    known = step(known.join(commits.select("commit_id", "committed_at"), "commit_id", "left").withColumn("_found", found), "tags")
    unique = known.groupBy(F.col("repo").alias("dep_repo"), "version_key").agg(F.count_distinct("commit_id").alias("_n"), F.min("_found").alias("_tag")).where("_n = 1").drop("_n")
    unique = step(unique, "unique")
    # of the releases of one ordinal the largest commit counts; a release without a time is older than any request
    releases = known.withColumn("_ordinal", ordinal(F.col("version_key"))).where("_ordinal is not null")
    releases = releases.select(F.col("repo").alias("key"), F.struct("_ordinal", "_found").alias("ordinal"), F.coalesce("tagged_at", F.lit("0001-01-01").cast("timestamp")).alias("at"))
    below = F.struct(F.col("limit").alias("_ordinal"), F.lit(None).cast(known.schema["_found"].dataType).alias("_found"))
    asked = rows.where("limit is not null").select("id", F.col("dep_repo").alias("key"), F.col("consumer_at").alias("at"), below.alias("below"))
    release(spark)
    best = latest_below(asked, releases).where("ordinal is not null").groupBy("id").agg(F.max("ordinal")["_found"].alias("_ceiling"))
    best = step(best, "ceilings")
    release(spark)

    # only rows that asked for a sha or a ceiling are joined by id
    by_id = has_sha | F.col("limit").isNotNull()
    nothing = F.lit(None).cast(known.schema["_found"].dataType)
    rows = rows.where(by_id).join(pinned, "id", "left").join(best, "id", "left").unionByName(rows.where(~by_id).withColumns({"_sha": nothing, "_ceiling": nothing}))
    rows = rows.join(F.broadcast(unique) if unique.count() <= MAX_BROADCAST else unique, ["dep_repo", "version_key"], "left")
    sign = F.substring("version", 1, 1).isin(*FLOOR_SIGNS)
    there = lambda name: F.col(f"{name}.commit_id").isNotNull()
    how = F.when(there("_sha"), "sha").when(there("_tag"), F.when(sign, "floor").otherwise("tag")).when(there("_ceiling"), "ceiling")
    rows = rows.withColumns({"_found": F.when(there("_sha"), F.col("_sha")).when(there("_tag"), F.col("_tag")).otherwise(F.col("_ceiling")), "resolution": how})
    fine = F.coalesce(F.col("_found.at") <= F.col("consumer_at"), F.lit(False))
    rows = rows.withColumns({"dep_commit_id": F.when(fine, F.col("_found.commit_id")), "resolution": F.when(fine, F.col("resolution")), "adoption_seconds": F.when(fine, epoch("consumer_at") - epoch("_found.at"))})
    return rows.drop("_sha", "_tag", "_ceiling", "_found", "limit")


def affected_sources(changed: DataFrame, declared: DataFrame, bump_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """The publishers whose edges a change of the consumers changed (repo) can alter: of now and of the stored edges."""
    of = lambda rows, consumer, dep: rows.join(changed.select(F.col("repo").alias(consumer)), consumer, "left_semi").select(F.col(dep).alias("source"))
    return of(declared, "consumer", "dep").unionByName(of(bump_rows, "consumer", "dep")).unionByName(of(edges, "target", "source")).where("source is not null").distinct()


def fingerprint(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """One row (n, print) that tells whether the content is as before, in whatever order."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("print"))
