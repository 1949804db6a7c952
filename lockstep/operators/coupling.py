"""Eligibility, marginals, pairs, hierarchy, scores, drift and risk over commits and changes.

Every stage handles all repositories at once: repo is a grouping key. Baskets are capped before pairs are made, so
a commit yields at most max_files * (max_files - 1) / 2 of them, within its own row and without a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import with_measures
from ..schemas import DRIFT_WINDOW_DAYS, HALF_LIFE_DAYS, LABEL_ROUNDS, MAX_FILES_PER_COMMIT, MIN_PAIR_SUPPORT, RISK_EVIDENCE
from ..sinks.steps import discard, step


def epoch(col: str | Column) -> Column:
    return F.unix_timestamp(F.col(col) if isinstance(col, str) else col)


def as_of_epoch(as_of: str) -> Column:
    return F.unix_timestamp(F.lit(as_of).cast("timestamp"))


def with_eligible(commits: DataFrame, cap: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    """A commit counts for pairs if it is no merge or replay, has a change and, with a cap above 0, at most cap files."""
    fits = F.lit(True) if cap <= 0 else F.col("n_files") <= cap
    return commits.withColumn("eligible", ~F.col("is_merge") & ~F.col("is_replay") & (F.col("n_files") > 0) & fits)


def population(commits: DataFrame, cap: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    return with_eligible(commits, cap).groupBy("repo").agg(F.count_if("eligible").alias("n_total"))


def dated(changes: DataFrame, commits: DataFrame, cap: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    """Changes with their commit's time, author and eligibility."""
    return changes.join(with_eligible(commits, cap).select("commit_id", "committed_at", "author_id", "eligible"), "commit_id")


def file_marginals(changes: DataFrame, commits: DataFrame, cap: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    return dated(changes, commits, cap).groupBy("repo", "file_id").agg(
        F.count(F.lit(1)).alias("change_count"),
        F.count_if("eligible").alias("pair_change_count"),
        F.sum(F.coalesce("insertions", F.lit(0.0))).alias("insertions"),
        F.sum(F.coalesce("deletions", F.lit(0.0))).alias("deletions"),
        F.count_distinct("author_id").alias("distinct_authors"),
        F.min("committed_at").alias("first_at"),
        F.max("committed_at").alias("last_at"),
    )


def deleted_files(changes: DataFrame, commits: DataFrame, deletion: str = "D", files: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """(repo, file_id, is_deleted): in repositories with a tree (repo, path) a file (repo, file_id, path) that is not in it.

    Where no tree could be read, a file is deleted if its last change, by time and commit, is a deletion.
    """
    last = F.max_by("change_type", F.struct("committed_at", "commit_id"))
    told = dated(changes, commits).groupBy("repo", "file_id").agg((last == deletion).alias("is_deleted"))
    if tree is None:
        return told
    read = tree.select("repo").distinct().withColumn("_read", F.lit(True))
    there = files.select("repo", "file_id", "path").join(tree.select("repo", "path").distinct(), ["repo", "path"]).select("repo", "file_id").withColumn("_there", F.lit(True))
    rows = files.select("repo", "file_id").join(read, "repo", "left").join(there, ["repo", "file_id"], "left").join(told, ["repo", "file_id"], "left")
    gone = F.when(F.col("_read"), F.col("_there").isNull()).otherwise(F.coalesce("is_deleted", F.lit(False)))
    return rows.select("repo", "file_id", gone.alias("is_deleted"))


def baskets(changes: DataFrame, commits: DataFrame, item: str = "file_id", cap: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    """Eligible commits with the sorted array of their distinct items."""
    rows = dated(changes, commits, cap).where("eligible")
    return rows.groupBy("repo", "commit_id", "committed_at", "author_id").agg(F.sort_array(F.collect_set(item)).alias("items"))


def basket_pairs(rows: DataFrame) -> DataFrame:
    """A row (a, b), a < b, for each pair of a basket."""
    pairs = F.flatten(F.transform("items", lambda x, i: F.transform(F.slice(F.col("items"), i + 2, F.size("items")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return rows.select("repo", "commit_id", "committed_at", "author_id", F.explode(pairs).alias("p")).select("*", "p.a", "p.b").drop("p")


def pairs(rows: DataFrame, min_support: int = MIN_PAIR_SUPPORT, as_of: str | None = None, half_life: float = HALF_LIFE_DAYS) -> DataFrame:
    """(repo, a, b, n_ab, first_at, last_at, distinct_authors) with n_ab >= min_support, and w_ab where as_of is given."""
    keep = {"n_ab": (F.count(F.lit(1)), F.sum), "first_at": (F.min("committed_at"), F.min), "last_at": (F.max("committed_at"), F.max)}
    if as_of is not None:
        age = F.greatest(as_of_epoch(as_of) - epoch("committed_at"), F.lit(0)) / 86400.0
        keep["w_ab"] = (F.sum(F.pow(F.lit(2.0), -age / max(half_life, 1.0))), F.sum)
    # authors are told apart by a first sum, which is smaller than the pairs, and not by a distinct count over these
    rows = basket_pairs(rows).groupBy("repo", "a", "b", "author_id").agg(*[x.alias(k) for k, (x, _) in keep.items()])
    rows = rows.groupBy("repo", "a", "b").agg(*[f(k).alias(k) for k, (_, f) in keep.items()], F.count("author_id").alias("distinct_authors"))
    return rows.where(F.col("n_ab") >= max(min_support, 1))


def pair_counts(rows: DataFrame, min_support: int = MIN_PAIR_SUPPORT) -> DataFrame:
    return basket_pairs(rows).groupBy("repo", "a", "b").agg(F.count(F.lit(1)).alias("n_ab")).where(F.col("n_ab") >= max(min_support, 1))


def basket_margins(rows: DataFrame) -> DataFrame:
    """(repo, file_id, pair_change_count) from baskets: how many of them hold the item."""
    return rows.select("repo", F.explode("items").alias("file_id")).groupBy("repo", "file_id").agg(F.count(F.lit(1)).alias("pair_change_count"))


def basket_population(rows: DataFrame) -> DataFrame:
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n_total"))


def partners(rows: DataFrame, asked: DataFrame, min_support: int = MIN_PAIR_SUPPORT) -> DataFrame:
    """(repo, item, other, n_ab, n_item) of the items asked (repo, item): only baskets that hold one are looked at, without pairs of others."""
    held = rows.select("repo", "items", F.explode("items").alias("item")).join(asked, ["repo", "item"], "left_semi")
    seen = held.groupBy("repo", "item").agg(F.count(F.lit(1)).alias("n_item"))
    both = held.select("repo", "item", F.explode("items").alias("other")).where("other <> item").groupBy("repo", "item", "other").agg(F.count(F.lit(1)).alias("n_ab"))
    return both.where(F.col("n_ab") >= max(min_support, 1)).join(seen, ["repo", "item"])


def author_files(changes: DataFrame, commits: DataFrame) -> DataFrame:
    rows = dated(changes, commits).where("author_id is not null")
    return rows.groupBy("repo", "author_id", "file_id").agg(F.count(F.lit(1)).alias("n_commits"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.min("committed_at").alias("first_at"), F.max("committed_at").alias("last_at"))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root '' among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def closure(files: DataFrame) -> DataFrame:
    """(file_id, dir_path, depth) of each directory above each file."""
    rows = files.select("file_id", F.explode(ancestors(F.col("path"))).alias("dir_path"))
    slashes = F.length("dir_path") - F.length(F.replace(F.col("dir_path"), F.lit("/"), F.lit("")))
    return rows.withColumn("depth", slashes + F.when(F.col("dir_path") != "", 1).otherwise(0))


def directory_marginals(changes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    above = closure(files)
    counts = above.groupBy("dir_path").agg(F.count(F.lit(1)).alias("file_count"))
    rows = dated(changes, commits).join(above, "file_id")
    sums = rows.groupBy("repo", "dir_path").agg(F.count_distinct("commit_id").alias("change_count"), F.count_distinct(F.when(F.col("eligible"), F.col("commit_id"))).alias("pair_change_count"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    return sums.join(counts, "dir_path")


def directory_baskets(changes: DataFrame, commits: DataFrame, files: DataFrame, cap: int = MAX_FILES_PER_COMMIT) -> DataFrame:
    rows = dated(changes, commits, cap).where("eligible").join(closure(files), "file_id")
    return rows.groupBy("repo", "commit_id", "committed_at", "author_id").agg(F.sort_array(F.collect_set("dir_path")).alias("items"))


def scored(pair_rows: DataFrame, marginals: DataFrame, totals: DataFrame, keys: list[str] | None = None, item: str = "file_id") -> DataFrame:
    """Pairs with both margins (n_a, n_b), n_total, the clamped cells and the measures named."""
    side = lambda x: marginals.select("repo", F.col(item).alias(x), F.col("pair_change_count").alias(f"n_{x}"))
    return with_measures(pair_rows.join(side("a"), ["repo", "a"]).join(side("b"), ["repo", "b"]).join(totals, "repo"), keys)


def both_ways(metrics: DataFrame) -> DataFrame:
    """Each pair from either side: (item, other), margins and confidences swapped for the second."""
    swap = {"a": "b", "b": "a", "n_a": "n_b", "n_b": "n_a", "confidence_ab": "confidence_ba", "confidence_ba": "confidence_ab"}
    names = metrics.columns
    back = metrics.select(*[F.col(swap.get(c, c)).alias(c) if swap.get(c, c) in names else F.col(c) for c in names])
    return metrics.unionByName(back).withColumnsRenamed({"a": "item", "b": "other"})


def drift_npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Null if a count is 0, 1 if the joint count is the population, not clipped: drift's own variant."""
    fine = (n_ab > 0) & (n_a > 0) & (n_b > 0) & (n > 0)
    value = F.log2(n_ab * n / (n_a * n_b)) / -F.log2(n_ab / n)
    return F.when(fine & (n_ab >= n), 1.0).when(fine, value)


def drift(rows: DataFrame, as_of: str, window_days: int = DRIFT_WINDOW_DAYS, least: int = 2, edge: float = 0.15) -> DataFrame:
    """Recent against historic npmi of pairs seen at least `least` times in both windows."""
    recent = epoch("committed_at") >= as_of_epoch(as_of) - window_days * 86400
    rows = rows.withColumn("recent", recent)
    split = lambda name: [F.count_if("recent").cast("double").alias(f"{name}_r"), F.count_if(~F.col("recent")).cast("double").alias(f"{name}_h")]
    total = rows.groupBy("repo").agg(*split("n"))
    margin = rows.select("repo", "recent", F.explode("items").alias("item")).groupBy("repo", "item").agg(*split("m"))
    pair_rows = basket_pairs(rows).withColumn("recent", recent).groupBy("repo", "a", "b").agg(*split("n_ab")).where(f"n_ab_r >= {least} and n_ab_h >= {least}")
    side = lambda x: margin.select("repo", F.col("item").alias(x), F.col("m_r").alias(f"{x}_r"), F.col("m_h").alias(f"{x}_h"))
    out = pair_rows.join(side("a"), ["repo", "a"]).join(side("b"), ["repo", "b"]).join(total, "repo")
    for w in ("r", "h"):
        out = out.withColumn(f"npmi_{w}", drift_npmi(*(F.col(f"{c}_{w}") for c in ("n_ab", "a", "b", "n"))))
    delta = F.coalesce("npmi_r", F.lit(0.0)) - F.coalesce("npmi_h", F.lit(0.0))
    trend = F.when(delta > edge, "emerging").when(delta < -edge, "decaying").otherwise("stable")
    return out.select("repo", "a", "b", F.col("n_ab_r").cast("long").alias("n_ab_recent"), F.col("n_ab_h").cast("long").alias("n_ab_historic"), F.col("npmi_r").alias("npmi_recent"), F.col("npmi_h").alias("npmi_historic"), delta.alias("delta"), trend.alias("trend"))


def max_ranks(rows: DataFrame, value: str, name: str, key: str = "repo", buckets: int = 1024) -> DataFrame:
    """(key, value, name): (#{x <= v} - 1) / max(n - 1, 1) of each value, 0 or more, among the rows of its key.

    Values are counted first; counts of values go into buckets by the logarithm between the least and the largest, so that a
    running count is taken over buckets and inside each, and no task sees all rows or values of a key.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    log = F.log1p(F.col(value).cast("double"))
    ends = rows.groupBy(key).agg(F.min(log).alias("_low"), F.max(log).alias("_high"), F.count(F.lit(1)).alias("_all"))
    spot = F.when(F.col("_high") > F.col("_low"), (log - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    placed = counts.join(ends, key).withColumn("_bucket", F.floor(spot * (buckets - 1)))
    before = placed.groupBy(key, "_bucket").agg(F.sum("_n").alias("_sum"))
    before = before.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum("_n").over(Window.partitionBy(key, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.withColumn("_inside", inside).join(before, [key, "_bucket"])
    return ranked.select(key, value, ((F.col("_before") + F.col("_inside") - 1) / F.greatest(F.col("_all") - 1, F.lit(1))).alias(name))


def file_risk(marginals: DataFrame, pair_rows: DataFrame, owners: DataFrame, as_of: str, evidence: float = RISK_EVIDENCE) -> DataFrame:
    """churn rank * coupling rank * (1 + concentration of owners) * n / (n + evidence)."""
    degree = pair_rows.select("repo", F.explode(F.array("a", "b")).alias("file_id")).groupBy("repo", "file_id").agg(F.count(F.lit(1)).alias("partners"))
    own = F.col("n_commits").cast("double")
    share = owners.groupBy("repo", "file_id").agg((F.sum(own * own) / (F.sum(own) * F.sum(own))).alias("hhi"))
    rows = marginals.where("change_count > 0").join(degree, ["repo", "file_id"], "left").join(share, ["repo", "file_id"], "left").fillna(0, ["partners"]).fillna(0.0, ["hhi"])
    rows = step(rows.withColumn("churn", F.col("insertions") + F.col("deletions")), "risk")
    rows = rows.join(max_ranks(rows, "churn", "churn_pct"), ["repo", "churn"]).join(max_ranks(rows, "partners", "coupling_pct"), ["repo", "partners"])
    weight = F.col("change_count") / (F.col("change_count") + evidence)
    days = F.floor((as_of_epoch(as_of) - epoch("last_at")) / 86400)
    return rows.select("repo", "file_id", "change_count", "partners", "churn_pct", "coupling_pct", "hhi", F.when(F.col("hhi") > 0, 1 / F.when(F.col("hhi") > 0, F.col("hhi"))).alias("effective_authors"), days.alias("days_since"), (F.col("churn_pct") * F.col("coupling_pct") * (1 + F.col("hhi")) * weight).alias("risk"))


def clusters(edges: DataFrame, rounds: int = LABEL_ROUNDS) -> DataFrame:
    """(repo, node, label): synchronous label propagation over (repo, a, b, weight); ties go to the smallest label.

    Labels start as the nodes' ids. Every round is a stored step, so that lineage stays short; it ends early when no
    label moves. A node's votes are summed before one is picked, without a window.
    """
    both = step(edges.select("repo", F.col("a").alias("node"), F.col("b").alias("peer"), "weight").unionByName(edges.select("repo", F.col("b").alias("node"), F.col("a").alias("peer"), "weight")), "edges")
    labels = both.select("repo", "node").distinct().withColumn("label", F.col("node"))
    stored = None
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "peer"), ["repo", "peer"]).groupBy("repo", "node", "label").agg(F.round(F.sum("weight"), 9).alias("votes"))
        after = votes.groupBy("repo", "node").agg(F.max_by("label", F.struct("votes", -F.col("label"))).alias("label"))
        after = step(after.join(labels.withColumnRenamed("label", "old"), ["repo", "node"], "left").withColumn("moved", ~F.col("label").eqNullSafe(F.col("old"))).drop("old"), "labels")
        if stored is not None:
            discard(stored)
        labels, stored = after.select("repo", "node", "label"), after
        if after.where("moved").isEmpty():
            break
    return labels
