"""Derived tables, stored and replaced by repository: baskets, margins, pairs and their scores.

Later stages read what earlier ones stored, so that the raw changes are read once. A rebuild of some repositories replaces just
their partitions; a rebuild that is run again gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coupling as c
from ..schemas import MIN_PAIR_SUPPORT
from ..sinks import tables
from ..sinks.steps import shared_dir
from ..sources import roles
from ..sources.roles import AS_OF
from .catalog import _FORMULAS, BASE
from .registry import query

TABLES = ("baskets", "margins", "pairs", "metrics")


def rebuild(changes: DataFrame, commits: DataFrame, folder: str, as_of: str, repos: DataFrame | None = None, keys: list[str] | None = None, min_support: int = MIN_PAIR_SUPPORT) -> None:
    """Stores TABLES below folder, of all repositories or of those in repos (repo)."""
    spark = changes.sparkSession
    if repos is not None:
        changes, commits = (x.join(repos.select("repo"), "repo", "left_semi") for x in (changes, commits))
    at = {name: f"{folder}/{name}" for name in TABLES}
    rows = c.baskets(changes, commits)
    tables.replace(rows, at["baskets"])
    rows = read(spark, folder, "baskets", rows.schema)
    if repos is not None:
        rows = rows.join(repos.select("repo"), "repo", "left_semi")
    margins = c.file_marginals(changes, commits)
    tables.replace(margins, at["margins"])
    pairs = c.pairs(rows, min_support, as_of)
    tables.replace(pairs, at["pairs"])
    stored = [read(spark, folder, name, x.schema) for name, x in (("pairs", pairs), ("margins", margins))]
    if repos is not None:
        stored = [x.join(repos.select("repo"), "repo", "left_semi") for x in stored]
    tables.replace(c.scored(stored[0], stored[1], c.basket_population(rows), keys), at["metrics"])


def read(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}")


@query("stored_metrics", BASE + f" select repo, a, b, n_ab, round({_FORMULAS['jaccard']}, 6) as jaccard, round({_FORMULAS['npmi']}, 6)::double as npmi from cells")
def stored_metrics(s, d):
    """Rebuilds all repositories, then one of them again, and reads the stored scores."""
    import uuid

    folder = f"{shared_dir(s)}/derived-{uuid.uuid4().hex}"
    changes, commits = roles.changes(s, d), roles.commits(s, d)
    rebuild(changes, commits, folder, AS_OF, keys=["jaccard", "npmi"])
    rebuild(changes, commits, folder, AS_OF, s.createDataFrame([("BUILDING",)], "repo string"), ["jaccard", "npmi"])
    return read(s, folder, "metrics").select("repo", "a", "b", "n_ab", F.round("jaccard", 6).alias("jaccard"), F.round("npmi", 6).alias("npmi"))
