"""Raw commit logs as tables, read from the export of a version-control log with raw and numstat blocks.

The export is what `log -z --raw --numstat` writes with a format of \\x01 and ten fields divided by \\x1f: sha, parents,
author name, email and time, committer name, email and time, subject, body. Spark's text reader splits it at \\x01, so
that a row is a commit with all its records, and large exports are read in parallel. A commit's records are divided by
NUL: `:modes shas STATUS`, then one path, or two for renames and copies; and `added<TAB>removed<TAB>path`, where an empty
path means that the old and the new one follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD, NUL, HEAD = "\x1f", "\x00", "\x01"


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each commit of the export; bytes that are no UTF-8 become replacement characters."""
    return spark.read.option("lineSep", HEAD).text(path).select(F.expr("make_valid_utf8(value)").alias("value")).where("trim(value) <> ''")


def _fields(rows: DataFrame) -> tuple[DataFrame, F.Column]:
    f = F.split(F.regexp_replace(F.substring_index("value", NUL, 1), r"\n+$", ""), FIELD)
    return rows.where(F.size(f) >= 9), f


def parse_commits(rows: DataFrame) -> DataFrame:
    """Heads of records; those of fewer than nine fields are dropped, emails lower-cased, bad times put at the epoch."""
    rows, f = _fields(rows)
    time = lambda k: F.coalesce(F.try_to_timestamp(F.trim(F.get(f, F.lit(k)))), F.timestamp_seconds(F.lit(0)))
    parents = F.filter(F.split(F.get(f, F.lit(1)), " "), lambda x: x != "")
    get = lambda k: F.get(f, F.lit(k))
    return rows.select(
        F.trim(get(0)).alias("sha"), parents.alias("parents"), get(2).alias("author_name"), F.lower(F.trim(get(3))).alias("author_email"), time(4).alias("authored_at"), get(5).alias("committer_name"),
        F.lower(F.trim(get(6))).alias("committer_email"), time(7).alias("committed_at"), get(8).alias("subject"), F.coalesce(get(9), F.lit("")).alias("body"), (F.size(parents) > 1).alias("is_merge"),
    )


def _number(text: str) -> int:
    return int(text) if text.isdigit() else 0


def changes_of(items: list[str]) -> list[tuple]:
    """(path, change_type, old_path, similarity, insertions, deletions, is_binary) of a commit's records, by first appearance.

    The two blocks are an outer join by path: a path of one block alone is modified, or has no lines. Broken ends are left out.
    """
    raw: dict[str, tuple] = {}
    lines: dict[str, tuple] = {}
    left = iter(items)
    for item in left:
        item = item.lstrip("\n")
        if item.startswith(":"):
            status = item.rpartition(" ")[2].strip() or "M"
            old = next(left, None) if status[0].upper() in "RC" else None
            path = next(left, None)
            if path is not None:
                raw[path] = (status[0].upper(), old, int(status[1:]) if status[1:].isdigit() else None)
                lines.setdefault(path, None)
        elif item.count("\t") >= 2:
            added, removed, path = item.split("\t", 2)
            if not path:
                next(left, None)
                path = next(left, None)
            if path is not None:
                binary = "-" in (added, removed)
                lines[path] = (0, 0, True) if binary else (_number(added), _number(removed), False)
    return [(path, *raw.get(path, ("M", None, None)), *(told or (0, 0, False))) for path, told in lines.items()]


_CHANGES = "sha string, nr long, path string, change_type string, old_path string, similarity long, insertions long, deletions long, is_binary boolean"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]


def parse_changes(rows: DataFrame) -> DataFrame:
    """(sha, nr, path, change_type, old_path, similarity, insertions, deletions, is_binary), a path once in each commit."""
    rows, f = _fields(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(sha, nr, *change) for sha, items in zip(*(c.to_pylist() for c in batch.columns), strict=True) for nr, change in enumerate(changes_of(items))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(_TYPES)], names=[c.split()[0] for c in _CHANGES.split(", ")])

    items = F.slice(F.split("value", NUL), F.lit(2), F.size(F.split("value", NUL)))
    return rows.select(F.trim(F.get(f, F.lit(0))).alias("sha"), items.alias("items")).mapInArrow(run, _CHANGES)


def authors(commits: DataFrame) -> DataFrame:
    """One author for each email: the first name that is not empty, and all names."""
    rows = commits.where("author_email <> ''").withColumn("name", F.nullif(F.trim("author_name"), F.lit("")))
    return rows.groupBy(F.col("author_email").alias("email")).agg(F.min_by("name", F.when(F.col("name").isNotNull(), F.col("committed_at"))).alias("display_name"), F.sort_array(F.collect_set("name")).alias("known_names"))


def tags(rows: DataFrame, repo: str) -> DataFrame:
    """(repo, name, commit_sha, main_sha, tagged_at) of lines `name<TAB>type<TAB>sha<TAB>peeled type<TAB>peeled sha<TAB>time<TAB>main sha`.

    An annotated tag counts by what it points at; tags of anything but commits are left out.
    """
    p = F.split("value", "\t")
    get = lambda k: F.nullif(F.get(p, F.lit(k)), F.lit(""))
    kind, sha = F.coalesce(get(3), get(1)), F.coalesce(get(4), get(2))
    return rows.where(kind == "commit").select(F.lit(repo).alias("repo"), get(0).alias("name"), sha.alias("commit_sha"), get(6).alias("main_sha"), F.try_to_timestamp(get(5)).alias("tagged_at"))
