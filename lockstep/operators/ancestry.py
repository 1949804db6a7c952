"""Which commits the tips of a repository reach, in a number of joins that grows with the logarithm of its depth.

Every commit has one parent that it follows, the first; these make a forest. Pointer doubling over the forest gives, after k
rounds, each commit's 2^k-th ancestor in it, and its generation: how many first parents there are down to the root. The jumps
of all rounds are stored once. The ancestors of any set of commits within the forest are then one join for each stored
jump, the longest first; further parents of merges start the same again, only from commits not yet reached, so that there
is another pass for each level to which merged branches are nested, and not for each generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.steps import discard, step

KEY = ["repo", "sha"]
#: Joins that one stored step of a pass spans.
SPAN = 6


@dataclass
class Ancestry:
    """jumps[k]: (repo, sha, up), the 2^k-th ancestor along first parents, where there is one; generations: (repo, sha, generation);
    merged: (repo, sha, parent_sha), parents that are not first."""

    jumps: list[DataFrame]
    generations: DataFrame
    merged: DataFrame

    @property
    def rounds(self) -> int:
        return len(self.jumps)


def ancestry(parents: DataFrame) -> Ancestry:
    """The stored jumps of parents (repo, child_sha, parent_sha, and nr of a parent if known).

    The first parent is that of the smallest nr, else of the smallest sha. A commit without a row of its own is a root. Rows may
    repeat; nulls in any of the three columns are left out. Parents that form a cycle fail the job.
    """
    rows = parents.where("repo is not null and child_sha is not null and parent_sha is not null")
    order = F.struct("nr", "parent_sha") if "nr" in parents.columns else F.col("parent_sha")
    first = step(rows.groupBy("repo", F.col("child_sha").alias("sha")).agg(F.min_by("parent_sha", order).alias("up")), "jump-0")
    merged = rows.select("repo", F.col("child_sha").alias("sha"), "parent_sha").distinct().join(first.withColumnRenamed("up", "parent_sha"), [*KEY, "parent_sha"], "left_anti")
    merged = step(merged, "merged")
    roots = first.select("repo", F.col("up").alias("sha")).distinct().join(first, KEY, "left_anti")
    jumps, far = [], step(first.select(*KEY, F.col("up").alias("at"), F.lit(1).cast("long").alias("generation")).unionByName(roots.select(*KEY, F.col("sha").alias("at"), F.lit(0).cast("long").alias("generation"))), "far")
    jump, most = first, first.count().bit_length()
    while True:
        jumps.append(jump)
        # a commit's pointer at its 2^k-th ancestor, or at the root with the way there, goes on from where it points
        there = far.select("repo", F.col("sha").alias("at"), F.col("at").alias("_at"), F.col("generation").alias("_more"))
        before = far
        far = step(far.join(there, ["repo", "at"], "left").select(*KEY, F.coalesce("_at", "at").alias("at"), (F.col("generation") + F.coalesce("_more", F.lit(0))).alias("generation")), "far")
        discard(before)
        jump = step(jump.join(jump.select("repo", F.col("sha").alias("up"), F.col("up").alias("_up")), ["repo", "up"]).select(*KEY, F.col("_up").alias("up")), f"jump-{len(jumps)}")
        if jump.isEmpty():
            discard(jump)
            return Ancestry(jumps, far.select(*KEY, "generation"), merged)
        if len(jumps) > most:  # longer than all commits in a row
            raise ValueError("parents form a cycle")


def reached(tips: DataFrame, known: Ancestry) -> DataFrame:
    """(repo, sha) of the tips (repo, sha) and all their ancestors, each once, as a stored table."""
    seen = front = step(tips.select(*KEY).where("repo is not null and sha is not null").distinct(), "tips")
    started = False
    while True:
        found = front
        for k in reversed(range(known.rounds)):
            up = found.join(known.jumps[k], KEY).select("repo", F.col("up").alias("sha"))
            found = found.unionByName(up).distinct()
            if k % SPAN == 0:
                found = step(found, "reached")
        new = step(found.join(seen, KEY, "left_anti"), "new") if started else found
        seen = step(seen.unionByName(new), "seen") if started else found
        started = True
        front = new.join(known.merged, KEY).select("repo", F.col("parent_sha").alias("sha")).distinct()
        front = step(front.join(seen, KEY, "left_anti"), "front")
        if front.isEmpty():
            return seen
