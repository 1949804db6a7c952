import random
import time

import pytest
from pyspark.sql import functions as F

from lockstep.operators.ancestry import ancestry, reached

PARENTS = "repo string, child_sha string, parent_sha string, nr int"


def closure(tips, parents):
    seen, front = set(), list(tips)
    while front:
        one = front.pop()
        if one not in seen:
            seen.add(one)
            front += [(one[0], p) for r, c, p, _ in parents if (r, c) == one]
    return sorted(seen)


def test_random_histories(spark):
    rng = random.Random(2)
    parents = []
    for repo in "qr":
        for k in range(1, 90):
            some = {rng.randrange(max(0, k - 12), k) for _ in range(rng.choice([1, 1, 1, 2, 3]))}
            if rng.random() > 0.06:
                parents += [(repo, f"c{k}", f"c{p}", nr) for nr, p in enumerate(rng.sample(sorted(some), len(some)))]
    table = spark.createDataFrame([*parents, parents[0], (None, "x", "y", 0), ("q", "c1", None, 0)], PARENTS)
    known = ancestry(table)
    for tips in ([("q", "c89"), ("r", "c60"), ("q", "c80"), ("q", "c80"), ("r", "unknown")], []):
        got = reached(spark.createDataFrame(tips, "repo string, sha string"), known)
        assert sorted(map(tuple, got.collect())) == closure(tips, parents)
    first = {(r, c): p for r, c, p, nr in parents if nr == 0}
    for r in known.generations.collect():
        n, at = 0, r.sha
        while (r.repo, at) in first:
            n, at = n + 1, first[r.repo, at]
        assert r.generation == n


def test_a_chain_of_100_000_commits_in_20_rounds(spark):
    n = 100_000
    chain = spark.range(1, n).select(F.lit("r").alias("repo"), F.format_string("c%06d", "id").alias("child_sha"), F.format_string("c%06d", F.col("id") - 1).alias("parent_sha"))
    known = ancestry(chain)
    assert known.rounds <= 20
    tips = spark.createDataFrame([("r", f"c{n - 1:06}")], "repo string, sha string")
    got = reached(tips, known)
    assert got.count() == n == got.distinct().count()
    assert known.generations.agg(F.max("generation")).first()[0] == n - 1


def test_cycles_fail(spark):
    with pytest.raises(ValueError, match="cycle"):
        ancestry(spark.createDataFrame([("r", "a", "b", 0), ("r", "b", "a", 0)], PARENTS))
