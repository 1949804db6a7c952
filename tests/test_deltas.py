import random

from pyspark.sql import functions as F

from lockstep.operators import coupling as c
from lockstep.sinks import deltas as d

SCHEMA = "repo string, commit_id long, committed_at timestamp, author_id long, items array<long>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(spark, commits):
    return spark.createDataFrame([(repo, k, items) for repo, k, items in commits], "repo string, commit_id long, items array<long>").select("repo", "commit_id", F.timestamp_seconds("commit_id").alias("committed_at"), F.lit(1).cast("long").alias("author_id"), "items")


def same_as_rebuilt(spark, folder, commits):
    whole = make(spark, commits)
    assert rows(d.pair_counts(spark, folder, 1)) == rows(c.pair_counts(whole, 1).select("repo", "a", "b", "n_ab"))
    assert rows(d.counts(spark, folder, "margins")) == rows(c.basket_margins(whole).select("repo", "file_id", "pair_change_count"))
    assert rows(d.counts(spark, folder, "population")) == rows(c.basket_population(whole).select("repo", "n_total"))


def test_equal_to_a_full_rebuild(spark, tmp_path):
    rng = random.Random(4)
    folder, commits, nr = str(tmp_path / "state"), [], 0
    for turn in range(3):
        came = []
        for _ in range(rng.randint(0, 25)):
            nr += 1
            came.append((rng.choice("xyz"), nr, sorted(rng.sample(range(9), rng.randint(1, 4)))))
        gone = rng.sample(commits, min(len(commits), rng.randint(0, 9)))
        batch = make(spark, [*came, *commits[:3]]), make(spark, gone).select("repo", "commit_id")
        d.apply_changes(spark, folder, *batch)
        if turn == 1:  # the same batch again changes nothing
            assert not d.apply_changes(spark, folder, *batch)
        commits = [x for x in [*commits, *came] if x not in gone]
    same_as_rebuilt(spark, folder, commits)


def test_a_repository_that_goes_whole_and_comes_back(spark, tmp_path):
    folder, none = str(tmp_path / "state"), make(spark, []).select("repo", "commit_id")
    commits = [("x", 1, [1, 2]), ("x", 2, [1, 2, 3]), ("y", 3, [1, 2])]
    d.apply_changes(spark, folder, make(spark, commits), none)
    d.apply_changes(spark, folder, make(spark, []), make(spark, commits[:2]).select("repo", "commit_id"))
    same_as_rebuilt(spark, folder, commits[2:])
    d.apply_changes(spark, folder, make(spark, commits), none)
    same_as_rebuilt(spark, folder, commits)


def test_a_failure_half_way_counts_once(spark, tmp_path, monkeypatch):
    folder, none = str(tmp_path / "state"), make(spark, []).select("repo", "commit_id")
    commits = [("x", k, [k % 3, 3 + k % 2]) for k in range(1, 12)]
    d.apply_changes(spark, folder, make(spark, commits[:5]), none)
    write, calls = d._write, []

    def fails(table, path):
        if f"{folder}/margins" == path:
            raise RuntimeError("lost")
        calls.append(path)
        write(table, path)

    monkeypatch.setattr(d, "_write", fails)
    try:
        d.apply_changes(spark, folder, make(spark, commits), none)
    except RuntimeError:
        pass
    assert f"{folder}/pairs" in calls
    monkeypatch.setattr(d, "_write", write)
    d.apply_changes(spark, folder, make(spark, commits), none)
    same_as_rebuilt(spark, folder, commits)


def test_only_touched_partitions_are_read(spark, tmp_path):
    folder, none = str(tmp_path / "state"), make(spark, []).select("repo", "commit_id")
    d.apply_changes(spark, folder, make(spark, [(r, k, [k, k + 1]) for r in "xyz" for k in range(30)]), none)
    table = d.stored(spark, f"{folder}/pairs", d._TABLES["pairs"][3])
    some = d._touched(table, spark.createDataFrame([("y", 3), ("y", 4)], "repo string, bucket int"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(repo" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all("repo=y" in name and ("bucket=3" in name or "bucket=4" in name) for name in [r[0] for r in some.select(F.input_file_name()).distinct().collect()])
