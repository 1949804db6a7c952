from pyspark.sql import functions as F

from lockstep.operators.backtest import replay
from lockstep.sources.history import authors, changes_of, parse_changes, parse_commits, records, tags

HEAD = lambda *f: "\x01" + "\x1f".join(f)
TIMES = ("2024-01-01T00:00:00Z", "Cyd", "c@x.org", "2024-01-01T01:00:00+02:00")
LOG = "\x00".join([
    HEAD("s1", "p0", "Ann", "ANN@x.org ", *TIMES, "AB-1: start", "first line\n\nFixes: #3\nChange-Id: I1\n"),
    "\n:100644 100644 a1 b1 M", "a/b.py", ":100644 100644 a2 b2 R090", "old.py", "new.py", ":000000 100644 0 b3 A", "logo.png",
    "3\t1\ta/b.py", "0\t0\t", "old.py", "new.py", "-\t-\tlogo.png", "5\t0\tonly\tnumstat.txt", ":100644 0 a4 0 D", "gone.py", "",
]) + "\x00".join([HEAD("s2", "p0 p1", "", "ann@x.org", "not a time", "", "", "neither", "merge"), ""]) + HEAD("too", "few")


def test_log(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    rows = records(spark, str(tmp_path / "log"))
    commits = {r.sha: r for r in parse_commits(rows).collect()}
    assert set(commits) == {"s1", "s2"} and commits["s2"].is_merge and not commits["s1"].is_merge
    assert commits["s1"].author_email == "ann@x.org" and commits["s2"].committed_at.year == 1970 and commits["s1"].committer_name == "Cyd"
    assert commits["s1"].body.split("\n")[2:4] == ["Fixes: #3", "Change-Id: I1"]
    changes = {r.path: r for r in parse_changes(rows).collect()}
    assert list(changes) == ["a/b.py", "new.py", "logo.png", "only\tnumstat.txt", "gone.py"] and {r.sha for r in changes.values()} == {"s1"}
    assert (changes["new.py"].change_type, changes["new.py"].similarity, changes["new.py"].old_path) == ("R", 90, "old.py")
    assert changes["logo.png"].is_binary and changes["logo.png"].insertions == 0 and changes["a/b.py"].insertions == 3
    assert (changes["only\tnumstat.txt"].change_type, changes["gone.py"].change_type, changes["gone.py"].deletions) == ("M", "D", 0)
    assert [(r.email, r.display_name) for r in authors(parse_commits(rows)).collect()] == [("ann@x.org", "Ann")]


def test_broken_ends():
    assert changes_of([":1 1 a b M"]) == [] and changes_of(["1\t2\t", "old"]) == [] and changes_of([]) == []


def test_tags(spark):
    rows = spark.createDataFrame([("v1\ttag\tt1\tcommit\tc1\t2024-01-01T00:00:00Z\tm1",), ("v2\tcommit\tc2\t\t\tbad\t",), ("blob\tblob\tb1\t\t\t\t",)], "value string")
    assert [(r.name, r.commit_sha, r.main_sha, r.tagged_at is None) for r in tags(rows, "r").orderBy("name").collect()] == [("v1", "c1", "m1", False), ("v2", "c2", None, True)]


def test_replay_looks_back_only(spark):
    rows = spark.range(6).select(F.lit("r").alias("repo"), F.col("id").alias("commit_id"), F.timestamp_seconds("id").alias("committed_at"), F.lit(1).alias("author_id"), F.expr("array(1L, 2L)").alias("items"))
    got = {(r.commit_id, r.seed): r.hits for r in replay(rows, warmup=1).collect()}
    assert got == {(i, s): int(i >= 2) for i in range(1, 6) for s in (1, 2)}
