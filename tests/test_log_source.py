import datetime as dt

import pytest
from pyspark.sql import functions as F

from lockstep.sources.history import parse_changes, parse_commits, records
from lockstep.sources.log_source import CommitLog, LogReader, LogStream, _records, _split_renames, read_log


def record(sha, parents="", at="2024-01-01T00:00:00Z", items=()):
    head = "\x1f".join([sha, parents, "Ann", "ANN@x.org", at, "Cyd", "c@x.org", at, f"AB-1: {sha}", "body\n\nFixes: #3\n"])
    return "\x01" + "\x00".join([head, *items]) + "\x00"


ITEMS = ["\n:1 1 a b M", "a/b.py", ":1 1 a b R060", "old.py", "new.py", ":1 1 a b C055", "x.py", "y.py", "3\t1\ta/b.py", "2\t0\t", "old.py", "new.py", "-\t-\tlogo.png"]


@pytest.fixture()
def logs(tmp_path):
    for repo in ("r one", "q"):
        for segment in (1, 2):
            folder = tmp_path / "logs" / f"repo={repo.replace(' ', '%20')}" / f"segment={segment}"
            folder.mkdir(parents=True)
            text = "".join(record(f"{repo[0]}{segment}{k:03}", "p1 p2" if k % 10 == 0 else "p1", f"2024-0{segment}-01T00:{k % 60:02}:00Z", ITEMS if k % 3 == 0 else ()) for k in range(200))
            (folder / "part-0").write_text(text)
            (folder / "_SUCCESS").write_text("")
    return str(tmp_path / "logs")


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_as_the_text_reader(spark, logs, split):
    got = read_log(spark, logs, merges="true", rename_similarity="0", split_bytes=str(split)).persist()
    for repo in ("r%20one", "q"):
        text = records(spark, f"{logs}/repo={repo}/*/part-0")
        want = sorted(map(tuple, parse_commits(text).collect()), key=str)
        own = got.where(F.col("repo") == repo.replace("%20", " "))
        heads = own.select("sha", "parents", "author_name", "author_email", "authored_at", "committer_name", "committer_email", "committed_at", "subject", F.regexp_replace("body", r"\n+$", ""), "is_merge")
        assert sorted(map(tuple, heads.collect()), key=str) == want and len(want) == 400
        changes = own.select("sha", F.inline("changes"))
        assert sorted(map(tuple, changes.collect()), key=str) == sorted(map(tuple, parse_changes(text).drop("nr").collect()), key=str)
    order = [r.sha for r in got.where("repo = 'q'").orderBy("nr").collect()]
    assert order == sorted(order)
    got.unpersist()


def test_options(spark, logs):
    newest = read_log(spark, logs, order="newest", rename_similarity="58").where("repo = 'q'").orderBy("nr").collect()
    assert len(newest) == 360 and newest[0].sha == "q2199" and not any(r.is_merge for r in newest)
    kinds = [(c.path, c.change_type, c.insertions) for c in next(r for r in newest if r.sha == "q1003").changes]
    assert kinds == [("a/b.py", "M", 3), ("new.py", "R", 2), ("y.py", "A", 0), ("logo.png", "M", 0)]
    assert _split_renames(("n", "R", "o", 40, 1, 2, False), 50) == [("n", "A", None, None, 1, 2, False), ("o", "D", None, None, 0, 0, False)]
    with pytest.raises(Exception, match="oldest or newest"):
        read_log(spark, logs, order="random").count()


def test_filters_are_pushed(spark, logs):
    rows = read_log(spark, logs, merges="true").where("repo = 'q' and committed_at >= '2024-02-01 00:30:00' and committed_at < '2024-02-01 00:40:00' and sha like 'q%'")
    assert rows.count() == sum(30 <= k % 60 < 40 for k in range(200))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "like" in plan.lower() or "StartsWith" in plan
    assert "committed_at#" not in plan.split("Filter")[1].split("\n")[0]
    reader = CommitLog({"path": logs})._of(LogReader)
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, StringContains

    left = [StringContains(("sha",), "q")]
    assert list(reader.pushFilters([EqualTo(("repo",), "q"), GreaterThanOrEqual(("committed_at",), dt.datetime(2024, 2, 1)), *left])) == left
    assert {p.repo for p in reader.partitions()} == {"q"} and sum(1 for p in reader.partitions() for b in reader.read(p) for _ in range(b.num_rows)) == 180


def test_records_of_ranges_cover_the_file(tmp_path):
    text = b"junk" + b"\x01a\x00" + b"\x01" + b"b" * 5000 + b"\x00" + b"\x01c\x00\x01\x00"
    (tmp_path / "f").write_bytes(text)
    for split in (1, 3, 7, 100, 10_000):
        found = []
        with open(tmp_path / "f", "rb") as file:
            for at in range(0, len(text), split):
                found += _records(file, at, min(at + split, len(text)))
        assert [r.rstrip(b"\x00") for _, r in found] == [b"a", b"b" * 5000, b"c", b""] and [text[at : at + 1] for at, _ in found] == [b"\x01"] * 4


def test_tips_as_offsets(tmp_path):
    folder = tmp_path / "repo=r" / "s1"
    folder.parent.mkdir()
    folder.write_text(record("a") + record("b"))
    stream = CommitLog({"path": str(tmp_path)})._of(LogStream)
    shas = lambda a, b: [s for p in stream.partitions(a, b) for batch in stream.read(p) for s in batch.column("sha").to_pylist()]
    first = stream.latestOffset()
    assert first["tips"]["r"][2] == "b" and shas(stream.initialOffset(), first) == ["a", "b"] and shas(first, first) == []
    folder.write_text(record("a") + record("b") + record("c") + record("d").rstrip("\x00"))
    second = stream.latestOffset()
    assert second["tips"]["r"][2] == "c" and shas(first, second) == ["c"]
    (tmp_path / "repo=r" / "s2").write_text(record("e"))
    folder.write_text(record("a") + record("b") + record("c") + record("d"))
    assert shas(second, stream.latestOffset()) == ["d", "e"]
    folder.write_text(record("a") + record("z") + record("c"))
    assert shas(first, stream.latestOffset()) == ["a", "z", "c", "e"]


def test_two_triggers_give_each_commit_once(spark, tmp_path):
    logs, out = tmp_path / "logs" / "repo=r", str(tmp_path / "out")
    logs.mkdir(parents=True)

    def trigger():
        run = read_log(spark, str(tmp_path / "logs"), stream=True).select("sha", "repo").writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        run.format("parquet").start(out).awaitTermination(120)
        return sorted(r.sha for r in spark.read.parquet(out).collect())

    (logs / "s1").write_text(record("a") + record("b"))
    assert trigger() == ["a", "b"]
    (logs / "s1").write_text(record("a") + record("b") + record("c"))
    (logs / "s2").write_text(record("d"))
    assert trigger() == ["a", "b", "c", "d"]
    assert trigger() == ["a", "b", "c", "d"]


def test_packed_segments_are_read_as_plain_ones(spark, logs, tmp_path):
    import gzip

    columns = ["repo", "sha", "parents", "committed_at", "changes"]
    rows = lambda folder: read_log(spark, folder, merges="true", split_bytes="1000").orderBy("repo", "nr").select(columns).collect()
    plain = rows(logs)
    for path in (tmp_path / "logs").glob("*/*/part-0"):
        text = path.read_bytes()
        half = text.index(b"\x01", len(text) // 2)
        (path.parent / "part-0.gz").write_bytes(gzip.compress(text[:half]))
        (path.parent / "part-1.gz").write_bytes(gzip.compress(text[half : half + 1]) + gzip.compress(text[half + 1 :]))
        path.rename(tmp_path / f"plain-{path.parent.parent.name}-{path.parent.name}")
    assert rows(logs) == plain and len(plain) == 800


def test_tips_of_packed_segments(tmp_path):
    import gzip

    packed = lambda *records: gzip.compress("".join(records).encode())
    folder = tmp_path / "repo=r"
    folder.mkdir()
    (folder / "s1.gz").write_bytes(packed(record("a"), record("b")))
    stream = CommitLog({"path": str(tmp_path)})._of(LogStream)
    shas = lambda a, b: [s for p in stream.partitions(a, b) for batch in stream.read(p) for s in batch.column("sha").to_pylist()]
    first = stream.latestOffset()
    assert shas(stream.initialOffset(), first) == ["a", "b"] and shas(first, first) == []
    (folder / "s1.gz").write_bytes(packed(record("a"), record("b")) + packed(record("c")))
    (folder / "s2.gz").write_bytes(packed(record("d")))
    second = stream.latestOffset()
    assert shas(first, second) == ["c", "d"]
    (folder / "s2.gz").write_bytes(packed(record("e")))
    assert shas(second, stream.latestOffset()) == ["a", "b", "c", "e"]


def test_exports_take_little_room_in_any_number_of_turns(spark, sf_dir, tmp_path, monkeypatch):
    import os

    from lockstep.plans import sources

    def export(lines):
        monkeypatch.setattr(sources, "LINES", lines)
        folder = f"{tmp_path}/{lines}"
        sources.log_of_orders(spark, sf_dir, folder)
        names = [f"{d}/{f}" for d, _, found in os.walk(folder) for f in found if f.startswith("part-")]
        return read_log(spark, folder, merges="true"), names

    (one, few), (turns, many) = export(10_000_000), export(1000)
    assert all(name.endswith(".gz") for name in few) and len({name.split("/segment=")[1].split("/")[0] for name in many}) == 6
    tables = sum(os.path.getsize(f"{sf_dir}/{name}.parquet") for name in ("orders", "lineitem", "customer"))
    assert sum(map(os.path.getsize, few)) < 4 * tables
    key = F.substring_index("subject", " ", -1).cast("long")
    rows = lambda found: [(r.repo, r.key, r.parents, r.changes) for r in found.withColumn("key", key).orderBy("repo", "nr").collect()]
    assert rows(one) == rows(turns) and [r[:2] for r in rows(one)] == sorted(r[:2] for r in rows(one))
    assert len(rows(one)) == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_segments_are_moved_into_the_log_of_the_stream(spark, sf_dir, tmp_path):
    import os

    from lockstep.plans import sources

    folder, out = str(tmp_path / "log"), str(tmp_path / "out")
    before = set(os.listdir(sources.shared_dir(spark)))
    seen = sources.read_log_batches(spark, sf_dir, folder, out, str(tmp_path / "check"))
    assert seen.count() == seen.select("sha").distinct().count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    left = [name for name in set(os.listdir(sources.shared_dir(spark))) - before if name.startswith("log-both")]
    copies = [f"{d}/{f}" for name in left for d, _, found in os.walk(f"{sources.shared_dir(spark)}/{name}") for f in found if f.startswith("part-")]
    assert len(left) == 1 and copies == []


def test_bounds_are_pushed_into_packed_segments(spark, logs, tmp_path):
    import gzip

    for path in (tmp_path / "logs").glob("*/*/part-0"):
        path.with_name("part-0.gz").write_bytes(gzip.compress(path.read_bytes()))
        path.rename(tmp_path / f"plain-{path.parent.parent.name}-{path.parent.name}")
    rows = read_log(spark, logs, merges="true").where("repo = 'q' and committed_at >= '2024-02-01 00:30:00' and committed_at < '2024-02-01 00:40:00'")
    assert rows.count() == sum(30 <= k % 60 < 40 for k in range(200))
    assert "committed_at#" not in rows._jdf.queryExecution().executedPlan().toString().split("Filter")[-1].split("\n")[0]
