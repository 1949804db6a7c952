import random

import pytest
from pyspark.sql import functions as F

from lockstep.operators import dependencies as dep
from lockstep.operators import mining as m
from lockstep.operators import reading as r
from lockstep.operators.coupling import clusters
from lockstep.sinks import tables as t


def rows(df, *names):
    return sorted((tuple(x[n] for n in names) for x in df.collect()), key=str)


def test_store_and_replace(spark, tmp_path):
    path = str(tmp_path / "pairs")
    schema = "a long, repo string"
    assert t.stored(spark, path, schema).count() == 0
    t.replace(spark.createDataFrame([(1, "x"), (2, "y")], schema), path)
    t.replace(spark.createDataFrame([(3, "y"), (4, "z")], schema), path)
    assert rows(t.stored(spark, path, schema), "repo", "a") == [("x", 1), ("y", 3), ("z", 4)]
    t.append(spark.createDataFrame([(9, "x")], schema), path)
    assert t.stored(spark, path, schema).where("repo = 'x'").count() == 2
    t.reset(spark, [path])
    assert t.stored(spark, path, schema).count() == 0


def test_loading_again_adds_nothing(spark):
    parsed = spark.createDataFrame([("r", "s1"), ("r", "s1"), ("r", "s2"), ("q", "s1")], "repo string, sha string")
    first = t.new_commits(parsed, parsed.limit(0))
    assert rows(first, "repo", "sha") == [("q", "s1"), ("r", "s1"), ("r", "s2")] and t.new_commits(parsed, first).count() == 0
    changes = spark.createDataFrame([("r", "s1", 2, "a", "D"), ("r", "s1", 1, "a", "M"), ("r", "s9", 1, "a", "M")], "repo string, sha string, nr long, path string, kind string")
    assert rows(t.new_changes(changes, first), "sha", "path", "kind") == [("s1", "a", "M")]


def test_sweep_and_tips(spark):
    commits = spark.createDataFrame([("r", x) for x in "abcde"] + [("q", "z")], "repo string, sha string")
    reach = spark.createDataFrame([("r", x) for x in "abc"], "repo string, sha string")
    assert rows(t.unreachable(commits, reach), "sha") == [("d",), ("e",)] and rows(t.sweep(commits, reach), "sha") == [("a",), ("b",), ("c",), ("z",)]
    parents = spark.createDataFrame([("r", "c", "b"), ("r", "b", "a"), ("r", "e", "d"), ("r", "d", "c")], "repo string, child_sha string, parent_sha string")
    assert rows(t.beyond_tips(commits.where("repo = 'r'"), commits.where("sha = 'c'"), parents), "sha") == [("d",), ("e",)]


def test_gating(spark):
    repos = spark.createDataFrame([("a", True, "ready", "1", "1"), ("b", True, "ready", "2", "1"), ("c", True, "ingesting", "2", "1"), ("d", False, "ready", "2", "1"), ("e", True, None, None, None)], "repo string, is_enabled boolean, ingest_status string, head_sha string, mark string")
    assert rows(t.stale_repos(repos, "mark"), "repo") == [("b",), ("e",)]
    assert rows(t.stale_repos(repos, "mark", repos.where("repo <> 'e'"), force=True), "repo") == [("a",), ("b",)]


def test_merge_repos(spark):
    schema = "host string, full_name string, provider string, description string, stargazers long, raw string, name string"
    old = spark.createDataFrame([("h", "o/a", "github", "d", 5, '{"x":1}', "a"), ("h", "o/b", "github", "d", 5, "{}", "b")], schema)
    new = spark.createDataFrame([("h", "o/a", "git", None, 0, "{}", "A"), ("h", "o/c", "git", None, 0, "{}", "c")], schema)
    got = {x.full_name: x for x in t.merge_repos(old, new).collect()}
    assert set(got) == {"o/a", "o/b", "o/c"} and tuple(got["o/a"])[2:] == ("git", "d", 5, '{"x":1}', "A") and got["o/b"].stargazers == 5 and got["o/c"].stargazers == 0


def test_tags_and_replays(spark):
    commits = spark.createDataFrame([("r", "s1", 1, "p1"), ("r", "s2", 2, "p1"), ("r", "s3", 3, "p3"), ("r", "s4", 4, None)], "repo string, sha string, commit_id long, patch_id string")
    tags = spark.createDataFrame([("r", "v1.2.0", "s1", "s2"), ("r", "nightly", "gone", None)], "repo string, name string, commit_sha string, main_sha string")
    assert rows(t.load_tags(tags, commits), "name", "commit_id", "main_commit_id", "version_key") == [("nightly", None, None, None), ("v1.2.0", 1, 2, "1.2")]
    assert rows(t.replays(commits, commits.where("sha in ('s1')")).where("is_replay"), "sha") == [("s2",)]


def walk(changes):
    """Plain Python: file identity through renames, and aliases."""
    at, out, old_names = {}, [], {}
    for nr, path, old in changes:
        if old in at:
            file = at[old]
            if at.get(path) not in (None, file):
                file = at[path]
            else:
                at[path] = file
        else:
            file = at.setdefault(path, path)
        out.append((nr, path, file))
        if old and old != path:
            old_names.setdefault(old, file)
    return out, old_names


def test_identity_through_renames(spark):
    rng = random.Random(3)
    want, old_names, table = [], [], []
    for repo in "xy":
        changes = [(nr, f"p{rng.randint(0, 9)}", f"p{rng.randint(0, 9)}" if rng.random() < 0.4 else None) for nr in range(60)]
        resolved, names = walk(changes)
        want += [(repo, *x) for x in resolved]
        old_names += [(repo, k, v) for k, v in names.items()]
        table += [(repo, *x) for x in changes]
    got = t.file_identity(spark.createDataFrame(table, "repo string, nr long, path string, old_path string")).persist()
    assert rows(got, "repo", "nr", "path", "file") == sorted(want, key=str)
    assert rows(t.aliases(got), "repo", "old_path", "file") == sorted(old_names, key=str)
    asked = spark.createDataFrame([("x", "./p1"), ("x", "never")], "repo string, path string")
    files = {x.path: x.file for x in t.resolve_paths(asked, t.current_paths(got), t.aliases(got)).collect()}
    assert files["never"] is None and files["p1"] is not None


def test_runs(spark):
    runs = spark.sql("select * from values (1, 'running', timestamp '2024-01-01 00:00', timestamp '2024-01-01 09:00'), (2, 'running', timestamp '2024-01-01 00:00', null), (3, 'running', timestamp '2024-01-01 09:00', timestamp '2024-01-01 11:00'), (4, 'done', timestamp '2024-01-01 00:00', null) as (id, status, started_at, heartbeat_at)")
    assert rows(t.stale_runs(runs, "2024-01-01 12:00"), "id") == [(1,), (2,)]
    errors = spark.createDataFrame([(1, "a\nx"), (1, "a"), (1, "b"), (2, "c"), (2, "b"), (3, None)], "run_id long, error string")
    assert rows(t.failure_summary(errors), "run_id", "line", "n", "failed") == [(1, "a", 2, 3), (2, "b", 1, 2)]


def test_feedback_reopens(spark):
    schema = "fingerprint string, kind string, severity string, detail string, occurrences long, first_at long, last_at long, status string"
    old = spark.createDataFrame([("f", "gap", "low", "old", 2, 1, 5, "fixed"), ("g", "gap", "low", "g", 1, 1, 1, "wontfix")], schema)
    reports = spark.createDataFrame([("f", "gap", "high", "new", 9), ("f", "gap", "high", "new", 7), ("h", "gap", "low", "h", 8)], "fingerprint string, kind string, severity string, detail string, at long")
    got = t.upsert_feedback(old, reports)
    assert rows(got, "fingerprint", "occurrences", "first_at", "last_at", "status") == [("f", 4, 1, 9, "open"), ("g", 1, 1, 1, "wontfix"), ("h", 1, 8, 8, "open")]
    assert rows(t.feedback_summary(got), "severity", "total", "open", "closed") == [("low", 3, 2, 1)]


def propagate(edges, rounds=10):
    """Synchronous label propagation in plain Python; ties to the smallest label."""
    labels = {n: n for e in edges for n in e[:2]}
    for _ in range(rounds):
        votes = {n: {} for n in labels}
        for a, b, w in edges:
            votes[a][labels[b]] = votes[a].get(labels[b], 0) + w
            votes[b][labels[a]] = votes[b].get(labels[a], 0) + w
        after = {n: min(v, key=lambda k: (-round(v[k], 9), k)) for n, v in votes.items()}
        if after == labels:
            break
        labels = after
    return labels


def test_clusters_and_their_modules(spark):
    rng = random.Random(5)
    pairs = {}
    for base in (0, 10, 20):
        for _ in range(20):
            a, b = sorted(rng.sample(range(base, base + 7), 2))
            pairs[a, b] = rng.randint(1, 8) / 8
    pairs[3, 12] = 0.125
    edges = [(a, b, w) for (a, b), w in pairs.items()]
    table = spark.createDataFrame([("r", *e) for e in edges], "repo string, a long, b long, weight double")
    labels = clusters(table)
    want = propagate(edges)
    assert {x.node: x.label for x in labels.collect()} == want
    files = spark.createDataFrame([("r", n, f"d{n % 3}/x/f{n}.py" if n % 5 else "top.py", n * 7 % 11) for n in want], "repo string, file_id long, path string, change_count long")
    stats = m.cluster_stats(labels, table, files)
    numbers = {label: k for k, label in enumerate(sorted(set(want.values())))}
    groups = {}
    for n, label in want.items():
        groups.setdefault(label, []).append(n)
    top = lambda n: f"d{n % 3}" if n % 5 else ""
    expected = {}
    for label, members in groups.items():
        if len(members) < 2:
            continue
        for n in members:
            own = [(want[a if b == n else b] == label, w) for a, b, w in edges if n in (a, b)]
            expected[n] = (numbers[label], len(members), round(sum(w for same, w in own if same) / sum(w for _, w in own), 9), len({top(x) for x in members}))
    assert {x.file_id: (x.cluster_id, x.cluster_size, round(x.cohesion, 9), x.dirs_spanned) for x in stats.collect()} == expected
    found = m.cross_directory_modules(stats, files).collect()
    assert [x.cluster_size for x in found] == sorted((len(g) for g in groups.values() if len(g) >= 3 and len({top(n) for n in g}) > 1), reverse=True)
    first = found[0]
    members = next(g for label, g in groups.items() if numbers[label] == first.cluster_id)
    best = sorted(members, key=lambda n: (-(n * 7 % 11), n))[:6]
    assert first.sample_files == [f"d{n % 3}/x/f{n}.py" if n % 5 else "top.py" for n in best] and first.directories == sorted({top(n) for n in members})


def test_snapshot_gap_and_own_name(spark):
    revisions = spark.createDataFrame([("o/me", "go.mod", f"s{k}", k) for k in range(4)], "repo string, manifest string, sha string, at long")
    entries = [("s0", "x/a", "1"), ("s1", "x/a", "1"), ("s3", "x/a", "1"), ("s1", "x/b", "1"), ("s2", "x/b", "2"), ("s0", "z/me", "1")]
    table = spark.createDataFrame([("o/me", "go.mod", *e, "go") for e in entries], "repo string, manifest string, sha string, name string, raw string, ecosystem string")
    changed = dep.snapshot_changes(revisions, table)
    assert rows(changed, "sha", "name", "raw") == [("s0", "x/a", "1"), ("s0", "z/me", "1"), ("s1", "x/b", "1"), ("s2", "x/b", "2"), ("s3", "x/a", "1")]
    locked = spark.createDataFrame([("o/me", "", "s2", "go", "x/b", "2.0.1")], "repo string, dir string, sha string, ecosystem string, name string, version string")
    assert rows(dep.bumps(changed, locked), "sha", "name", "version", "tier") == [("s0", "x/a", "1", "declared"), ("s1", "x/b", "1", "declared"), ("s2", "x/b", "2.0.1", "locked"), ("s3", "x/a", "1", "declared")]


def test_scoped_rebuild_and_fingerprint(spark):
    declared = spark.createDataFrame([("c1", "p1"), ("c2", "p2")], "consumer string, dep string")
    bumps = spark.createDataFrame([("c1", "p3"), ("c1", None)], "consumer string, dep string")
    edges = spark.createDataFrame([("p4", "c1"), ("p5", "c2")], "source string, target string")
    changed = spark.createDataFrame([("c1",)], "repo string")
    assert rows(dep.affected_sources(changed, declared, bumps, edges), "source") == [("p1",), ("p3",), ("p4",)]
    one, two = dep.fingerprint(declared, "consumer", "dep").first(), dep.fingerprint(declared.orderBy(F.desc("dep")), "consumer", "dep").first()
    assert one == two != dep.fingerprint(declared.limit(1), "consumer", "dep").first()


@pytest.mark.parametrize("options,want", [({}, ["b", "a"]), ({"include_paused": True, "order_by": "name", "descending": False}, ["a", "b", "c"]), ({"search": "100%"}, ["b"]), ({"language": "go", "status": "ready"}, ["a"])])
def test_list_repos(spark, options, want):
    repos = spark.createDataFrame([("a", "o/a", "x", "go", "ready", 1, None, True), ("b", "o/b", "is 100% done", None, "ready", 2, 1, True), ("c", "o/c", None, "go", "failed", 3, 1, False)], "name string, full_name string, description string, primary_language string, ingest_status string, commit_count long, account_id long, is_enabled boolean")
    assert [x.name for x in r.list_repos(repos, **options).collect()] == want
    assert rows(r.get_repo(repos, "o/c"), "name") == [("c",)] and r.get_repo(repos, "none").count() == 0


def test_deleted_by_the_tree(spark):
    from lockstep.operators.coupling import deleted_files

    files = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("q", 3, "c"), ("q", 4, "d")], "repo string, file_id long, path string")
    changes = spark.createDataFrame([("r", 1, 1, "M"), ("r", 1, 2, "M"), ("q", 2, 3, "D"), ("q", 2, 4, "M")], "repo string, commit_id long, file_id long, change_type string")
    commits = spark.sql("select * from values ('r', 1L, 1L, timestamp '2024-01-01', false, false, 2L), ('q', 2L, 1L, timestamp '2024-01-01', false, false, 2L) as (repo, commit_id, author_id, committed_at, is_merge, is_replay, n_files)")
    tree = spark.createDataFrame([("r", "a")], "repo string, path string")
    assert rows(deleted_files(changes, commits, files=files, tree=tree), "file_id", "is_deleted") == [(1, False), (2, True), (3, True), (4, False)]


def test_a_registered_measure(spark):
    from lockstep.functions import measures as ms

    ms.register_measure(ms.Measure("twice", "similarity", lambda t: 2 * t.a), "double")
    try:
        df = spark.createDataFrame([(3, 5, 6, 100)], "n_ab long, n_a long, n_b long, n_total long")
        assert ms.with_measures(df, ["Double "]).first().twice == 6
    finally:
        ms.REGISTRY.pop("twice")
        ms.ALIASES.pop("double")


def test_a_batch_tried_again_is_stored_once(spark, tmp_path):
    from lockstep.streaming import calls as sc

    writer = {}

    class Stream:
        def __init__(self, rows):
            self.rows = rows

        writeStream = property(lambda self: self)

        def foreachBatch(self, f):
            writer["f"] = f
            return self

        option = trigger = lambda self, *a, **b: self

        def start(self):
            return self

    path = str(tmp_path / "calls")
    sc.append(Stream(None), path, str(tmp_path / "c"))
    batch = spark.sql("select 1L id, timestamp '2024-01-01 01:00' at union all select 2L, timestamp '2024-01-02 01:00'")
    for k in (0, 1, 1):
        writer["f"](batch, k)
    assert rows(spark.read.parquet(path).groupBy("batch").count(), "batch", "count") == [(0, 2), (1, 2)]
