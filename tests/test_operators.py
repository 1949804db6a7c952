from pyspark.sql import functions as F

from lockstep.functions import text
from lockstep.operators import coupling as c
from lockstep.operators import graph as g
from lockstep.schemas import BUMPS, CHANGES, COMMITS, DECLARED, clamp_limit


def history(spark):
    """Files 1 and 2 together ten times, 1 alone five, 2 alone three, 3 alone seven times."""
    plan = [[1, 2]] * 10 + [[1]] * 5 + [[2]] * 3 + [[3]] * 7
    day = lambda i: f"timestamp '2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00'"
    commits = " union all ".join(f"select 'r' repo, {i}L commit_id, {i % 2}L author_id, {day(i)} committed_at, false is_merge, false is_replay, {len(f)}L n_files" for i, f in enumerate(plan))
    rows = [("r", i, f, 2.0, 1.0, "M") for i, files in enumerate(plan) for f in files]
    return spark.createDataFrame(rows, CHANGES), spark.sql(commits).to(spark.createDataFrame([], COMMITS).schema)


def test_designed_history(spark):
    changes, commits = history(spark)
    assert c.population(commits).first().n_total == 25
    marginals = {r.file_id: r.pair_change_count for r in c.file_marginals(changes, commits).collect()}
    assert marginals == {1: 15, 2: 13, 3: 7}
    assert [(r.a, r.b, r.n_ab) for r in c.pair_counts(c.baskets(changes, commits)).collect()] == [(1, 2, 10)]
    row = c.scored(c.pair_counts(c.baskets(changes, commits)), c.file_marginals(changes, commits), c.population(commits), ["confidence_ab", "confidence_ba"]).first()
    assert (row.confidence_ab, row.confidence_ba) == (10 / 15, 10 / 13)
    assert c.population(commits, cap=1).first().n_total == 15


def test_closure_and_owner(spark):
    files = spark.createDataFrame([(1, "a/b/c.py"), (2, "top.md")], "file_id long, path string")
    got = {(r.file_id, r.dir_path, r.depth) for r in c.closure(files).collect()}
    assert got == {(1, "", 0), (1, "a", 1), (1, "a/b", 2), (2, "", 0)}
    modules = spark.createDataFrame([("a",), ("a/b",), ("a/bx",)], "module string")
    assert [tuple(r) for r in g.owning_module(files, modules).collect()] == [(1, "a/b")]


def test_impact_and_chain(spark):
    declared = spark.createDataFrame([("packager", "signer", "m"), ("runtime", "packager", "m")], DECLARED)
    bumps = spark.sql("select id, 'packager' consumer, 'signer' dep, timestamp '2024-03-01' - make_dt_interval(int(10 * id)) consumer_at, timestamp '2024-02-28' - make_dt_interval(int(10 * id)) upstream_at, 'v' version, 'declared' tier from range(5)").to(spark.createDataFrame([], BUMPS).schema)
    edges = g.edge_scores(declared, bumps, "2024-03-01")
    got = {(r.source, r.target): (r.bump_count, r.median_days, r.score) for r in edges.collect()}
    assert got == {("signer", "packager"): (5, 2.0, 0.8), ("packager", "runtime"): (0, None, 0.5)}
    assert [tuple(r) for r in g.chains(edges, "signer").collect()] == [("signer>packager>runtime", 2, 0.4)]
    assert [r.path for r in g.chains(g.upstream(edges), "runtime").collect()] == ["runtime>packager>signer"]


def test_drift_npmi(spark):
    rows = spark.createDataFrame([(4.0, 4.0, 4.0, 4.0), (5.0, 5.0, 5.0, 4.0), (0.0, 1.0, 1.0, 4.0)], "a double, b double, c double, d double")
    assert [r[0] for r in rows.select(c.drift_npmi(*(F.col(x) for x in "abcd"))).collect()] == [1.0, 1.0, None]


def test_clusters(spark):
    edges = spark.createDataFrame([("r", 1, 2, 1.0), ("r", 2, 3, 1.0), ("r", 1, 3, 1.0), ("r", 7, 8, 1.0), ("r", 8, 9, 1.0), ("r", 7, 9, 1.0)], "repo string, a long, b long, weight double")
    got = {r.node: r.label for r in c.clusters(edges).collect()}
    assert len({got[1], got[2], got[3]}) == 1 and len({got[7], got[8], got[9]}) == 1 and got[1] != got[7]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda col: one.select(col).first()[0]
    keys = {"1.2.0": "1.2", "sub/v1.2.0": "1.2", "release-1.12.1": "1.12.1", "release_0_10": "0.10", "1.0.0-rc1": "1-rc1", "*": None, "latest": None, "": None}
    assert {k: value(text.version_key(F.lit(k))) for k in keys} == keys
    kinds = {"v1.2.3": "tag", "2.0.0-rc.1": "tag", "^1.2.0": "range", "*": "range", "": "range", "a" * 40: "commit", "v0.0.0-20200101000000-abcdefabcdef": "commit"}
    kinds |= {"1.x": "range", "1.0.0.Final": "range", '"==1.2.3"': "tag", "pin abcdefabcdef": "commit"}
    assert {k: value(text.classify(F.lit(k))[0]) for k in kinds} == kinds and value(text.classify(F.lit("pin abcdefabcdef"))[1]) == "abcdefabcdef"
    edges = {">=2,<3": ("2", "3"), "1.0.0-linux": ("1.0.0-linux", None), "[1.0,2.0)": ("1.0", None), "<=4.1.*": (None, "4.1"), "": (None, None)}
    assert {k: tuple(value(x) for x in text.bounds(F.lit(k))) for k in edges} == edges
    assert value(text.ordinal(F.lit("2.10"))) == [2, 10] and value(text.ordinal(F.lit("1-rc1"))) is None
    assert value(text.issue_keys(F.lit("AB-1234: rotate the seed (#99)"))) == ["AB-1234"] and value(text.pr_refs(F.lit("fix (#99)"))) == ["99"]
    assert value(text.issue_keys(F.lit("a-1234567 API-version AB-1234567"))) == ["AB-1234567"]
    assert value(text.trailers(F.lit("x\nChange-Id: I1\nnote: y\nchange-id:I1\nFIXES: "))) == ["change-id: I1"]
    assert [(f.kind, f.key) for f in value(text.facts(F.lit("AB-1 (#2)"), F.lit(None).cast("string")))] == [("issue_key", "AB-1"), ("pr_ref", "2")]
    assert [value(text.stem(F.lit(p))) for p in ("spec_runner.rb", "foo-test.js", "x/FooImpl.java", "test.py")] == ["runner", "foo", "foo", "test"]
    assert value(text.concept_tokens(F.lit("HTTPServerError.java"))) == ["http", "server"]
    assert value(text.extension(F.lit("a/b/C.PY"))) == "py" and value(text.extension(F.lit(".env"))) == ""
    assert value(text.concept_tokens(F.lit("x/ImmutableList.java"))) == ["immutable", "list"]
    assert value(text.stem(F.lit("pkg/core_test.go"))) == "core"
    assert [clamp_limit(x) for x in (None, 0, 5, 9999)] == [50, 1, 5, 1000]


def test_stream(spark, sf_dir, tmp_path):
    from lockstep.streaming.calls import append, hourly, read_calls

    query = hourly(read_calls(spark, sf_dir)).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    total = spark.sql("select sum(calls) from hours").first()[0]
    assert total == spark.read.parquet(f"{sf_dir}/events.parquet").count()
    append(read_calls(spark, sf_dir), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == total


def test_whole_tables_behind_the_subsets(spark, sf_dir):
    from lockstep.plans.catalog import QUERIES

    count = lambda name: QUERIES[name](spark, sf_dir).count()
    rows = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    assert count("bump_list") == rows("lineitem")
    assert count("prefix_match") == rows("orders")
    assert count("longest_prefix_owner") == rows("part")
