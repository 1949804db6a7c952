from pyspark.sql import functions as F

from lockstep.sinks.stages import Stage, run_stages


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def stages(log):
    def sums(inputs, repos):
        log.append(("sums", sorted(r.repo for r in repos.collect())))
        return inputs["changes"].groupBy("repo").agg(F.sum("v").alias("v"))

    def doubled(inputs, repos):
        log.append(("doubled", sorted(r.repo for r in repos.collect())))
        return inputs["sums"].select((F.col("v") * 2).alias("v"), "repo")

    return [Stage("sums", ("changes", "notes"), sums), Stage("doubled", ("sums",), doubled)]


def test_only_what_changed_is_rebuilt(spark, tmp_path):
    log, folder = [], str(tmp_path / "state")
    make = lambda data: spark.createDataFrame(data, "repo string, v long")
    data, notes = [("a", 1), ("a", 1), ("b b/c", 5), ("d", 0)], make([("a", 0)])
    run = lambda: run_stages(spark, folder, stages(log), {"changes": make(data), "notes": notes})
    read = lambda name: rows(spark.read.parquet(f"{folder}/{name}").select("repo", "v"))
    assert run() == {"sums": 3, "doubled": 3} and read("doubled") == [("a", 4), ("b b/c", 10), ("d", 0)]
    data.reverse()
    log.clear()
    assert run() == {"sums": 0, "doubled": 0} and not log
    data.remove(("a", 1))
    assert run() == {"sums": 1, "doubled": 1} and log == [("sums", ["a"]), ("doubled", ["a"])]
    assert read("doubled") == [("a", 2), ("b b/c", 10), ("d", 0)]
    notes = make([("a", 0), ("d", 1)])
    # the input changed, its result did not
    assert run() == {"sums": 1, "doubled": 0}
    data.remove(("b b/c", 5))
    assert run() == {"sums": 1, "doubled": 1} and read("sums") == [("a", 1), ("d", 0)] == [(r, v // 2) for r, v in read("doubled")]


def test_affected_repositories_are_built_too(spark, tmp_path):
    edges = spark.createDataFrame([("lib", "app"), ("lib", "web"), ("x", "y")], "dep string, repo string")
    built = []

    def build(inputs, repos):
        built.append(sorted(r.repo for r in repos.collect()))
        return inputs["edges"].select(F.col("dep").alias("repo"), F.col("repo").alias("consumer")).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))

    affected = lambda inputs, changed: inputs["edges"].join(changed, "repo", "left_semi").select(F.col("dep").alias("repo"))
    stage = [Stage("impact", ("edges",), build, affected)]
    assert run_stages(spark, str(tmp_path / "s"), stage, {"edges": edges}) == {"impact": 2}
    more = edges.unionByName(spark.createDataFrame([("lib", "app")], edges.schema))
    assert run_stages(spark, str(tmp_path / "s"), stage, {"edges": more}) == {"impact": 1} and built == [["lib", "x"], ["lib"]]
    assert rows(spark.read.parquet(str(tmp_path / "s" / "impact")).select("repo", "n")) == [("lib", 3), ("x", 1)]
