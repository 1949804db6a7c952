import bisect
import random

import pytest
from pyspark.sql import functions as F

from lockstep.operators import dominance
from lockstep.operators.backtest import prompts
from lockstep.operators.replay import measure_rates, replay_measures
from lockstep.operators.running import numbered, running

REQUESTS, POINTS = "id long, key string, at long, below long", "key string, ordinal long, at long"


@pytest.mark.parametrize("width", [2, 5, 64])
def test_as_by_looking_at_all_points(spark, monkeypatch, width):
    monkeypatch.setattr(dominance, "WIDTH", width)
    rng = random.Random(width)
    points = [(rng.choice("aab"), rng.randint(0, 60), rng.randint(0, 40)) for _ in range(150)] + [("c", 5, 5), (None, 1, 1), ("a", None, 1), ("a", 1, None)]
    asked = [(k, rng.choice("aabcd"), rng.randint(-1, 42), rng.randint(-1, 62)) for k in range(200)] + [(1, "a", 20, 30), (900, None, 5, 5), (901, "a", None, 5), (902, "a", 5, None)]
    got = dominance.latest_below(spark.createDataFrame(asked, REQUESTS), spark.createDataFrame(points, POINTS)).collect()

    def best(key, at, below):
        good = [o for k, o, t in points if None not in (key, at, below, k, o, t) and k == key and t <= at and o < below]
        return max(good, default=None)

    order = lambda rows: sorted(rows, key=str)
    assert order((r.id, r.key, r.at, r.below, r.ordinal) for r in got) == order((*a, best(*a[1:])) for a in asked)
    none = spark.createDataFrame([], POINTS)
    assert [r.ordinal for r in dominance.latest_below(spark.createDataFrame(asked[:2], REQUESTS), none).collect()] == [None, None]


def test_one_key_with_100_000_points_and_requests(spark):
    n = 100_000
    points = spark.range(n).select(F.lit("k").alias("key"), F.pmod(F.xxhash64("id"), F.lit(10 * n)).alias("ordinal"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).alias("at"))
    asked = spark.range(n).select("id", F.lit("k").alias("key"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n)).alias("at"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10 * n)).alias("below"))
    got = dominance.latest_below(asked, points)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == n
    by_time = sorted((r.at, r.ordinal) for r in points.collect())
    seen, at = [], 0
    for r in sorted(rows.values(), key=lambda r: r.at):
        while at < n and by_time[at][0] <= r.at:
            bisect.insort(seen, by_time[at][1])
            at += 1
        k = bisect.bisect_left(seen, r.below)
        assert r.ordinal == (seen[k - 1] if k else None)


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), k, rng.randint(0, 5)) for k in range(300)]
    table = spark.createDataFrame(rows, "key string, nr long, v long")
    got = {r.nr: (r.before, r.n) for r in numbered(running(table, ["key"], F.floor(F.col("nr") / 20), ["nr"], F.col("v"), "before"), ["key"], F.floor(F.col("nr") / 50), ["nr"], "n").collect()}
    for key, nr, _ in rows:
        earlier = [v for k, m, v in rows if k == key and m < nr]
        assert got[nr] == (sum(earlier), len(earlier) + 1)


def test_measures_replayed_by_brute_force(spark):
    rng = random.Random(7)
    baskets = [(rng.choice("xy"), k, sorted(rng.sample(range(7), rng.randint(1, 4)))) for k in range(70)]
    table = spark.createDataFrame(baskets, "repo string, commit_id long, items array<long>").withColumn("committed_at", F.timestamp_seconds(F.col("commit_id") * 900_000))
    keys = ["confidence_ab", "confidence_ba", "jaccard"]
    got = replay_measures(table, keys, k=2, warmup=5)
    want = []
    for repo in "xy":
        past = []
        for _, k, items in (b for b in baskets if b[0] == repo):
            if len(past) >= 5 and len(items) >= 2:
                for seed in items:
                    n_a = sum(seed in p for p in past)
                    for measure in keys:
                        scores = []
                        for other in {x for p in past if seed in p for x in p} - {seed}:
                            n_ab, n_b = sum(seed in p and other in p for p in past), sum(other in p for p in past)
                            score = {"confidence_ab": n_ab / n_a, "confidence_ba": n_ab / n_b, "jaccard": n_ab / (n_a + n_b - n_ab)}[measure]
                            if n_ab >= 2:
                                scores.append((-round(score, 9), other))
                        places = [n for n, (_, x) in enumerate(sorted(scores)[:2], 1) if x in items]
                        want.append((repo, k, seed, len(items) - 1, measure, len(places), places[0] if places else None))
            past.append(items)
    assert sorted(map(tuple, got.select("repo", "commit_id", "seed", "targets", "measure", "hits", "first_rank").collect()), key=str) == sorted(want, key=str)
    assert measure_rates(got, 2).count() == 6
    nrs = {(r.repo, r.commit_id): r.nr for r in prompts(table).collect()}
    assert all(nrs[repo, k] == 1 + sum(b[0] == repo and b[1] < k for b in baskets) for repo, k, _ in baskets)


def test_ceilings_among_many_releases_of_one_version_keep_no_steps(spark):
    import os

    from lockstep.operators.dependencies import resolve_versions
    from lockstep.sinks.steps import shared_dir

    rng = random.Random(3)
    stamp = lambda name: F.timestamp_seconds(F.col(name)).alias(name)
    dated = [(k, rng.randint(0, 50)) for k in range(300)]
    commits = spark.createDataFrame([("r", f"{k:040x}", k, at) for k, at in dated], "repo string, sha string, commit_id long, committed_at long").select("repo", "sha", "commit_id", stamp("committed_at"))
    tagged = [("r", rng.choice(["1.1", "1.2", "2"]), k, at if k % 7 else None) for k, at in dated[:250]] + [("r", "7", 299, 0), ("r", "1", 9999, 1)]
    tags = spark.createDataFrame(tagged, "repo string, version_key string, commit_id long, tagged_at long").select("repo", "version_key", "commit_id", stamp("tagged_at"))
    wanted = [(k, rng.randint(0, 50), rng.choice(["<1.2", "<2", "<3", "v7", "^7", "<1", "<1.1"]), f"{k:040x}"[: rng.choice([5, 40])] if k % 5 == 0 else None) for k in range(400)]
    rows = spark.createDataFrame(wanted, "id long, consumer_at long, version string, dep_sha string").select("id", stamp("consumer_at"), F.lit("r").alias("dep_repo"), "version", "dep_sha")
    before = set(os.listdir(shared_dir(spark)))
    got = {r.id: (r.dep_commit_id, r.resolution, r.adoption_seconds) for r in resolve_versions(rows, tags, commits).collect()}
    at, order = dict(dated), {"1": (1,), "1.1": (1, 1), "1.2": (1, 2), "2": (2,), "3": (3,), "7": (7,)}

    def want(k, consumer, version, sha):
        found, how = None, None
        if sha and len(sha) >= 12 and k in at:
            found, how = k, "sha"
        elif version in ("v7", "^7"):
            found, how = 299, "floor" if version[0] == "^" else "tag"
        elif version[0] == "<":
            good = [(order[v], c) for _, v, c, t in tagged if order[v] < order[version[1:]] and (t is None or t <= consumer)]
            found, how = (max(good)[1], "ceiling") if good else (None, None)
        fine = found in at and at[found] <= consumer
        return (found, how, consumer - at[found]) if fine else (None, None, None)

    assert got == {row[0]: want(*row) for row in wanted} and len({how for _, how, _ in got.values()}) == 5
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before}
    assert not left & {"step-order", "step-numbers", "step-level-0", "step-climb"}


def test_measures_replayed_in_turns_keep_no_offers(spark, monkeypatch):
    import os

    from lockstep.operators import replay
    from lockstep.sinks.steps import shared_dir

    rng = random.Random(8)
    baskets = [(rng.choice("xy"), k, sorted(rng.sample(range(7), rng.randint(1, 4)))) for k in range(70)]
    table = spark.createDataFrame(baskets, "repo string, commit_id long, items array<long>").withColumn("committed_at", F.timestamp_seconds(F.col("commit_id") * 900_000))
    rows = lambda: sorted(map(tuple, replay.replay_measures(table, ["confidence_ab", "jaccard"], k=2, warmup=5).collect()), key=str)
    once, made = rows(), []
    monkeypatch.setattr(replay, "EVENTS", 200)
    monkeypatch.setattr(replay, "OFFERS", 100)
    told = replay._told
    monkeypatch.setattr(replay, "_told", lambda *x: made.append(1) or told(*x))
    before = set(os.listdir(shared_dir(spark)))
    assert rows() == once and len(made) > 2
    left = [name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark))) - before]
    assert left.count("step-hits") == len(made) and not {"step-offers", "step-versions"} & set(left)
