import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm.knn import group_bounds, op1_knn, products, search


def brute(rows, asks, k):
    """All pairs in plain Python."""
    fine = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for row, (i, v) in enumerate(fine):
        if not asks(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for other, (j, w) in enumerate(fine) if other != row)
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = search(df, F.pmod("vec_id", F.lit(5)) == 0, k, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def test_clusters_ties_and_copies(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 4
    rows = [(i, [float(x) for x in (centres[i % 6] + rng.normal(size=8) * 0.05).astype(np.float32)]) for i in range(240)]
    rows += [(i, [0.5] * 8) for i in range(240, 330)]  # copies, more than k
    rows += [(i, [0.0] * 8) for i in range(330, 360)]
    for options in ({}, {"pivots": 6, "group_queries": 8, "block_rows": 40}, {"pivots": 1, "group_queries": 1, "block_rows": 1000}):
        assert run(spark, rows, 7, **options) == brute(rows, lambda i: i % 5 == 0, 7)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [-0.001, 3.0]), (10, [1.0, 2.0, 0.5]), (11, []), (15, [3e6, -3e6])]
    assert run(spark, rows, 3) == brute(rows, lambda i: i is not None and i % 5 == 0, 3)
    assert run(spark, [], 3) == []
    assert run(spark, [(5, [1.0])], 3) == []
    assert run(spark, [(1, [1.0])], 3) == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    data, queries = rng.normal(size=(300, 5)), rng.normal(size=(20, 5)) * 0.1 + 1
    pivots = data[:7]
    dist = np.linalg.norm(data[:, None] - pivots, axis=2)
    cell = dist.argmin(1)
    near = {c: sorted(dist[cell == c, c])[:4] for c in range(7)}
    centre = queries.mean(0)
    radius = np.linalg.norm(queries - centre, axis=1).max()
    bound = group_bounds(pivots, near, centre[None], np.array([radius]), 4)[0]
    assert (np.sort(queries @ data.T, axis=1)[:, -4] >= bound - 1e-9).all()


@pytest.mark.parametrize("big", [100, 10**12])
def test_products_are_exact(big):
    a = np.array([[big, -3], [5, big]], np.int64)
    b = np.array([[1, 2, 0]], np.int64)
    assert products(a, b).ravel().tolist() == [big - 6, 5 + 2 * big]


def test_overflow_fails():
    with pytest.raises(ValueError, match="64-bit"):
        products(np.full((1, 2), 10**12, np.int64), np.full((1, 2), 10**12, np.int64))


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding] if r.embedding is not None else None) for r in table]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op1_knn(spark, sf_dir).collect())
    assert got == brute(rows, lambda i: i % 20 == 0, 20)


def test_repeated_rows_are_candidates_each(spark):
    same = [1.0, 2.0]
    rows = [(1, [1.0, 1.0]), (2, same), (2, same), (3, [0.5, 0.5]), (20, same), (20, same), (40, [-1.0, 0.0])]
    got = search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.pmod("vec_id", F.lit(20)) == 0, k=5, block_rows=2)
    hits = {}
    for r in got.orderBy("query_id", "rank").collect():
        hits.setdefault((r.query_id, r["rank"]), []).append(r.vec_id)
    # each of the two rows of 20 sees the other, both rows of 2, and all else
    assert [hits[20, n] for n in (1, 2, 3, 4, 5)] == [[2, 2], [2, 2], [20, 20], [1, 1], [3, 3]]
    assert [hits[40, n] for n in (1, 2, 3, 4, 5)] == [[3], [1], [2], [2], [20]]
