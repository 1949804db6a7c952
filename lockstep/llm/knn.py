"""Exact top-k search by a Voronoi join, for the largest inner products.

Vectors are quantised to integers, so that scores are exact. Rows of equal vectors form one class with its k + 1
smallest ids, which is all that any query can return of them. Pivots split query and data classes into Voronoi
cells. Query cells are merged into groups of about group_queries; a group's summary is its centre c and the radius
R of its members around c. A cell's summary is the k + 1 smallest distances d of its members to its pivot p. With
these, by the Cauchy-Schwarz inequality,

    q.x >= c.p - R |p| - (|c| + R) d      gives a group's bound: the (k + 1)th largest over all cells, a score
                                          that k + 1 classes reach for every query of the group;
    q.x <= min(c.x + R |x|, c.p + R |p| + (|c| + R) d)    tells which data classes may reach it.

Only those are replicated to the group, in blocks of about block_rows, and each (group, block) is solved locally;
the blocks' best lists are merged by query. Where vectors have no clusters the bounds let everything through and
the join becomes a blocked scan of all rows for each group of queries; results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, materialise

K = 20
PIVOTS = 256
GROUP_QUERIES = 1024
BLOCK_ROWS = 16_384


def quantised(embedding: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component as long; null where the vector or a component is null or not finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(fine, F.transform(embedding, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


def _matrix(column) -> np.ndarray:
    """An Arrow or pandas column of long arrays as a matrix; shorter vectors count as padded with zeros."""
    rows = column.to_pylist() if isinstance(column, pa.Array) else column
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, max(0, width - a.shape[1]))))[:, : max(width, a.shape[1])]


def products(data: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where sums stay below 2^53, else in 64-bit integers; ValueError beyond those."""
    width = max(data.shape[1], queries.shape[1])
    data, queries = _wide(data, width), _wide(queries, width)
    most = float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(width, 1)
    if most >= 2.0**63:
        raise ValueError("inner products may exceed 64-bit integers: use a smaller factor")
    if most < 2.0**53:
        return (data.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    return data @ queries.T


class Pivots(NamedTuple):
    at: np.ndarray  # float64, pivots x width

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distance, rows) with rows as wide as pivots."""
        width = max(self.at.shape[1], rows.shape[1])
        x, p = _wide(rows, width).astype(np.float64), _wide(self.at, width)
        square = np.maximum((x**2).sum(1)[:, None] - 2 * x @ p.T + (p**2).sum(1), 0)
        cell = square.argmin(1)
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(1)), x


def _assign(shared):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            cell, dist, _ = shared.value.nearest(_matrix(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(dist)], names=[*batch.schema.names, "cell", "dist"])

    return run


def merged_groups(pivots: np.ndarray, counts: dict[int, int], radii: dict[int, float], size: int) -> tuple[dict[int, tuple[int, int]], np.ndarray, np.ndarray]:
    """(cell to first group and number of groups, centres, radii): neighbouring cells together, large ones split by hash."""
    top = max(1, int(len(pivots) ** 0.5))
    far = ((pivots[:, None] - pivots[None, :top]) ** 2).sum(2).argmin(1)
    order = sorted(counts, key=lambda c: (far[c], c))
    runs, held = [], 0
    for c in order:
        if not runs or held + counts[c] > size:
            runs.append([])
            held = 0
        runs[-1].append(c)
        held += counts[c]
    of_cell, centres, reach = {}, [], []
    for cells in runs:
        weight = np.array([counts[c] for c in cells], float)
        centre = (pivots[cells] * weight[:, None]).sum(0) / weight.sum()
        radius = max(np.linalg.norm(pivots[c] - centre) + radii[c] for c in cells)
        parts = max(1, -(-int(weight.sum()) // size)) if len(cells) == 1 else 1
        for c in cells:
            of_cell[c] = (len(centres), parts)
        centres += [centre] * parts
        reach += [radius] * parts
    return of_cell, np.array(centres), np.array(reach)


def group_bounds(pivots: np.ndarray, near: dict[int, list[float]], centres: np.ndarray, radii: np.ndarray, n: int) -> np.ndarray:
    """For each group a score that n classes reach for each of its queries; minus infinity where there are fewer."""
    cells = np.array([c for c, ds in near.items() for _ in ds], np.int64)
    dists = np.array([d for ds in near.values() for d in ds])
    if len(cells) < n:
        return np.full(len(centres), -np.inf)
    dots, size = centres @ pivots.T, np.linalg.norm(pivots, axis=1)
    out = np.empty(len(centres))
    for g, (c, r) in enumerate(zip(centres, radii, strict=True)):
        low = dots[g, cells] - r * size[cells] - (np.linalg.norm(c) + r) * dists
        out[g] = np.partition(low, len(low) - n)[len(low) - n]
    return out


class Plan(NamedTuple):
    pivots: Pivots
    centres: np.ndarray
    radii: np.ndarray
    bounds: np.ndarray
    blocks: int


def _replicate(shared):
    """Rows (group, block, vec, ids) of each data class for every group whose bound it may reach."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in rows:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0)).astype(np.float64)
            width = max(x.shape[1], plan.centres.shape[1])
            x, centres, p = _wide(x, width), _wide(plan.centres, width), _wide(plan.pivots.at, width)
            cell, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            direct = x @ centres.T + np.linalg.norm(x, axis=1)[:, None] * plan.radii
            by_cell = (p @ centres.T + np.linalg.norm(p, axis=1)[:, None] * plan.radii)[cell] + (np.linalg.norm(centres, axis=1) + plan.radii) * dist[:, None]
            upper = np.minimum(direct, by_cell)
            for g in range(len(centres)):
                at = np.flatnonzero(upper[:, g] * (1 + 1e-9 * np.sign(upper[:, g])) + 1e-6 >= plan.bounds[g])
                if len(at):
                    part = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g), pa.int32()), part.column(4), part.column(0), part.column(1)], names=["group", "block", "vec", "ids"])

    return run


_TOP = "vec array<long>, block int, top array<struct<below: long, vec_id: long, same: boolean>>"


def solve(data: pd.DataFrame, queries: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n best (minus score, id, whether of the query's own vector) of each query among data."""
    if not len(data) or not len(queries):
        return pd.DataFrame({"vec": [], "block": [], "top": []}, dtype=object)
    ids = data["ids"].to_numpy()
    least = np.fromiter((x[0] for x in ids), np.int64, len(ids))
    scores = products(_matrix(data["vec"]), _matrix(queries["vec"]))
    few = min(n, len(data))
    cut = np.partition(scores, len(data) - few, axis=0)[len(data) - few]
    own = {tuple(v): k for k, v in enumerate(data["vec"])}
    tops = []
    for j, vec in enumerate(queries["vec"]):
        at = np.flatnonzero(scores[:, j] >= cut[j])
        at = at[np.lexsort([least[at], -scores[at, j]])][:n]
        mine = own.get(tuple(vec), -1)
        rows = sorted((-int(scores[k, j]), int(i), bool(k == mine)) for k in at for i in ids[k])
        tops.append([{"below": b, "vec_id": i, "same": s} for b, i, s in rows[:n]])
    return pd.DataFrame({"vec": list(queries["vec"]), "block": data["block"].iloc[0], "top": tops})


def search(embeddings: DataFrame, is_query: Column, k: int = K, factor: float = 64.0, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all rows of embeddings (vec_id, embedding) for each that is_query.

    Scores are integer inner products of the quantised vectors, ties go to smaller ids, and a query's own row is no
    candidate. Rows with a null id, or whose vector is null or holds a null, NaN or infinite component, take no part.
    Every row is a candidate and, if it asks, a query of its own, also where rows repeat an id or a vector. Shorter vectors count as padded with zeros. Other columns are
    ignored; with fewer than k candidates all are given; an empty table gives an empty result. Where components are so large
    that a score might not fit into 64 bits the job fails instead of giving wrapped scores.
    """
    spark = embeddings.sparkSession
    batches(spark, 4096)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), factor).alias("vec"), is_query.alias("asks")).where("vec_id is not null and vec is not null")
    asked = rows.where("asks").select("vec_id", "vec")
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    classes = materialise(best.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    wanted = asked.groupBy("vec").agg(F.count(F.lit(1)).alias("n"))
    n_classes = classes.count()
    found = classes.select("vec", F.xxhash64("vec").alias("h")).orderBy("h", "vec").limit(pivots).select("vec").toArrow()
    if not n_classes:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    at = Pivots(_matrix(found.column("vec").combine_chunks()).astype(np.float64))
    share = spark.sparkContext.broadcast(at)  # at most pivots rows
    blocks = max(1, -(-n_classes // block_rows))
    cells = materialise(classes.mapInArrow(_assign(share), "vec array<long>, ids array<long>, cell int, dist double"), "cells")
    queries = materialise(wanted.mapInArrow(_assign(share), "vec array<long>, n long, cell int, dist double"), "queries")
    of_cell = queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).toPandas()
    if not len(of_cell):
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    nth = F.row_number().over(Window.partitionBy("cell").orderBy("dist"))
    near = cells.select("cell", "dist").withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("cell").agg(F.collect_list("dist").alias("near")).toPandas()

    where, centres, radii = merged_groups(at.at, dict(zip(of_cell["cell"], of_cell["n"], strict=True)), dict(zip(of_cell["cell"], of_cell["radius"], strict=True)), group_queries)
    bounds = group_bounds(at.at, dict(zip(near["cell"], near["near"], strict=True)), centres, radii, k + 1)
    plan = spark.sparkContext.broadcast(Plan(at, centres, radii, bounds, blocks))
    block = F.pmod(F.xxhash64("vec"), F.lit(blocks)).cast("int")
    data = cells.withColumn("block", block).mapInArrow(_replicate(plan), "group int, block int, vec array<long>, ids array<long>")
    first = F.element_at(F.create_map(*[F.lit(int(x)) for c, (g, _) in where.items() for x in (c, g)]), F.col("cell"))
    parts = F.element_at(F.create_map(*[F.lit(int(x)) for c, (_, m) in where.items() for x in (c, m)]), F.col("cell"))
    group = (first + F.pmod(F.xxhash64("vec", F.lit("part")), parts)).cast("int").alias("group")
    grouped = queries.select(group, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec")
    tops = data.groupBy("group", "block").cogroup(grouped.groupBy("group", "block")).applyInPandas(lambda a, b: solve(a, b, k + 1), _TOP)

    merged = lambda x: F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k + 1).alias("top")
    tops = tops.groupBy("vec", F.pmod("block", F.lit(64)).alias("part")).agg(merged(0)).groupBy("vec").agg(merged(0))
    out = asked.join(tops, "vec").select(F.col("vec_id").alias("query_id"), "top")
    own = F.array_position(F.transform("top", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), F.lit(True))  # the query's own row, once
    other = F.filter("top", lambda x, i: i + 1 != own)
    out = out.select("query_id", F.posexplode(F.slice(other, 1, k)).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.below")).alias("score"))


def op1_knn(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod("vec_id", F.lit(20)) == 0)


OP1_SQL = """
with rows as (
  select row_number() over () as nr, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as vec from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.vec::double[], c.vec::double[])::bigint as score
  from rows q join rows c on q.nr <> c.nr where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20"""
