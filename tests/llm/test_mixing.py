import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lockstep.llm.mixing import BLOCK_WORDS, mix_documents, mix_sources, op9_mixing, permuted, with_targets


def refill(sizes, weights, factor, most):
    """Targets by resharing the excess, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = factor * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5000, None: 20, "é": 300}, {"a": 7}, {"a": 0, "b": 9}, {f"s{i}": i * i for i in range(12)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in with_targets(df).collect()}
    assert got == pytest.approx(refill(sizes, (5, 2, 1), 1.5, 2))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5))).collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != sorted(got)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"w{i} " * (i % 37), f"s{i % 5}" if i % 11 else None, "x", i) for i in range(400)]
    rows += [(1000, None, "s1", "x", 0), (None, "no id here", "s1", "x", 0), (5, "w5 " * 5, "s0", "x", 5), (5, "w5 " * 5, "s0", "x", 5), (2000, "long " * 9000, "s2", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, taken long")


def test_mix(spark, docs):
    got = mix_sources(docs, block_words=8, shard_slots=100).documents.collect()
    assert len(got) == docs.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert target == pytest.approx(refill(sizes, (5, 2, 1), 1.5, 2))
    assert all(abs(taken[s] - target[s]) <= 17 for s in sizes)
    again = mix_sources(docs.repartition(5), block_words=8, shard_slots=100).documents.collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix_sources(docs.limit(0)).documents.count() == 0


def test_slots_visit_blocks_evenly(docs):
    mix = mix_sources(docs, block_words=8, shard_slots=100)
    rows = mix.slots.groupBy("source_key", "epoch", "block").count()
    assert rows.where("count > 1").count() == 0 and mix.slots.agg(F.max("epoch")).first()[0] == 1
    quotas = {r.source_key: r.quota for r in mix.sources.collect()}
    assert {r.source_key: r["count"] for r in mix.slots.groupBy("source_key").count().collect()} == {k: q for k, q in quotas.items() if q}


def test_documents(docs):
    mixed = mix_documents(docs, block_words=8, shard_slots=100)
    taken = mix_sources(docs, block_words=8, shard_slots=100).documents.where("taken > 0")
    assert mixed.columns == docs.columns
    words = sorted((r.doc_id or -1, len(r.text.split())) for r in mixed.collect())
    assert words == sorted((r.doc_id or -1, r.taken) for r in taken.collect())


def test_documents_keep_clashing_columns(spark):
    names = ["size", "words", "source_key", "nth", "taken", "offset", "segments", "block", "_mix_size"]
    rows = [(i, f"w{i} " * (1 + i % 9), f"s{i % 3}", *[f"{n}{i}" for n in names]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    mixed = mix_documents(docs, block_words=8, shard_slots=10)
    assert mixed.dtypes == docs.dtypes
    got = mixed.collect()
    assert len(got) > 30 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


def taken_by_hand(rows, slots, block_words):
    """Words taken of each document: stream offsets from the order of the blocks' documents, visits from the slots."""
    out = defaultdict(int)
    for key, doc_id, size, offset in rows:
        for w in range(offset, offset + size):
            out[doc_id] += slots.get((key, w // block_words), 0)
    return out


def test_query(spark, sf_dir):
    rows = op9_mixing(spark, sf_dir).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes = {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for i, r in texts.items()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    by_source, taken = defaultdict(int), defaultdict(int)
    for i, r in texts.items():
        by_source[r.source] += sizes[i]
    target = refill(by_source, (5, 2, 1), 1.5, 2)
    for r in rows:
        source = texts[r.doc_id].source
        assert r.source_size == by_source[source] and r.target == pytest.approx(target[source]) and 0 <= r.taken <= 2 * r["size"]
        taken[source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 * BLOCK_WORDS + 1 for s in target)
    mix = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), segments=True)
    slots = {(r.source_key, r.block): r["count"] for r in mix.slots.groupBy("source_key", "block").count().collect()}
    placed = [(r.source_key, r.doc_id, r["size"], r.offset) for r in mix.documents.collect()]
    ends = defaultdict(int)
    for key, _, size, offset in sorted(placed, key=lambda r: (r[0], r[3], r[2])):
        assert offset == ends[key] or size == 0  # the stream of a source has no gap and no overlap
        ends[key] = max(ends[key], offset + size)
    hand = taken_by_hand(placed, slots, BLOCK_WORDS)
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: hand[r.doc_id] for r in rows}
