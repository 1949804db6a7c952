import random
import re

import numpy as np
import pytest

from lockstep.llm.jaccard_join import components, differences, jaccard_groups, keep_one, op2_jaccard, signatures


def shingles(text, words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(rows, words, percent):
    sets = [(i, shingles(t, words)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted(((i is not None, i or 0, len(a), None if i is None else root(i)) for i, a in sets), key=str)


def run(spark, rows, words, percent):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    return sorted(((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_groups(df.repartition(3), words, percent).collect()), key=str)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for edits in (1, 2, 3, 5, 8):  # families around the threshold, so that chains form
        texts += family(rng, [rng.choice(vocabulary) for _ in range(60)], 25, edits)
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]) for _ in range(60)]
    texts += ["Same TEXT here now"] * 5 + ["same text here NOW", "one two", "ONE  two", "one three", "é É", None, "", " \n "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, (None, "one two"), (3, texts[3]), (4, "another text under a known id of course")]


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (2, 50), (1, 100)])
def test_as_brute_force(spark, corpus, words, percent):
    assert run(spark, corpus, words, percent) == brute(corpus, words, percent)


def test_empty_and_keep_one(spark, corpus):
    assert run(spark, [], 4, 85) == []
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    kept = sorted(r.doc_id for r in keep_one(df).where("doc_id is not null").collect())
    want = {i: c for _, i, _, c in brute(corpus, 5, 80) if c is not None}
    assert sorted(set(kept)) == sorted(i for i, c in want.items() if i == c)


def test_components_of_a_path(spark):
    rng = random.Random(2)
    nodes = rng.sample(range(1000), 60)
    edges = [(a, b) for a, b in zip(nodes, nodes[1:], strict=False)] + [(5000, 5001), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(nodes) for n in nodes} | {5000: 5000, 5001: 5000}


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((True, r.doc_id, r.n_shingles, r.component_id) for r in op2_jaccard(spark, sf_dir).collect()), key=str)
    assert got == brute(rows, 4, 85)


@pytest.mark.parametrize("percent", [85, 80, 50, 30])
def test_linked_sets_share_enough_signatures(percent):
    rng = np.random.default_rng(percent)
    most, ranges = differences(percent)
    checked = 0
    for _ in range(300):
        n = int(rng.integers(2, 400))
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        gone = int(rng.integers(0, max(1, n * (100 - percent) // 150 + 1)))
        other = np.concatenate([base[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, gone + 2)), dtype=np.uint64) * np.uint64(2)])
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        checked += 1
        who, kind, sig = signatures([a, b], percent)
        shared = [len(np.intersect1d(sig[(who == 0) & (kind == k)], sig[(who == 1) & (kind == k)])) >= ranges[k] - most[k] for k in set(kind[who == 0]) & set(kind[who == 1])]
        assert any(shared)
    assert checked > 50
