import numpy as np
import pytest
from pyspark.sql import functions as F

from lockstep.llm.common import read_table
from lockstep.llm.quality import GRADES, MIN_KEPT, SCALE, SIZE, Model, features, fit, grade, maximise, op3_quality, rated, select_documents


def test_features_by_brute_force():
    texts = [b"the the cat", b"", b"A a  b\tB b", b"one"]
    f = features(texts)
    assert np.diff(f.word_heads).tolist() == [3, 0, 5, 1]
    assert f.repeats.tolist() == [0.5, 0.0, 0.75, 0.0]
    assert f.words[0] == f.words[1] != f.words[2] and f.words[3] == f.words[4]
    alone = features([b"A a  b\tB b"])
    assert alone.words.tolist() == f.words[3:8].tolist()
    assert alone.grams.tolist() == f.grams[f.gram_heads[2] : f.gram_heads[3]].tolist()
    assert len(f.grams) == sum(map(len, texts)) == f.gram_heads[-1]


def test_thresholds_are_ordered_and_grades_found():
    rng = np.random.default_rng(1)
    grades = rng.integers(0, GRADES, 900)
    places = np.stack([np.full(900, SIZE), grades * 7], 1).ravel()
    heads = np.arange(0, 1801, 2)
    w, t = maximise(grades, heads, places, np.ones(1800))
    assert t[0] < t[1]
    score = w[grades * 7] + w[SIZE]
    tails = Model(w, t).tails(score)
    assert (np.abs(tails.sum(1) - grades) < 0.5).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    words = ["river", "stone", "green", "walks", "slowly", "under", "bridge", "light"]
    rows, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words, 30))
        kind = i % 5
        if kind == 0:
            text = " ".join([rng.choice(words)] * 30)
        elif kind == 1:
            text += " nastyword " + " ".join(rng.choice(words, 30))
        rows.append((i, text, "x"))
        if i < 400:
            labels.append((i, int(kind != 0), int(kind == 1)))
    labels += [(None, 1, 0), (3, None, 0), (4, 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, keep string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    model = fit(docs, labels)
    rows = grade(docs, model).where("doc_id >= 400").collect()
    assert len(rows) == 200
    good = [r.keep for r in rows if r.doc_id % 5 > 1]
    bad = [r.keep for r in rows if r.doc_id % 5 <= 1]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.05
    mean = lambda k: np.mean([r.expected_grade for r in rows if r.doc_id % 5 == k])
    assert mean(0) < mean(1) < mean(2)
    kept = select_documents(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id >= 400").collect()) == sorted(r.doc_id for r in rows if r.keep)
    again = fit(docs.repartition(3), labels)
    assert np.array_equal(model.thresholds, again.thresholds) or np.allclose(model.thresholds, again.thresholds)


def test_odd_rows(spark, corpus):
    docs, labels = corpus
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (2, "word " * 50_000, 3), (2, "word " * 50_000, 3)], "doc_id long, text string, p_best int")
    model = fit(docs, labels)
    assert grade(odd, model).count() == 4
    assert grade(odd.limit(0), model).count() == 0
    none = fit(odd, labels.limit(0))
    assert none is None and select_documents(odd, none).count() == 4
    assert grade(odd, none).where(F.col("keep")).count() == 4
    assert sorted(r.grade for r in rated(labels.where("doc_id < 3")).collect()) == [0, 1, 2]


def row_of(text):
    """Place -> share of one text, by dictionaries."""
    f = features([text.encode()])
    out = {SIZE: float(f.repeats[0])}
    for places, scale, n in ((f.words, 1.0, len(f.words) ** 0.5), (f.grams, SCALE, len(f.grams))):
        for p in places.tolist():
            out[p] = out.get(p, 0.0) + scale / n
    return out


def dense_fit(rows, steps=120, penalty=2e-5):
    """The classifier on one dense matrix of the rows (grade, features); the weights by place, thresholds."""
    grades = np.array([g for g, _ in rows])
    names = sorted({p for _, x in rows for p in x})
    at = {p: k for k, p in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for k, (_, values) in enumerate(rows):
        for p, v in values.items():
            x[k, at[p]] = v
    w, free, m1, m2 = np.zeros(len(names)), np.zeros(2), 0, 0
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, steps + 1):
        f, t = x @ w, np.array([-np.inf, free[0], free[0] + np.exp(free[1]), np.inf])
        low, high = sigmoid(f - t[grades]), sigmoid(f - t[grades + 1])
        p = low - high
        a, b = low * (1 - low) / p, high * (1 - high) / p
        gt = [np.mean(np.where(grades == k, a, 0) - np.where(grades == k - 1, b, 0)) for k in (1, 2)]
        g = np.concatenate([-x.T @ ((a - b) / len(f)) + penalty * w, [gt[0] + gt[1], np.exp(free[1]) * gt[1]]])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.15 * (1 - 0.9 * step / steps) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w, free = w - move[:-2], free - move[-2:]
    return dict(zip(names, w, strict=True)), np.array([free[0], free[0] + np.exp(free[1])])


def test_query_by_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in read_table(spark, sf_dir, "documents").collect()}
    rows = {i: row_of(t) for i, t in texts.items()}
    marked = [(r.doc_id, r.quality, r.toxic, r.h) for r in read_table(spark, sf_dir, "labels").withColumn("h", F.xxhash64("doc_id")).collect()]
    known = [(i, 0 if q < 1 else 1 if x > 0 else 2, h % 4 == 0) for i, q, x, h in sorted(marked, key=lambda r: (r[3], r[0])) if i in rows]
    w, t = dense_fit([(g, rows[i]) for i, g, held in known if not held])
    score = {i: sum(w.get(p, 0.0) * v for p, v in x.items()) for i, x in rows.items()}
    tail = {i: [1 / (1 + np.exp(k - s)) for k in t] for i, s in score.items()}
    best = sorted(tail[i][1] for i, g, held in known if held and g == 2)
    cut = best[int((1 - MIN_KEPT) * len(best))]
    got = {r.doc_id: r for r in op3_quality(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert abs(r.expected_grade - sum(tail[i])) < 1e-3 and abs(r.p_best - tail[i][1]) < 1e-3
        assert r.keep == (tail[i][1] >= cut) or abs(tail[i][1] - cut) < 1e-3


def test_bounds_and_order(spark, corpus):
    docs, labels = corpus
    whole, again = fit(docs, labels), fit(docs.repartition(7), labels, fit_entries=10**9)
    assert np.allclose(whole.weights, again.weights) and np.isclose(whole.cut, again.cut)
    few = fit(docs, labels, fit_entries=3000)
    assert few is not None and not np.allclose(few.weights, whole.weights)
    assert fit(docs, labels, fit_entries=0) is None
