"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

A text's score f is one linear function of hashed features: the weights of its words over the root of their number
(a few telling words then count in a long text too), the mean weight of its byte trigrams, and the share of words
that repeat the word before. Ordered thresholds t1 < t2 < ... turn it into
grades: P(grade >= k) = 1 / (1 + exp(t_k - f)). The weights are shared by all grades; t1 and the logarithms of the
gaps are fitted with them by maximum likelihood. From these come the expected grade and the tail probability of the
best grade; documents are kept by the latter, at the highest threshold that still keeps min_kept of the best-graded
held-out documents. The fit runs in one task on a sample that is bounded in rows and in entries at every input size;
the driver gets the model alone.

Ratings: 0 low quality, 1 good quality but toxic, 2 good and clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, document_words, grouped_texts

GRADES = 3
FIT_ROWS = 8_000
FIT_ENTRIES = 16_000_000  # places with counts, 8 bytes each
BLOCK_ENTRIES = 1 << 20
CHUNK = 1 << 19  # bytes of texts whose features are held at once
MIN_KEPT = 0.995
BITS = 18
SIZE = 2 << BITS  # words, then trigrams; one more weight for repeats
SCALE = 20.0
_ODD = np.uint32(0x9E3779B1)


class Features(NamedTuple):
    words: np.ndarray  # a table place for each word
    word_heads: np.ndarray  # where each text's words start, and the end
    grams: np.ndarray
    gram_heads: np.ndarray
    repeats: np.ndarray  # a share for each text


def features(texts: list[bytes]) -> Features:
    """Table places of all words and byte trigrams of some texts."""
    hashes, heads = document_words(texts)
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
        same[1] = 0
    first, last = np.minimum(heads[:-1] + 1, len(hashes)), heads[1:]
    count = heads[1:] - heads[:-1]
    repeats = np.where(count > 1, (same[last] - same[np.minimum(first, last)]) / np.maximum(count - 1, 1), 0.0)
    raw = np.frombuffer(b"  ".join(texts) + b"  ", np.uint8).astype(np.uint32)
    grams = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * _ODD >> np.uint32(32 - BITS)).astype(np.int64) + (1 << BITS)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    own = np.ones(len(grams), bool)
    own[np.cumsum(sizes)[:-1] - 1] = own[np.cumsum(sizes)[:-1] - 2] = False  # those that begin between two texts
    gram_heads = np.concatenate([[0], np.cumsum(sizes - 2)])
    return Features((hashes >> np.uint64(64 - BITS)).astype(np.int64), heads, grams[own], gram_heads, repeats)


def _sums(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[heads[1:]] - sums[heads[:-1]]


def _counts(heads: np.ndarray) -> np.ndarray:
    return np.maximum(heads[1:] - heads[:-1], 1)


class Model(NamedTuple):
    weights: np.ndarray  # float32, SIZE + 1
    thresholds: np.ndarray  # GRADES - 1, ascending
    cut: float = 0.5

    def score(self, texts: list[bytes]) -> np.ndarray:
        f = features(texts)
        words = _sums(self.weights[f.words], f.word_heads) / np.sqrt(_counts(f.word_heads))
        grams = _sums(self.weights[f.grams], f.gram_heads) / _counts(f.gram_heads)
        return words + SCALE * grams + self.weights[SIZE] * f.repeats

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1: texts x (GRADES - 1)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -60, 60)))


def tails_of(model: Model, column) -> np.ndarray:
    """The tail probabilities of an Arrow column of texts, a few texts at a time."""
    return np.concatenate([model.tails(model.score(texts)) for _, texts in grouped_texts(column, CHUNK)] or [np.zeros((0, GRADES - 1))])


_SPARSE = "h long, t long, doc_id long, grade int, held boolean, places array<int>, counts array<float>"
_MODEL = "weights binary, thresholds array<double>, cut double"


def rated(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic); rows with a null in any of the three don't count."""
    grade = F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(GRADES - 1)
    return labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", grade.cast("int").alias("grade"))


def _sparse(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's places and shares; what one weight of the table adds to its score."""
    for batch in rows:
        for first, texts in grouped_texts(batch.column(5), CHUNK):
            f = features(texts)
            places, counts = [], []
            for k in range(len(texts)):
                w, g = f.words[f.word_heads[k] : f.word_heads[k + 1]], f.grams[f.gram_heads[k] : f.gram_heads[k + 1]]
                wp, wc = np.unique(w, return_counts=True)
                gp, gc = np.unique(g, return_counts=True)
                places.append(np.concatenate([wp, gp, [SIZE]]).astype(np.int32))
                counts.append(np.concatenate([wc / max(len(w), 1) ** 0.5, SCALE * gc / max(len(g), 1), [f.repeats[k]]]).astype(np.float32))
            ids = [c.slice(first, len(texts)) for c in batch.columns[:5]]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(places, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], names=["h", "t", "doc_id", "grade", "held", "places", "counts"])


def maximise(grades: np.ndarray, heads: np.ndarray, places: np.ndarray, counts: np.ndarray, steps: int = 120, penalty: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam over all rows; a function of its arguments.

    The entries of row k are those from heads[k] to heads[k + 1], at least one. Sums run over blocks of rows of about
    BLOCK_ENTRIES entries, so that besides the arguments little memory is needed.
    """
    w = np.zeros(SIZE + 1)
    free = np.zeros(GRADES - 1)  # t1 and logarithms of gaps
    m1, m2 = np.zeros(len(w) + len(free)), np.zeros(len(w) + len(free))
    cuts = np.unique(np.concatenate([np.searchsorted(heads, np.arange(0, heads[-1], BLOCK_ENTRIES)), [len(grades)]]))
    blocks = [(a, b, slice(heads[a], heads[b]), heads[a:b] - heads[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for step in range(1, steps + 1):
        f = np.concatenate([np.add.reduceat(counts[x] * w[places[x]], at) for _, _, x, at in blocks])
        t = np.concatenate([[-np.inf], free[:1], free[:1] + np.cumsum(np.exp(free[1:])), [np.inf]])
        with np.errstate(over="ignore"):
            low, high = 1 / (1 + np.exp(t[grades] - f)), 1 / (1 + np.exp(t[grades + 1] - f))
        p = np.maximum(low - high, 1e-9)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        slope = -(d_low - d_high) / len(f)
        gw = penalty * w
        for a, b, x, at in blocks:
            gw += np.bincount(places[x], np.repeat(slope[a:b], np.diff(np.append(at, x.stop - x.start))) * counts[x], len(w))
        gt = np.array([(np.where(grades == k, d_low, 0) - np.where(grades == k - 1, d_high, 0)).sum() / len(f) for k in range(1, GRADES)])
        gf = np.concatenate([[gt.sum()], np.exp(free[1:]) * np.cumsum(gt[::-1])[::-1][1:]])
        g = np.concatenate([gw, gf])
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        move = 0.15 * (1 - 0.9 * step / steps) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
        w -= move[: len(w)]
        free -= move[len(w) :]
    return w.astype(np.float32), np.concatenate([free[:1], free[:1] + np.cumsum(np.exp(free[1:]))])


def _fitted(fit_entries: int, min_kept: float):
    """Fits on the rows of one task, in their order, until fit_entries is reached: one row, or none without rows."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, grades, held, sizes, room = ([], []), [], [], [], fit_entries
        for batch in rows:
            lengths = batch.column(5).value_lengths().to_numpy()
            n = int(np.searchsorted(np.cumsum(lengths), room, side="right"))  # 0 once the bound was reached
            grades.append(batch.column(3).to_numpy()[:n].astype(np.int64))
            held.append(batch.column(4).to_numpy(zero_copy_only=False)[:n])
            sizes.append(lengths[:n])
            for own in (False, True):  # entries of those to fit on and of those held out, apart
                chosen = batch.slice(0, n).filter(pa.array(held[-1] == own))
                parts[own].append((chosen.column(5).flatten().to_numpy().astype(np.int32), chosen.column(6).flatten().to_numpy().astype(np.float32)))
            room = room - int(lengths[:n].sum()) if n == len(lengths) else -1
        if not sum(map(len, grades)):
            return
        grades, held, sizes = map(np.concatenate, (grades, held, sizes))
        if held.all():  # nothing to fit on but what was held out
            held, parts = np.zeros(len(held), bool), (parts[1], [])
        places, counts = (np.concatenate([p[k] for p in parts[0]]) for k in (0, 1))
        parts[0].clear()
        weights, thresholds = maximise(grades[~held], np.concatenate([[0], np.cumsum(sizes[~held])]), places, counts)
        model, best = Model(weights, thresholds), grades[held] == GRADES - 1
        if best.any():
            places, counts = (np.concatenate([p[k] for p in parts[1]]) for k in (0, 1))
            scores = np.add.reduceat(counts * weights[places].astype(np.float64), np.concatenate([[0], np.cumsum(sizes[held])[:-1]]))[best]
            tails = np.sort(model.tails(scores)[:, -1])
            model = model._replace(cut=float(tails[int((1 - min_kept) * len(tails))]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([thresholds.tolist()]), pa.array([model.cut])], names=["weights", "thresholds", "cut"])

    return run


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, min_kept: float = MIN_KEPT, fit_entries: int = FIT_ENTRIES) -> Model | None:
    """Fits on the labelled documents with the fit_rows smallest hashes of doc_id; every fourth is held out for the cut.

    The bounds hold at every input size: fit_rows rated ids are broadcast, and one task gets the whole texts' entries
    (a place and a count for each distinct word and trigram) in the order of the hashes until fit_entries are reached.
    None where no document is labelled.
    """
    batches(docs.sparkSession, 500)
    sample = rated(labels).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "grade").limit(fit_rows)
    sample = sample.select("doc_id", "grade", "h", (F.pmod("h", F.lit(4)) == 0).alias("held"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select("h", F.xxhash64("text").alias("t"), F.col("doc_id").cast("long"), "grade", "held", "text").mapInArrow(_sparse, _SPARSE)
    found = rows.repartition(1).sortWithinPartitions("h", "doc_id", "grade", "t").mapInArrow(_fitted(fit_entries, min_kept), _MODEL).first()
    return found and Model(np.frombuffer(found.weights, np.float32), np.array(found.thresholds), found.cut)


_GRADED = pa.schema([("expected_grade", pa.float64()), ("p_best", pa.float64()), ("keep", pa.bool_())])


def grade(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs with expected_grade, p_best (the tail probability of the best grade) and keep.

    A null text is graded as an empty one, which has score 0. Without a model (nothing was labelled) all are kept,
    with null grades. Null ids and repeated rows stay; other columns are ignored; an empty table gives an empty one.
    """
    names = [*keep, *_GRADED.names]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "expected_grade double, p_best double, keep boolean"])
    if model is None:
        return docs.select(*keep, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("p_best"), F.lit(True).alias("keep"))
    batches(docs.sparkSession, 500)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB at every input size

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            tails = tails_of(m, batch.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= m.cut)], names=names)

    return docs.select(*keep, F.col("text").alias("_graded")).mapInArrow(run, schema)


def select_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the classifier keeps, all columns as they were."""
    if model is None:
        return docs
    batches(docs.sparkSession, 500)
    shared, n = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            tails = tails_of(m, batch.column(n))
            yield batch.filter(pa.array(tails[:, -1] >= m.cut))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
