"""Runs of words that repeat with a period, found over whole texts, and texts with the repetitions taken out.

A run is a maximal stretch of words in which words period apart are identical, period being the smallest such number,
and whose length is at least least_words and exponent times the period. For each period p all pairs (i, i + p) agree
along length - p >= need(p) = max(least_words, exponent * p) - p places of a run, so that a grid of the points
0, need(p), 2 need(p), ... has a point in each. The grids of all periods are harmonic: n log n points together, not n^2.
At all points (p, i) at once, prefix hashes and a binary search give how far words agree to the right and to the left
(the longest common extensions). Hashes may only claim too much, so that each stretch found is then verified word by
word, and measured word by word where a hash was wrong; stretches that several grid points or multiples of a period
found are merged, the smallest period being kept.

A text is one row's work: nothing is shuffled, memory is bounded by the text and by POINTS grid points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX

LEAST_WORDS = 24
EXPONENT = 3
#: Grid points that are looked at together.
POINTS = 1 << 20
#: Bytes of words that are put out together.
OUT_BYTES = 1 << 22

#: Two primes below 2^31, so that a product of two residues fits into 64 bits, and a base for each.
_PRIMES = ((np.uint64(2147483629), 1000003579), (np.uint64(2147483587), 1500450271))

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])
_OUT_SQL = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class PrefixHashes:
    """Hashes of any stretch of a row of numbers, modulo two primes."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.sums, self.powers = [], []
        for prime, base in _PRIMES:
            powers = np.ones(n + 1, np.uint64)
            have, step = 1, base
            while have <= n:  # doubling: base^(have + j) = base^have * base^j
                more = min(have, n + 1 - have)
                powers[have : have + more] = powers[:more] * np.uint64(step) % prime
                have, step = have + more, step * step % int(prime)
            terms = (ids.astype(np.uint64) + np.uint64(1)) % prime * powers[:n] % prime
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)]) % prime)
            self.powers.append(powers)

    def same(self, i: np.ndarray, p: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the hashes of the stretches at i and i + p of this length agree."""
        found = np.ones(len(i), bool)
        for (prime, _), sums, powers in zip(_PRIMES, self.sums, self.powers, strict=True):
            here = (sums[i + length] + prime - sums[i]) % prime * powers[p] % prime
            there = (sums[i + p + length] + prime - sums[i + p]) % prime
            found &= here == there
        return found


def _extend(hashes: PrefixHashes, i: np.ndarray, p: np.ndarray, limit: np.ndarray, left: bool) -> np.ndarray:
    """The longest common extensions of all (i, i + p) to one side, up to limit, by one binary search for all."""
    low, high = np.zeros_like(limit), limit.copy()
    while (low < high).any():
        mid = (low + high + 1) >> 1
        same = hashes.same(i - mid if left else i, p, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _measured(ids: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The stretch of period p around i and i + p, by comparing words."""
    other = np.flatnonzero(ids[:-p] != ids[p:])
    k = int(np.searchsorted(other, i))
    if k < len(other) and other[k] == i:
        return i, i
    return int(other[k - 1]) + 1 if k else 0, (int(other[k]) if k < len(other) else len(ids) - p) + p


def _grid(n: int, least: int, exponent: int, points: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (period, grid point), about so many points at a time."""
    periods = np.arange(1, n // exponent + 1, dtype=np.int64)
    need = np.maximum(least, exponent * periods) - periods
    counts = (n - periods - 1) // need + 1
    ends = np.cumsum(counts)
    done = 0
    while done < len(periods):
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + points, "right")))
        some = counts[done:upto]
        p = np.repeat(periods[done:upto], some)
        i = (np.arange(len(p)) - np.repeat(np.cumsum(some) - some, some)) * np.repeat(need[done:upto], some)
        yield p, i
        done = upto


def runs_of(ids: np.ndarray, least_words: int = LEAST_WORDS, exponent: int = EXPONENT, points: int = POINTS) -> np.ndarray:
    """The runs (start, length, period) of a row of word numbers, in order of start, then period."""
    n = len(ids)
    found = np.zeros((0, 4), np.int64)
    if n < max(least_words, exponent):
        return found[:, :3]
    hashes = None
    for p, i in _grid(n, least_words, exponent, points):
        keep = ids[i] == ids[i + p]
        p, i = p[keep], i[keep]
        if not len(p):
            continue
        # most points that agree by chance agree with neither neighbour
        after = (i + p + 1 < n) & (ids[i + 1 - (i + p + 1 >= n)] == ids[np.minimum(i + p + 1, n - 1)])
        keep = after | ((i > 0) & (ids[i - 1] == ids[i + p - 1]))
        p, i = p[keep], i[keep]
        if not len(p):
            continue
        hashes = hashes or PrefixHashes(ids)
        right, left = _extend(hashes, i, p, n - i - p, False), _extend(hashes, i, p, i, True)
        start, end = i - left, i + p + right
        keep = end - start >= np.maximum(least_words, exponent * p)
        some = np.stack([start[keep], end[keep], p[keep], i[keep]], axis=1)
        found = _merged(np.concatenate([found, some]))
    rows = []
    for start, end, p, i in found.tolist():
        inside = (ids[start : end - p] == ids[start + p : end]).all()
        if not inside or (start and ids[start - 1] == ids[start + p - 1]) or (end < n and ids[end] == ids[end - p]):
            start, end = _measured(ids, i, p)
            if end - start < max(least_words, exponent * p):
                continue
        rows.append((start, end, p, i))
    found = _merged(np.array(rows, np.int64).reshape(-1, 4))
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return np.stack([found[:, 0], found[:, 1] - found[:, 0], found[:, 2]], axis=1)


def _merged(found: np.ndarray) -> np.ndarray:
    """One row for each (start, end), that of the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when of each run only its first period stays."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:n]) == 0


def _scan(least_words: int, exponent: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                words = (text.as_py() or b"").split()
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = runs_of(ids, least_words, exponent)
                if len(runs):
                    words = [words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()]
                spans = [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()]
                collapsed = b" ".join(words)
                held.append((doc_id.as_py(), len(ids), spans, collapsed.decode("utf-8")))
                size += len(collapsed)
                if size >= OUT_BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of docs (doc_id, text), a row for each row of docs.

    Words are the maximal runs of characters other than the six ASCII blanks, upper and lower case apart, numbered from
    0. runs holds (start, length, period) in words by start, then period; exponent is 2 or more. collapsed has the words
    that stay when of each run only its first period does, joined by single spaces; so it is the text with its blanks
    evened out where there are no runs. A null, empty or blank text has no words and no runs and collapses to ''. Null
    ids stay, repeated rows give a row each, other columns are ignored whatever their names, and an empty table gives
    an empty one.
    """
    assert least_words >= 2 and exponent >= 2
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(least_words, exponent), _OUT_SQL)


def with_loops(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the loops that the query plants: a tenth of all documents end in a repeated stretch.

    With h = crc32 of the decimal id and g = h div 10, where h mod 10 is 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) mod p, a = g mod n, p = 1 + (n - a) div (3 + g mod 8). A null id leaves the text alone.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD_REGEX), F.lit(0))
    looped = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(F.pmod(h, F.lit(10)) == 0, words).alias("words"))
    n = F.size("words")
    looped = looped.withColumn("a", F.when(n > 0, F.pmod(F.col("g"), n.cast("long"))))
    looped = looped.withColumn("p", F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.pmod(F.col("g"), F.lit(8)))))
    head = F.slice("words", 1, F.col("a").cast("int"))
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (n - F.col("a")).cast("int"))
    return looped.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The run of greatest length / period and digests of runs and collapsed text, of what find_runs() gives."""
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))),
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(find_runs(with_loops(docs)))
