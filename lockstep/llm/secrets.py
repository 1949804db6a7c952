"""Secret scans: three base patterns, and a character convolutional network over every candidate.

Candidates are all base spans, and all runs of 12 or more characters of [A-Za-z0-9+/_=-] that are not one character
repeated: maximal ones, or what base spans leave of them. The network reads each with its surrounding context (one row of WIDTH bytes and a flag for
those that belong to the candidate; one of more than INSIDE bytes in overlapping windows, of which the highest score
counts): byte embedding, one convolution, maximum over all places, logistic output. It is trained
in numpy on labelled findings: rows of a seeded generator of secrets and look-alikes (long words and names, UUIDs, versions,
dates, paths, slugs, rules of one character, numbers, addresses), half of them set in prose that has no secret nearby. Scores
are calibrated on held-out findings by Platt's method, and the threshold is the best of those that keep min_recall of
the held-out secrets. Base spans always stay, whatever their score; the network adds spans, of kind "model". How many
base spans it finds too tells its recall on the corpus itself.
"""

from __future__ import annotations

import random
import re
import string
import uuid
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

KINDS = ("assign", "access", "hex", "model")
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
STRIDE = 12
EMBED, FILTERS, REACH = 8, 24, 5
MIN_RECALL = 0.95
LEAST = 12

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYS = (b"passw", b"secret", b"token", b"api")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list((string.ascii_letters + string.digits + "+/_=-").encode())] = True


def runs(inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that are at least so long."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def base_spans(data: bytes, raw: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the base patterns."""
    found = []
    low = data.lower()
    if any(k in low for k in _KEYS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(data) if m.end() - m.start() >= 18]
    found += [(int(a), 2, int(b)) for a, b in zip(*runs(_HEX[raw], 16), strict=True)]
    return found


def candidates(raw: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) in bytes of the candidates that are no base spans; a rule of one character is none."""
    free = _TOKEN[raw]
    for start, _, end in taken:
        free[start:end] = False
    starts, ends = runs(free, LEAST)
    if not len(starts):
        return []
    changes = np.concatenate([[0], np.cumsum(raw[1:] != raw[:-1])])
    keep = changes[ends - 1] > changes[starts]
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def window(data: bytes, start: int, end: int) -> np.ndarray:
    """The bytes around a candidate (0 beyond the text, 127 for any beyond ASCII) and its flags, as one row of 2 * WIDTH."""
    last = min(end, start + INSIDE)
    before, inside, after = data[max(0, start - BEFORE) : start], data[start:last], data[end : end + AFTER]
    row = before.rjust(BEFORE, b"\0") + inside.ljust(INSIDE, b"\0") + after.ljust(AFTER, b"\0")
    out = np.zeros(2 * WIDTH, np.uint8)
    out[:WIDTH] = np.minimum(np.frombuffer(row, np.uint8), 127)
    out[WIDTH + BEFORE : WIDTH + BEFORE + last - start] = 1
    return out


def windows(data: bytes, start: int, end: int) -> list[np.ndarray]:
    """The first window of a candidate, and those that slide over what it does not hold, up to the end."""
    last = end - INSIDE
    places = [*range(start + STRIDE, last, STRIDE), last] if last > start else []
    return [window(data, start, end), *(window(data, a, a + INSIDE) for a in places)]


class Network(NamedTuple):
    embed: np.ndarray  # 128 x EMBED
    conv: np.ndarray  # REACH * (EMBED + 1) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # FILTERS
    out_bias: np.ndarray
    slope: float = 1.0  # of the calibration
    shift: float = 0.0
    threshold: float = 0.5

    def features(self, rows: np.ndarray) -> np.ndarray:
        """What the convolution sees: rows x places x REACH * (EMBED + 1)."""
        x = np.concatenate([self.embed[rows[:, :WIDTH]], rows[:, WIDTH:, None].astype(np.float32)], axis=2)
        n = WIDTH - REACH + 1
        return np.concatenate([x[:, k : k + n] for k in range(REACH)], axis=2)

    def logits(self, rows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.features(rows) @ self.conv + self.bias, 0).max(axis=1)
        return hidden @ self.out + self.out_bias

    def probability(self, rows: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Calibrated probabilities of a secret."""
        logits = np.concatenate([self.logits(rows[k : k + chunk]) for k in range(0, len(rows), chunk)] or [np.zeros(0, np.float32)])
        return 1 / (1 + np.exp(-(self.slope * logits + self.shift)))


def labelled_findings(n: int = 12000, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """n windows, half around a secret; a seeded generator stands for a reviewed list of findings."""
    rng = random.Random(seed)
    pick = lambda alphabet, a, b: "".join(rng.choice(alphabet) for _ in range(rng.randint(a, b)))
    alnum, lower = string.ascii_letters + string.digits, string.ascii_lowercase
    word = lambda: pick(lower, 2, 9)
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 5)))
    # long words as languages make them: syllables of a consonant, a vowel and an ending
    syllable = lambda: rng.choice(["", *"bcdfghlmnprstvw"]) + rng.choice(["a", "e", "i", "o", "u", "ou", "ea", "ie"]) + rng.choice(["", "", "n", "r", "s", "t", "l", "nd", "th", "ng", "st", "tion", "ment"])
    spoken = lambda a, b: "".join(syllable() for _ in range(rng.randint(a, b)))
    secret = [
        lambda: pick(alnum, 20, 44),
        lambda: pick(alnum + "+/", 24, 60) + rng.choice(["", "=", "=="]),
        lambda: rng.choice(["sk_live_", "pk_test_", "ghp_", "gho_", "xoxb-", "xoxp-", "glpat-", "npm_"]) + pick(alnum, 16, 40),
        lambda: "AIza" + pick(alnum + "_-", 30, 36),
        lambda: "eyJ" + pick(alnum + "_-", 30, 60),
        lambda: pick("ABCDEF0123456789", 24, 48),
        lambda: pick(string.ascii_uppercase + string.digits, 18, 32),
        lambda: pick(alnum + "_-", 16, 30),
        lambda: pick(string.ascii_letters, 20, 40),
        lambda: pick("0123456789abcdef", 32, 64),
        lambda: f"{rng.choice(['token', 'password', 'secret', 'api_key'])}{rng.choice(['=', ' = ', ': '])}{rng.choice(['', chr(34)])}{pick(rng.choice([alnum, '0123456789abcdef']), 20, 48)}",
    ]
    benign = [
        lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}",
        lambda: f"{word()}-{word()}-{rng.randint(1, 999)}-{word()}",
        lambda: f"{word()}/{word()}/{word()}{rng.randint(1, 99)}",
        lambda: f"{word()}_{word()}_{rng.randint(1, 9999)}",
        lambda: f"{word()}{word()}{word()}{rng.randint(1, 99)}",
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + str(rng.randint(1, 9)),
        lambda: f"{rng.randint(10**11, 10**15)}{word()[:2]}",
        lambda: f"mail{rng.randint(0, 9)}-{word()}-{word()}",
        lambda: f"{word()}={rng.randint(1, 999)}-{word()}{word()}",
        lambda: f"v{rng.randint(0, 9)}-{rng.randint(0, 99)}-{word()}-release",
        lambda: spoken(5, 9),
        lambda: spoken(4, 8).capitalize(),
        lambda: "".join(spoken(1, 3).capitalize() for _ in range(rng.randint(3, 5))),
        lambda: f"{spoken(2, 4)}{rng.choice('-_/=')}{spoken(2, 4)}",
        lambda: (spoken(3, 8) + spoken(3, 3))[: rng.randint(LEAST, 24)].upper(),
        lambda: "".join(rng.choice(["re", "on", "an", "th", "er", "en", "st", "ing", "tion", "ment", "heit", "ung", "ado", "que", "lich"]) for _ in range(9))[: rng.randint(LEAST, 20)].upper(),
        lambda: "".join(rng.choice(["re", "on", "an", "th", "er", "en", "st", "ing", "tion", "ment", "heit", "ung", "ado", "que", "sch"]) for _ in range(9))[: rng.randint(LEAST, 24)].upper(),
        lambda: rng.choice(lower + string.ascii_uppercase + "-=_+/") * rng.randint(LEAST, 80),
        lambda: rng.choice(lower + string.ascii_uppercase + string.digits) * rng.randint(INSIDE, 90),
        lambda: pick(string.digits, LEAST, 20),
    ]
    key = ["key", "credential", "auth", "bearer", "access key", "private key", "pwd", "client id", "signature", "login"]
    rows, labels = [], []
    for i in range(n):
        good = i % 2 == 0
        value = rng.choice(secret if good else benign)()
        while len(value) < LEAST:
            value += pick(alnum, 4, 8) if good else spoken(2, 3)
        lead = f"{rng.choice(key)}{rng.choice([': ', '=', ' is ', ' '])}" if rng.random() < (0.5 if good else 0.15) else f"{prose()}{rng.choice([' ', '. ', ', '])}"
        at_start, at_end = rng.random() < 0.1, rng.random() < 0.1
        text = b"" if at_start else f"{prose()} {lead}".encode()
        tail = b"" if at_end else f"{rng.choice([' ', ', ', '. ', chr(34)])}{prose()}".encode()
        start, end = len(text), len(text) + len(value.encode())
        if rng.random() < 0.25:  # at the end of a long run, as a later window sees it
            text += (value[0] * rng.randint(30, 90) if len(set(value)) == 1 else "".join(f"{word()}{rng.choice('/-_=')}" for _ in range(rng.randint(10, 16)))).encode()
            end = len(text) + len(value.encode())
            start = max(start, end - INSIDE)
        rows.append(window(text + value.encode() + tail, start, end))
        labels.append(good)
    return np.stack(rows), np.array(labels, np.float32)


def train(rows: np.ndarray, labels: np.ndarray, epochs: int = 6, seed: int = 7, min_recall: float = MIN_RECALL) -> Network:
    """Adam on two thirds of the findings; calibration and threshold on the rest. A function of its arguments."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(rows))
    fit, held = order[: 2 * len(order) // 3], order[2 * len(order) // 3 :]
    shapes = {"embed": (128, EMBED), "conv": (REACH * (EMBED + 1), FILTERS), "bias": (FILTERS,), "out": (FILTERS,), "out_bias": (1,)}
    w = {k: (rng.standard_normal(s) * (0.2 if len(s) > 1 else 0.1)).astype(np.float32) for k, s in shapes.items()}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step, n = 0, WIDTH - REACH + 1
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            x, y = rows[batch], labels[batch]
            net = Network(*(w[k] for k in shapes))
            seen = net.features(x)
            hidden = seen @ w["conv"] + w["bias"]
            best = hidden.argmax(axis=1)
            top = np.take_along_axis(hidden, best[:, None, :], 1)[:, 0]
            active = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-(active @ w["out"] + w["out_bias"])))
            error = ((p - y) / len(y)).astype(np.float32)
            back = error[:, None] * w["out"] * (top > 0)
            grads = {"out": active.T @ error, "out_bias": error.sum(keepdims=True), "bias": back.sum(0)}
            picked = seen[np.arange(len(x))[:, None], best]  # rows x FILTERS x REACH * (EMBED + 1)
            grads["conv"] = np.einsum("nfd,nf->df", picked, back)
            into = np.einsum("nf,df->nfd", back, w["conv"]).reshape(len(x), FILTERS, REACH, EMBED + 1)[..., :EMBED]
            places = best[:, :, None] + np.arange(REACH)
            grads["embed"] = np.zeros_like(w["embed"])
            np.add.at(grads["embed"], x[np.arange(len(x))[:, None, None], places], into)
            step += 1
            for k, g in grads.items():
                first, second = moment[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                w[k] = w[k] - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    net = Network(*(w[k].astype(np.float32) for k in shapes))
    logits, y = net.logits(rows[held]).astype(np.float64), labels[held].astype(np.float64)
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton's method for the two numbers of Platt's calibration
        p = 1 / (1 + np.exp(-(slope * logits + shift)))
        d, v = p - y, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(v * logits**2).sum() + 1e-3, (v * logits).sum()], [(v * logits).sum(), v.sum() + 1e-3]])
        slope, shift = np.array([slope, shift]) - np.linalg.solve(hess, [(d * logits).sum(), d.sum()])
    net = net._replace(slope=float(slope), shift=float(shift))
    return net._replace(threshold=best_threshold(net.probability(rows[held]), y > 0, min_recall))


def best_threshold(p: np.ndarray, good: np.ndarray, min_recall: float) -> float:
    """Of the thresholds that keep min_recall, that with the best F1, the nearest to one half among equals.

    Where none of 0.02, 0.04 to 0.98 keeps min_recall, the highest score that does.
    """
    best = None
    for t in np.arange(0.02, 0.99, 0.02):
        hit = (p >= t) & good
        recall = hit.sum() / max(1, good.sum())
        f1 = 2 * hit.sum() / max(1, (p >= t).sum() + good.sum())
        if recall >= min_recall and (best is None or (round(f1, 12), -abs(t - 0.5)) > best[:2]):
            best = round(f1, 12), -abs(t - 0.5), t
    return float(best[2] if best else np.sort(p[good])[int((1 - min_recall) * good.sum())])


@cache
def default_network() -> Network:
    return train(*labelled_findings())


def _places(raw: np.ndarray, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets as code points."""
    if not spans or not (raw >= 128).any():
        return spans
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(points[a]), k, int(points[b])) for a, k, b in spans]


class Scan(NamedTuple):
    """spans: (start, kind, end) in code points, sorted; read: candidates scored; confirmed: base spans that the network finds too."""

    spans: list[tuple[int, int, int]]
    read: int
    confirmed: int


def scan_text(data: bytes, net: Network | None = None) -> list[tuple[int, int, int]]:
    """The spans of one text."""
    return scan_texts([data], net)[0].spans


def _scores(rows: list[np.ndarray], firsts: list[int], net: Network) -> np.ndarray:
    return np.maximum.reduceat(net.probability(np.stack(rows)), firsts) if rows else np.zeros(0)


def scan_texts(texts: list[bytes], net: Network | None, most_rows: int = 4096) -> list[Scan]:
    """The scans of some texts; windows are scored about most_rows at a time, so that long texts need no more memory."""
    found = [base_spans(data, np.frombuffer(data, np.uint8)) for data in texts]
    read, confirmed = [0] * len(texts), [0] * len(texts)
    rows: list[np.ndarray] = []
    owners: list[tuple] = []

    def score() -> None:
        for (k, a, b, base, _), p in zip(owners, _scores(rows, [first for *_, first in owners], net), strict=True):
            read[k] += 1
            if p >= net.threshold and base:
                confirmed[k] += 1
            elif p >= net.threshold:
                found[k].append((a, 3, b))
        rows.clear()
        owners.clear()

    for k, data in enumerate(texts if net is not None else []):
        base = list(found[k])
        for a, b, known in [*((a, b, True) for a, _, b in base), *((a, b, False) for a, b in candidates(np.frombuffer(data, np.uint8), base))]:
            owners.append((k, a, b, known, len(rows)))
            rows += windows(data, a, b)
            if len(rows) >= most_rows:
                score()
    score()
    spans = [sorted(_places(np.frombuffer(data, np.uint8), x)) for data, x in zip(texts, found, strict=True)]
    return [Scan(*x) for x in zip(spans, read, confirmed, strict=True)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, net: Network | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of docs, spans: array of (kind, start, end) in code points of the whole text, by start and kind, n_read and n_confirmed.

    n_read counts the candidates that the network scored, base spans among them; n_confirmed the base spans that it finds too.
    net is trained from the labelled findings where none is given. A null or empty text has no spans. Null ids and
    repeated rows stay, a result each. Other columns are ignored; an empty table gives an empty one.
    """
    net = net or default_network()
    batches(docs.sparkSession, 500)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [t.encode() if t else b"" for t in batch.column(len(keep)).to_pylist()]
            scans = scan_texts(texts, net)
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x.spans] for x in scans]
            counts = [pa.array([x.read for x in scans], pa.int64()), pa.array([x.confirmed for x in scans], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(spans, _SPANS), *counts], names=[*keep, "spans", "n_read", "n_confirmed"])

    text = F.col("text").alias("_scanned")
    return docs.select(*keep, text).mapInArrow(run, f"{schema}, spans array<struct<kind: string, start: long, end: long>>, n_read long, n_confirmed long")


def redact_secrets(docs: DataFrame, net: Network | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of find_secrets() replaced by mask (overlapping spans by one); n_chars follows."""
    net = net or default_network()
    batches(docs.sparkSession, 500)
    n, names = docs.columns.index("text"), docs.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(n).to_pylist()
            out = []
            for text, scan in zip(texts, scan_texts([t.encode() if t else b"" for t in texts], net), strict=True):
                spans = scan.spans
                if spans:
                    parts, at, edge = [], 0, -1
                    for a, _, b in spans:
                        if a >= edge:
                            parts += [text[at:a], mask]
                            at = edge = b
                        elif b > edge:
                            at = edge = b
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = list(batch.columns)
            columns[n] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "model")
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), of_kind(KINDS[3]), "n_read", "n_confirmed")
