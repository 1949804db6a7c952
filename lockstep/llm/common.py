"""Shared helpers: the cluster's shared folder, materialised tables, vectorised word hashing."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII blanks.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_REGEX = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one only where Spark runs in one machine without it."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lockstep-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lockstep-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialise() made, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps: it does so when the driver drops their plans."""
    gc.collect()
    spark._jvm.System.gc()


def batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of so many rows: a batch of whole texts then stays at a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of about so many bytes for the jobs run inside; the session's own setting stands again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: A pseudorandom 64-bit value for each byte, A-Z as a-z; 0 marks blanks in _IS_BLANK.
_VALUES = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[list(BLANKS)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
        _INVERSE = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)
    return _POWERS, _INVERSE


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of UTF-8 data, and where each word starts and ends.

    The hash is a polynomial over the bytes modulo 2^64, from one running sum, so that a text needs a few
    passes in numpy and no loop over words.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    inside = np.concatenate([[False], ~_IS_BLANK[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    powers, inverse = _powers(len(raw))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[raw] * powers[: len(raw)], dtype=np.uint64)])
    hashes = (sums[ends] - sums[starts]) * inverse[starts] if len(starts) else np.zeros(0, np.uint64)
    return mix64(hashes + (ends - starts).astype(np.uint64)), starts, ends


def grouped_texts(column, limit: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """An Arrow string column as lists of UTF-8 texts of about limit bytes together, with the first row's number.

    Hashing words takes some ten arrays of eight times as many bytes, so that limit bounds a worker's memory.
    """
    first, held, size = 0, [], 0
    for k, text in enumerate(column.to_pylist()):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        held.append(data)
        size += len(data)
        if size >= limit:
            yield first, held
            first, held, size = k + 1, [], 0
    if held:
        yield first, held


def document_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and the place where each text's words start (one more at the end)."""
    hashes, starts, _ = word_hashes(b" ".join(texts))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    heads = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, heads)
