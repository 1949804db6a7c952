"""Byte-level BPE encoding and decoding over whole texts, long ones in overlapping chunks.

Texts of up to chunk_chars characters are pre-tokenised and encoded where they are. A longer text is cut into
chunks, each with the overlap that it shares with the next. All chunks are pre-tokenised in parallel, each from its
own start, which may lie inside a pre-token. Two scans of the same characters that share one boundary share all
later ones, so neighbours are stitched at the first boundary that both have in their overlap; each chunk then
encodes the pieces between its two stitches. Where neighbours share no boundary (one unbroken run longer than the
overlap), the whole text is encoded in one piece, with the same result.

Decoding concatenates the bytes of the ids; only whole documents are turned into text, as ids may end inside a
character.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches

CHUNK_CHARS = 32_768
OVERLAP = 1_024
LOOKAHEAD = 16
CACHE_PIECES = 400_000

#: White_Space of Unicode, as ranges of code points. Fixed values.
_SPACE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def load_ranks(path: str) -> bytes:
    """The bytes of a rank file (token in base64, blank, rank); a few hundred KB, shipped with each task."""
    with open(path, "rb") as file:
        return file.read()


def _class(major: str) -> str:
    """The characters below U+10000 whose general category begins with major, as the inside of a character class."""
    found = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == major]
    return "".join(rf"\u{c:04x}" for c in found)


@cache
def splitters() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """(for characters assigned below U+10000, what makes a text need the other, for any text).

    All have the meaning of public_tokenizers.PATTERN. The first writes its classes out, which Python's own engine
    scans faster than the regex library scans properties. The first alternative there can match nowhere where the
    contractions can, so the order among them doesn't matter.
    """
    import regex
    from public_tokenizers import PATTERN

    letters, digits = _class("L"), _class("N")
    space = "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in _SPACE)
    fast = re.compile(rf" ?[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")
    unassigned = "".join(rf"\u{c:04x}" for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn")
    return fast, re.compile(rf"[\U00010000-\U0010ffff{unassigned}]"), regex.compile(PATTERN)


def splitter(text: str) -> re.Pattern:
    fast, other, slow = splitters()
    return slow if not text.isascii() and other.search(text) else fast


class Pieces(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers; holds a bounded number of them."""

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.table = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=self.table, special_tokens={})
        self.tokens = [b""] * (max(self.table.values()) + 1)
        for token, rank in self.table.items():
            self.tokens[rank] = token

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.encoding._core_bpe.encode_single_piece(piece.encode("utf-8", "replace")))
        if sys.byteorder != "little":
            ids.byteswap()
        found = ids.tobytes()
        if len(piece) < 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = found
        return found

    def encode(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))



_LOADED: dict[int, Pieces] = {}


def pieces_of(ranks: bytes) -> Pieces:
    """One table for each worker process and rank file."""
    key = hash(ranks)
    if key not in _LOADED:
        _LOADED[key] = Pieces(ranks)
    return _LOADED[key]


def boundaries(text: str) -> np.ndarray:
    """Where pre-tokens of text end, from its start on."""
    return np.fromiter((m.end() for m in splitter(text).finditer(text)), np.int64)


def _encode_short(ranks: bytes, n: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(ranks)
        for batch in rows:
            ids = [table.encode(splitter(t).findall(t)) if t else b"" for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ids, pa.binary())], names=[*batch.schema.names[:n], "ids"])

    return run


def _cut(chunk: int, overlap: int):
    """Rows (row, chunk, start, last, text) of the long texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for k, s in enumerate(starts):
                    part = text[s:] if s == starts[-1] else text[s : s + chunk + overlap + LOOKAHEAD]
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "row": row, "chunk": k, "start": s, "last": s == starts[-1], "text": part}], _CHUNKS)

    return run


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("row", pa.string()), ("chunk", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
_CHUNKS_SQL = "doc_id long, row string, chunk int, start long, last boolean, text string"


def _scan(chunk: int, overlap: int):
    """Adds head and tail: the boundaries within the overlap with the chunk before and after, in places of the text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            heads, tails = [], []
            for start, text in zip(batch.column("start").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ends = boundaries(text)
                heads.append((ends[ends <= overlap] + start).tolist())
                tails.append((ends[(ends > chunk) & (ends <= chunk + overlap)] + start).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=[*batch.schema.names, "head", "tail"])

    return run


def _encode_stitched(ranks: bytes):
    """Encodes the pieces between a chunk's two stitches."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(ranks)
        for batch in rows:
            out = []
            for row in batch.select(["start", "text", "from", "to"]).to_pylist():
                text, start = row["text"], row["start"]
                to = row["to"] - start if row["to"] is not None else len(text)
                pieces = []
                for m in splitter(text).finditer(text, row["from"] - start):
                    if m.end() > to:
                        break
                    pieces.append(m.group())
                out.append(table.encode(pieces))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("chunk"), pa.array(out, pa.binary())], names=["doc_id", "row", "chunk", "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): the ids of the whole text as little-endian unsigned 32-bit integers.

    ids are those that the tiktoken library's encode_ordinary gives with the same ranks and pattern. A null or empty
    text has no ids (an empty binary). Null ids and repeated rows stay, a result each; repeats of one long text under
    one id are encoded once for each. Other columns are ignored. An empty table gives an empty one.
    """
    assert chunk_chars >= 2 * overlap
    ranks = load_ranks(ranks_path)
    batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(_encode_short(ranks, 1), "doc_id long, ids binary")
    long_ = rows.where(F.length("text") > chunk_chars).groupBy("doc_id", F.sha2("text", 256).alias("row")).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    times = long_.select("doc_id", "row", "times")
    chunks = long_.select("doc_id", "row", "text").mapInArrow(_cut(chunk_chars, overlap), _CHUNKS_SQL)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = chunks.repartition(n, "row", "chunk").mapInArrow(_scan(chunk_chars, overlap), f"{_CHUNKS_SQL}, head array<long>, tail array<long>")
    of_doc = Window.partitionBy("doc_id", "row").orderBy("chunk")
    stitch = F.when(F.col("chunk") > 0, F.array_min(F.array_intersect(F.lag("tail").over(of_doc), F.col("head")))).otherwise(F.lit(0).cast("long"))
    scanned = scanned.withColumn("from", stitch).withColumn("to", F.lead("from").over(of_doc))
    scanned = scanned.withColumn("torn", F.max(F.col("from").isNull()).over(Window.partitionBy("doc_id", "row"))).drop("head", "tail")
    pieces = scanned.where("not torn").mapInArrow(_encode_stitched(ranks), "doc_id long, row string, chunk int, ids binary")
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.hex("ids").alias("ids")))), lambda x: x["ids"]), "")
    joined = pieces.groupBy("doc_id", "row").agg(F.unhex(hexes).alias("ids"))
    torn = scanned.where("torn and chunk = 0").select("doc_id", "row")
    whole = long_.join(torn, (long_["doc_id"].eqNullSafe(torn["doc_id"])) & (long_["row"] == torn["row"]), "left_semi")
    whole = whole.select("doc_id", "row", "text").mapInArrow(_encode_short(ranks, 2), "doc_id long, row string, ids binary")
    found = joined.unionByName(whole)
    found = found.join(times.withColumnRenamed("doc_id", "own").withColumnRenamed("row", "same"), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("row") == F.col("same")))
    return short.unionByName(found.select("doc_id", F.explode(F.array_repeat("ids", F.col("times").cast("int"))).alias("ids")))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded, the bytes that the ids of (doc_id, ids) stand for; null ids give null."""
    ranks = load_ranks(ranks_path)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces_of(ranks)
        for batch in rows:
            out = [table.decode(x) if x is not None else None for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    ranks = path("byte_bpe_multi_50k.tiktoken")
    return digests(decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks), ranks))
