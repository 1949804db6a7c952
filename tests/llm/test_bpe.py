import base64
import hashlib

import numpy as np
import pytest

from lockstep.llm.bpe import boundaries, decode, digests, encode, splitter
from public_tokenizers import PATTERN, path

RANKS = path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    (1, "Hello world, it's 12345 o'clock\n\n\n  done   "),
    (2, None),
    (3, ""),
    (4, "É ça ñ 你好 мир 😀😀  x\x1cx\xa0y ͸ ²½"),
    (5, "a" * 700),
    (6, " \n" * 500 + "x" + "\t" * 300),
    (7, "the quick (brown) fox's 3.14 dögs \n" * 60),
    (7, "the quick (brown) fox's 3.14 dögs \n" * 60),
    (None, "no id " * 100),
    (8, "<|endoftext|> we'll"),
    (9, "x'll " + "?!" * 400 + " end\n\n\nfoo" * 50),
]


@pytest.mark.parametrize("chunk,overlap", [(32768, 1024), (128, 32), (128, 64)])
def test_as_the_library(spark, library, chunk, overlap):
    docs = spark.createDataFrame([(i, t, "z") for i, t in TEXTS], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4")), bytes(r.decoded)) for r in decode(encode(docs, RANKS, chunk, overlap), RANKS).collect())
    want = sorted((i or 0, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for i, t in TEXTS)
    assert got == want


def test_chunks_stitch_where_boundaries_meet():
    text = "some words, and 12 more; " * 20
    ends = boundaries(text)
    late = boundaries(text[37:]) + 37
    first = min(set(ends) & set(late))
    assert [e for e in ends if e >= first] == [e for e in late if e >= first]
    assert splitter("😀") is not splitter("plain")


def test_digests_over_the_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in digests(decode(encode(docs, RANKS, 2048, 256), RANKS)).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0
