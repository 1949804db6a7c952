import base64
import hashlib

import numpy as np
import pytest

import corpus_pipeline
from lockstep.llm.common import materialise
from public_tokenizers import PATTERN, path
from tests.llm.test_jaccard_join import brute
from tests.llm.test_secrets import plain


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, sf_dir), name)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]
    for before, after in stages[:-1]:
        assert before.dtypes == after.dtypes


def test_quality_keeps_clean_documents(spark, stages):
    before, after = map(rows, stages[0])
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    kept = lambda quality, toxic: np.mean([r.doc_id in after for r in labels if (r.quality, r.toxic) == (quality, toxic)])
    assert kept(1, 0) >= 0.98 and kept(0, 0) <= 0.2 and kept(1, 1) <= 0.5
    assert all(after[i] == before[i] for i in after)


def test_one_of_each_component(stages):
    before, after = map(rows, stages[1])
    want = {i for _, i, _, c in brute([(i, r.text) for i, r in before.items()], 5, 80) if i == c}
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_secrets_are_masked(stages):
    before, after = map(rows, stages[2])
    assert set(before) == set(after)
    for i, r in after.items():
        assert plain(r.text) == [] and r.n_chars == len(r.text)
        if not plain(before[i].text):
            assert "[SECRET]" in r.text or r.text == before[i].text


def test_mixture_has_words_of_its_document(stages):
    before, after = map(rows, stages[3])
    size = lambda t: len(t.split())
    assert set(after) <= set(before)
    total = 0
    for i, r in after.items():
        total += size(r.text)
        assert 0 < size(r.text) <= 2 * size(before[i].text) and r.n_chars == len(r.text)
        assert set(r.text.split()) <= set(before[i].text.split())
    assert abs(total / sum(size(r.text) for r in before.values()) - 1.5) < 0.02


def test_tokens_as_the_library(stages):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    before, after = map(rows, stages[4])
    assert set(before) == set(after)
    for i, r in before.items():
        ids = np.array(library.encode_ordinary(r.text), "<u4")
        assert after[i].n_tokens == len(ids) and after[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert after[i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
