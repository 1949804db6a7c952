import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lockstep.llm.secrets import default_network, find_secrets, labelled_findings, op6_secrets, redact_secrets, scan_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain(text):
    """The base patterns by brute force over the str."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


PARTS = ["password", "API_KEY", "apikey", "token", "=", ": ", "'", '"', "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", "é", "ſecret", "你", " ", "\n", "abc+/=_-.", "😀"]


@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_base_spans_as_brute_force(text):
    assert [s for s in scan_text(text.encode(), default_network()) if s[1] < 3] == plain(text)


def test_network_holds_its_recall_on_new_findings():
    rows, labels = labelled_findings(2000, seed=99)
    net = default_network()
    said = net.probability(rows) >= net.threshold
    assert said[labels > 0].mean() >= 0.9
    assert said[labels == 0].mean() <= 0.1
    p = net.probability(rows)
    assert abs(p.mean() - labels.mean()) < 0.05  # calibrated


def test_added_spans_touch_no_base_span():
    text = "é the key: ghp_a8Kd93mNq2ZxW7rT5vYb1LcP0 and password=abcdef0123456789xyz done"
    spans = scan_text(text.encode(), default_network())
    assert [text[a:b] for a, k, b in spans if k == 3] == ["ghp_a8Kd93mNq2ZxW7rT5vYb1LcP0"]
    assert [k for _, k, _ in spans if k < 3] == [0, 2]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, 3), (2, "", 3), (None, "token = abcdefghijkl", 3), (3, "x" * 50_000 + " AKIAABCDEFGHIJ1234 ", 3), (3, "x" * 50_000 + " AKIAABCDEFGHIJ1234 ", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int")


def test_odd_rows(spark, odd):
    got = sorted(((r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.spans]) for r in find_secrets(odd).collect()), key=str)
    assert got == [(0, [("assign", 0, 20)]), (1, []), (2, []), (3, [("access", 50_001, 50_019)]), (3, [("access", 50_001, 50_019)])]
    assert find_secrets(odd.limit(0)).count() == 0


def test_redaction(spark, odd):
    got = {r.doc_id: r.text for r in redact_secrets(odd).collect()}
    assert got[None] == "[SECRET]" and got[1] is None and got[3] == "x" * 50_000 + " [SECRET] "


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in want) for x in range(3))
        assert ",".join(s for s in r.spans.split(",") if not s.startswith("model")) == said


def test_the_network_reads_every_candidate_of_the_corpus(spark):
    """On sf0.01: all base spans and runs of token characters are scored; tokens in hex are found by the network too, words are left alone."""
    rows = op6_secrets(spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    read = sum(r.n_read for r in rows)
    assert read > 3000 and all(r.n_read >= r.n_assign + r.n_access + r.n_hex - 1 for r in rows)
    tokens = sum(len(re.findall(r"token = ", texts[r.doc_id])) for r in rows)
    assert tokens and sum(r.n_confirmed for r in rows) >= 0.9 * tokens
    assert sum(r.n_model for r in rows) <= 0.02 * read


def test_recall_on_findings_planted_into_corpus_texts(spark, sf_dir):
    """Keys of forms that no base pattern knows, in the middle of documents: at least 0.9 are found."""
    rng = np.random.Generator(np.random.PCG64(11))
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    hits = []
    for text in texts:
        key = rng.choice(["", "ghp_", "sk_live_"]) + "".join(rng.choice(alphabet, 32))
        at = text.find(" ", len(text) // 2)
        if at >= 0:
            planted = f"{text[:at]} {key}{text[at:]}"
            hits.append(any(k == 3 and planted[a:b] == key for a, k, b in scan_text(planted.encode(), default_network())))
    assert len(hits) > 150 and np.mean(hits) >= 0.9


def test_training_repeats():
    assert np.array_equal(labelled_findings(50)[0], labelled_findings(50)[0])


def test_secrets_at_the_end_of_long_runs():
    path = "com/example/some/harmless/folder/of/packages/and/more/classes/v2/"
    rng = np.random.Generator(np.random.PCG64(3))
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(alphabet, 40)) for _ in range(40)]
    found = lambda value: any(k == 3 for _, k, _ in scan_text(f"see the page {value} for more".encode(), default_network()))
    assert np.mean([found(path + k) for k in keys]) >= 0.9
    assert not found(path)


def test_what_a_base_span_leaves_of_a_run_is_scored():
    text = "the key: sk-proj-0123456789abcdef0123Zk8Qd93mNq2XxW7rT5vYb1LcP0Hs end"
    assert [(k, text[a:b]) for a, k, b in scan_text(text.encode(), default_network())] == [(2, "0123456789abcdef0123"), (3, "Zk8Qd93mNq2XxW7rT5vYb1LcP0Hs")]
