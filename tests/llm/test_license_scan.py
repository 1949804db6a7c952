import random
import re

import pytest

from lockstep.llm.license_scan import PHRASES, TEMPLATES, frequency_order, op13_license_scan, scan_licenses, summary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, templates=TEMPLATES, phrases=PHRASES, percent=90, hop=32):
    """(n_words, places, notices) by looking at every block and every template."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places = sorted((i, label, p) for label, p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    notices = []
    for start in range(0, len(words), hop):
        block = set(words[start : start + 2 * hop])
        for label, t in templates:
            tokens = set(t.split())
            if 100 * len(tokens & block) >= percent * len(tokens):
                notices.append((start, label, t, len(tokens & block) / len(tokens)))
    return len(words), places, sorted(notices)


def got(df):
    return sorted(((r.doc_id, (r.n_words, [tuple(x) for x in r.places], [tuple(x) for x in r.notices])) for r in df.collect()), key=str)


@pytest.mark.parametrize("percent,hop", [(90, 32), (60, 32), (34, 25)])
def test_as_by_brute_force(spark, percent, hop):
    rng = random.Random(percent)
    vocabulary = sorted({w for _, t in TEMPLATES for w in t.split()}) + ["lorem", "ñandú"] * 60
    docs = [(0, None), (1, ""), (2, "?! \n"), (3, "MIT License"), (4, "MIT-License, mit license mit License"), (5, "general public\nlicense " * 40), (5, "general public\nlicense " * 40), (None, "the Apache License")]
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 150))
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(TEMPLATES)[1].title().split()
            if rng.random() < 0.5:
                notice[rng.randrange(len(notice))] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = notice
        docs.append((10 + i, rng.choice([" ", "\n", " // "]).join(words)))
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id int, text string, words string, block int")
    want = sorted(((i, brute(t, percent=percent, hop=hop)) for i, t in docs), key=str)
    assert got(scan_licenses(rows, percent=percent, hop=hop)) == want
    assert sum(len(n) for _, (_, _, n) in want) > 100


def test_notice_across_lines_and_with_one_word_changed(spark):
    header = TEMPLATES[2][1].split()
    wrapped = "\n// ".join(" ".join(header[k : k + 5]) for k in range(0, len(header), 5)).replace("person", "entity")
    docs = spark.createDataFrame([(1, "lorem ipsum " * 200 + wrapped + " dolor" * 300), (2, "released under the open license"), (3, "The MIT licensed work")], "doc_id long, text string")
    rows = {r.doc_id: r for r in summary(scan_licenses(docs)).collect()}
    assert rows[1].labels == "mit" and rows[1].base_labels == "" and 0.9 <= rows[1].score < 1
    assert rows[2].labels == rows[3].labels == "" and rows[2].score == 0


def test_order_and_empty_table(spark):
    docs = spark.createDataFrame([("the The the mit",), (None,), ("license mit",)], "text string")
    assert frequency_order(docs, ["license", "mit", "the", "absent"]) == ["absent", "license", "mit", "the"]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert summary(scan_licenses(none)).count() == 0
    with pytest.raises(ValueError):
        scan_licenses(none, templates=[("long", "w " * 40 + "w")])


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op13_license_scan(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
