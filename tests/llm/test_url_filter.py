import pytest
from pyspark.sql import functions as F

from lockstep.llm.url_filter import RULES, canonical_url, filter_urls

URLS = [
    (1, "http://Shop.COM:80/x?b=1&utm_a=2#t", "shop.com/x?b=1"),
    (2, "https://www.a.org/p/?ref=z", "a.org/p"),
    (3, "http://a.org/p", "a.org/p"),
    (4, "http://a.org/P", "a.org/P"),
    (5, None, ""),
    (6, "no scheme/at/all", ""),
    (7, "http://example.com/en/1", "example.com/en/1"),
    (8, "http://www.example.com/en/1", "example.com/en/1"),
    (9, "http://notexample.com/en/1", "notexample.com/en/1"),
    (10, "x://sub.net/fr/?q", "sub.net/fr?q"),
    (11, "http://ÉCOLE.net/de/a://b", "École.net/de/a://b".replace("É", "É")),
    (12, "http://com", "com"),
    (13, "://", ""),
    (3, "http://a.org/p", "a.org/p"),
    (None, "http://b.org/\n1", "b.org/\n1"),
]


def fits(host, path, h, p):
    return (host == h or host.endswith(f".{h}")) and path.startswith(p)


def parts(url):
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    return host, path


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, "h", "r") for i, u, _ in URLS], "page_id long, url string, host string, rule string")


def test_canonical(spark, pages):
    got = [r[0] for r in pages.select(canonical_url(F.col("url"))).collect()]
    assert [g.lower() for g in got] == [c.lower() for *_, c in URLS]


@pytest.mark.parametrize("n_blocks", [1, 4, 1 << 16])
def test_as_brute_force(spark, pages, n_blocks):
    listed = ["a.org/p", "École.net/de/a://b", "", None, "a.org/p", "elsewhere.org/", *(f"filler{i}.org/" for i in range(300))]
    df = spark.createDataFrame([(x, 1) for x in listed], "canonical string, page_id long")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, df, n_blocks=n_blocks).collect()), key=str)
    want = []
    for i, url, canonical in URLS:
        host, path = parts(url)
        ruled = sorted((r for r in RULES if fits(host, path, *r[1:])), key=lambda r: len(r[1] + r[2]))
        verdict = ruled[-1][0] if ruled else "block" if canonical and canonical in listed else "allow"
        want.append((i or 0, host, path, ruled[-1][1] + ruled[-1][2] if ruled else None, verdict))
    assert got == sorted(want, key=str)


def test_filter_is_selective(spark, pages):
    listed = spark.createDataFrame([(f"filler{i}.org/",) for i in range(300)], "canonical string")
    assert filter_urls(pages, listed).where("possible").count() == 0
    assert filter_urls(pages.limit(0), listed).count() == 0
    assert filter_urls(pages, listed.limit(0)).count() == len(URLS)
