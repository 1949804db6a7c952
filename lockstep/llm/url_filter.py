"""URL filter: host and path rules first, then a blocked Bloom filter before an exact join with listed URLs.

DataFrame functions only. The listed canonical URLs are hashed into a Bloom filter of 256-bit blocks (eight
32-bit words, one bit set in each), held as a table of at most n_blocks rows of 40 bytes; it is broadcast. n_blocks
follows the number of listed URLs up to MAX_BLOCKS, which bounds it at every input size (40 MB). Rows that miss a bit are certainly not listed and need no shuffle; the
others go to an exact join on the canonical URL, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path) of the rules used by the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Query parameters that say where a visitor came from: utm_ and these.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
WORDS = 8
KEYS_A_BLOCK = 16  # 16 bits for each key: about one in 1,000 others passes
MIN_BLOCKS, MAX_BLOCKS = 1 << 10, 1 << 20
_URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, k)


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    return ascii_lower(_part(url, 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return _part(url, 2)


def canonical_url(url: Column) -> Column:
    """host/path?query: no scheme, leading www., default port, trailing slash, fragment or tracking parameter."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    kept = F.filter(F.split(_part(url, 3), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(kept, "&")
    return F.concat(host, F.regexp_replace(url_path(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits. A rule fits its host and all subdomains."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit of each word, from eight groups of five bits of a second hash."""
    other = F.xxhash64(key, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(other, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, n_blocks: int = 1 << 16) -> DataFrame:
    """(block, w0..w7) of the distinct keys in column canonical: at most n_blocks rows."""
    rows = listed.select(_block(F.col("canonical"), n_blocks).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("canonical")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def with_possible(rows: DataFrame, keys: DataFrame, n_blocks: int = 1 << 16) -> DataFrame:
    """Adds possible: whether the Bloom filter of keys may hold the row's canonical. keys has one column of that name."""
    found = rows.withColumn("block", _block(F.col("canonical"), n_blocks)).join(F.broadcast(bloom_blocks(keys, n_blocks)), "block", "left")
    passes = F.lit(True)
    for i, bit in enumerate(_bits(F.col("canonical"))):
        passes = passes & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(bit) != 0)
    return found.withColumn("possible", passes).drop("block", *[f"w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", n_blocks: int | None = None) -> DataFrame:
    """Judges every row of pages: (id, host, path, rule, verdict, possible).

    listed has a column canonical, as canonical_url() makes it; nulls, empty strings and repeats in it count for
    nothing. Where no rule fits, a listed URL is blocked and any other allowed. possible tells whether the Bloom
    filter let the row through to the exact join (null where a rule decided). A null url, or one without ://, has
    empty host and path, fits no rule, is not listed and so is allowed. Repeated rows and ids stay, one result
    each; an empty pages gives an empty result. Other columns are ignored, whatever their names.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("canonical"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    keys = listed.select("canonical").where("canonical <> ''").distinct()
    if n_blocks is None:
        n_blocks = min(MAX_BLOCKS, max(MIN_BLOCKS, 1 << (keys.count() // KEYS_A_BLOCK).bit_length()))
    found = with_possible(rows.where("said is null and canonical <> ''"), keys, n_blocks)
    out = [F.col("id").alias(id_col), "host", "path", "rule"]
    ruled = rows.where("said is not null or canonical = ''").select(*out, F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("boolean").alias("possible"))
    clear = found.where(~F.col("possible")).select(*out, F.lit("allow").alias("verdict"), F.lit(False).alias("possible"))
    hit = found.where("possible").join(keys.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    hit = hit.select(*out, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"), F.lit(True).alias("possible"))
    return ruled.unionByName(clear).unionByName(hit)


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page. Listed: the canonical URLs of all pages reached with a utm_ parameter."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = pages.where(F.col("url").rlike(r"[?&]utm_")).select(canonical_url(F.col("url")).alias("canonical"))
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    host = r"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    cases = lambda what: " ".join(f"when {fits(h, p)} then '{what(v, h, p)}'" for v, h, p in order)
    return rf"""
    with parts as (
      select page_id, url, {host} as host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1) as query
      from pages),
    kept as (
      select *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')), '&') as q
      from parts),
    canon as (
      select page_id, url, host, path,
             regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || case when q <> '' then '?' || q else '' end as canonical,
             case {cases(lambda v, h, p: h + p)} end as rule,
             case {cases(lambda v, h, p: v)} end as said
      from kept),
    listed as (select distinct canonical from canon where canonical <> '' and regexp_matches(url, '[?&]utm_'))
    select page_id, host, path, rule, coalesce(said, case when listed.canonical is not null then 'block' else 'allow' end) as verdict
    from canon left join listed on canon.canonical = listed.canonical"""


OP10_SQL = _sql()
