"""Queries of the text functions: versions, ranges, names, facts and addresses built from the tables' columns.

Each text is one SQL expression that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import roles
from .registry import query

#: A version string of a part: releases, ranges, pins and names of many forms.
VERSION = """case p_partkey % 14
 when 0 then 'v' || cast(p_size as string) || '.0.' || cast(p_partkey % 7 as string) || '.0'
 when 1 then '^' || cast(p_size as string) || '.' || cast(p_partkey % 10 as string)
 when 2 then '>=1.' || cast(p_size as string) || ', <2.' || cast(p_partkey % 9 as string) || '.*'
 when 3 then 'v0.0.0-20240102030405-' || substring(md5(cast(p_partkey as string)), 1, 12)
 when 4 then md5(cast(p_partkey as string)) || substring(md5(cast(p_partkey as string)), 1, 8)
 when 5 then '== ' || cast(p_size as string) || '.' || cast(p_partkey as string)
 when 6 then '<=' || cast(p_size as string) || '.0.1-linux'
 when 7 then 'release_' || cast(p_size as string) || '_00' || cast(p_partkey % 7 as string) || '-GA'
 when 8 then '"' || cast(p_size as string) || '.x"'
 when 9 then '1.' || cast(p_size as string) || '.0.Final'
 when 10 then '[1.' || cast(p_size as string) || ',2.0)'
 when 11 then '~> 2.' || cast(p_size as string) || '.x'
 when 12 then 'git+' || p_brand || '@' || substring(md5(cast(p_partkey as string)), 1, 12)
 else p_name end"""
#: A path of a part, in several naming styles.
PATH = """'src/' || lower(p_type) || '/' || case p_partkey % 7
 when 0 then replace(p_name, ' ', '_') || '_test.py'
 when 1 then 'HTTPServer' || substring(p_brand, 1, 5) || 'ErrorHandler' || cast(p_size as string) || 'Parser.java'
 when 2 then 'test_' || replace(p_name, ' ', '-') || '.spec.ts'
 when 3 then 'spec_' || replace(p_name, ' ', '') || 'Impl.go'
 when 4 then '.' || replace(p_name, ' ', '.')
 when 5 then 'TestTest' || replace(p_name, ' ', '') || 'TESTSPEC'
 else upper(p_name) || '.x' end"""
SUBJECT = """'ENG-' || cast(o_orderkey * 1234567 as string) || ' ' || o_orderpriority || ' AB1-' || cast(o_custkey as string) || case when o_orderkey % 3 = 0 then ' (#' || cast(o_custkey as string) || ')' else '' end"""
BODY = """'why: ' || o_orderpriority || chr(10) || 'Change-Id: I' || md5(cast(o_orderkey as string)) || chr(10) || case when o_orderkey % 2 = 0 then ' signed-off-by :  c' || cast(o_custkey % 50 as string) || ' ' || chr(13) || chr(10) || 'Signed-Off-By: c' || cast(o_custkey % 50 as string) else 'FIXES:' end || chr(10) || 'Reviewed-on: ' || repeat(o_orderpriority, 60)"""
ADDRESS = """case p_partkey % 9
 when 0 then 'https://github.com/' || replace(p_name, ' ', '-') || '/' || p_type || '/tree/main/src'
 when 1 then 'git@gitlab.com:' || p_type || '/sub/' || replace(p_name, ' ', '_') || '.git'
 when 2 then p_type || '/' || replace(p_name, ' ', '.')
 when 3 then ' https://GitLab.com/a/b/' || p_type || '/-/issues/' || cast(p_size as string)
 when 4 then 'ssh://git@example.org:2222/' || p_type || '/' || replace(p_name, ' ', '-')
 when 5 then 'http://bitbucket.org/' || p_type || '/r' || cast(p_partkey as string) || '/src/x?at=y#z'
 when 6 then p_name || ' is no address'
 when 7 then 'https://example.com/'
 else p_type end"""
DEPENDENCY = """case p_partkey % 6
 when 0 then 'github.com/' || p_type || '/' || replace(p_name, ' ', '-') || '/v' || cast(p_size as string)
 when 1 then '@' || p_type || '/' || replace(p_name, ' ', '-')
 when 2 then 'https://example.com/' || p_type || '/' || replace(p_name, ' ', '-') || '.git#main'
 when 3 then '"' || replace(p_name, ' ', '-') || '/"'
 when 4 then 'v2'
 else p_brand end"""


def _parts(s: SparkSession, d: str, expression: str) -> DataFrame:
    return roles.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(expression).alias("raw"))


def _commits(s: SparkSession, d: str) -> DataFrame:
    return roles.table(s, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("committed_at"), F.expr(SUBJECT).alias("subject"), F.expr(BODY).alias("body"))


def _of(expression: str) -> str:
    return f"with raws as (select p_partkey as id, {expression} as raw from part)"


_UNQUOTED = _of(VERSION) + r""", texts as (select id, regexp_replace(trim(raw), '^["'']+|["'']+$', '', 'g') as t from raws)"""
_KEY = r"""(case when regexp_extract({t}, '{p}', 1) <> '' then
 regexp_replace(array_to_string(list_transform(regexp_split_to_array(regexp_extract({t}, '{p}', 1), '[._]'), lambda x: x::hugeint::varchar), '.'), '(\.0)+$', '')
 || case when regexp_replace(lower(regexp_extract({t}, '{p}', 2)), '^[-+._]+', '') in ('', 'jre', 'android', 'ga', 'final') then '' else '-' || regexp_replace(lower(regexp_extract({t}, '{p}', 2)), '^[-+._]+', '') end end)""".replace("{p}", text.VERSION_AT_END)


@query("version_key", _UNQUOTED + f" select id, {_KEY.replace('{t}', 't')} as version_key from texts")
def version_key(s, d):
    return _parts(s, d, VERSION).select("id", text.version_key(F.col("raw")).alias("version_key"))


@query("range_bounds", _UNQUOTED + f""", found as (select id, list_zip(regexp_extract_all(t, '{text.BOUND}', 1), regexp_extract_all(t, '{text.BOUND}', 2)) as f from texts)
select id, regexp_replace(regexp_replace(list_filter(f, lambda x: coalesce(x[1], '') not in ('<', '<='))[1][2], '{text.WILDCARD_TAIL}', ''), '\\.+$', '') as floor,
 regexp_replace(regexp_replace(list_filter(f, lambda x: coalesce(x[1], '') in ('<', '<='))[1][2], '{text.WILDCARD_TAIL}', ''), '\\.+$', '') as ceiling from found""")
def range_bounds(s, d):
    low, high = text.bounds(F.col("raw"))
    return _parts(s, d, VERSION).select("id", low.alias("floor"), high.alias("ceiling"))


@query("classify_reference", _UNQUOTED + f""", e as (select id, coalesce(nullif(regexp_extract(t, '{text.EXACT}', 1), ''), t) as v from texts),
x as (select id, case when regexp_extract(v, '{text.PSEUDO}', 1) <> '' then regexp_extract(v, '{text.PSEUDO}', 1)
 when regexp_extract(v, '{text.SHA}', 1) <> '' and not regexp_matches(v, '{text.TAG}') then regexp_extract(v, '{text.SHA}', 1) end as sha, regexp_matches(v, '{text.TAG}') as tag from e)
select id, case when sha is not null then 'commit' when tag then 'tag' else 'range' end as kind, sha from x""")
def classify_reference(s, d):
    kind, sha = text.classify(F.col("raw"))
    return _parts(s, d, VERSION).select("id", kind.alias("kind"), sha.alias("sha"))


@query("version_ordinal", _UNQUOTED + f", k as (select id, {_KEY.replace('{t}', 't')} as k from texts) select id, k as version_key, case when not contains(k, '-') then array_to_string(list_transform(string_split(k, '.'), lambda x: x::decimal(20, 0)::varchar), '.') end as ordinal from k where k is not null")
def version_ordinal(s, d):
    rows = _parts(s, d, VERSION).select("id", text.version_key(F.col("raw")).alias("version_key")).where("version_key is not null")
    return rows.withColumn("ordinal", F.array_join(F.transform(text.ordinal(F.col("version_key")), lambda x: x.cast("string")), "."))


def _cut(name: str) -> str:
    """The SQL of the affix rule: each affix at the front, then at the end, as long as something is left."""
    step = name
    for affix in ("test", "test", "spec", "spec", "test", "spec", "impl", "test", "spec"):
        step = f"regexp_replace(regexp_replace({step}, '^{affix}(.+)$', '\\1', 's'), '^(.+){affix}$', '\\1', 's')"
    return step


@query("stem_tokens", _of(PATH) + f""", n as (select id, string_split(string_split(raw, '/')[-1], '.')[1] as name from raws)
select id, regexp_replace({_cut('lower(name)')}, '^[._-]+|[._-]+$', '', 'g') as stem,
 list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+'), lambda x: lower(x)), lambda x: length(x) >= 4 and x not in {text.STOPWORDS}))) as tokens from n""")
def stem_tokens(s, d):
    return _parts(s, d, PATH).select("id", text.stem(F.col("raw")).alias("stem"), text.concept_tokens(F.col("raw")).alias("tokens"))


@query("path_parts", _of("'  ./' || " + PATH) + r""", n as (select id, regexp_replace(trim(raw), '^\./', '') as p from raws), b as (select id, p, string_split(p, '/')[-1] as base from n)
select id, array_to_string(string_split(p, '/')[:-2], '/') as dir_path, base as basename, length(p) - length(replace(p, '/', '')) as depth,
 case when contains(ltrim(base, '.'), '.') and length(string_split(base, '.')[-1]) <= 20 then lower(string_split(base, '.')[-1]) else '' end as extension from b""")
def path_parts(s, d):
    rows = _parts(s, d, "'  ./' || " + PATH).select("id", text.normalised(F.col("raw")).alias("p"))
    p = F.col("p")
    return rows.select("id", text.directory(p).alias("dir_path"), text.basename(p).alias("basename"), text.depth(p).alias("depth"), text.extension(p).alias("extension"))


@query("dependency_ref", _of(DEPENDENCY) + r""", a as (select id, regexp_replace(regexp_replace(regexp_replace(trim(raw), '^["'']+|["'']+$', '', 'g'), '/+$', ''), '^@+', '') as t from raws),
b as (select id, regexp_replace(string_split(case when contains(t, '://') then substr(t, strpos(t, '://') + 3) else t end, '#')[1], '\.git$', '') as t from a),
p as (select id, list_filter(string_split(t, '/'), lambda x: x <> '' and not regexp_matches(x, '^v[0-9]+$')) as parts from b)
select id, case when len(parts) > 1 then lower(parts[-2]) end as owner, lower(coalesce(parts[-1], '')) as name from p""")
def dependency_ref(s, d):
    owner, name = text.repo_ref(F.col("raw"))
    return _parts(s, d, DEPENDENCY).select("id", owner.alias("owner"), name.alias("name"))


@query("repository_url", _of(ADDRESS) + r""", t as (select id, trim(raw) as t, trim(trim(raw), '/') as bare from raws),
u as (select id, case when not contains(t, '//') and regexp_matches(t, '^[\w.-]+@[\w.-]+:.+$') then 'https://' || regexp_extract(t, '@([\w.-]+):', 1) || '/' || regexp_extract(t, '@[\w.-]+:(.+)$', 1)
 when contains(t, '://') then t when regexp_full_match(bare, '[\w.-]+(/[\w.-]+)?') then 'https://github.com/' || bare end as u from t),
p as (select id, lower(regexp_extract(u, '://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as host, regexp_extract(u, '://[^/?#]*:([0-9]+)', 1) as port, list_filter(string_split(regexp_extract(u, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from u),
c as (select id, host, port, parts[:coalesce(list_min(list_filter(list_transform(parts, lambda x, i: case when i > 2 and x in {deep} then i - 1 end), lambda x: x is not null)), len(parts))] as parts,
 case host when 'github.com' then 'github' when 'gitlab.com' then 'gitlab' when 'bitbucket.org' then 'bitbucket' else 'git' end as provider from p),
o as (select id, host, port, provider, len(parts) as n, case when provider = 'gitlab' and len(parts) > 2 then array_to_string(parts[:-2], '/') else parts[1] end as owner, regexp_replace(case when provider = 'gitlab' and len(parts) > 2 then parts[-1] else parts[2] end, '\.git$', '') as repo from c),
w as (select *, 'https://' || host || case when port <> '' then ':' || port else '' end || '/' || owner || coalesce('/' || repo, '') as web from o)
select id, case when n > 0 then provider end as provider, case when n > 0 then host end as host, case when n > 0 then owner end as owner, case when n > 0 then repo end as repo, case when n > 0 then web end as web_url,
 case when n > 0 then coalesce(web || case when repo is not null then '.git' end, '') end as clone_url from w""".replace("{deep}", str(text.DEEP_LINKS)))
def repository_url(s, d):
    return _parts(s, d, ADDRESS).select("id", *[v.alias(k) for k, v in text.repository_url(F.col("raw")).items()])


_FACTS = f"""with commits as (select o_orderkey as commit_id, epoch(o_orderdate)::bigint as committed_at, {SUBJECT} as subject, {BODY} as body from orders),
lines as (select commit_id, committed_at, unnest(regexp_split_to_array(body, '\\r\\n|[\\n\\r]')) as line from commits),
told as (select commit_id, committed_at, lower(trim(string_split(line, ':')[1])) as name, trim(substr(line, strpos(line, ':') + 1)) as value from lines where contains(line, ':')),
facts as (select commit_id, committed_at, 'issue_key' as kind, unnest(list_distinct(regexp_extract_all(subject, '{text.ISSUE_KEY}', 1))) as key from commits
 union all select commit_id, committed_at, 'pr_ref', unnest(list_distinct(regexp_extract_all(subject, '{text.PR_REF}', 1))) from commits
 union all select distinct commit_id, committed_at, 'trailer', substr(name || ': ' || value, 1, 300) from told where name in {text.TRAILERS} and value <> '')"""


def _facts(s: SparkSession, d: str) -> DataFrame:
    rows = _commits(s, d).select("commit_id", "committed_at", F.explode(text.facts(F.col("subject"), F.col("body"))).alias("f"))
    return rows.select("commit_id", "committed_at", "f.kind", "f.key")


@query("facts_extract", _FACTS + " select commit_id, kind, key from facts")
def facts_extract(s, d):
    return _facts(s, d).drop("committed_at")


@query("commits_by_key", _FACTS + " select commit_id, committed_at, key from facts where kind = 'trailer' and key = 'signed-off-by: c7' order by committed_at desc, commit_id limit 50")
def commits_by_key(s, d):
    rows = _facts(s, d).where("kind = 'trailer' and key = 'signed-off-by: c7'")
    return rows.select("commit_id", "committed_at", "key").orderBy(F.desc("committed_at"), "commit_id").limit(50)


@query("commit_facts", _FACTS + " select commit_id, count(*) as facts, count(*) filter (kind = 'trailer') as trailers from facts group by 1")
def commit_facts(s, d):
    return _facts(s, d).groupBy("commit_id").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("kind") == "trailer").alias("trailers"))


@query("module_path", _of("repeat('./', cast(p_partkey % 3 as int)) || repeat('/', cast(p_partkey % 2 as int)) || p_type || '/./' || p_brand") + r" select id, regexp_replace(raw, '^(\./|/)+', '') as path from raws")
def module_path(s, d):
    return _parts(s, d, "repeat('./', cast(p_partkey % 3 as int)) || repeat('/', cast(p_partkey % 2 as int)) || p_type || '/./' || p_brand").select("id", text.module_path(F.col("raw")).alias("path"))
