"""Queries of the dependency stages over manifest histories that orders and lines stand for.

A customer's orders are the revisions of its manifest, in time; an order's lines are the entries. Orders of status P
are tagged releases of the customer's nation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import version_key
from ..operators import dependencies as dep
from ..sources import roles
from .registry import query
from .texts import DEPENDENCY

RAW = "'v1.' || cast(cast(min(l_quantity) as int) as string)"
#: The version that a line asks of its supplier's nation.
VERSION = """case l_linenumber % 4 when 0 then substring(md5(cast(l_orderkey as string)), 1, 20)
 when 1 then 'v' || cast(l_partkey % 40 as string) || '.' || cast(l_suppkey % 10 as string) when 2 then '^' || cast(l_partkey % 40 as string) || '.' || cast(l_suppkey % 10 as string) || '.0'
 else '<' || cast(l_partkey % 40 as string) || '.' || cast(l_suppkey % 10 as string) end"""
TAG = "'v' || cast(o_custkey % 40 as string) || '.' || cast(o_orderkey % 10 as string) || '.0'"

_REVISIONS = f"""with revisions as (select o_custkey as repo, o_orderkey as sha, o_orderdate as at_, row_number() over (partition by o_custkey order by o_orderdate, cast(o_orderkey as string)) as nr from orders),
entries as (select o_custkey as repo, l_orderkey as sha, l_suppkey % 25 as name, {RAW} as raw from lineitem join orders on l_orderkey = o_orderkey group by 1, 2, 3),
lagged as (select e.*, nr, lag(nr) over w as before, lag(raw) over w as old from entries e join revisions using (repo, sha) window w as (partition by repo, name order by nr)),
changed as (select * from lagged where before is null or before < nr - 1 or old is distinct from raw)"""


def _history(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = roles.table(s, d, "orders")
    repo = F.concat(F.lit("org/r"), F.col("o_custkey").cast("string")).alias("repo")
    revisions = orders.select(repo, F.lit("go.mod").alias("manifest"), F.col("o_orderkey").cast("string").alias("sha"), F.col("o_orderdate").alias("at"))
    lines = roles.table(s, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    entries = lines.groupBy("o_custkey", "l_orderkey", F.expr("l_suppkey % 25").alias("s")).agg(F.expr(RAW).alias("raw"))
    entries = entries.select(repo, F.lit("go.mod").alias("manifest"), F.col("l_orderkey").cast("string").alias("sha"), F.concat(F.lit("example.com/org/r"), F.col("s").cast("string")).alias("name"), "raw", F.lit("go").alias("ecosystem"))
    return revisions, entries


@query("snapshot_changes", _REVISIONS + " select 'org/r' || repo as repo, sha::varchar as sha, 'example.com/org/r' || name as name, raw from changed")
def snapshot_changes(s, d):
    return dep.snapshot_changes(*_history(s, d)).select("repo", "sha", "name", "raw")


@query("bump_extract", _REVISIONS + """, locks as (select o_custkey as repo, l_orderkey as sha, l_suppkey % 25 as name, max('9.' || l_linenumber) as version from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1, 2, 3)
select 'org/r' || c.repo as repo, c.sha::varchar as sha, 'example.com/org/r' || c.name as name, coalesce(version, raw) as version, case when version is null then 'declared' else 'locked' end as tier
from changed c left join locks using (repo, sha, name) where c.repo <> c.name""")
def bump_extract(s, d):
    lines = roles.table(s, d, "lineitem").where("l_returnflag = 'R'").join(roles.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda x: F.col(x).cast("string")
    locked = lines.select(F.concat(F.lit("org/r"), text("o_custkey")).alias("repo"), F.lit("").alias("dir"), text("l_orderkey").alias("sha"), F.lit("go").alias("ecosystem"), F.concat(F.lit("example.com/org/r"), F.expr("cast(l_suppkey % 25 as string)")).alias("name"), F.concat(F.lit("9."), text("l_linenumber")).alias("version"))
    return dep.bumps(dep.snapshot_changes(*_history(s, d)), locked).select("repo", "sha", "name", "version", "tier")


@query("transitive_entries", _REVISIONS + """, locks as (select distinct o_custkey as repo, l_orderkey as sha, l_partkey % 60 as name, 'v' || l_partkey as version from lineitem join orders on l_orderkey = o_orderkey)
select 'org/r' || repo as repo, sha::varchar as sha, 'example.com/org/r' || name as name, version from locks where not exists (select 1 from entries e where e.repo = locks.repo and e.sha = locks.sha and e.name = locks.name)""")
def transitive_entries(s, d):
    lines = roles.table(s, d, "lineitem").join(roles.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    text = lambda x: F.col(x).cast("string")
    locked = lines.select(F.concat(F.lit("org/r"), text("o_custkey")).alias("repo"), F.lit("").alias("dir"), text("l_orderkey").alias("sha"), F.lit("go").alias("ecosystem"), F.concat(F.lit("example.com/org/r"), F.expr("cast(l_partkey % 60 as string)")).alias("name"), F.concat(F.lit("v"), text("l_partkey")).alias("version")).distinct()
    return dep.transitive(locked, _history(s, d)[1]).select("repo", "sha", "name", "version")


@query("package_claims", "select p_type as ecosystem, lower(p_name) as name, min(p_brand) as repo from part group by 1, 2 having count(distinct p_brand) = 1")
def package_claims(s, d):
    return dep.claims(roles.table(s, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("ecosystem"), F.col("p_name").alias("name"))).select("ecosystem", "name", "repo")


_NAMES = f"""with names as (select p_partkey as id, {DEPENDENCY} as raw, case p_partkey % 4 when 0 then 'npm' when 1 then '' else 'go' end as ecosystem from part),
a as (select *, regexp_replace(regexp_replace(regexp_replace(trim(raw), '^["'']+|["'']+$', '', 'g'), '/+$', ''), '^@+', '') as t from names),
b as (select *, regexp_replace(string_split(case when contains(t, '://') then substr(t, strpos(t, '://') + 3) else t end, '#')[1], '\\.git$', '') as u from a),
c as (select *, list_filter(string_split(u, '/'), lambda x: x <> '' and not regexp_matches(x, '^v[0-9]+$')) as parts from b),
r as (select id, ecosystem, lower(trim(raw)) as claim, case when len(parts) > 1 then lower(parts[-2]) end as owner, lower(coalesce(parts[-1], '')) as name from c),
repos as (select p_type || '/' || replace(p_name, ' ', '-') || '/' || p_brand as repo, lower(p_type) as owner, lower(replace(p_name, ' ', '-')) as name from part group by 1, 2, 3),
fulls as (select owner, name, max(repo) as repo from repos group by 1, 2), bares as (select name, min(repo) as repo from repos group by 1 having count(distinct repo) = 1),
claims as (select 'npm' as ecosystem, lower(p_brand) as name, min(p_type || '/' || replace(p_name, ' ', '-') || '/' || p_brand) as repo from part group by 1, 2 having count(distinct p_type || '/' || replace(p_name, ' ', '-') || '/' || p_brand) = 1
 union all select 'go', 'brand#1', 'none')"""


@query("resolve_names", _NAMES + """ select id, coalesce(claims.repo, case when r.ecosystem in ('', 'go') then case when r.owner is not null then fulls.repo else bares.repo end end) as dep_repo
from r left join claims on claims.ecosystem = r.ecosystem and claims.name = r.claim left join fulls on fulls.owner = r.owner and fulls.name = r.name left join bares on bares.name = r.name""")
def resolve_names(s, d):
    part = roles.table(s, d, "part")
    ecosystem = F.expr("case p_partkey % 4 when 0 then 'npm' when 1 then '' else 'go' end")
    names = part.select(F.col("p_partkey").alias("id"), F.expr(DEPENDENCY).alias("name"), ecosystem.alias("ecosystem"))
    repo = F.concat_ws("/", "p_type", F.expr("replace(p_name, ' ', '-')"), "p_brand")
    repos = part.select(repo.alias("repo"), F.col("p_type").alias("owner"), F.expr("replace(p_name, ' ', '-')").alias("name")).distinct()
    claimed = dep.claims(part.select(repo.alias("repo"), F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name")))
    claimed = claimed.unionByName(s.createDataFrame([("go", "brand#1", "none")], "ecosystem string, name string, repo string"))
    return dep.resolve_names(names, repos, claimed).select("id", "dep_repo")


_TIERS = f"""with bumps as (select l_orderkey * 10 + l_linenumber as id, l_shipdate as consumer_at, s_nationkey as dep_repo, {VERSION} as version, l_linenumber % 4 as form from lineitem join supplier on l_suppkey = s_suppkey),
commits as (select c_nationkey as repo, md5(cast(o_orderkey as string)) as sha, o_orderkey as commit_id, o_orderdate as committed_at from orders join customer on o_custkey = c_custkey),
tags as (select c_nationkey as repo, (o_custkey % 40) as major, (o_orderkey % 10) as minor, o_orderkey as commit_id, o_orderdate as tagged_at from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P'),
keyed as (select *, case when minor = 0 then major::varchar else major || '.' || minor end as version_key, case when minor = 0 then [major] else [major, minor] end as ordinal from tags),
wanted as (select *, case when form in (1, 2) then regexp_replace(regexp_extract(version, '([0-9]+\\.[0-9]+)', 1), '\\.0$', '') end as version_key, case when form = 3 then list_transform(string_split(regexp_replace(substr(version, 2), '\\.0$', ''), '.'), lambda x: x::bigint) end as lim from bumps),
pinned as (select id, arg_min(commit_id, sha) as c from wanted join commits on repo = dep_repo and starts_with(sha, version) where form = 0 group by 1),
uniq as (select repo, version_key, min(commit_id) as c from keyed group by 1, 2 having count(distinct commit_id) = 1),
ceil_ as (select id, arg_max(k.commit_id, (k.ordinal, k.commit_id)) as c from wanted w join keyed k on k.repo = w.dep_repo and k.ordinal < w.lim and k.tagged_at <= w.consumer_at where form = 3 group by 1),
picked as (select w.id, w.consumer_at, coalesce(p.c, u.c, x.c) as c, case when p.c is not null then 'sha' when u.c is not null then case when form = 2 then 'floor' else 'tag' end when x.c is not null then 'ceiling' end as resolution
 from wanted w left join pinned p using (id) left join uniq u on u.repo = w.dep_repo and u.version_key = w.version_key left join ceil_ x on x.id = w.id)
select id, case when committed_at <= consumer_at then c end as dep_commit_id, case when committed_at <= consumer_at then resolution end as resolution, case when committed_at <= consumer_at then (epoch(consumer_at) - epoch(committed_at))::bigint end as adoption_seconds
from picked left join commits on commit_id = c"""


def _tiers(s: SparkSession, d: str) -> DataFrame:
    lines = roles.table(s, d, "lineitem").join(roles.table(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sha = F.expr("case when l_linenumber % 4 = 0 then substring(md5(cast(l_orderkey as string)), 1, 20) end")
    rows = lines.select(F.expr("l_orderkey * 10 + l_linenumber").alias("id"), F.col("l_shipdate").alias("consumer_at"), F.col("s_nationkey").alias("dep_repo"), F.expr(VERSION).alias("version"), sha.alias("dep_sha"))
    orders = roles.table(s, d, "orders").join(roles.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    commits = orders.select(F.col("c_nationkey").alias("repo"), F.expr("md5(cast(o_orderkey as string))").alias("sha"), F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("committed_at"))
    tags = orders.where("o_orderstatus = 'P'").select(F.col("c_nationkey").alias("repo"), version_key(F.expr(TAG)).alias("version_key"), F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("tagged_at"))
    return dep.resolve_versions(rows, tags, commits)


@query("resolution_tiers", _TIERS)
def resolution_tiers(s, d):
    return _tiers(s, d).select("id", "dep_commit_id", "resolution", "adoption_seconds")


@query("go_modules", """with e as (select p_type as repo, lower(p_brand) || '/go.mod' as manifest, 'example.com/x/' || lower(p_type) || '/' || lower(replace(p_brand, '1', '2')) as name, 'v' || p_size as raw from part),
several as (select repo from e group by 1 having count(distinct manifest) >= 2),
m as (select repo, regexp_replace(manifest, '/[^/]*$', '') as consumer_module, string_split(name, '/')[-1] as dep_module, manifest, min(raw) as version from e join several using (repo) group by 1, 2, 3, 4)
select * from m where dep_module <> consumer_module""")
def go_modules(s, d):
    part = roles.table(s, d, "part")
    name = F.concat(F.lit("example.com/x/"), F.lower("p_type"), F.lit("/"), F.lower(F.expr("replace(p_brand, '1', '2')")))
    entries = part.select(F.col("p_type").alias("repo"), F.concat(F.lower("p_brand"), F.lit("/go.mod")).alias("manifest"), name.alias("name"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("raw"), F.lit("go").alias("ecosystem"))
    return dep.modules(entries, part.select(F.col("p_type").alias("repo"), F.col("p_type").alias("name")).distinct())


@query("declared_at_head", _NAMES + """, e as (select id, ecosystem, raw, coalesce(claims.repo, case when r.ecosystem in ('', 'go') then case when r.owner is not null then fulls.repo else bares.repo end end) as dep_repo, r.name as key
 from r join names using (id, ecosystem) left join claims on claims.ecosystem = r.ecosystem and claims.name = r.claim left join fulls on fulls.owner = r.owner and fulls.name = r.name left join bares on bares.name = r.name)
select 'me' as repo, raw as name, 'm' || (id % 3) as manifest, first(dep_repo order by ecosystem) as dep_repo from e where key <> 'me' group by 1, 2, 3""")
def declared_at_head(s, d):
    part = roles.table(s, d, "part")
    entries = part.select(F.lit("me").alias("repo"), F.expr(DEPENDENCY).alias("name"), F.expr("'m' || cast(p_partkey % 3 as string)").alias("manifest"), F.expr("case p_partkey % 4 when 0 then 'npm' when 1 then '' else 'go' end").alias("ecosystem"), F.lit("1.0").alias("raw"))
    repo = F.concat_ws("/", "p_type", F.expr("replace(p_name, ' ', '-')"), "p_brand")
    repos = part.select(repo.alias("repo"), F.col("p_type").alias("owner"), F.expr("replace(p_name, ' ', '-')").alias("name")).distinct()
    claimed = dep.claims(part.select(repo.alias("repo"), F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name")))
    claimed = claimed.unionByName(s.createDataFrame([("go", "brand#1", "none")], "ecosystem string, name string, repo string"))
    return dep.declared_dependencies(entries, repos, claimed).select("repo", "name", "manifest", "dep_repo")
