"""Queries of the read layer: noise, labels, evidence, hotspots, listings, directories, impact, runs and feedback.

Suppliers are files here, with paths by rule; parts are files of a second kind for the predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import judgement as j
from ..functions import text
from ..operators import backtest as bt
from ..operators import coupling as c
from ..operators import graph as g
from ..operators import mining as m
from ..operators import reading as r
from ..schemas import CLUSTER_MIN_SUPPORT
from ..sinks import tables as sink
from ..sources import roles
from ..sources.roles import AS_OF, EVENTS_AS_OF
from .catalog import _CALLS, _DRIFT, _EDGES, _EVERY, _FORMULAS, _RISK, BASE, _drift, _edges, _history, _metrics, _pairs, _risk
from .registry import query

#: The path of supplier {k}: sources, tests beside them, copies in other folders, generated files, manifests, documents.
FILE = """case {k} % 10 when 0 then 'src/m' || cast({k} % 4 as string) || '/core.go' when 1 then 'src/m' || cast({k} % 3 as string) || '/f' || cast({k} % 7 as string) || '.go'
 when 2 then 'src/m' || cast({k} % 3 as string) || '/f' || cast({k} % 7 as string) || '_test.go' when 3 then 'pkg/gen/g' || cast({k} as string) || '.go' when 4 then 'api/a' || cast({k} as string) || '.pb.go'
 when 5 then 'web/package.json' when 6 then 'docs/d' || cast({k} as string) || '.md' when 7 then '.github/workflows/w' || cast({k} as string) || '.yml' when 8 then 'lib/CHANGELOG.md'
 else 'lib/x/y/z' || cast({k} as string) || '.py' end"""
#: The path of a part, of every kind that a predicate tells apart.
KINDS = """case p_partkey % 16 when 0 then 'vendor/' || p_type || '/a.go' when 1 then 'x/node_modules/b.js' when 2 then p_type || '/go.sum' when 3 then 'a/api.pb.go' when 4 then 'dist.go'
 when 5 then 'CHANGES.txt' when 6 then 'src/.changeset/x.md' when 7 then '.releaserc.json' when 8 then 'docs/' || p_type || '.html' when 9 then 'doc/a' when 10 then 'README' when 11 then 'a/Jenkinsfile'
 when 12 then 'go.work' when 13 then 'lib/x.min.css' when 14 then 'my' || 'Readme.rst' else 'src/' || p_type || '/' || replace(p_name, ' ', '/') || '.go' end"""
# The SQL has its own words for what the functions under test know: the listed names that occur in the paths above, and the patterns.
_LISTED = "('go.sum', 'go.work', 'package.json')"
_TREES = r"(^|/)(vendor|node_modules|third_party|dist|generated|gen|__pycache__)/|(_gen|\.pb|_auto_test)\.go$|\.min\.(js|css)$"
_RELEASES = r"(^|/)(CHANGELOG|CHANGES|HISTORY|VERSION|version)(\.(md|txt))?$|(^|/)\.releaserc\.json$|(^|/)\.changeset/"
_DOCUMENTS = r"(^|/)docs?/|(^|/)README(\.[a-z]+)?$|\.(md|mdx|rst)$|(^|/)\.github/|(^|/)Jenkinsfile$"
_NOISE = f"(regexp_replace({{p}}, '^.*/', '') in {_LISTED} or regexp_matches({{p}}, '{_TREES}') or regexp_matches({{p}}, '{_RELEASES}'))"
_AUX = f"({_NOISE} or regexp_matches({{p}}, '{_DOCUMENTS}'))"
_FILES = f"files as (select s_suppkey as file_id, {FILE.format(k='s_suppkey')} as path from supplier)"


def _files(s: SparkSession, d: str) -> DataFrame:
    return roles.table(s, d, "supplier").select(F.col("s_suppkey").alias("file_id"), F.expr(FILE.format(k="s_suppkey")).alias("path"))


@query("noise_paths", f"with x as (select p_partkey as id, {KINDS} as p from part) select id, {_NOISE.format(p='p')} as noise, {_AUX.format(p='p')} as auxiliary from x")
def noise_paths(s, d):
    rows = roles.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr(KINDS).alias("p"))
    return rows.select("id", j.is_noise(F.col("p")).alias("noise"), j.is_auxiliary(F.col("p")).alias("auxiliary"))


@query("hotspots_ranked", BASE + f""", {_FILES}, deleted as (select repo, file_id, arg_max(change_type, (committed_at, commit_id)) = 'R' as gone from dated group by 1, 2),
top as (select m.repo, m.file_id, path, change_count from marginals m join files using (file_id) join deleted using (repo, file_id) where not gone order by change_count desc, m.repo, m.file_id limit 200),
kept as (select *, {_AUX.format(p='path')} as auxiliary from top where not {_NOISE.format(p='path')} order by auxiliary, change_count desc, repo, file_id limit 25)
select k.repo, k.file_id, path, change_count, auxiliary, coalesce(partners, 0) as partner_count from kept k
left join (select repo, file_id, count(*) as partners from (select repo, unnest([a, b]) as file_id from pairs) group by 1, 2) using (repo, file_id)""")
def hotspots_ranked(s, d):
    changes, commits = _history(s, d)
    rows = c.file_marginals(changes, commits).join(c.deleted_files(changes, commits, "R"), ["repo", "file_id"]).join(_files(s, d), "file_id").select("repo", "file_id", "path", "change_count", "is_deleted")
    partners = _pairs(s, d).select("repo", F.explode(F.array("a", "b")).alias("file_id")).groupBy("repo", "file_id").agg(F.count(F.lit(1)).alias("partners"))
    return r.hotspots(rows, partners).select("repo", "file_id", "path", "change_count", "auxiliary", "partner_count")


_LABELLED = BASE + f""", {_FILES}, x as (select repo, a, b, n_ab, last_at, n_ab::double / n_a as conf, {_FORMULAS['npmi']} as npmi, {_FORMULAS['jaccard']} as jac, {_FORMULAS['log_likelihood_ratio']} as g2, fa.path as own, fb.path as path
 from cells join (select repo, a, b, last_at from pairs) using (repo, a, b) join files fa on fa.file_id = a join files fb on fb.file_id = b),
y as (select *, regexp_replace(path, '^.*/', '') as base, regexp_replace(own, '^.*/', '') as own_base, regexp_replace(regexp_replace(own, '^.*/', ''), '\\.[^.]*$', '') as stem from x),
z as (select *, base in ('go.sum', 'package-lock.json', 'yarn.lock') or list_has_any(string_split(lower(regexp_replace(path, '[^/]*$', '')), '/'), ['gen', 'generated', 'vendor', 'node_modules', 'mocks', '.gen', 'dist', '__generated__']) or contains(lower(base), 'zz_generated') or contains(lower(base), '.pb.go') or contains(lower(base), '.min.js') or contains(lower(base), '.generated.') or starts_with(lower(base), 'mock_') or starts_with(lower(base), 'mocks_') as generated,
 starts_with(base, stem || '_test.') or starts_with(base, 'test_' || stem || '.') or starts_with(base, stem || '.test.') or starts_with(base, stem || '.spec.') as own_test,
 base = own_base and regexp_replace(path, '/[^/]*$', '') <> regexp_replace(own, '/[^/]*$', '') as sibling from y),
l as (select *, list_filter([case when generated then 'generated' end, case when own_test then 'own_test' end, case when n_ab < 5 then 'thin_support' end, case when sibling then 'sibling_variant' end], lambda v: v is not null) as labels,
 not (generated or own_test) and n_ab >= 3 as informative, (conf >= 0.5)::int + (npmi >= 0.2 or jac >= 0.2)::int + (g2 > 2)::int as positive from z),
cards as (select *, case when not informative or n_ab < 3 then 'weak' when n_ab >= 10 and positive >= 2 then 'strong' when n_ab >= 5 and positive >= 1 then 'moderate' else 'weak' end as evidence from l)"""


def _labelled(s: SparkSession, d: str) -> DataFrame:
    keys = ["confidence_ab", "npmi", "jaccard", "log_likelihood_ratio"]
    path = lambda side, name: _files(s, d).select(F.col("file_id").alias(side), F.col("path").alias(name))
    changes, commits = _history(s, d)
    pairs = c.pairs(c.baskets(changes, commits))
    rows = c.scored(pairs, c.file_marginals(changes, commits), c.population(commits), keys).join(path("a", "own"), "a").join(path("b", "path"), "b")
    labels, informative = j.partner_labels(F.col("path"), F.col("own"), F.col("n_ab"))
    rows = rows.withColumns({"labels": labels, "informative": informative})
    return rows.withColumns(j.evidence_card(F.col("n_ab"), *[F.col(k) for k in keys], F.col("labels"), F.col("informative")))


@query("partner_label_sets", _LABELLED + " select repo, a, b, array_to_string(labels, ',') as labels, informative from l")
def partner_label_sets(s, d):
    return _labelled(s, d).select("repo", "a", "b", F.array_join("labels", ",").alias("labels"), "informative")


@query("evidence_cards", _LABELLED + """ select repo, a, b, evidence, case when positive in (0, 3) then 'signals agree' else 'mixed signals' end as agreement,
 case when len(labels) > 0 then 'Flagged as ' || replace(array_to_string(labels, ', '), '_', ' ') || '; verify before editing.' when not informative then 'Likely structural noise; verify before editing.'
 when evidence = 'strong' then 'Strong evidence that this file is meaningfully related.' when evidence = 'moderate' then 'Moderate evidence of a meaningful relationship.' else 'Limited evidence; treat this relationship cautiously.' end as summary from cards""")
def evidence_cards(s, d):
    return _labelled(s, d).select("repo", "a", "b", "evidence", "agreement", "summary")


@query("evidence_ranked", _LABELLED + """ select repo, a, b, n_ab from cards order by case evidence when 'weak' then 0 when 'moderate' then 1 else 2 end desc, positive desc, n_ab desc,
 floor((epoch(timestamp '2001-12-01') - epoch(last_at)) / 86400), repo, a, b limit 50""")
def evidence_ranked(s, d):
    days = F.floor((c.as_of_epoch(AS_OF) - c.epoch("last_at")) / 86400)
    rows = _labelled(s, d).orderBy(F.desc("grade"), F.desc("positive"), F.desc("n_ab"), days, "repo", "a", "b").limit(50)
    return rows.select("repo", "a", "b", "n_ab")


@query("partner_sentences", _LABELLED + """, t as (select l.*, greatest(floor((epoch(timestamp '2001-12-01') - epoch(last_at)) / 86400), 0)::bigint as days, round_even(conf * 100, 0)::int || '%' as share, case when n_ab < 5 then ' (on ' || n_ab || ' shared commits, so treat as provisional)' else '' end as hedge from l)
select repo, a, b, case when days > 270 then 'STALE -- last co-changed ' || days || ' days ago; treat as historical, verify the path still exists' when days <= 30 then 'current -- co-changed ' || days || ' days ago' else 'co-changed ' || days || ' days ago' end as currency,
 case when conf = 0 then 'no directional signal' when n_ab < 3 then share || ' of the time, but on only ' || n_ab || ' shared commits -- weak evidence'
 else 'changes together ' || share || ' of the time -- ' || case when conf >= 0.7 then case when n_ab < 5 then 'may need updating too' else 'very likely needs updating too' end when conf >= 0.4 then 'worth checking' else 'occasional' end || hedge end as confidence from t""")
def partner_sentences(s, d):
    days = F.greatest(F.floor((c.as_of_epoch(AS_OF) - c.epoch("last_at")) / 86400), F.lit(0))
    rows = _labelled(s, d).withColumn("days", days)
    return rows.select("repo", "a", "b", j.currency(F.col("days"), F.lit(None).cast("string"), F.lit(False)).alias("currency"), j.confidence_sentence(F.col("confidence_ab"), F.col("n_ab")).alias("confidence"))


_RECORDS = """s_suppkey as id, 'r' || cast(s_suppkey % 40 as string) as name, 'Org' || cast(s_nationkey as string) || '/R' || cast(s_suppkey % 40 as string) as full_name, s_suppkey % 13 = 0 as is_disabled, s_suppkey % 7 = 0 as is_private,
 s_suppkey % 3 = 0 as is_fork, 'org' || cast(s_nationkey as string) || '/r' || cast((s_suppkey * 7) % 40 as string) as parent_full_name, s_suppkey % 11 = 0 as is_archived"""


@query("select_scopes", f"""with x as (select {_RECORDS} from supplier) select id from x where not is_disabled and lower(name) not in ('r5', 'r6') and lower(full_name) not in ('org3/r8') and not is_private and not is_archived
 and not (is_fork and lower(parent_full_name) in (select lower(full_name) from x where not is_fork union all select 'org1/r1'))""")
def select_scopes(s, d):
    rows = roles.table(s, d, "supplier").selectExpr(*[x.strip() for x in _RECORDS.replace("\n", " ").split(", ")])
    tracked = s.createDataFrame([("Org1/R1",)], "full_name string")
    return r.select_repos(rows, tracked, skip=("R5", "r6", "ORG3/r8")).select("id")


@query("select_scopes_only", f"with x as (select {_RECORDS} from supplier) select id from x where lower(name) = 'r5' or lower(full_name) = 'org3/r8'")
def select_scopes_only(s, d):
    rows = roles.table(s, d, "supplier").selectExpr(*[x.strip() for x in _RECORDS.replace("\n", " ").split(", ")])
    return r.select_repos(rows, rows.select("full_name"), only=("R5", "org3/R8")).select("id")


_SCOPES = """scopes as (select c_nationkey as id, n_name as name, 'org/' || n_name as full_name, 'nation of region ' || n_regionkey as description, count(*) as commit_count, max(o_orderdate) as last_commit_at
 from orders join customer on o_custkey = c_custkey join nation on n_nationkey = c_nationkey group by 1, 2, 3, 4)"""


def _scopes(s: SparkSession, d: str) -> DataFrame:
    rows = roles.table(s, d, "orders").join(roles.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("commit_count"), F.max("o_orderdate").alias("last_commit_at"))
    nation = roles.table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"), F.concat(F.lit("org/"), "n_name").alias("full_name"), F.concat(F.lit("nation of region "), F.col("n_regionkey").cast("string")).alias("description"))
    return rows.join(nation, "c_nationkey").withColumn("is_enabled", F.lit(True)).withColumnRenamed("c_nationkey", "id")


@query("list_scopes", f"with {_SCOPES} select name, commit_count from scopes where contains(lower(full_name), 'region 1') or contains(lower(description), 'region 1') order by commit_count desc, full_name limit 3 offset 1")
def list_scopes(s, d):
    return r.list_repos(_scopes(s, d), search="Region 1", order_by="no such key", limit=3, offset=1).select("name", "commit_count")


@query("scope_detail", f"with {_SCOPES} select id, full_name, commit_count from scopes where name = (select min(n_name) from nation)")
def scope_detail(s, d):
    first = roles.table(s, d, "nation").agg(F.min("n_name")).first()[0]
    return r.get_repo(_scopes(s, d), first).select("id", "full_name", "commit_count")


@query("search_paths", BASE + f", {_FILES} select m.repo, m.file_id, path, change_count from marginals m join files using (file_id) where contains(lower(path), 'm1/f') and change_count >= 2 order by path, m.repo, m.file_id limit 40")
def search_paths(s, d):
    rows = c.file_marginals(*_history(s, d)).join(_files(s, d), "file_id")
    return r.search_files(rows, "M1/F", min_changes=2, order_by="path", limit=40).select("repo", "file_id", "path", "change_count")


@query("resolve_item", """with now as (select p_type as repo, p_brand as path, min(p_partkey)::varchar as file from part group by 1, 2), old as (select p_type as repo, p_name as old_path, max(p_partkey)::varchar as file from part group by 1, 2),
asked as (select p_partkey as id, p_type as repo, case p_partkey % 3 when 0 then p_brand when 1 then p_name else 'nowhere' end as path from part)
select id, coalesce(now.file, old.file) as file from asked left join now using (repo, path) left join old on old.repo = asked.repo and old.old_path = asked.path""")
def resolve_item(s, d):
    part = roles.table(s, d, "part")
    key = F.col("p_partkey")
    now = part.groupBy(F.col("p_type").alias("repo"), F.col("p_brand").alias("path")).agg(F.min(key).cast("string").alias("file"))
    old = part.groupBy(F.col("p_type").alias("repo"), F.col("p_name").alias("old_path")).agg(F.max(key).cast("string").alias("file"))
    asked = part.select(key.alias("id"), F.col("p_type").alias("repo"), F.concat(F.lit(" ./"), F.expr("case p_partkey % 3 when 0 then p_brand when 1 then p_name else 'nowhere' end")).alias("path"))
    return sink.resolve_paths(asked, now, old).select("id", "file")


_DIRS = BASE + f""", {_FILES}, closure as (select file_id, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as dir_path from files, unnest(range(len(string_split(path, '/')))) as t(i)),
dirs as (select repo, dir_path, count(distinct commit_id) as change_count from dated join closure using (file_id) group by 1, 2)"""


def _dirs(s: SparkSession, d: str) -> DataFrame:
    return c.directory_marginals(*_history(s, d), _files(s, d))


@query("directories", _DIRS + " select dir_path, change_count from dirs where repo = 'BUILDING' order by change_count desc, dir_path limit 200")
def directories(s, d):
    return r.directories(_dirs(s, d), "BUILDING").select("dir_path", "change_count")


@query("directory_tree", f"""with {_FILES}, dirs as (select distinct array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as dir_path from files, unnest(range(len(string_split(path, '/')))) as t(i))
select 'directory' as kind, dir_path as path from dirs where starts_with(dir_path, 'lib/') and not contains(substr(dir_path, 5), '/') union all select 'self', 'lib' union all select * from (select 'file', path from files where regexp_replace(path, '/[^/]*$', '') = 'lib' order by path limit 1000)""")
def directory_tree(s, d):
    return r.directory_tree(c.closure(_files(s, d)).select("dir_path").distinct(), _files(s, d), "lib")


@query("module_context", """with rows as (select distinct p_type as repo, lower(p_brand) as consumer_module, lower(p_brand) || '/sub' || p_size % 3 as dep_module from part),
names as (select repo, unnest([consumer_module, dep_module]) as m from rows), asked as (select p_partkey as id, p_type as repo, lower(p_brand) || '/sub' || p_size % 5 || '/x.go' as path from part),
own as (select id, asked.repo, arg_max(m, length(m)) as m from asked left join names on names.repo = asked.repo and (path = m or starts_with(path, m || '/')) group by 1, 2)
select id, m as owning_module, coalesce((select list_sort(list(distinct dep_module)) from rows where rows.repo = own.repo and consumer_module = m), []) as declares, coalesce((select list_sort(list(distinct consumer_module)) from rows where rows.repo = own.repo and dep_module = m), []) as declared_by from own""")
def module_context(s, d):
    part = roles.table(s, d, "part")
    sub = lambda n: F.concat(F.lower("p_brand"), F.expr(f"'/sub' || cast(p_size % {n} as string)"))
    rows = part.select(F.col("p_type").alias("repo"), F.lower("p_brand").alias("consumer_module"), sub(3).alias("dep_module")).distinct()
    asked = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("repo"), F.concat(F.lit("./"), sub(5), F.lit("/x.go")).alias("path"))
    return r.module_context(asked, rows)


# --- impact ----------------------------------------------------------------------------------------------------

_IMPACT = f"with {_EVERY}, {_EDGES}"


@query("impact_upstream", _IMPACT + " select source, is_declared, score from edges where target = (select min(n_name) from nation) order by is_declared desc, score desc, source limit 20")
def impact_upstream(s, d):
    first = roles.table(s, d, "nation").agg(F.min("n_name")).first()[0]
    return r.impact_of(_edges(s, d), "target", F.lit(first)).select("source", "is_declared", "score")


@query("impact_declared_only", _IMPACT + " select target, score from edges where is_declared and source = (select max(n_name) from nation) order by score desc, target limit 20")
def impact_declared_only(s, d):
    last = roles.table(s, d, "nation").agg(F.max("n_name")).first()[0]
    return r.impact_of(_edges(s, d), "source", F.lit(last), declared_only=True).select("target", "score")


@query("impact_pair", _IMPACT + " select source, target, is_declared, bump_count, score from edges where source = (select max(n_name) from nation) and target = (select min(n_name) from nation)")
def impact_pair(s, d):
    ends = roles.table(s, d, "nation").agg(F.max("n_name").alias("source"), F.min("n_name").alias("target"))
    return _edges(s, d).join(F.broadcast(ends), ["source", "target"]).select("source", "target", "is_declared", "bump_count", "score")  # one row


@query("impact_graph", _IMPACT + ", top as (select source, target, score from edges where score >= 0.9 order by score desc, source, target limit 40) select * from top")
def impact_graph(s, d):
    return r.impact_graph(_edges(s, d), 0.9, 40).select("source", "target", "score")


@query("impact_graph_nodes", _IMPACT + ", top as (select source, target, score from edges where score >= 0.9 order by score desc, source, target limit 40) select distinct unnest([source, target]) as node from top")
def impact_graph_nodes(s, d):
    return r.impact_graph(_edges(s, d), 0.9, 40).select(F.explode(F.array("source", "target")).alias("node")).distinct()


@query("impact_validated_counts", _IMPACT + " select target, count(*) as total, count(*) filter (is_declared or bump_count > 0) as validated from edges group by 1")
def impact_validated_counts(s, d):
    return _edges(s, d).groupBy("target").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_declared") | (F.col("bump_count") > 0)).alias("validated"))


@query("declared_dependency", "select a.n_name as consumer, min(b.n_name) as dep from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey group by 1")
def declared_dependency(s, d):
    return roles.declared(s, d).groupBy("consumer").agg(F.min("dep").alias("dep"))


@query("dependency_overview", f"with {_EVERY} select consumer, dep, count(*) as bumps, epoch(max(consumer_at))::bigint as last_bump from bumps group by 1, 2 order by bumps desc, consumer, dep limit 100")
def dependency_overview(s, d):
    rows = roles.bumps(s, d).groupBy("consumer", "dep").agg(F.count(F.lit(1)).alias("bumps"), F.max(c.epoch("consumer_at")).alias("last_bump"))
    return rows.orderBy(F.desc("bumps"), "consumer", "dep").limit(100)


@query("bump_newest", f"with {_EVERY} select id, consumer, dep, epoch(consumer_at)::bigint as bumped_at from bumps order by consumer_at desc nulls last, id limit 100")
def bump_newest(s, d):
    rows = roles.bumps(s, d).select("id", "consumer", "dep", c.epoch("consumer_at").alias("bumped_at"))
    return rows.orderBy(F.desc_nulls_last("bumped_at"), "id").limit(100)


_ACROSS = f"""with p as (select l_orderkey as id, l_suppkey as up, l_partkey as down from lineitem), interesting as (select s_suppkey from supplier where not {_NOISE.format(p='(' + FILE.format(k='s_suppkey') + ')')}),
pairs as (select u.up as upstream_file, x.down as consumer_file, count(distinct x.id) as n_bumps, max(o_orderdate) as last_at from p u join p x on x.id = u.id join orders on o_orderkey = x.id where u.up in (select s_suppkey from interesting) group by 1, 2)"""


def _across(s: SparkSession, d: str) -> DataFrame:
    lines = roles.table(s, d, "lineitem")
    bumps = roles.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("version"))
    up = lines.select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("file_id")).join(_files(s, d).where(~j.is_noise(F.col("path"))), "file_id").select("id", "file_id")
    return g.cross_pairs(bumps, up, lines.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("file_id")))


@query("cross_scope_without_noise", _ACROSS + " select upstream_file, consumer_file, n_bumps from pairs where n_bumps >= 2")
def cross_scope_without_noise(s, d):
    return _across(s, d).where("n_bumps >= 2").select("upstream_file", "consumer_file", "n_bumps")


@query("coupled_across_scopes", _ACROSS + """, up as (select 'upstream' as direction, upstream_file as other, n_bumps, epoch(last_at)::bigint as last_at from pairs where consumer_file = 7 and n_bumps >= 1 order by n_bumps desc, other limit 12),
down as (select 'downstream' as direction, consumer_file as other, n_bumps, epoch(last_at)::bigint as last_at from pairs where upstream_file = 7 and n_bumps >= 1 order by n_bumps desc, other limit 12)
select * from (select * from up union all select * from down) order by n_bumps desc, direction, other limit 12""")
def coupled_across_scopes(s, d):
    return r.coupled_across(_across(s, d), F.lit(7), min_support=1).select("direction", "other", "n_bumps", c.epoch("last_at").alias("last_at"))


# --- mining ----------------------------------------------------------------------------------------------------

_LIVE = "live as (select repo, file_id from dated group by 1, 2 having arg_max(change_type, (committed_at, commit_id)) <> 'R')"


def _live(s: SparkSession, d: str) -> DataFrame:
    return c.deleted_files(*_history(s, d), deletion="R").where("not is_deleted")


@query("drift_decaying_live", _DRIFT + f", {_LIVE} select t.repo, a, b, round(delta, 6) as delta from trends t join live x on x.repo = t.repo and x.file_id = a join live y on y.repo = t.repo and y.file_id = b where trend = 'decaying' order by delta, t.repo, a, b limit 25")
def drift_decaying_live(s, d):
    rows = _drift(s, d).withColumn("delta", F.round("delta", 6))
    return m.drifting_pairs(rows, _live(s, d), "decaying").select("repo", "a", "b", "delta")


@query("risky_items_live", _RISK + f""", {_LIVE}, top as (select repo, file_id, arg_max(author_id, (k, -author_id)) as top_author from own group by 1, 2)
select r.repo, r.file_id, round(coalesce(risk, 0), 6) as risk, top_author from risk r join live using (repo, file_id) left join top using (repo, file_id) where change_count >= 5 order by risk desc, r.repo, r.file_id limit 25""")
def risky_items_live(s, d):
    risk = _risk(s, d).withColumn("risk", F.round("risk", 6))
    return m.risky_files(risk, _live(s, d), c.author_files(*_history(s, d))).select("repo", "file_id", "risk", "top_author")


@query("top_owners", BASE + ", own as (select repo, file_id, author_id, count(*) as k from dated group by 1, 2, 3) select repo, file_id, arg_max(author_id, (k, -author_id)) as top_author from own group by 1, 2")
def top_owners(s, d):
    return m.top_authors(c.author_files(*_history(s, d)))


def _clusters(s: SparkSession, d: str) -> DataFrame:
    edges = _metrics(s, d, ["npmi"]).where(f"n_ab >= {CLUSTER_MIN_SUPPORT} and npmi > 0").select("repo", "a", "b", F.col("npmi").alias("weight"))
    return m.cluster_stats(c.clusters(edges), edges, _files(s, d))


@query("cluster_stats")  # label propagation is iterative; tests hold it against plain Python
def cluster_stats(s, d):
    return _clusters(s, d).withColumn("cohesion", F.round("cohesion", 6))


@query("cross_hierarchy_modules")
def cross_hierarchy_modules(s, d):
    files = c.file_marginals(*_history(s, d)).join(_files(s, d), "file_id")
    return m.cross_directory_modules(_clusters(s, d), files)


@query("mining_overview")
def mining_overview(s, d):
    return m.overview(_clusters(s, d), _drift(s, d), _edges(s, d))


@query("idle_items", BASE + " select distinct repo, file_id from changes except select repo, file_id from dated where eligible")
def idle_items(s, d):
    changes, commits = _history(s, d)
    rows = c.dated(changes, commits)
    return changes.select("repo", "file_id").distinct().subtract(rows.where("eligible").select("repo", "file_id"))


@query("items_without_pairs", BASE + " select repo, file_id from marginals m where not exists (select 1 from pairs where pairs.repo = m.repo and m.file_id in (a, b))")
def items_without_pairs(s, d):
    paired = _pairs(s, d).select("repo", F.explode(F.array("a", "b")).alias("file_id"))
    return c.file_marginals(*_history(s, d)).select("repo", "file_id").join(paired, ["repo", "file_id"], "left_anti")


@query("prompt_sample", BASE + " select repo, commit_id from commits where eligible order by md5('20260830:' || commit_id), commit_id limit 100")
def prompt_sample(s, d):
    return r.sample(c.with_eligible(roles.commits(s, d)).where("eligible").select("repo", "commit_id"), "commit_id", 100, 20260830)


_BASELINE = BASE + """, {files}, num as (select repo, commit_id, row_number() over (partition by repo order by committed_at, commit_id) as nr, n from (select repo, commit_id, committed_at, count(*) as n from dated where eligible group by 1, 2, 3)),
occ as (select repo, commit_id, file_id, nr, n from dated join num using (repo, commit_id)), seeds as (select * from occ where nr > 20 and n between 2 and 25),
keyed as (select file_id, regexp_replace(path, '/[^/]*$', '') as k from files), offers as (select x.file_id as seed, y.file_id as other, row_number() over (partition by x.file_id order by y.file_id) as place from keyed x join keyed y on x.k = y.k and x.file_id <> y.file_id),
hit as (select s.repo, s.commit_id, s.file_id, count(o.file_id) as hits from seeds s left join offers f on f.seed = s.file_id and place <= 5 left join occ o on o.repo = s.repo and o.commit_id = s.commit_id and o.file_id = f.other group by 1, 2, 3)
select repo, count(*) as prompts, count(*) filter (hits > 0) as hit from hit group by 1""".replace("{files}", _FILES)


@query("backtest_baselines", _BASELINE)
def backtest_baselines(s, d):
    rows = bt.baseline(c.baskets(*_history(s, d)), _files(s, d), text.directory(F.col("path")))
    return bt.rates(rows).select("repo", "prompts", "hit")


@query("backtest_stem_baseline", _BASELINE.replace("regexp_replace(path, '/[^/]*$', '') as k", "regexp_replace(regexp_replace(lower(string_split(regexp_replace(path, '^.*/', ''), '.')[1]), '_test$', ''), '^[._-]+|[._-]+$', '', 'g') as k"))
def backtest_stem_baseline(s, d):
    rows = bt.baseline(c.baskets(*_history(s, d)), _files(s, d), text.stem(F.col("path")))
    return bt.rates(rows).select("repo", "prompts", "hit")


# --- shapes ----------------------------------------------------------------------------------------------------


@query("corpus_shape_languages", "select coalesce(lang, 'unknown') as language, count(*) as n from documents group by 1")
def corpus_shape_languages(s, d):
    return roles.table(s, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_shape_adoption_days", f"with {_EVERY} select least(greatest(trunc((epoch(consumer_at) - epoch(upstream_at)) / 86400 / 60) + 1, 1), 7)::bigint as bucket, count(*) as n from bumps where upstream_at <= consumer_at group by 1")
def corpus_shape_adoption_days(s, d):
    rows = g.resolved(roles.bumps(s, d)).where("adoption_seconds is not null")
    bucket = F.least(F.greatest((F.col("adoption_seconds") / 86400 / 60).cast("long") + 1, F.lit(1)), F.lit(7))
    return rows.groupBy(bucket.cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("corpus_shape_scope_sizes", f"with {_SCOPES} select case when commit_count < 100 then '<100' when commit_count < 1000 then '100-1k' when commit_count < 10000 then '1k-10k' else '10k+' end as bucket, count(*) as n, sum(commit_count)::bigint as commits from scopes where commit_count > 0 group by 1")
def corpus_shape_scope_sizes(s, d):
    n = F.col("commit_count")
    bucket = F.when(n < 100, "<100").when(n < 1000, "100-1k").when(n < 10000, "1k-10k").otherwise("10k+")
    return _scopes(s, d).where("commit_count > 0").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("commit_count").alias("commits"))


@query("corpus_shape_scope_recency", """with x as (select n_nationkey, floor((epoch(timestamp '2001-12-01') - epoch(max(o_orderdate))) / 86400) as age from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1)
select case when age is null then 'never' when age < 30 then 'past month' when age < 180 then 'past 6 months' when age < 365 then 'past year' else 'over a year' end as bucket, count(*) as n from x group by 1""")
def corpus_shape_scope_recency(s, d):
    last = _scopes(s, d).select(F.col("id").alias("n_nationkey"), "last_commit_at")
    age = F.floor((c.as_of_epoch(AS_OF) - c.epoch("last_commit_at")) / 86400)
    bucket = F.when(age.isNull(), "never").when(age < 30, "past month").when(age < 180, "past 6 months").when(age < 365, "past year").otherwise("over a year")
    return roles.table(s, d, "nation").join(last, "n_nationkey", "left").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- runs and feedback -----------------------------------------------------------------------------------------


@query("feedback_summary", """with f as (select sha256(coalesce(event_type, '') || '|' || user_id::varchar) as print, event_type as severity, count(*) as k, min(ts) as a, max(ts) as b from events group by 1, 2)
select severity, count(*) as total, count(*) as open, 0 as closed from f group by 1""")
def feedback_summary(s, d):
    calls = roles.calls(s, d)
    reports = calls.select(text.fingerprint(F.col("name"), F.col("client")).alias("fingerprint"), F.lit("gap").alias("kind"), F.col("name").alias("severity"), F.col("client").alias("detail"), "at")
    old = s.createDataFrame([], "fingerprint string, kind string, severity string, detail string, occurrences long, first_at timestamp, last_at timestamp, status string")
    return sink.feedback_summary(sink.upsert_feedback(old, reports))


@query("feedback_upsert", """select substr(sha256(coalesce(event_type, '') || '|' || user_id::varchar), 1, 32) as fingerprint, count(*) as occurrences, floor(epoch(min(ts)))::bigint as first_at, floor(epoch(max(ts)))::bigint as last_at from events group by 1""")
def feedback_upsert(s, d):
    calls = roles.calls(s, d)
    reports = calls.select(text.fingerprint(F.col("name"), F.col("client")).alias("fingerprint"), F.lit("gap").alias("kind"), F.col("name").alias("severity"), F.col("client").alias("detail"), "at")
    half = reports.where(c.epoch("at") < c.as_of_epoch(EVENTS_AS_OF) - 15 * 86400)
    old = s.createDataFrame([], "fingerprint string, kind string, severity string, detail string, occurrences long, first_at timestamp, last_at timestamp, status string")
    rows = sink.upsert_feedback(sink.upsert_feedback(old, half), reports.where(c.epoch("at") >= c.as_of_epoch(EVENTS_AS_OF) - 15 * 86400))
    return rows.select("fingerprint", "occurrences", c.epoch("first_at").alias("first_at"), c.epoch("last_at").alias("last_at"))


@query("failure_summary", """with x as (select user_id, case when value < 50 then 'timeout' when value < 150 then 'refused' else 'other: ' || event_type end as line from events where event_type = 'error'), n as (select user_id, line, count(*) as n from x group by 1, 2),
r as (select *, row_number() over (partition by user_id order by n desc, line) as k, sum(n) over (partition by user_id) as failed from n) select user_id as run_id, line, n, failed::bigint as failed from r where k = 1""")
def failure_summary(s, d):
    error = F.expr("case when value < 50 then 'timeout' when value < 150 then 'refused' else 'other: ' || event_type end || chr(10) || 'second line'")
    rows = roles.table(s, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("run_id"), error.alias("error"))
    return sink.failure_summary(rows)


@query("recent_runs", _CALLS + ", parts as (select client as id, count(*) as repos, count(*) filter (status = 'ok') as succeeded, max(ts) as started_at from calls group by 1) select id, repos, succeeded from parts order by started_at desc, id desc limit 20")
def recent_runs(s, d):
    calls = roles.calls(s, d)
    runs = calls.groupBy(F.col("client").alias("id")).agg(F.max("at").alias("started_at"))
    parts = calls.select(F.col("client").alias("run_id"), F.col("id").alias("repo"), F.when(F.col("status") == "ok", "success").otherwise("failed").alias("status"))
    return r.recent_runs(r.run_detail(runs, parts)).select("id", "repos", "succeeded")


@query("event_tumbling_stream", _CALLS + " select floor(epoch(ts))::bigint // 3600 * 3600 as hour_start, surface, count(*) as calls, count(*) filter (status = 'error') as errors from calls group by 1, 2")
def event_tumbling_stream(s, d):
    import uuid

    from ..streaming.calls import hourly, read_calls

    name = f"hours_{uuid.uuid4().hex}"
    hourly(read_calls(s, d)).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return s.table(name)
