"""Every registered query beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures, text
from ..operators import coupling as c
from ..operators import events as ev
from ..operators import graph as g
from ..schemas import CLUSTER_MIN_SUPPORT
from ..sources import roles
from ..sources.roles import AS_OF, EVENTS_AS_OF
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

_COMMITS = """commits as (
  select c_mktsegment as repo, o_orderkey as commit_id, o_custkey as author_id, o_orderdate as committed_at, o_orderstatus = 'P' as is_replay,
         coalesce(n, 0) as n_files, o_orderstatus <> 'P' and coalesce(n, 0) between 1 and 60 as eligible
  from orders join customer on o_custkey = c_custkey left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey),
changes as (
  select c_mktsegment as repo, l_orderkey as commit_id, {item} as file_id, sum(l_quantity) as insertions, sum(l_linenumber)::double as deletions, arg_min(l_returnflag, (l_linenumber, l_returnflag)) as change_type
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2, 3),
dated as (select x.*, committed_at, author_id, eligible from changes x join commits using (commit_id)),
totals as (select repo, count(*) filter (eligible) as n_total from commits group by 1),
marginals as (
  select repo, file_id, count(*) as change_count, count(*) filter (eligible) as pair_change_count, sum(insertions) as insertions, sum(deletions) as deletions,
         count(distinct author_id) as distinct_authors, min(committed_at) as first_at, max(committed_at) as last_at
  from dated group by 1, 2),
pairs as (
  select x.repo, x.file_id as a, y.file_id as b, count(*) as n_ab, min(x.committed_at) as first_at, max(x.committed_at) as last_at, count(distinct x.author_id) as distinct_authors,
         sum(pow(2, -greatest(epoch(timestamp '2001-12-01') - epoch(x.committed_at), 0) / 86400.0 / 365)) as w_ab
  from dated x join dated y on x.commit_id = y.commit_id and x.file_id < y.file_id and x.eligible group by 1, 2, 3 having count(*) >= 2),
cells as (
  select repo, a, b, n_ab, m.pair_change_count as n_a, n.pair_change_count as n_b, n_total,
         n_ab::double as ca, m.pair_change_count - n_ab::double as cb, n.pair_change_count - n_ab::double as cc, n_total - m.pair_change_count - n.pair_change_count + n_ab::double as cd,
         m.pair_change_count::double as na, n.pair_change_count::double as nb, n_total::double as n
  from pairs join marginals m using (repo) join marginals n using (repo) join totals using (repo) where m.file_id = a and n.file_id = b)"""
BASE = "with " + _COMMITS.format(item="l_suppkey")
PARTS = "with " + _COMMITS.format(item="l_partkey") + """,
files as (select p_partkey as file_id, p_type || '/' || p_brand || '/' || p_name as path from part),
closure as (
  select file_id, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') as dir_path from files, unnest(range(len(string_split(path, '/')))) as t(i))"""


def _history(s: SparkSession, d: str, item: str = "l_suppkey") -> tuple[DataFrame, DataFrame]:
    return roles.changes(s, d, item), roles.commits(s, d)


def _pairs(s: SparkSession, d: str, item: str = "l_suppkey") -> DataFrame:
    return c.pair_counts(c.baskets(*_history(s, d, item)))


def _metrics(s: SparkSession, d: str, keys: list[str], item: str = "l_suppkey") -> DataFrame:
    """Scored pairs; pairs, margins and population all come from the same baskets."""
    rows = c.baskets(*_history(s, d, item))
    return c.scored(c.pair_counts(rows), c.basket_margins(rows), c.basket_population(rows), keys)


def _secs(name: str):
    return c.epoch(name).alias(name)


# --- aggregate -------------------------------------------------------------------------------------------------


@query("top_partners", BASE + """, busiest as (select file_id from marginals where repo = 'BUILDING' order by change_count desc, file_id limit 1)
select case when a = file_id then b else a end as other, n_ab, round(n_ab::double / case when a = file_id then n_a else n_b end, 6) as confidence
from cells, busiest where repo = 'BUILDING' and file_id in (a, b) order by confidence desc, other limit 25""")
def top_partners(s, d):
    changes, commits = (x.where("repo = 'BUILDING'") for x in _history(s, d))
    busiest = changes.groupBy("repo", F.col("file_id").alias("item")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item").limit(1).select("repo", "item")
    rows = c.partners(c.baskets(changes, commits), F.broadcast(busiest))  # one row
    return rows.select("other", "n_ab", F.round(F.col("n_ab") / F.col("n_item"), 6).alias("confidence")).orderBy(F.desc("confidence"), "other").limit(25)


@query("eligible_population", BASE + " select repo, n_total from totals")
def eligible_population(s, d):
    return c.population(roles.commits(s, d))


@query("item_marginals", BASE + " select repo, file_id, change_count, pair_change_count, insertions, deletions, distinct_authors, epoch(first_at)::bigint as first_at, epoch(last_at)::bigint as last_at from marginals")
def item_marginals(s, d):
    rows = c.file_marginals(*_history(s, d))
    return rows.select("repo", "file_id", "change_count", "pair_change_count", "insertions", "deletions", "distinct_authors", _secs("first_at"), _secs("last_at"))


@query("deleted_flag", BASE + " select repo, file_id, arg_max(change_type, (committed_at, commit_id)) = 'R' as is_deleted from dated group by 1, 2")
def deleted_flag(s, d):
    return c.deleted_files(*_history(s, d), deletion="R")


@query("scope_rollup", BASE + """ select t.repo, commit_count, file_count, author_count, raw_pairs, insertions from
(select repo, count(*) as commit_count, count(distinct author_id) as author_count from commits group by 1) t
join (select repo, count(*) as file_count, sum(insertions) as insertions from marginals group by 1) using (repo)
join (select repo, count(*) as raw_pairs from (select distinct x.repo, x.file_id, y.file_id from dated x join dated y on x.commit_id = y.commit_id and x.file_id < y.file_id and x.eligible) group by 1) using (repo)""")
def scope_rollup(s, d):
    changes, commits = _history(s, d)
    heads = commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commit_count"), F.count_distinct("author_id").alias("author_count"))
    files = c.file_marginals(changes, commits).groupBy("repo").agg(F.count(F.lit(1)).alias("file_count"), F.sum("insertions").alias("insertions"))
    raw = c.pair_counts(c.baskets(changes, commits), 1).groupBy("repo").agg(F.count(F.lit(1)).alias("raw_pairs"))
    return heads.join(files, "repo").join(raw, "repo")


@query("pair_counts", BASE + " select repo, a, b, n_ab from pairs")
def pair_counts(s, d):
    return _pairs(s, d)


@query("pair_counts_sparse", PARTS + " select repo, a, b, n_ab from pairs")
def pair_counts_sparse(s, d):
    return _pairs(s, d, "l_partkey")


@query("pair_recency_weight", BASE + " select repo, a, b, n_ab, round(w_ab, 6) as w_ab, epoch(first_at)::bigint as first_at, epoch(last_at)::bigint as last_at, distinct_authors from pairs")
def pair_recency_weight(s, d):
    rows = c.pairs(c.baskets(*_history(s, d)), as_of=AS_OF)
    return rows.select("repo", "a", "b", "n_ab", F.round("w_ab", 6).alias("w_ab"), _secs("first_at"), _secs("last_at"), "distinct_authors")


@query("owner_item", BASE + " select repo, author_id, file_id, count(*) as n_commits, sum(insertions) as insertions, sum(deletions) as deletions, epoch(max(committed_at))::bigint as last_at from dated group by 1, 2, 3")
def owner_item(s, d):
    return c.author_files(*_history(s, d)).select("repo", "author_id", "file_id", "n_commits", "insertions", "deletions", _secs("last_at"))


@query("hierarchy_closure", PARTS + " select file_id, dir_path, length(dir_path) - length(replace(dir_path, '/', '')) + (dir_path <> '')::int as depth from closure")
def hierarchy_closure(s, d):
    return c.closure(roles.paths(s, d))


@query("hierarchy_marginals", PARTS + """ select repo, dir_path, count(distinct commit_id) as change_count, count(distinct commit_id) filter (eligible) as pair_change_count,
 sum(insertions) as insertions, sum(deletions) as deletions, any_value(file_count) as file_count
from dated join closure using (file_id) join (select dir_path, count(*) as file_count from closure group by 1) using (dir_path) group by 1, 2""")
def hierarchy_marginals(s, d):
    return c.directory_marginals(*_history(s, d, "l_partkey"), roles.paths(s, d))


@query("hierarchy_pairs", PARTS + """, dirs as (select distinct repo, commit_id, dir_path from dated join closure using (file_id) where eligible)
select x.repo, x.dir_path as a, y.dir_path as b, count(*) as n_ab from dirs x join dirs y on x.commit_id = y.commit_id and x.dir_path < y.dir_path group by 1, 2, 3 having count(*) >= 2""")
def hierarchy_pairs(s, d):
    return c.pair_counts(c.directory_baskets(*_history(s, d, "l_partkey"), roles.paths(s, d)))


# --- scores ----------------------------------------------------------------------------------------------------

_DET, _MARGIN, _E = "(ca * cd - cb * cc)", "(na * nb * (cc + cd) * (cb + cd))", "(na * nb / n)"
_DIV = lambda x, y: f"(case when abs({y}) > 1e-12 then ({x}) / ({y}) else 0 end)"
_LIFT = _DIV("ca * n", "na * nb")
_PMI = f"(case when {_LIFT} > 0 then log2({_LIFT}) else 0 end)"
_CELLS = (("ca", "na", "nb"), ("cb", "na", "(n - nb)"), ("cc", "(n - na)", "nb"), ("cd", "(n - na)", "(n - nb)"))
_SUM = lambda log, scale: " + ".join(f"(case when {x} > 0 then {x} {scale} * {log}({x} * n / ({r} * {k})) else 0 end)" for x, r, k in _CELLS)
_FORMULAS = {
    "jaccard": _DIV("ca", "ca + cb + cc"), "dice": _DIV("2 * ca", "2 * ca + cb + cc"), "sorensen": _DIV("2 * ca", "2 * ca + cb + cc"), "ochiai": _DIV("ca", "sqrt(na * nb)"), "simpson": _DIV("ca", "least(na, nb)"),
    "braun_blanquet": _DIV("ca", "greatest(na, nb)"), "kulczynski": f"({_DIV('ca', 'na')} + {_DIV('ca', 'nb')}) / 2", "fager": f"case when least(na, nb) > 0 then ca / sqrt(na * nb) - 1 / (2 * sqrt(greatest(na, nb))) else 0 end",
    "russell_rao": _DIV("ca", "n"), "sokal_michener": _DIV("ca + cd", "n"), "rogers_tanimoto": _DIV("ca + cd", "ca + cd + 2 * (cb + cc)"), "hamann": _DIV("ca + cd - cb - cc", "n"), "faith": _DIV("ca + cd / 2", "n"),
    "mutual_information": f"greatest({_SUM('log2', '/ n')}, 0)", "pmi": _PMI, "ppmi": f"greatest({_PMI}, 0)", "npmi": f"case when ca >= n then 1 when ca <= 0 then -1 else greatest(-1, least(1, {_PMI} / -log2(ca / n))) end",
    "chi_square": _DIV(f"n * {_DET} * {_DET}", _MARGIN), "log_likelihood_ratio": f"greatest(2 * ({_SUM('ln', '')}), 0)", "t_score": f"(ca - {_E}) / sqrt(greatest(ca, 1))", "z_score": _DIV(f"ca - {_E}", f"sqrt({_E})"),
    "phi": _DIV(_DET, f"sqrt({_MARGIN})"), "cramers_v": f"sqrt(greatest({_DIV(f'{_DET} * {_DET}', _MARGIN)}, 0))", "yules_q": _DIV(_DET, "ca * cd + cb * cc"),
    "yules_y": _DIV("sqrt(ca * cd) - sqrt(cb * cc)", "sqrt(ca * cd) + sqrt(cb * cc)"), "michael": _DIV(f"4 * {_DET}", "pow(ca + cd, 2) + pow(cb + cc, 2)"), "association_strength": _LIFT,
    "confidence_ab": _DIV("ca", "na"), "confidence_ba": _DIV("ca", "nb"),
}
_TAILS = ("poisson_significance", "hypergeometric_significance")


def _score(family: str, keys: list[str]) -> None:
    sql = BASE + " select repo, a, b, " + ", ".join(f"round({_FORMULAS[k]}, 6)::double as {k}" for k in keys) + " from cells"

    def run(s, d):
        return _metrics(s, d, keys).select("repo", "a", "b", *[(F.round(k, 6) + 0.0).alias(k) for k in keys])

    query(f"score_{family}", sql)(run)


for _family in ("similarity", "matching", "information", "significance", "correlation", "probability"):
    _score(_family, [m.key for m in measures.REGISTRY.values() if m.family == _family and m.key not in _TAILS and not m.directional])
_score("directional", ["confidence_ab", "confidence_ba"])

_LNPMF_P = f"(k * ln({_E}) - {_E} - lgamma(k + 1))"
_LNC = lambda m, k: f"(lgamma({m} + 1) - lgamma({k} + 1) - lgamma({m} - {k} + 1))"


@query("score_poisson", BASE + f", sums as (select repo, a, b, sum(case when k < ca then exp({_LNPMF_P}) else 0 end) as below, sum(case when k >= ca then exp({_LNPMF_P}) else 0 end) as above from cells, unnest(range(0, 400)) as t(k) group by 1, 2, 3) select repo, a, b, round(case when below < 0.5 then -log10(1 - below) else -log10(above) end, 5) as score from sums")
def score_poisson(s, d):
    return _metrics(s, d, ["poisson_significance"]).select("repo", "a", "b", F.round("poisson_significance", 5).alias("score"))


@query("score_hypergeometric", BASE + f", sums as (select repo, a, b, sum(exp({_LNC('na', 'k')} + {_LNC('(n - na)', '(nb - k)')} - {_LNC('n', 'nb')})) as above from cells, unnest(range(0, 1000)) as t(k) where k >= ca and k <= least(na, nb) group by 1, 2, 3) select repo, a, b, round(-log10(above), 5) as score from sums")
def score_hypergeometric(s, d):
    return _metrics(s, d, ["hypergeometric_significance"]).select("repo", "a", "b", F.round("hypergeometric_significance", 5).alias("score"))


# --- read layer ------------------------------------------------------------------------------------------------


@query("coupled_items", BASE + """ select item, other, n_ab, round(conf, 6) as score from (
 select a as item, b as other, n_ab, n_ab::double / n_a as conf, repo from cells union all select b, a, n_ab, n_ab::double / n_b, repo from cells)
where repo = 'BUILDING' and item = 7 and n_ab >= 2 order by score desc, other limit 25""")
def coupled_items(s, d):
    asked = s.createDataFrame([("BUILDING", 7)], "repo string, item long")
    rows = c.partners(c.baskets(*(x.where("repo = 'BUILDING'") for x in _history(s, d))), F.broadcast(asked))  # one row
    return rows.select("item", "other", "n_ab", F.round(F.col("n_ab") / F.col("n_item"), 6).alias("score")).orderBy(F.desc("score"), "other").limit(25)


@query("coupled_items_min_score", BASE + """ select b as other, n_ab, round(n_ab::double / n_a, 6) as score from cells where repo = 'MACHINERY' and a = 3 and n_ab::double / n_a >= 0.05""")
def coupled_items_min_score(s, d):
    asked = s.createDataFrame([("MACHINERY", 3)], "repo string, item long")
    rows = c.partners(c.baskets(*(x.where("repo = 'MACHINERY'") for x in _history(s, d))), F.broadcast(asked)).where("other > item and n_ab / n_item >= 0.05")  # one row
    return rows.select("other", "n_ab", F.round(F.col("n_ab") / F.col("n_item"), 6).alias("score"))


@query("strongest_pairs", BASE + f" select repo, a, b, n_ab, round({_FORMULAS['jaccard']}, 6) as score from cells where n_ab >= 3 order by score desc, repo, a, b limit 25")
def strongest_pairs(s, d):
    rows = _metrics(s, d, ["jaccard"]).where("n_ab >= 3")
    return rows.select("repo", "a", "b", "n_ab", F.round("jaccard", 6).alias("score")).orderBy(F.desc("score"), "repo", "a", "b").limit(25)


_GRAPH = BASE + f", edges as (select a, b, n_ab, round({_FORMULAS['npmi']}, 6)::double as score from cells where repo = 'HOUSEHOLD' and n_ab >= 3 order by score desc, a, b limit 150)"


def _graph(s, d):
    rows = _metrics(s, d, ["npmi"]).where("repo = 'HOUSEHOLD' and n_ab >= 3")
    return rows.select("a", "b", "n_ab", F.round("npmi", 6).alias("score")).orderBy(F.desc("score"), "a", "b").limit(150)


@query("coupling_graph_edges", _GRAPH + " select * from edges")
def coupling_graph_edges(s, d):
    return _graph(s, d)


@query("coupling_graph_nodes", _GRAPH + " select distinct unnest([a, b]) as file_id from edges")
def coupling_graph_nodes(s, d):
    return _graph(s, d).select(F.explode(F.array("a", "b")).alias("file_id")).distinct()


@query("pair_detail_cells", BASE + " select repo, a, b, ca::bigint as cell_a, cb::bigint as cell_b, cc::bigint as cell_c, cd::bigint as cell_d, round(na * nb / n, 6) as expected from cells where a = 1 and b = 2")
def pair_detail_cells(s, d):
    rows = c.baskets(*_history(s, d))
    both = c.pair_counts(rows.where(F.array_contains("items", 1) & F.array_contains("items", 2)).withColumn("items", F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    rows = c.scored(both, c.basket_margins(rows.withColumn("items", F.filter("items", lambda x: x.isin(1, 2)))), c.basket_population(rows), [])
    return rows.select("repo", "a", "b", *[F.col(f"cell_{x}").cast("long").alias(f"cell_{x}") for x in "abcd"], F.round(measures.cells().expected, 6).alias("expected"))


@query("co_change_evidence", BASE + " select commit_id, epoch(committed_at)::bigint as committed_at from dated where file_id = 1 intersect select commit_id, epoch(committed_at)::bigint from dated where file_id = 2")
def co_change_evidence(s, d):
    rows = c.dated(*_history(s, d)).select("file_id", "commit_id", _secs("committed_at"))
    return rows.where("file_id = 1").drop("file_id").intersect(rows.where("file_id = 2").drop("file_id"))


@query("coupled_hierarchy", PARTS + """, dirs as (select distinct repo, commit_id, dir_path from dated join closure using (file_id) where eligible)
select y.repo, y.dir_path as other, count(*) as n_ab from dirs x join dirs y on x.commit_id = y.commit_id and x.dir_path <> y.dir_path
where x.dir_path = (select min(dir_path) from closure where dir_path <> '' and not contains(dir_path, '/')) and y.dir_path <> '' group by 1, 2 having count(*) >= 2""")
def coupled_hierarchy(s, d):
    top = c.closure(roles.paths(s, d)).where("depth = 1").agg(F.min("dir_path").alias("item"))
    asked = roles.table(s, d, "customer").select(F.col("c_mktsegment").alias("repo")).distinct().join(F.broadcast(top))  # one row
    rows = c.partners(c.directory_baskets(*_history(s, d, "l_partkey"), roles.paths(s, d)), F.broadcast(asked))  # a row for each repository
    return rows.where("other <> ''").select("repo", "other", "n_ab")


@query("hotspots_with_partners", BASE + """ select m.repo, m.file_id, change_count, coalesce(partners, 0) as partner_count from marginals m
left join (select repo, file_id, count(*) as partners from (select repo, unnest([a, b]) as file_id from pairs) group by 1, 2) using (repo, file_id) order by change_count desc, repo, file_id limit 25""")
def hotspots_with_partners(s, d):
    partners = _pairs(s, d).select("repo", F.explode(F.array("a", "b")).alias("file_id")).groupBy("repo", "file_id").agg(F.count(F.lit(1)).alias("partners"))
    rows = c.file_marginals(*_history(s, d)).join(partners, ["repo", "file_id"], "left")
    return rows.select("repo", "file_id", "change_count", F.coalesce("partners", F.lit(0)).alias("partner_count")).orderBy(F.desc("change_count"), "repo", "file_id").limit(25)


@query("item_history", BASE + " select repo, commit_id, epoch(committed_at)::bigint as committed_at, author_id from dated where file_id = 5 order by committed_at desc, commit_id limit 50")
def item_history(s, d):
    rows = c.dated(*_history(s, d)).where("file_id = 5").select("repo", "commit_id", _secs("committed_at"), "author_id")
    return rows.orderBy(F.desc("committed_at"), "commit_id").limit(50)


@query("item_owners", BASE + " select author_id, count(*) as n_commits from dated where file_id = 5 and repo = 'BUILDING' group by 1 order by n_commits desc, author_id limit 20")
def item_owners(s, d):
    rows = c.author_files(*_history(s, d)).where("file_id = 5 and repo = 'BUILDING'")
    return rows.select("author_id", "n_commits").orderBy(F.desc("n_commits"), "author_id").limit(20)


@query("search_items", "select p_partkey as file_id, p_type || '/' || p_brand || '/' || p_name as path from part where contains(lower(p_name), 'o') order by path, file_id limit 50")
def search_items(s, d):
    rows = roles.paths(s, d).where(F.contains(F.lower(text.basename(F.col("path"))), F.lit("o")))
    return rows.select("file_id", "path").orderBy("path", "file_id").limit(50)


@query("search_scopes", "select c_mktsegment as repo, count(*) as customers from customer where contains(lower(c_mktsegment), 'u') group by 1")
def search_scopes(s, d):
    rows = roles.table(s, d, "customer").where(F.contains(F.lower("c_mktsegment"), F.lit("u")))
    return rows.groupBy(F.col("c_mktsegment").alias("repo")).agg(F.count(F.lit(1)).alias("customers"))


@query("language_counts", "select lang, count(*) as n from documents group by 1 order by n desc, lang")
def language_counts(s, d):
    return roles.table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


@query("extension_counts", r"select regexp_extract(url, '\.([a-z0-9]{1,20})(?:[?#].*)?$', 1) as extension, count(*) as n from pages group by 1 order by n desc, extension limit 60")
def extension_counts(s, d):
    found = F.regexp_extract("url", r"\.([a-z0-9]{1,20})(?:[?#].*)?$", 1)
    return roles.table(s, d, "pages").groupBy(found.alias("extension")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension").limit(60)


@query("overview", BASE + " select (select count(*) from commits) as commits, (select count(*) from commits where eligible) as eligible_commits, (select count(distinct (repo, file_id)) from changes) as files, (select count(*) from pairs) as pairs, (select count(distinct author_id) from commits) as authors")
def overview(s, d):
    changes, commits = _history(s, d)
    heads = c.with_eligible(commits).agg(F.count(F.lit(1)).alias("commits"), F.count_if("eligible").alias("eligible_commits"), F.count_distinct("author_id").alias("authors"))
    files = changes.agg(F.count_distinct("repo", "file_id").alias("files"))
    return heads.join(F.broadcast(files)).join(F.broadcast(_pairs(s, d).agg(F.count(F.lit(1)).alias("pairs"))))  # one row each


_SHAPES = {
    "commits_by_year": ("select year(committed_at)::int as bucket, count(*) as n from commits group by 1", lambda h, k: k.groupBy(F.year("committed_at").alias("bucket"))),
    "commit_width": ("select least(n_files, 12)::bigint as bucket, count(*) as n from commits where eligible group by 1", lambda h, k: c.with_eligible(k).where("eligible").groupBy(F.least("n_files", F.lit(12)).cast("long").alias("bucket"))),
    "authors_per_file": ("select least(distinct_authors, 8)::bigint as bucket, count(*) as n from marginals group by 1", lambda h, k: c.file_marginals(h, k).groupBy(F.least("distinct_authors", F.lit(8)).cast("long").alias("bucket"))),
    "pair_support": ("select least(n_ab, 10)::bigint as bucket, count(*) as n from pairs group by 1", lambda h, k: c.pair_counts(c.baskets(h, k)).groupBy(F.least("n_ab", F.lit(10)).cast("long").alias("bucket"))),
    "repo_recency": ("select case when age < 30 then 'past month' when age < 180 then 'past 6 months' when age < 365 then 'past year' else 'over a year' end as bucket, count(*) as n from (select repo, floor((epoch(timestamp '2001-12-01') - epoch(max(committed_at))) / 86400) as age from commits group by 1) group by 1",
                     lambda h, k: k.groupBy("repo").agg(F.floor((c.as_of_epoch(AS_OF) - F.max(c.epoch("committed_at"))) / 86400).alias("age")).groupBy(F.when(F.col("age") < 30, "past month").when(F.col("age") < 180, "past 6 months").when(F.col("age") < 365, "past year").otherwise("over a year").alias("bucket"))),
    "repo_sizes": ("select case when n < 100 then '<100' when n < 1000 then '100-1k' when n < 10000 then '1k-10k' else '10k+' end as bucket, count(*) as n from (select repo, count(*) as n from commits group by 1) group by 1",
                   lambda h, k: k.groupBy("repo").agg(F.count(F.lit(1)).alias("m")).groupBy(F.when(F.col("m") < 100, "<100").when(F.col("m") < 1000, "100-1k").when(F.col("m") < 10000, "1k-10k").otherwise("10k+").alias("bucket"))),
}


def _shape(name: str, sql: str, group) -> None:
    query(f"corpus_shape_{name}", BASE + " " + sql)(lambda s, d: group(*_history(s, d)).agg(F.count(F.lit(1)).alias("n")))


for _name, (_sql, _group) in _SHAPES.items():
    _shape(_name, _sql, _group)


@query("duplicate_groups", "select md5(text) as head, count(*) as n, list_sort(list(doc_id)) as ids from documents group by 1 having count(*) > 1")
def duplicate_groups(s, d):
    rows = roles.table(s, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("head"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("doc_id")).alias("ids")).where("n > 1")


@query("measure_catalog")
def measure_catalog(s, d):
    rows = [(m.key, m.family, m.low, m.high, m.neutral, m.directional, m.note) for m in measures.REGISTRY.values()]
    return s.createDataFrame([(a, b, None if x is None else float(x), None if y is None else float(y), n, e, f) for a, b, x, y, n, e, f in rows], "key string, family string, low double, high double, neutral double, directional boolean, note string")


@query("partner_labels", BASE + " select repo, a, b, n_ab, n_ab < 5 as thin, case when n_ab >= 10 then 'strong' when n_ab >= 5 then 'moderate' else 'weak' end as evidence from cells")
def partner_labels(s, d):
    from ..schemas import THIN_SUPPORT

    grade = F.when(F.col("n_ab") >= 10, "strong").when(F.col("n_ab") >= THIN_SUPPORT, "moderate").otherwise("weak")
    return _pairs(s, d).select("repo", "a", "b", "n_ab", (F.col("n_ab") < THIN_SUPPORT).alias("thin"), grade.alias("evidence"))


@query("content_fingerprint")
def content_fingerprint(s, d):
    return _pairs(s, d).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b", "n_ab")).alias("print"))


# --- mining ----------------------------------------------------------------------------------------------------

_NPMI = lambda w: f"case when nab{w} <= 0 or m{w} <= 0 or k{w} <= 0 or n{w} <= 0 then null when nab{w} >= n{w} then 1 else log2(nab{w} * n{w} / (m{w} * k{w})) / -log2(nab{w} / n{w}) end"
_DRIFT = BASE + f""", e as (select *, committed_at >= timestamp '2001-12-01' - interval 365 day as recent from dated where eligible),
t as (select repo, count(*) filter (recent)::double as nr, count(*) filter (not recent)::double as nh from (select distinct repo, commit_id, recent from e) group by 1),
m as (select repo, file_id, count(*) filter (recent)::double as r, count(*) filter (not recent)::double as h from e group by 1, 2),
j as (select x.repo, x.file_id as a, y.file_id as b, count(*) filter (x.recent)::double as nabr, count(*) filter (not x.recent)::double as nabh from e x join e y on x.commit_id = y.commit_id and x.file_id < y.file_id group by 1, 2, 3),
q as (select j.*, m.r as mr, m.h as mh, k.r as kr, k.h as kh, nr, nh from j join m on m.repo = j.repo and m.file_id = a join m k on k.repo = j.repo and k.file_id = b join t on t.repo = j.repo where nabr >= 2 and nabh >= 2),
d as (select repo, a, b, nabr::bigint as n_ab_recent, nabh::bigint as n_ab_historic, ({_NPMI('r')})::double as npmi_recent, ({_NPMI('h')})::double as npmi_historic from q),
drift as (select *, coalesce(npmi_recent, 0) - coalesce(npmi_historic, 0) as delta from d),
trends as (select *, case when delta > 0.15 then 'emerging' when delta < -0.15 then 'decaying' else 'stable' end as trend from drift)"""


def _drift(s, d):
    return c.drift(c.baskets(*_history(s, d)), AS_OF)


@query("drift_pairs", _DRIFT + " select repo, a, b, n_ab_recent, n_ab_historic, round(npmi_recent, 6) as npmi_recent, round(npmi_historic, 6) as npmi_historic, round(delta, 6) as delta, trend from trends")
def drift_pairs(s, d):
    return _drift(s, d).select("repo", "a", "b", "n_ab_recent", "n_ab_historic", *[F.round(x, 6).alias(x) for x in ("npmi_recent", "npmi_historic", "delta")], "trend")


@query("drift_emerging", _DRIFT + " select repo, a, b, round(delta, 6) as delta from trends where trend = 'emerging' order by delta desc, repo, a, b limit 25")
def drift_emerging(s, d):
    return _drift(s, d).where("trend = 'emerging'").select("repo", "a", "b", F.round("delta", 6).alias("delta")).orderBy(F.desc("delta"), "repo", "a", "b").limit(25)


_RISK = BASE + """, own as (select repo, file_id, author_id, count(*)::double as k from dated group by 1, 2, 3),
h as (select repo, file_id, sum(pow(k / total, 2)) as hhi from (select *, sum(k) over (partition by repo, file_id) as total from own) group by 1, 2),
deg as (select repo, file_id, count(*) as partners from (select repo, unnest([a, b]) as file_id from pairs) group by 1, 2),
base as (select m.*, coalesce(partners, 0) as partners, hhi, insertions + deletions as churn from marginals m left join deg using (repo, file_id) left join h using (repo, file_id)),
r as (select *, (count(*) over (partition by repo order by churn range between unbounded preceding and current row) - 1)::double / greatest(count(*) over (partition by repo) - 1, 1) as churn_pct,
 (count(*) over (partition by repo order by partners range between unbounded preceding and current row) - 1)::double / greatest(count(*) over (partition by repo) - 1, 1) as coupling_pct from base),
risk as (select *, churn_pct * coupling_pct * (1 + hhi) * change_count / (change_count + 25.0) as risk from r)"""


def _risk(s, d):
    changes, commits = _history(s, d)
    return c.file_risk(c.file_marginals(changes, commits), _pairs(s, d), c.author_files(changes, commits), AS_OF)


@query("item_risk", _RISK + " select repo, file_id, partners, round(churn_pct, 6) as churn_pct, round(coupling_pct, 6) as coupling_pct, round(hhi, 6) as hhi, floor((epoch(timestamp '2001-12-01') - epoch(last_at)) / 86400)::bigint as days_since, round(risk, 6) as risk from risk")
def item_risk(s, d):
    return _risk(s, d).select("repo", "file_id", F.col("partners").cast("long"), *[F.round(x, 6).alias(x) for x in ("churn_pct", "coupling_pct", "hhi")], "days_since", F.round("risk", 6).alias("risk"))


@query("risky_items", _RISK + " select repo, file_id, round(risk, 6) as risk from risk where change_count >= 5 order by risk desc, repo, file_id limit 25")
def risky_items(s, d):
    return _risk(s, d).where("change_count >= 5").select("repo", "file_id", F.round("risk", 6).alias("risk")).orderBy(F.desc("risk"), "repo", "file_id").limit(25)


@query("clusters")
def clusters(s, d):
    edges = _metrics(s, d, ["npmi"]).where(f"n_ab >= {CLUSTER_MIN_SUPPORT} and npmi > 0").select("repo", "a", "b", F.col("npmi").alias("weight"))
    return c.clusters(edges).groupBy("repo", "label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where("size >= 2")


# --- impact ----------------------------------------------------------------------------------------------------

_BUMPS = """bumps as (select l_orderkey * 10 + l_linenumber as id, cn.n_name as consumer, sn.n_name as dep, l_shipdate as consumer_at, o_orderdate as upstream_at
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
 join nation cn on cn.n_nationkey = c_nationkey join nation sn on sn.n_nationkey = s_nationkey {where})"""
_EVERY = _BUMPS.format(where="")
_EDGES = """declared as (select a.n_name as target, b.n_name as source from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey),
seen as (select dep as source, consumer as target, count(*) as bump_count, quantile_cont(case when upstream_at <= consumer_at then (epoch(consumer_at) - epoch(upstream_at)) / 86400.0 end, 0.5) as median_days, max(consumer_at) as last_at from bumps group by 1, 2),
edges as (select source, target, d.is_declared is not null as is_declared, coalesce(bump_count, 0) as bump_count, median_days,
 round(least(1, case when d.is_declared is not null then 0.5 else 0.2 end + least(0.3, 0.02 * coalesce(bump_count, 0)) + case when epoch(timestamp '2001-12-01') - epoch(last_at) < 90 * 86400 then 0.2 when epoch(timestamp '2001-12-01') - epoch(last_at) < 365 * 86400 then 0.1 else 0 end)::double, 6) as score
 from (select distinct source, target, true as is_declared from declared) d full join seen using (source, target) where source <> target)"""
_IMPACT = f"with recursive {_EVERY}, {_EDGES}"


def _edges(s, d):
    return g.edge_scores(roles.declared(s, d), roles.bumps(s, d), AS_OF)


@query("edge_scores", _IMPACT + " select source, target, is_declared, bump_count, round(median_days, 6) as median_days, score, row_number() over (partition by source order by score desc, target)::int as rank from edges")
def edge_scores(s, d):
    return _edges(s, d).select("source", "target", "is_declared", "bump_count", F.round("median_days", 6).alias("median_days"), "score", "rank")


@query("impact_downstream", _IMPACT + " select target, is_declared, score from edges where source = (select max(n_name) from nation) order by is_declared desc, score desc, target limit 20")
def impact_downstream(s, d):
    top = roles.table(s, d, "nation").agg(F.max("n_name").alias("source"))
    return _edges(s, d).join(F.broadcast(top), "source").select("target", "is_declared", "score").orderBy(F.desc("is_declared"), F.desc("score"), "target").limit(20)  # one row


@query("impact_edge_counts", _IMPACT + " select source, count(*) as edges, count(*) filter (is_declared) as declared from edges group by 1")
def impact_edge_counts(s, d):
    return _edges(s, d).groupBy("source").agg(F.count(F.lit(1)).alias("edges"), F.count_if("is_declared").alias("declared"))


_CHAINS = _IMPACT + """, strong as (select {src} as source, {dst} as target, score from edges where score >= 0.5),
walk as (select [source, target] as path, score as path_score from strong where source = (select {pick} from nation)
 union all select list_append(path, strong.target), path_score * score from walk join strong on path[len(path)] = strong.source where not list_contains(path, strong.target) and len(path) <= 3)
select array_to_string(path, '>') as path, (len(path) - 1)::int as depth, round(path_score, 4) as path_score from walk where len(path) > 2 order by path_score desc, depth, path limit 40"""


@query("impact_chains", _CHAINS.format(src="source", dst="target", pick="arg_max(n_name, n_nationkey)"))
def impact_chains(s, d):
    start = roles.table(s, d, "nation").agg(F.max_by("n_name", "n_nationkey")).first()[0]
    return g.chains(_edges(s, d), start)


@query("upstream_chains", _CHAINS.format(src="target", dst="source", pick="min(n_name)"))
def upstream_chains(s, d):
    start = roles.table(s, d, "nation").agg(F.min("n_name")).first()[0]
    return g.chains(g.upstream(_edges(s, d)), start)


@query("bump_list", f"with {_EVERY} select consumer, dep, id, case when upstream_at <= consumer_at then round((epoch(consumer_at) - epoch(upstream_at)) / 86400.0, 1) end as adoption_days from bumps")
def bump_list(s, d):
    return g.resolved(roles.bumps(s, d)).select("consumer", "dep", "id", F.round(F.col("adoption_seconds") / 86400.0, 1).alias("adoption_days"))


@query("impossible_edges_rejected", f"with {_EVERY} select consumer, dep, count(*) as bumps, count(*) filter (upstream_at > consumer_at) as impossible from bumps group by 1, 2")
def impossible_edges_rejected(s, d):
    return g.resolved(roles.bumps(s, d)).groupBy("consumer", "dep").agg(F.count(F.lit(1)).alias("bumps"), F.count_if(~F.col("possible")).alias("impossible"))


@query("dependency_summary", f"with {_EVERY}, x as (select consumer, dep, list_sort(list(epoch(consumer_at) - epoch(upstream_at)) filter (upstream_at <= consumer_at)) as lags, count(*) as bumps from bumps group by 1, 2) select consumer, dep, bumps, lags[len(lags) // 2 + 1]::bigint as upper_median from x")
def dependency_summary(s, d):
    # the upper median is the discrete one of the falling order; the aggregate holds counts of distinct lags, not rows
    upper = F.expr("percentile_disc(0.5) within group (order by adoption_seconds desc)")
    return g.resolved(roles.bumps(s, d)).groupBy("consumer", "dep").agg(F.count(F.lit(1)).alias("bumps"), upper.cast("long").alias("upper_median"))


@query("asof_ceiling", "with req as (select o_orderkey as id, o_custkey as key, o_orderdate as at, 200000.0 as below from orders) select req.id, max(o_totalprice) as ordinal from req left join orders o on o.o_custkey = req.key and o.o_totalprice < req.below and o.o_orderdate <= req.at group by 1")
def asof_ceiling(s, d):
    orders = roles.table(s, d, "orders")
    req = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.lit(200000.0).alias("below"))
    rel = orders.select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("ordinal"), F.col("o_orderdate").alias("tagged_at"))
    return g.asof_ceiling(req, rel).select("id", "ordinal")


@query("unique_version_match", "with tags as (select p_brand as key, p_size as version, count(distinct p_partkey) as n, min(p_partkey) as target from part group by 1, 2) select p_partkey as id, case when n = 1 then target end as target from part left join tags on key = p_brand and version = p_size")
def unique_version_match(s, d):
    part = roles.table(s, d, "part")
    req = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("key"), F.col("p_size").alias("version"))
    return g.unique_match(req, req.withColumnRenamed("id", "target")).select("id", "target")


@query("prefix_match", "with shas as (select md5(o_orderkey::varchar) as sha from orders), req as (select o_orderkey as id, substr(md5(o_orderkey::varchar), 1, 16) as prefix from orders) select id, min(sha) as sha from req left join shas on substr(sha, 1, 16) = prefix group by 1")
def prefix_match(s, d):
    orders = roles.table(s, d, "orders")
    sha = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    return g.prefix_match(orders.select(F.col("o_orderkey").alias("id"), F.substring(sha, 1, 16).alias("prefix")), orders.select(sha.alias("sha"))).select("id", "sha")


@query("longest_prefix_owner", PARTS + """, modules as (select distinct dir_path as module from closure where dir_path <> '')
select file_id, arg_max(module, length(module)) as module from files join modules on path = module or starts_with(path, module || '/') group by 1""")
def longest_prefix_owner(s, d):
    files = roles.paths(s, d)
    modules = c.closure(files).where("dir_path <> ''").select(F.col("dir_path").alias("module"))
    return g.owning_module(files, modules)


@query("cross_scope_pairs", """with b as (select l_orderkey as id, l_suppkey as up, l_partkey as down from lineitem)
select y.up as upstream_file, x.down as consumer_file, count(distinct x.id) as n_bumps from b y join b x on x.id = y.id group by 1, 2 having count(distinct x.id) >= 2""")
def cross_scope_pairs(s, d):
    lines = roles.table(s, d, "lineitem").join(roles.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    bumps = roles.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("version"))
    side = lambda item: lines.select(F.col("l_orderkey").alias("id"), F.col(item).alias("file_id"))
    return g.cross_pairs(bumps, side("l_suppkey"), side("l_partkey")).where("n_bumps >= 2").select("upstream_file", "consumer_file", "n_bumps")


# --- calls -----------------------------------------------------------------------------------------------------

_CALLS = "with calls as (select event_id as id, ts, case when event_type in ('view', 'click') then 'http' else 'mcp' end as surface, event_type as name, case when event_type = 'error' then 'error' else 'ok' end as status, value as duration_ms, user_id::varchar as client from events)"


@query("calls_summary", _CALLS + " select surface, status, count(*) as calls, count(distinct client) as clients, round(quantile_cont(duration_ms, 0.5), 1) as p50, round(quantile_cont(duration_ms, 0.95), 1) as p95, floor(epoch(max(ts)))::bigint as last_at from calls group by 1, 2")
def calls_summary(s, d):
    return ev.summary(roles.calls(s, d))


@query("calls_by_name", _CALLS + " select surface, name, count(*) as calls, count(*) filter (status = 'error') as errors, round(avg(duration_ms), 1) as avg_ms from calls group by 1, 2 order by calls desc, surface, name limit 50")
def calls_by_name(s, d):
    return ev.by_name(roles.calls(s, d))


@query("calls_timeline", _CALLS + ", spine as (select epoch(timestamp '2024-01-31')::bigint // 3600 - i as hour from range(168) t(i)), seen as (select floor(epoch(ts))::bigint // 3600 as hour, count(*) as calls, count(*) filter (status = 'error') as errors from calls group by 1) select hour * 3600 as hour_start, coalesce(calls, 0) as calls, coalesce(errors, 0) as errors from spine left join seen using (hour)")
def calls_timeline(s, d):
    return ev.timeline(roles.calls(s, d), EVENTS_AS_OF, 168)


@query("calls_recent", _CALLS + " select id, name, floor(epoch(ts))::bigint as \"at\" from calls order by calls.ts desc, id desc limit 100")
def calls_recent(s, d):
    return ev.recent(roles.calls(s, d)).select("id", "name", _secs("at"))


@query("calls_prune", _CALLS + " select id from calls where ts >= timestamp '2024-01-31' - interval 10 day and id >= (select min(id) from (select id from calls order by id desc limit 500))")
def calls_prune(s, d):
    return ev.pruned(roles.calls(s, d), EVENTS_AS_OF, 10, 500).select("id")


@query("call_sessions", _CALLS + """, x as (select client, ts, id, floor(epoch(ts))::bigint - lag(floor(epoch(ts))::bigint) over (partition by client order by ts, id) as gap from calls)
select client, sum(case when gap is null or gap > 1800 then 1 else 0 end)::bigint as sessions, count(*) as calls from x group by 1""")
def call_sessions(s, d):
    return ev.sessions(roles.calls(s, d))


# --- text ------------------------------------------------------------------------------------------------------


@query("url_parse", r"select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as query, regexp_extract(url, '#(.*)$', 1) as fragment from pages")
def url_parse(s, d):
    return roles.table(s, d, "pages").select("page_id", *[v.alias(k) for k, v in text.source_url(F.col("url")).items()])


@query("path_split", "select p_partkey as file_id, p_type || '/' || p_brand as dir_path, p_name as basename, 2 as depth from part where not contains(p_name, '/')")
def path_split(s, d):
    p = F.col("path")
    return roles.paths(s, d).select("file_id", text.directory(p).alias("dir_path"), text.basename(p).alias("basename"), text.depth(p).alias("depth"))


@query("wilson_interval", BASE + """, x as (select repo, count(*)::double as n, count(*) filter (eligible)::double as h from commits group by 1)
select repo, round((h / n + 3.8416 / (2 * n) - 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as low, round((h / n + 3.8416 / (2 * n) + 1.96 * sqrt(h / n * (1 - h / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) as high from x""")
def wilson_interval(s, d):
    rows = c.with_eligible(roles.commits(s, d)).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("h"))
    low, high = text.wilson(F.col("h"), F.col("n"))
    return rows.select("repo", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


# --- replay ----------------------------------------------------------------------------------------------------


@query("backtest_hit_rate", BASE + """,
num as (select repo, commit_id, row_number() over (partition by repo order by committed_at, commit_id) as nr, n from (select repo, commit_id, committed_at, count(*) as n from dated where eligible group by 1, 2, 3)),
occ as (select repo, commit_id, nr, file_id, n from dated join num using (repo, commit_id)),
seeds as (select * from occ where nr > 20 and n between 2 and 25),
sup as (select s.repo, s.commit_id, s.file_id as seed, y.file_id as other, count(*) as n_ab from seeds s join occ x on x.repo = s.repo and x.file_id = s.file_id and x.nr < s.nr
 join occ y on y.repo = x.repo and y.nr = x.nr and y.file_id <> s.file_id group by 1, 2, 3, 4 having count(*) >= 2),
top as (select *, row_number() over (partition by repo, commit_id, seed order by n_ab desc, other) as place from sup),
hit as (select s.repo, s.commit_id, s.file_id as seed, count(o.file_id) as hits from seeds s left join top t on t.repo = s.repo and t.commit_id = s.commit_id and t.seed = s.file_id and place <= 5
 left join occ o on o.repo = s.repo and o.commit_id = s.commit_id and o.file_id = t.other group by 1, 2, 3)
select repo, count(*) as prompts, count(*) filter (hits > 0) as hit from hit group by 1""")
def backtest_hit_rate(s, d):
    from ..operators import backtest

    return backtest.rates(backtest.replay(c.baskets(*_history(s, d)))).select("repo", "prompts", "hit")


_MEASURES = ["confidence_ab", "log_likelihood_ratio", "jaccard", "npmi", "confidence_ba"]


@query("backtest_measures", BASE + """, x as (select distinct repo, commit_id, committed_at, file_id from dated where eligible),
nrs as (select repo, commit_id, row_number() over (partition by repo order by committed_at, commit_id) as nr, size from (select repo, commit_id, committed_at, count(*) as size from x group by all)),
u as (select x.repo, x.commit_id, file_id, nr, size, row_number() over (partition by x.repo, file_id order by nr) - 1 as before from x join nrs using (repo, commit_id)),
ev as (select a.repo, a.file_id as seed, b.file_id as other, a.nr from u a join u b on a.commit_id = b.commit_id and a.file_id <> b.file_id),
asked as (select * from u where nr > 20 and size between 2 and 25),
pairs_at as (select p.repo, p.commit_id, p.file_id as seed, p.nr, p.before as n_a, e.other, count(*) as n_ab from asked p join ev e on e.repo = p.repo and e.seed = p.file_id and e.nr < p.nr group by all having count(*) >= 2),
counts as (select a.repo, a.commit_id, seed, other, n_ab, n_a, a.nr - 1 as n_total, u.before + 1 as n_b from pairs_at a asof join (select repo, file_id, nr, before from u) u on u.repo = a.repo and u.file_id = a.other and a.nr > u.nr),
cells_at as (select *, n_ab::double as ca, n_a - n_ab::double as cb, n_b - n_ab::double as cc, n_total - n_a - n_b + n_ab::double as cd, n_a::double as na, n_b::double as nb, n_total::double as n from counts),
scores as (""" + " union all ".join(f"select repo, commit_id, seed, other, '{key}' as measure, round({_FORMULAS[key]}, 9) as score from cells_at" for key in _MEASURES) + """),
offers as (select * from scores qualify row_number() over (partition by measure, commit_id, seed order by score desc, other) <= 5),
hits as (select measure, o.repo, o.commit_id, seed, count(*) as hits from offers o join u on u.commit_id = o.commit_id and u.file_id = o.other group by all)
select m.measure, p.repo, count(*) as prompts, count(h.hits) as hit, coalesce(sum(h.hits), 0)::bigint as found
from asked p cross join (select unnest(['confidence_ab', 'log_likelihood_ratio', 'jaccard', 'npmi', 'confidence_ba']) as measure) m left join hits h on h.measure = m.measure and h.commit_id = p.commit_id and h.seed = p.file_id group by 1, 2""")
def backtest_measures(s, d):
    """How often five measures name a file of the commit among their first five, over all of history as of each commit."""
    from ..operators import replay

    results = replay.replay_measures(c.baskets(*_history(s, d)), _MEASURES)
    found = results.groupBy("repo", "measure").agg(F.count(F.lit(1)).alias("prompts"), F.count_if(F.col("hits") > 0).alias("hit"), F.sum("hits").alias("found"))
    return found.select("measure", "repo", "prompts", "hit", "found")
