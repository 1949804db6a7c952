"""Queries of the sources: manifests and lock files written from the tables, and commit logs as batch and stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.steps import release, shared_dir
from ..sources import manifests, roles
from ..sources.log_source import read_log, write_log
from .registry import query

#: Of each kind: the file's name, what stands before its entries, an entry, what divides them, and what stands after them.
#: {k} is a part's number, {v} its size.
FORMS = (
    ("go.mod", "module example.com/m\n\nrequire (\n", "\tgithub.com/o/p{k} v1.{v}.0 // indirect", "\n", "\n)\n"),
    ("requirements.txt", "# pinned\n-r other.txt\n", "p{k}[extra] == 1.{v}  # why", "\n", "\n"),
    ("package.json", '{"name": "m", "private": true, "devDependencies": {', '"p{k}": "^1.{v}.0"', ", ", "}}"),
    ("Cargo.lock", "version = 3\n\n", '[[package]]\nname = "P{k}"\nversion = "1.{v}.0"\ndependencies = [\n "x",\n]', "\n\n", "\n"),
    ("pom.xml", "<project><dependencies>", "<dependency><groupId>g</groupId><artifactId>p{k}</artifactId><version>1.{v}</version></dependency>", "\n", "</dependencies></project>"),
    ("package-lock.json", '{"lockfileVersion": 3, "packages": {"": {"version": "0.0.1"}, ', '"node_modules/p{k}": {"version": "1.{v}.0", "dev": true}', ",\n", "}}"),
)


def manifest_files(s: SparkSession, d: str) -> DataFrame:
    """(repo, path, text): for each supplier a file that names the parts of its lines, its kind by the supplier's number."""
    lines = roles.table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    parts = roles.table(s, d, "part").select("p_partkey", "p_size")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("kind", F.pmod("l_suppkey", F.lit(len(FORMS))))
    by_kind = lambda values: F.element_at(F.array(*values), (F.col("kind") + 1).cast("int"))
    fill = lambda form: F.replace(F.replace(F.lit(form), F.lit("{k}"), F.col("l_partkey").cast("string")), F.lit("{v}"), F.col("p_size").cast("string"))
    rows = rows.withColumn("entry", by_kind([fill(form[2]) for form in FORMS])).groupBy("l_suppkey", "kind").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    column = lambda k: by_kind([F.lit(form[k]) for form in FORMS])
    text = F.concat(column(1), F.array_join(F.col("entries"), "\x00"), column(4))
    text = F.replace(text, F.lit("\x00"), column(3))
    return rows.select(F.col("l_suppkey").cast("string").alias("repo"), F.concat(F.lit("src/"), column(0)).alias("path"), text.alias("text"))


_NAMED = "with x as (select distinct l_suppkey, l_partkey, p_size, l_suppkey % 6 as kind from lineitem join part on l_partkey = p_partkey)"


@query("manifest_entries", _NAMED + """
select l_suppkey::varchar as repo, ['go', 'python', 'npm', 'rust', 'java', 'npm'][kind + 1] as ecosystem, case kind when 0 then 'github.com/o/p' when 3 then 'P' else 'p' end || l_partkey as name,
  case kind when 0 then 'v1.' || p_size || '.0' when 1 then '== 1.' || p_size when 2 then '^1.' || p_size || '.0' when 4 then '1.' || p_size else '1.' || p_size || '.0' end as raw,
  case when kind = 2 then 'range' else 'tag' end as kind from x""")
def manifest_entries(s, d):
    """Every dependency that the files name, with what its version is; the root entry of a lock names no package."""
    rows = manifests.parse_manifests(manifest_files(s, d))
    return rows.select("repo", "ecosystem", "name", "raw", "kind")


@query("lock_entries", _NAMED + " select l_suppkey::varchar as repo, case kind when 3 then 'rust' else 'npm' end as ecosystem, 'p' || l_partkey as name, '1.' || p_size || '.0' as version from x where kind in (3, 5)")
def lock_entries(s, d):
    return manifests.parse_locks(manifest_files(s, d)).select("repo", "ecosystem", "name", "version")


# --- commit logs ----------------------------------------------------------------------------------------------------------


#: Lines that are exported at once: what an export shuffles doesn't grow with the tables then.
LINES = 10_000_000


def log_of_orders(s: SparkSession, d: str, folder: str, segment=None, mode: str = "error") -> None:
    """Writes every order as a commit of its customer's segment of the market, every line as a change.

    An urgent order is a merge; a line that was returned is a rename, its similarity by the part's number. Orders come in turns,
    by ranges of their keys, each a segment of its own; a turn's orders and lines are shuffled once, together and as numbers.
    """
    turns = max(1, -(-roles.table(s, d, "lineitem").count() // LINES))
    edges = roles.table(s, d, "orders").approxQuantile("o_orderkey", [k / turns for k in range(1, turns)], 0.1 / turns) if turns > 1 else []
    for turn, (low, high) in enumerate(zip([None, *map(int, edges)], [*map(int, edges), None], strict=True)):
        name = F.concat((F.lit(1) if segment is None else segment).cast("string"), F.lit(f"-{turn:06}"))
        inside = lambda key, low=low, high=high: key.isNotNull() & (F.lit(True) if low is None else key >= low) & (F.lit(True) if high is None else key < high)
        rows = _commits_of_orders(s, d, name, inside)
        write_log(rows, folder, mode if turn == 0 else "append", ranged=True)
        release(s)


def _commits_of_orders(s: SparkSession, d: str, segment: Column, inside: Callable[[Column], Column]) -> DataFrame:
    """(repo, segment, nr, head, items) of the orders whose keys are inside, in ranges of nr."""
    customer = roles.table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("repo"))
    orders = roles.table(s, d, "orders").where(inside(F.col("o_orderkey"))).join(customer, "o_custkey")
    order = F.struct("repo", segment.alias("segment"), "o_orderdate", "o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_returnflag") == "R").alias("returned"))
    lines = roles.table(s, d, "lineitem").where(inside(F.col("l_orderkey"))).select(F.col("l_orderkey").alias("nr"), line.alias("line"))
    rows = orders.select(F.col("o_orderkey").alias("nr"), order.alias("order")).unionByName(lines, allowMissingColumns=True).repartitionByRange("nr")

    path = F.concat(F.lit("p"), F.col("line.l_partkey"), F.lit("/s"), F.col("line.l_suppkey"), F.lit("/l"), F.col("line.l_linenumber"), F.lit("-"), F.col("line.cents"), F.lit(".go"))
    returned = F.col("line.returned")
    status = F.when(returned, F.concat(F.lit("R0"), (F.lit(40) + F.pmod("line.l_partkey", F.lit(60))).cast("string"))).otherwise("M")
    raw = F.concat_ws("\x00", F.concat(F.lit(":100644 100644 a b "), status), F.when(returned, F.concat(F.lit("old/"), path)), path)
    counts = F.concat_ws("\t", F.col("line.quantity"), F.col("line.l_linenumber"), F.lit(""))
    numstat = F.when(returned, F.concat_ws("\x00", counts, F.concat(F.lit("old/"), path), path)).otherwise(F.concat(counts, path))
    rows = rows.select("nr", "order", F.when(F.col("line").isNotNull(), F.struct("line.l_linenumber", raw.alias("raw"), numstat.alias("numstat"))).alias("line"))
    rows = rows.groupBy("nr").agg(F.collect_list("order").alias("orders"), F.sort_array(F.collect_list("line")).alias("lines")).select("nr", F.inline("orders"), F.concat("lines.raw", "lines.numstat").alias("items"))
    sha = lambda key: F.md5(key.cast("string"))
    key = F.col("nr")
    parents = F.when(F.col("urgent"), F.concat_ws(" ", sha(key - 1), sha(key - 2))).otherwise(sha(key - 1))
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    who = F.concat(F.lit("c"), F.col("o_custkey"))
    mail = F.concat(who, F.lit("@x.org"))
    head = F.array(sha(key), parents, who, mail, at, who, mail, at, F.concat(F.lit("order "), key), F.lit("body"))
    return rows.select("repo", "segment", "nr", head.alias("head"), "items")


def _folder(s: SparkSession, tag: str) -> str:
    return f"{shared_dir(s)}/{tag}-{uuid.uuid4().hex}"


def _short(sha: str) -> Column:
    """Hexadecimal digits as bytes, half as many for the shuffle of distinct ones; the first byte tells them from other texts."""
    digits = F.unhex(sha)
    return F.when(F.lower(F.hex(digits)) == F.col(sha), F.concat(F.lit(b"h"), digits)).otherwise(F.concat(F.lit(b"t"), F.encode(sha, "utf-8")))


_LOG = """with x as (
  select c_mktsegment as repo, o_orderkey, o_orderdate, o_orderpriority = '1-URGENT' as is_merge, l_returnflag = 'R' as moved, 40 + l_partkey % 60 as likeness, l_quantity, l_linenumber
  from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey),
changes as (
  select repo, o_orderkey, o_orderdate, is_merge, case when not moved then 'M' when likeness >= {similarity} then 'R' else 'A' end as change_type, l_quantity::bigint as insertions, l_linenumber::bigint as deletions from x
  union all select repo, o_orderkey, o_orderdate, is_merge, 'D', 0, 0 from x where moved and likeness < {similarity})"""


@query("log_scan", _LOG.format(similarity=70) + """
select repo, change_type, count(*) as changes, count(distinct o_orderkey) as commits, sum(insertions)::bigint as insertions, sum(deletions)::bigint as deletions from changes where not is_merge group by 1, 2""")
def log_scan(s, d):
    """The orders, exported as a log and read back without merges, renames below 70 % as additions and deletions."""
    folder = _folder(s, "log")
    log_of_orders(s, d, folder)
    rows = read_log(s, folder, rename_similarity=70).select("repo", _short("sha").alias("sha"), F.inline("changes"))
    sums = [F.sum(c).alias(c) for c in ("insertions", "deletions")]
    return rows.groupBy("repo", "change_type").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("sha").alias("commits"), *sums)


@query("log_scan_bounded", _LOG.format(similarity=50) + """
select repo, o_orderkey as commit_id, epoch(o_orderdate)::bigint as committed_at, is_merge, count(*) filter (change_type = 'R') as renames, count(*) as changes
from changes where repo = 'BUILDING' and o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1999-01-01' group by all""")
def log_scan_bounded(s, d):
    """One repository's commits of two years, merges among them: both bounds are pushed into the scan."""
    folder = _folder(s, "log")
    log_of_orders(s, d, folder)
    rows = read_log(s, folder, merges="true").where("repo = 'BUILDING' and committed_at >= '1997-01-01' and committed_at < '1999-01-01' and size(changes) > 0")
    return rows.select("repo", F.substring_index("subject", " ", -1).cast("long").alias("commit_id"), F.unix_timestamp("committed_at").alias("committed_at"), "is_merge", F.size(F.filter("changes", lambda c: c["change_type"] == "R")).cast("long").alias("renames"), F.size("changes").cast("long").alias("changes"))


@query("log_stream", """select c_mktsegment as repo, count(*) as commits, count(distinct o_orderkey) as shas, sum(case when o_orderdate < timestamp '1998-07-01' then 1 else 0 end)::bigint as first_trigger
from orders join customer on o_custkey = c_custkey group by 1""")
def log_stream(s, d):
    """Two triggers over a log that grows between them: each commit comes once, those of the first segment with the first."""
    folder, out, check = (_folder(s, tag) for tag in ("log", "log-table", "log-tips"))
    seen = read_log_batches(s, d, folder, out, check)
    return seen.groupBy("repo").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct(_short("sha")).alias("shas"), F.count_if(F.col("batch") == 0).alias("first_trigger"))


def _move(s: SparkSession, of: str, to: str, segment: int) -> None:
    """Moves a segment of all repositories from one log to another, as a fetch does that puts finished files into place."""
    path = s._jvm.org.apache.hadoop.fs.Path
    store = path(to).getFileSystem(s._jsc.hadoopConfiguration())
    store.mkdirs(path(to))
    for found in store.globStatus(path(f"{of}/repo=*/segment={segment}*")):
        folder = path(f"{to}/{found.getPath().getParent().getName()}")
        store.mkdirs(folder)
        if not store.rename(found.getPath(), path(folder, found.getPath().getName())):
            raise OSError(f"can't move {found.getPath()}")


def read_log_batches(s: SparkSession, d: str, folder: str, out: str, check: str) -> DataFrame:
    late = F.when(F.col("o_orderdate") < F.lit("1998-07-01").cast("timestamp_ntz"), 1).otherwise(2)
    both = _folder(s, "log-both")
    log_of_orders(s, d, both, late)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    for segment in (1, 2):
        _move(s, both, folder, segment)
        run = read_log(s, folder, stream=True, merges="true").select("repo", "sha").writeStream.foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start()
        run.awaitTermination()
    return s.read.parquet(out)


# --- stateful streams -----------------------------------------------------------------------------------------------------

_CALLS = "with calls as (select event_id as id, user_id::varchar as client, epoch_us(ts) // 1000 as at_ms from events), mark as (select max(at_ms) - 3600000 as w from calls)"


def _stored_stream(rows: DataFrame, s: SparkSession, tag: str) -> DataFrame:
    """Runs a stream over what its source holds, to its end, and gives the stored rows."""
    out = _folder(s, tag)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(s, f"{tag}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


@query("idle_runs_stream", _CALLS + """,
next as (select *, lead(at_ms) over (partition by client order by at_ms, id) as following from calls),
ends as (select client, at_ms from next, mark where following - at_ms > 86400000 or (following is null and at_ms + 86400000 <= w)),
spans as (select client as id, at_ms as last_ms, lag(at_ms) over (partition by client order by at_ms) as before from (select distinct * from ends))
select id, last_ms, (select count(*) from calls c where c.client = s.id and c.at_ms <= s.last_ms and (s.before is null or c.at_ms > s.before)) as beats from spans s""")
def idle_runs_stream(s, d):
    """Clients that fell silent for more than a day, as a stream with timers, and their calls since the silence before."""
    from ..streaming.calls import read_calls
    from ..streaming.runs import idle_runs

    return _stored_stream(idle_runs(read_calls(s, d), "client", 24 * 60), s, "idle")


@query("expired_calls_stream", _CALLS + """, x as (select id, ceil((at_ms + 10 * 86400000) / 86400000)::bigint * 86400000 as expired_ms from calls)
select id, expired_ms from x, mark where expired_ms <= w""")
def expired_calls_stream(s, d):
    """Calls that are out of a retention of ten days by the watermark, dropped by timers at the ends of days."""
    from ..streaming.calls import read_calls
    from ..streaming.runs import expired_calls

    return _stored_stream(expired_calls(read_calls(s, d), "client", 10), s, "expired")


# --- incremental state ----------------------------------------------------------------------------------------------------


@query("retracted_pairs", """with commits as (
  select c_mktsegment as repo, o_orderkey as commit_id from orders join customer on o_custkey = c_custkey join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey
  where o_orderstatus <> 'P' and n <= 60 and o_orderpriority <> '5-LOW'),
items as (select distinct repo, commit_id, l_suppkey as f from commits join lineitem on l_orderkey = commit_id)
select x.repo, x.f as a, y.f as b, count(*) as n_ab from items x join items y on x.commit_id = y.commit_id and x.f < y.f group by 1, 2, 3 having count(*) >= 2""")
def retracted_pairs(s, d):
    """Pair counts by signed changes: orders before 1999, then the later ones come and all of low priority go."""
    from ..operators import coupling as c
    from ..sinks import deltas

    rows = c.baskets(roles.changes(s, d), roles.commits(s, d))
    folder, early = _folder(s, "state"), F.col("committed_at") < F.lit("1999-01-01").cast("timestamp")
    low = roles.table(s, d, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("commit_id"))
    gone = rows.join(low, "commit_id", "left_semi").select("repo", "commit_id")
    deltas.apply_changes(s, folder, rows.where(early), gone.limit(0))
    deltas.apply_changes(s, folder, rows.where(~early), gone)
    return deltas.pair_counts(s, folder)


@query("reached_commits", """with recursive o as (
  select o_orderkey as k, n_name as repo, o_orderpriority = '1-URGENT' as merges, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as p1,
    lag(o_orderkey) over (partition by c_nationkey order by o_orderdate, o_orderkey) as p2, lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as n, c_acctbal
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
edges as (select repo, k, p1 as p from o where p1 is not null union select repo, k, p2 from o where merges and p2 is not null),
r as (select repo, k from o where n is null and c_acctbal > 9000 union select e.repo, e.p from r join edges e on e.repo = r.repo and e.k = r.k)
select repo, count(*) as reached, sum(k)::bigint as keys from r group by 1""")
def reached_commits(s, d):
    """Orders whose parent is the customer's order before, urgent ones merging the nation's; what the last orders of rich customers reach."""
    from pyspark.sql import Window

    from ..operators.ancestry import ancestry, reached

    customer = roles.table(s, d, "customer").join(roles.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("repo"), "c_acctbal")
    orders = roles.table(s, d, "orders").join(customer, "o_custkey")
    by = lambda *keys: Window.partitionBy(*keys).orderBy("o_orderdate", "o_orderkey")
    sha = lambda c: c.cast("string")
    rows = orders.select("repo", F.col("o_orderkey").alias("k"), F.lag("o_orderkey").over(by("o_custkey")).alias("p1"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lag("o_orderkey").over(by("repo"))).alias("p2"), F.lead("o_orderkey").over(by("o_custkey")).isNull().alias("last"), "c_acctbal")
    parents = rows.select("repo", sha(F.col("k")).alias("child_sha"), F.posexplode(F.array("p1", "p2")).alias("nr", "p")).where("p is not null").withColumn("parent_sha", sha(F.col("p")))
    tips = rows.where("last and c_acctbal > 9000").select("repo", sha(F.col("k")).alias("sha"))
    found = reached(tips, ancestry(parents))
    return found.groupBy("repo").agg(F.count(F.lit(1)).alias("reached"), F.sum(F.col("sha").cast("long")).alias("keys"))


@query("calls_admitted", """with x as (select surface, length(name || client || round(duration_ms)::bigint::varchar) > 9 as over from (
  select case when event_type in ('view', 'click') then 'http' else 'mcp' end as surface, event_type as name, user_id::varchar as client, value as duration_ms from events))
select surface, count(*) filter (not over) as kept, (select count(*) from x) as seen, (select count(*) from x where over) as dropped from x group by 1""")
def calls_admitted(s, d):
    """The call log with calls above a size refused: what is stored by surface, and the counts of the batches' admission."""
    from ..streaming.calls import append_bounded, read_calls

    out = _folder(s, "calls")
    size = F.length(F.concat("name", "client", F.round("duration_ms").cast("long").cast("string")))
    append_bounded(read_calls(s, d), out, _folder(s, "calls-state"), size, 9).awaitTermination()
    told = s.read.parquet(f"{out}-admission").agg(F.sum("seen").alias("seen"), F.sum("dropped").alias("dropped")).first()
    kept = s.read.parquet(out).groupBy("surface").agg(F.count(F.lit(1)).alias("kept"))
    return kept.withColumns({name: F.lit(told[name]) for name in ("seen", "dropped")})


# --- stored indexes -------------------------------------------------------------------------------------------------------


@query("search_by_trigrams", """select p_partkey as file_id, p_type || '/' || p_brand || '/' || p_name as path from part where contains(lower(p_type || '/' || p_brand || '/' || p_name), '/brand#12/')
union all select p_partkey, p_type || '/' || p_brand || '/' || p_name from part where contains(lower(p_type || '/' || p_brand || '/' || p_name), '7')""")
def search_by_trigrams(s, d):
    """Paths that hold a directory, by its trigrams, and paths that hold a digit, which has none."""
    from ..operators import trigrams

    paths, folder = roles.paths(s, d), _folder(s, "trigrams")
    trigrams.write_index(paths, folder)
    return trigrams.search(paths, folder, "/Brand#12/").unionByName(trigrams.search(paths, folder, "7")).select("file_id", "path")


# --- stages with stored state ---------------------------------------------------------------------------------------------


@query("staged_rebuild", """with commits as (
  select c_mktsegment as repo, o_orderkey as commit_id from orders join customer on o_custkey = c_custkey join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey
  where o_orderstatus <> 'P' and n <= 60 and not (c_mktsegment = 'BUILDING' and o_orderdate >= timestamp '2000-01-01')),
items as (select distinct repo, commit_id, l_suppkey as f from commits join lineitem on l_orderkey = commit_id),
pairs as (select x.repo, x.f as a, y.f as b, count(*) as n_ab from items x join items y on x.commit_id = y.commit_id and x.f < y.f group by 1, 2, 3 having count(*) >= 2)
select repo, count(*) as pairs, sum(n_ab)::bigint as support, 5 as first, 0 as again, case when repo = 'BUILDING' then 1 else 0 end as third from pairs group by 1""")
def staged_rebuild(s, d):
    """Pairs and their sums as stages: all repositories, then nothing, then the one whose baskets of two years went."""
    from ..operators import coupling as c
    from ..sinks.stages import Stage, run_stages

    pairs = Stage("pairs", ("baskets",), lambda inputs, repos: c.pair_counts(inputs["baskets"].join(repos, "repo", "left_semi")))
    sums = Stage("sums", ("pairs",), lambda inputs, repos: inputs["pairs"].join(repos, "repo", "left_semi").groupBy("repo").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n_ab").alias("support")))
    rows, folder = c.baskets(roles.changes(s, d), roles.commits(s, d)), _folder(s, "stages")
    first = run_stages(s, folder, [pairs, sums], {"baskets": rows})
    again = run_stages(s, folder, [pairs, sums], {"baskets": rows})
    less = rows.where(~((F.col("repo") == "BUILDING") & (F.col("committed_at") >= F.lit("2000-01-01").cast("timestamp"))))
    third = run_stages(s, folder, [pairs, sums], {"baskets": less})
    told = F.when(F.col("repo") == "BUILDING", F.lit(third["sums"])).otherwise(0)
    return s.read.parquet(f"{folder}/sums").select("repo", "pairs", "support", F.lit(first["sums"]).alias("first"), F.lit(again["pairs"] + again["sums"]).alias("again"), told.alias("third"))


# --- identity through renames ---------------------------------------------------------------------------------------------


@query("file_identities", """with recursive c as (
  select distinct c_mktsegment as repo, l_orderkey * 10000000 + l_partkey * 100 + l_suppkey % 100 as nr, 'p' || l_partkey as path, case when l_suppkey % 5 = 0 then 'p' || ((l_partkey * 7 + l_suppkey % 100) % 1999) end as old
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
f as (select repo, path, min(nr) as nr, arg_min_null(old, nr) as old from c group by 1, 2),
up as (select f.repo, f.path, o.path as older from f join f o on o.repo = f.repo and o.path = f.old where f.old <> f.path and o.nr < f.nr),
chain as (select repo, path, path as file from f where not exists (select 1 from up where up.repo = f.repo and up.path = f.path) union all select up.repo, up.path, chain.file from up join chain on chain.repo = up.repo and chain.path = up.older)
select c.repo, file, count(*) as changes, count(distinct c.path) as paths from c join chain using (repo, path) group by 1, 2""")
def file_identities(s, d):
    """Lines as changes of parts, those of every fifth supplier as renames from another part: changes and paths of each file."""
    from ..sinks.tables import file_identity

    lines = roles.table(s, d, "lineitem").join(roles.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(roles.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    old = F.expr("case when l_suppkey % 5 = 0 then concat('p', (l_partkey * 7 + l_suppkey % 100) % 1999) end")
    nr = F.expr("l_orderkey * 10000000 + l_partkey * 100 + l_suppkey % 100")
    rows = lines.select(F.col("c_mktsegment").alias("repo"), nr.alias("nr"), F.concat(F.lit("p"), "l_partkey").alias("path"), old.alias("old_path")).distinct()
    found = file_identity(rows)
    return found.groupBy("repo", "file").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("path").alias("paths"))
