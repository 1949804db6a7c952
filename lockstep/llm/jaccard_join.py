"""N-gram Jaccard join with a token-group matrix: exact links between documents, and their connected components.

A document's tokens are 64-bit hashes of its distinct word shingles; equal sets form one class.

1. Most documents are linked with nothing, and signatures tell: sets that link differ in at most H tokens, so of
   H + x + 1 ranges of token values at least x + 1 hold the same tokens in both. A document stays only if so many of
   its ranges are met elsewhere. Ranges are cut alike for sets of similar sizes.
2. Sets of those that stay get one global order of tokens, rare ones first, by exact counts. Sets that link share a
   token among the first n - ceil(t n) + 1 of each, and its places tell how many more they can share.
3. For each such token the sets are compared with at most three of its sets, a linear number of pairs: this joins
   families of copies into groups of similar documents.
4. Groups are dealt into sub-groups of sets of one size, about MEMBERS each. The token-group matrix holds the union of a
   sub-group's tokens as rows (sub-group, token). A set that shares a first token with a sub-group of another
   group is a candidate; the matrix bounds what any member can share with it, |Q and union|, and the sub-group is
   opened only if the bound and the size allow a link. Only members of opened ones are compared.

No link between components is lost, while pairs inside a family are not expanded. Components come from alternating
large-star and small-star steps over stored tables; nothing is collected to the driver. Tokens are equal by their 64-bit
hashes and sets by 128-bit sums of them, so results are exact up to collisions of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, discard, document_words, grouped_texts, materialise, mix64
from .url_filter import with_possible

MEMBERS = 64
GROUP_TOKENS = 500_000
_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Classes of sizes for the signatures: each begins at 1.5 times the one before.
_FIRSTS = [1]
while _FIRSTS[-1] < 1 << 40:
    _FIRSTS.append(max(_FIRSTS[-1] + 1, -(-3 * _FIRSTS[-1] // 2)))
_CLASSES = 128


def token_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with fewer words has its whole sequence as one."""
    assert 1 <= words <= len(_MULTIPLIERS)
    hashes, heads = document_words(texts)
    n = len(hashes) - words + 1
    long_ = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        long_ += hashes[k : k + n] * _MULTIPLIERS[k]
    long_ = mix64(long_)
    out = []
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(long_[a : b - words + 1]))
        elif b > a:
            out.append(mix64((hashes[a:b] * _MULTIPLIERS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sums(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and 128-bit sums of sets."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    s1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
    s2 = np.array([mix64(x ^ _SALT).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
    return n, s1, s2


def _facts(words: int):
    """(doc_id, n, s1, s2) of each document."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, texts in grouped_texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *map(pa.array, _sums(token_sets(texts, words)))], names=["doc_id", "n", "s1", "s2"])

    return run


def _full_sets(words: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, texts in grouped_texts(batch.column(1)):
                sets = token_sets(texts, words)
                tokens = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *map(pa.array, _sums(sets)), tokens], names=["doc_id", "n", "s1", "s2", "tokens"])

    return run


def differences(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each class of sizes: in how many tokens sets up to its largest can differ and link, and the number of ranges."""
    largest = np.array(_FIRSTS[1:], np.int64) - 1
    most = 2 * (100 - percent) * largest // (100 + percent)
    return most, np.where(most > 0, most + 1 + -(-most // 5), 0)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set's number, class of sizes, signature) for each range of the sets' tokens.

    A set has those of the classes that a set of its size up to 100 / percent times its size can be in.
    """
    _, ranges = differences(percent)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    firsts = np.array(_FIRSTS, np.int64)
    own = np.searchsorted(firsts, sizes, side="right") - 1
    tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    mixed = mix64(tokens ^ _SALT)
    out, step = [], 0
    while True:
        kind = own + step
        asked = (sizes > 0) & ((step == 0) | (firsts[kind] * percent <= sizes * 100))
        if not asked.any():
            return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))
        m = np.where(asked, ranges[kind], 0)
        used = m[of] > 0
        place = (tokens[used] >> np.uint64(32)) * m[of[used]].astype(np.uint64) >> np.uint64(32)
        heads = np.concatenate([[0], np.cumsum(m)])
        # a set's tokens are sorted, so those of a range lie together
        ends = np.cumsum(np.bincount(heads[of[used]] + place.astype(np.int64), minlength=heads[-1]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed[used], dtype=np.uint64)])[np.concatenate([[0], ends])]
        who = np.repeat(np.arange(len(sets)), m)
        number = (np.arange(heads[-1]) - heads[who]).astype(np.uint64)
        out.append((who, kind[who], mix64(np.diff(sums) + number * _STEP + mix64(kind[who].astype(np.uint64)))))
        step += 1


def _signed(words: int, percent: int):
    """(sig, doc_id, tag): signatures, each once for a group of texts; equal sets of one task appear once.

    tag = class + _CLASSES * what the row counts for when its signature is met elsewhere: 1, or 0 where it was met within the
    group. What a document met within the group is one row more, -(class + _CLASSES * number), of a signature of its own.
    """

    def told(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        who, kind, sig = signatures(sets, percent)
        docs = np.array(ids, np.int64)
        _, at, where, times = np.unique(sig, return_index=True, return_inverse=True, return_counts=True)
        met = times[where] > 1
        pair, number = np.unique(who[met] * _CLASSES + kind[met], return_counts=True)
        own = mix64(docs[pair // _CLASSES].view(np.uint64) * _STEP + pair.astype(np.uint64))
        sigs = np.concatenate([sig[at], own])
        tags = np.concatenate([kind[at] + _CLASSES * (times == 1), -(pair % _CLASSES + _CLASSES * number)])
        docs = np.concatenate([docs[who[at]], docs[pair // _CLASSES]])
        return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(docs), pa.array(tags.astype(np.int64))], names=["sig", "doc_id", "tag"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        ids, sets, held = [], [], 0
        for batch in rows:
            for first, texts in grouped_texts(batch.column(1)):
                for doc_id, tokens in zip(batch.column(0).slice(first, len(texts)).to_pylist(), token_sets(texts, words), strict=True):
                    mark = tokens.sum(dtype=np.uint64).tobytes() + mix64(tokens).sum(dtype=np.uint64).tobytes()
                    if not len(tokens) or mark in known:
                        continue
                    if len(known) < 1_000_000:
                        known.add(mark)
                    ids.append(doc_id)
                    sets.append(tokens)
                    held += len(tokens)
                    if held >= GROUP_TOKENS:
                        yield told(ids, sets)
                        ids, sets, held = [], [], 0
        if sets:
            yield told(ids, sets)

    return run


def _possible(known: DataFrame, words: int, percent: int) -> DataFrame:
    """The ids of documents that can have a link to another set; of equal sets at least one."""
    most, ranges = differences(percent)
    needed = F.array(*(F.lit(int(r - m)) for m, r in zip(most, ranges, strict=True)))
    rows = known.mapInArrow(_signed(words, percent), "sig long, doc_id long, tag long")
    rows = rows.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("sig"))).where("tag < 0 or times > 1")
    size = F.abs("tag")
    met = rows.groupBy("doc_id", (size % _CLASSES).cast("int").alias("kind")).agg(F.sum(F.floor(size / _CLASSES)).alias("met"))
    return met.where(F.col("met") >= F.element_at(needed, F.col("kind") + 1)).select("doc_id").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b), by alternating large-star and small-star until they stand still.

    component is the smallest node reachable. Every step is a stored table. Nodes without an edge to another
    don't appear; nulls and loops count for nothing.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        print_ = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if print_ == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = print_
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large.where("u <> v"), "large")
        discard(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = materialise(small.distinct(), "small")
        discard(large)


def _allowed(n: str, left: str, n2: str, left2: str, percent: int) -> Column:
    """Whether sets of sizes n and n2 can link whose first common token leaves so many tokens, itself included."""
    sizes = F.least(n, n2) * 100 >= F.greatest(n, n2) * percent
    return sizes & (F.least(left, left2) * (100 + percent) >= (F.col(n) + F.col(n2)) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) of keys whose sets link, as pairs of ids."""
    left = sets.select(F.col("key").alias("a"), F.col("doc_id").alias("ia"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("key").alias("b"), F.col("doc_id").alias("ib"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    linked = (both > 0) & (both * 100 >= (F.col("na") + F.col("nb") - both) * percent)
    return materialise(pairs.join(left, "a").join(right, "b").where(linked).select(F.col("ia").alias("a"), F.col("ib").alias("b")).distinct(), tag)


def _sets(known: DataFrame, facts: DataFrame, words: int, percent: int) -> DataFrame:
    """(key, doc_id, n, tokens): the stored sets that can link, each once; key is one half of the set's sum."""
    ids = materialise(_possible(known, words, percent), "possible")
    chosen = facts.join(ids, "doc_id", "left_semi").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    chosen = materialise(chosen, "chosen")
    # a Bloom filter spares the texts of most others a shuffle
    near = with_possible(known.withColumn("canonical", F.col("doc_id")), chosen.withColumnRenamed("doc_id", "canonical")).where("possible")
    near = near.join(chosen, "doc_id", "left_semi").select("doc_id", "text")
    sets = near.mapInArrow(_full_sets(words), "doc_id long, n long, s1 long, s2 long, tokens array<long>").where("n > 0")
    sets = materialise(sets.dropDuplicates(["s1", "s2"]).select(F.col("s1").alias("key"), "doc_id", "n", "tokens"), "sets")
    discard(ids)
    discard(chosen)
    return sets


def _first_tokens(sets: DataFrame, percent: int) -> DataFrame:
    """(key, n, alone, token, left): the first tokens of each set, but for the alone ones that no other has; left: tokens from there on."""
    spread = sets.select("key", "n", F.explode("tokens").alias("token"))
    times = spread.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = spread.join(times, "token").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    shared = shared.select("key", "n", alone.alias("alone"), F.slice("shared", F.lit(1), F.greatest(first - alone, F.lit(0)).cast("int")).alias("shared"))
    return shared.select("key", "n", "alone", F.posexplode("shared").alias("pos", "s")).select("key", "n", "alone", F.col("s.token").alias("token"), (F.col("n") - F.col("alone") - F.col("pos")).alias("left"))


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text).

    Texts link when 100 |A and B| >= percent |A or B| over their distinct shingles of words words (A-Z in lower
    case, words divided by ASCII blanks; a text with fewer words has one shingle, its whole sequence). component_id
    is the smallest id reachable by links, the own one included. A text without words, or null, links with nothing.
    Repeated rows stay, a result each, and rows of one id count as one node with all their links. A null id has a
    null component. Other columns are ignored; an empty table gives an empty one. percent is from 1 to 100.
    """
    batches(docs.sparkSession, 500)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where("doc_id is not null")
    facts = materialise(rows.mapInArrow(_facts(words), "doc_id long, n long, s1 long, s2 long"), "facts")
    same = facts.where("n > 0 and doc_id is not null")
    sets = _sets(known, same, words, percent)
    met = materialise(_first_tokens(sets, percent), "met")

    # the set with the smallest share of tokens of its own is nearest to all others; two more make chains rarer
    one, near = F.struct("key", "n", "left"), F.struct(F.col("alone") / F.col("n"), "key")
    leads = met.groupBy("token").agg(F.min_by(one, near).alias("x"), F.min(one).alias("y"), F.max(one).alias("z")).where("y.key <> z.key")
    leads = leads.select("token", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("l")).select("token", F.col("l.key").alias("b"), F.col("l.n").alias("nb"), F.col("l.left").alias("lb"))
    star = met.join(leads, "token").where((F.col("key") != F.col("b")) & _allowed("n", "left", "nb", "lb", percent))
    star = materialise(star.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct(), "star")
    links = _verified(star, sets, percent, "star-links")
    equal = same.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    equal = materialise(same.join(equal, ["s1", "s2", "n"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b"), "equal")
    grouped = components(links.unionByName(equal))

    # groups of more than MEMBERS sets of one size are dealt into sub-groups
    members = sets.select("key", "doc_id", "n").join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "n", F.coalesce("component", "doc_id").alias("gid"))
    sized = members.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("of_size"))
    whole = sized.groupBy("gid").agg(F.sum("of_size").alias("own"))
    dealt = F.xxhash64("gid", "n", F.pmod(F.xxhash64("key"), F.ceil(F.col("of_size") / MEMBERS)))
    members = materialise(members.join(sized.join(whole, "gid"), ["gid", "n"]).select("key", "n", "gid", "own", dealt.alias("sub")), "members")
    placed = met.join(members.select("key", "gid", "own", "sub"), "key")
    mixed = placed.groupBy("token").agg(F.min("gid").alias("g0"), F.max("gid").alias("g1")).where("g0 <> g1").select("token")
    placed = materialise(placed.join(mixed, "token", "left_semi"), "placed")
    columns = placed.groupBy("token", F.col("sub").alias("s"), F.col("gid").alias("g"), F.col("own").alias("size"), F.col("n").alias("m")).agg(F.max("left").alias("rest"))
    smaller = (F.col("own") < F.col("size")) | ((F.col("own") == F.col("size")) & (F.col("gid") < F.col("g")))
    wanted = placed.join(columns, "token").where((F.col("gid") != F.col("g")) & smaller & _allowed("n", "left", "m", "rest", percent))
    wanted = materialise(wanted.select("key", "n", "s", "m").distinct(), "candidates")

    matrix = sets.join(members.select("key", F.col("sub").alias("s")), "key").join(wanted.select("s").distinct(), "s", "left_semi")
    matrix = matrix.select("s", F.explode("tokens").alias("token")).distinct()
    asked = wanted.join(sets.select("key", "tokens"), "key").select("key", "n", "s", "m", F.explode("tokens").alias("token"))
    bound = asked.join(matrix, ["s", "token"]).groupBy("key", "n", "s", "m").agg(F.count(F.lit(1)).alias("most"))
    opened = materialise(bound.where((F.col("most") * (100 + percent) >= (F.col("n") + F.col("m")) * percent)).select("key", "s"), "opened")

    asking = opened.join(placed.select("key", "n", "token", "left"), "key")
    inside = placed.select("token", F.col("sub").alias("s"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    rest = asking.join(inside, ["token", "s"]).where(_allowed("n", "left", "nb", "lb", percent))
    rest = rest.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    found = _verified(rest, sets, percent, "found")
    for done in (sets, met, star, members, placed, wanted, opened):
        discard(done)
    grouped = components(links.unionByName(equal).unionByName(found))
    out = facts.join(grouped, facts["doc_id"] == grouped["node"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without all but the document of smallest id of each component; of rows that repeat an id and text one stays."""
    first = jaccard_groups(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).join(first, "doc_id", "left_semi")
    return kept.unionByName(docs.where("doc_id is null")).select(*docs.columns)


def op2_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


OP2_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingled as (
  select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
                                    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from worded),
tokens as (select doc_id, len(s) as n, unnest(s) as t from shingled),
links as (
  select a.doc_id as a, b.doc_id as b
  from tokens a join tokens b on a.t = b.t and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach as (select doc_id, doc_id as other from documents union select reach.doc_id, links.b from reach join links on reach.other = links.a)
select shingled.doc_id, len(shingled.s)::bigint as n_shingles, min(reach.other) as component_id
from shingled join reach on reach.doc_id = shingled.doc_id
group by shingled.doc_id, len(shingled.s)"""
