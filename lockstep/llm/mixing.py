"""Mixing sources to target weights, with DataFrame functions only.

The words of each source form one stream, cut into blocks of block_words. Output shards of shard_slots slots draw
multinomial source counts: each slot draws its source from the targets by a seeded hash. The counts of all shards
are then held to the sources' quotas: slots that a source has drawn beyond its quota go to the sources that have
drawn too few, in shard order. The i-th slot of a source, counted over the shards, maps to block perm(i) of the
source, where perm is a swap-or-not shuffle, a pseudorandom permutation of exactly the block numbers that needs
no state; beyond the last block the next permutation begins. Blocks are joined with documents by index. A block is
visited at most max_repeat times and no slot is dropped, so taken words come within about a block of each target.

Stream positions come from sums over hash buckets of each source, so that a source with a third of all documents
is spread over many tasks. The table of sources (one row each) is the only thing ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, materialise

WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 16
BINS = 4096
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 16
SEED = 20240131
_BEFORE = (Window.unboundedPreceding, -1)


class Mix(NamedTuple):
    """sources: a row each with its target and quota; documents: what is taken of each; slots: shard, source_key, block, epoch."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_REGEX)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: equal sources, null included, have equal keys."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def unit(*cols: Column) -> Column:
    """A pseudorandom number in [0, 1) of these columns."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def permuted(index: Column, size: Column, key: Column) -> Column:
    """Where the pseudorandom permutation of 0..size-1 named key takes index: the swap-or-not shuffle."""

    def swap_or_not(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        return F.when(F.xxhash64(key, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap_or_not)


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, factor: float = 1.5, max_repeat: float = 2.0) -> DataFrame:
    """Adds pos, weight and target to rows of (source, source_size).

    Sources in code-point order, null last, weigh weights in turn. Together they are to give factor times all
    words; no target is above max_repeat times its source's size, and what is above goes to the others by weight.
    That is target = min(cap, level * weight), where level is the largest of (total - caps before) / (weights from
    here on) over the sources in order of cap / weight.
    """
    every, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("pos", F.row_number().over(by_name).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("pos") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = rows.withColumns({"weight": w, "cap": F.col("source_size") * F.lit(float(max_repeat)), "total": F.sum("source_size").over(every) * F.lit(float(factor))})
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "pos").rowsBetween(*_BEFORE)
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    rows = rows.withColumn("own", (F.col("total") - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))) / F.greatest(left, F.lit(1e-12)))
    return rows.withColumn("target", F.least("cap", F.max("own").over(every) * F.col("weight"))).drop("cap", "own", "total")


def _allocated(sources: DataFrame, n_sources: int, n_slots: int, shard_slots: int, seed: int, tasks: int) -> DataFrame:
    """(shard, source_key, start, n): multinomial counts by shard, held to the quotas; start counts a source's earlier slots."""
    spark = sources.sparkSession
    by_pos = Window.orderBy("pos")
    share = F.sum("target").over(by_pos) / F.sum("target").over(Window.partitionBy())
    ends = sources.withColumn("hi", F.when(F.lead("pos").over(by_pos).isNull(), F.lit(1.0)).otherwise(share))
    ends = ends.withColumn("lo", F.coalesce(F.lag("hi").over(by_pos), F.lit(0.0))).where("hi > lo")
    bins = ends.select("source_key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS), F.least(F.floor(F.col("hi") * BINS), F.lit(BINS - 1)))).alias("bin"))
    if n_sources <= 1 << 16:  # then bins has at most BINS + 2 * 65536 rows
        bins = F.broadcast(bins)
    slots = spark.range(0, n_slots, 1, tasks).select(F.floor(F.col("id") / shard_slots).alias("shard"), unit(F.lit(seed), F.col("id")).alias("u"))
    drawn = slots.withColumn("bin", F.floor(F.col("u") * BINS)).join(bins, "bin").where("u >= lo and u < hi").groupBy("shard", "source_key").count()
    by_shard = Window.partitionBy("source_key").orderBy("shard").rowsBetween(*_BEFORE)
    held = drawn.join(sources.select("source_key", "pos", "quota"), "source_key").withColumn("before", F.coalesce(F.sum("count").over(by_shard), F.lit(0)))
    held = materialise(held.withColumn("kept", F.greatest(F.lit(0).cast("long"), F.least(F.col("count"), F.col("quota") - F.col("before")))), "draws")

    def units(rows: DataFrame, order: str, n: str) -> DataFrame:
        start = F.coalesce(F.sum(n).over(Window.orderBy(order).rowsBetween(*_BEFORE)), F.lit(0))
        rows = rows.withColumn("from", start).where(F.col(n) > 0)
        return rows.withColumn("unit", F.explode(F.sequence(F.col("from"), F.col("from") + F.col(n) - 1))).drop(n, "from")

    spare = units(held.groupBy("shard").agg(F.sum(F.col("count") - F.col("kept")).alias("spare")), "shard", "spare")
    kept = held.groupBy("source_key").agg(F.sum("kept").alias("kept"))
    short = sources.select("source_key", "pos", "quota").join(kept, "source_key", "left")
    short = units(short.select("source_key", "pos", (F.col("quota") - F.coalesce("kept", F.lit(0))).alias("short")), "pos", "short")
    moved = spare.join(short, "unit").groupBy("shard", "source_key").count()
    total = held.select("shard", "source_key", F.col("kept").alias("n")).unionByName(moved.withColumnRenamed("count", "n"))
    total = total.groupBy("shard", "source_key").agg(F.sum("n").alias("n")).where("n > 0")
    return total.withColumn("start", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, factor: float = 1.5, max_repeat: float = 2.0, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, segments: bool = False) -> Mix:
    """Mixes docs (doc_id, text, source) to target weights; see with_targets() and the module's text.

    documents has doc_id, source, size (words of the text; 0 for a null or blank one), source_size, target (its
    source's), taken (words the mix takes, repeats counted, at most max_repeat times size) and, if asked for,
    segments: an array of (start, length, times) in words, in text order. Equal rows stay apart: each is a document
    with its own place in the stream. A null source is a source of its own, null ids are kept, and empty docs give
    empty results. Other columns are ignored. The result is a function of docs and seed.
    """
    spark = docs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sizes = materialise(docs.select("doc_id", "source", source_key(F.col("source")).alias("source_key"), n_words(F.col("text")).alias("size")), "sizes")
    sums = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = with_targets(sums, weights, factor, max_repeat)
    sources = sources.withColumn("n_blocks", F.ceil(F.col("source_size") / block_words))
    quota = F.round(F.col("target") * F.col("n_blocks") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    sources = materialise(sources.withColumn("quota", F.least(quota, F.floor(F.col("n_blocks") * F.lit(float(max_repeat))))), "sources")
    n_sources, n_docs, n_slots = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("quota"), F.lit(0))).first()
    tasks = max(tasks, n_slots // 500_000)

    alloc = materialise(_allocated(sources, n_sources, n_slots, shard_slots, seed, tasks), "alloc").repartition(tasks, "shard", "source_key")
    slots = alloc.select("shard", "source_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("i"))
    small = F.broadcast if n_sources <= 1 << 16 else lambda x: x
    slots = slots.join(small(sources.select("source_key", "n_blocks")), "source_key").withColumn("epoch", F.floor(F.col("i") / F.col("n_blocks")))
    block = permuted(F.pmod(F.col("i"), F.col("n_blocks")), F.col("n_blocks"), F.xxhash64(F.lit(seed), F.col("source_key"), F.col("epoch")))
    slots = slots.select("shard", "source_key", "epoch", block.alias("block"))

    n_buckets = max(1, n_docs // 256)
    placed = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(n_buckets)))
    base = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    base = base.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("source_key").orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0))).drop("words")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("source_key", "bucket").orderBy("doc_id", "size").rowsBetween(*_BEFORE)), F.lit(0))
    placed = placed.withColumn("inside", inside).join(base, ["source_key", "bucket"]).withColumn("offset", F.col("base") + F.col("inside"))
    first, last = F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("size") - 1) / block_words)
    blocks = F.when(F.col("size") > 0, F.sequence(first, last)).otherwise(F.array(F.lit(-1).cast("long")))
    parts = placed.select("source_key", "doc_id", "source", "size", "offset", F.explode(blocks).alias("block"))
    takes = slots.groupBy("source_key", "block").agg(F.count(F.lit(1)).alias("times"))
    start = F.greatest(F.col("offset"), F.col("block") * block_words)
    length = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block_words) - start
    parts = parts.join(takes, ["source_key", "block"], "left").withColumns({"start": start - F.col("offset"), "length": length, "times": F.coalesce("times", F.lit(0))})
    keep = [F.sum(F.when(F.col("times") > 0, F.col("length") * F.col("times")).otherwise(0)).alias("taken")]
    if segments:
        keep.append(F.array_sort(F.collect_list(F.when(F.col("times") > 0, F.struct("start", "length", "times")))).alias("segments"))
    out = parts.groupBy("source_key", "doc_id", "source", "size", "offset").agg(*keep)
    out = out.join(small(sources.select("source_key", "source_size", "target")), "source_key").drop("source_key" if not segments else "")
    return Mix(sources, out, slots)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each text replaced by the words that the mix takes of it; rows of which it takes none go.

    A document that is taken whole keeps its text as it is, once or, with a line break between, several times;
    of others the taken words stay, in order and with repeats, joined by single spaces. n_chars, where docs has it,
    is the new text's length; all other columns stay, whatever their names.
    """
    own = "_mix"
    while any(c.lower().startswith(own) for c in docs.columns):
        own = f"_{own}"
    key = ["source_key", "doc_id", "size", "nth"]
    name = {k: f"{own}_{k}" for k in [*key, "words", "segments"]} | {f"of {k}": f"{own}_of_{k}" for k in key}
    mixed = mix_sources(docs, segments=True, **options).documents
    nth = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    mixed = mixed.where("taken > 0").withColumn("nth", nth(key[:3], "offset")).select(*[F.col(k).alias(name[f"of {k}"]) for k in key], F.col("segments").alias(name["segments"]))
    rows = docs.withColumns({name["source_key"]: source_key(F.col("source")), name["doc_id"]: F.col("doc_id"), name["size"]: n_words(F.col("text"))})
    rows = rows.withColumn(name["nth"], nth([name[k] for k in key[:3]], "text"))
    segments = F.col(name["segments"])
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD_REGEX), F.lit(0))
    times = F.transform(segments, lambda s: s["times"])
    whole = (F.aggregate(segments, F.lit(0).cast("long"), lambda n, s: n + s["length"]) == F.col(name["size"])) & (F.array_max(times) == F.array_min(times))
    some = F.flatten(F.transform(segments, lambda s: F.flatten(F.array_repeat(F.slice(F.col(name["words"]), (s["start"] + 1).cast("int"), s["length"].cast("int")), s["times"].cast("int")))))
    rows = rows.join(mixed, [rows[name[k]].eqNullSafe(mixed[name[f"of {k}"]]) for k in key]).withColumn(name["words"], F.when(~whole, words))
    text = F.when(whole, F.array_join(F.array_repeat(F.col("text"), F.array_max(times).cast("int")), "\n")).otherwise(F.array_join(some, " "))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).documents.select("doc_id", "size", "source_size", "target", "taken")
