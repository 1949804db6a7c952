"""License notices in whole texts by an exact set-similarity join, with DataFrame functions only.

Text blocks are stretches of 2 * HOP words that begin at every HOP-th word, so that any HOP words in a row stand
together in one. A block holds a notice when it has at least percent % of the notice's distinct words; a phrase, which
needs all of its words, moreover where they stand consecutively.

The join: the words of all templates are ordered by how often they occur in all documents, rare ones first. A block
that has need of the m words of a template has one of the template's m - need + 1 rarest (its prefix). Only blocks with
some prefix word leave the scan of the documents. They meet the templates by that word, in a broadcast hash join with
the prefixes (bounded by the templates, which are a parameter). Pairs fall where the block has too few words of
templates at all (length), or where too few words come after this one in the order, in the template or the block
(position). A pair is met at the first prefix word that both have and at no other, so that it comes once; its overlap
is then counted in full.

Documents are not shuffled: what leaves the scan is a row for each document with those blocks. That row has a number
and is stored, so that blocks find back to their document when ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

#: A word is a maximal run of a-z, 0-9 and characters beyond ASCII, of the lower-cased text.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HOP = 32
PERCENT = 90

#: Phrases and their labels. Fixed values.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)

#: Labels and notices: sentences that publicly known licenses ask to be put into texts, or that they begin with. Fixed values.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl", "made available under the terms of the eclipse public license"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
)


class _Template(NamedTuple):
    label: str
    words: list[str]
    phrase: bool
    need: int


def _templates(templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]], percent: int, hop: int) -> list[_Template]:
    rows = []
    for phrase, pairs in ((False, templates), (True, phrases)):
        for label, text in pairs:
            words = text.split(" ")
            if not text or len(words) > hop:
                raise ValueError(f"a template has 1 to {hop} words: {text!r}")
            m = len(set(words))
            rows.append(_Template(label, words, phrase, m if phrase else -(-percent * m // 100)))
    return rows


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(LICENSE_WORD), F.lit(0))


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def frequency_order(docs: DataFrame, words: Sequence[str]) -> list[str]:
    """These words by their number of occurrences in all docs (text), rare ones first, then by code points."""
    seen = docs.select(F.explode(_words(F.col("text"))).alias("word")).where(F.col("word").isin(*words)).groupBy("word").count()
    counts = dict(seen.collect())  # at most as many rows as words
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, percent: int = PERCENT, hop: int = HOP) -> DataFrame:
    """(doc_id, n_words, places, notices) of docs (doc_id, text), a row for each row of docs.

    places has (label, start, words) for each place where a phrase's words stand consecutively, by start and label;
    notices has (start, label, template, containment) for each block that begins at word start and holds at least
    percent % of the distinct words of that template, words counted from 0. Templates and phrases are lower-case words
    separated by single blanks, at most hop of them.

    Null, empty and wordless texts have no words, places or notices. Null ids stay, repeated rows give a row each,
    other columns are ignored whatever their names, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = _templates(templates, phrases, percent, hop)
    order = frequency_order(docs, sorted({w for t in rows for w in t.words}))
    rank = {w: k for k, w in enumerate(order)}
    index = []
    for k, t in enumerate(rows):
        tokens = sorted(set(t.words), key=rank.__getitem__)
        for i, token in enumerate(tokens[: len(tokens) - t.need + 1]):
            index.append((token, k, t.label, t.phrase, " ".join(t.words), t.words, tokens, i, t.need))
    prefix = sorted({row[0] for row in index})
    schema = "token string, template int, label string, is_phrase boolean, wording string, sequence array<string>, tokens array<string>, i int, need int"
    index = F.broadcast(spark.createDataFrame(index, schema))

    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("words"))
    hits = F.filter(F.transform("words", lambda w, i: F.when(w.isin(*prefix), F.floor(i / hop).cast("int"))), lambda b: b.isNotNull())
    scanned = scanned.withColumn("hits", F.array_distinct(hits))
    blocks = F.array_distinct(F.concat("hits", F.filter(F.transform("hits", lambda b: b - 1), lambda b: b >= 0)))
    blocks = F.transform(blocks, lambda b: F.struct(b.alias("block"), F.slice("words", b * hop + 1, 2 * hop).alias("words")))
    facts = scanned.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), blocks.alias("blocks"))
    facts = materialise(facts, "license-blocks")

    blocks = facts.select("row", F.inline("blocks")).withColumn("own", F.array_intersect(_strings(order), "words"))
    met = blocks.select("row", "block", "words", "own", F.posexplode("own").alias("j", "token")).join(index, "token")
    left = F.least(F.size("tokens") - F.col("i"), F.size("own") - F.col("j"))
    met = met.where((F.size("own") >= F.col("need")) & (left >= F.col("need")))
    met = met.where(~F.arrays_overlap(F.slice("tokens", F.lit(1), F.col("i")), "own"))
    overlap = F.size(F.array_intersect("tokens", "own"))
    met = met.withColumn("overlap", overlap).where("overlap >= need")
    start = F.col("block").cast("long") * hop
    found = F.filter(F.sequence(F.lit(0), F.lit(hop - 1)), lambda p: F.slice("words", p + 1, F.size("sequence")) == F.col("sequence"))
    place = lambda p: F.struct((start + p).alias("start"), F.col("label").alias("label"), F.col("wording").alias("words"))
    notice = F.struct(start.alias("start"), "label", F.col("wording").alias("template"), (F.col("overlap") / F.size("tokens")).alias("containment"))
    met = met.select("row", F.when(F.col("is_phrase"), F.transform(found, place)).alias("places"), F.when(~F.col("is_phrase"), notice).alias("notice"))
    met = met.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"), F.array_sort(F.collect_list("notice")).alias("notices"))
    out = facts.drop("blocks").join(met, "row", "left")
    none = lambda name: F.coalesce(name, F.slice(F.array(F.expr(_EMPTY[name])), 1, 0)).alias(name)
    return out.select("doc_id", "n_words", none("places"), none("notices"))


#: A value of the element type, of which an empty array is made.
_EMPTY = {
    "places": "named_struct('start', 0L, 'label', '', 'words', '')",
    "notices": "named_struct('start', 0L, 'label', '', 'template', '', 'containment', 0d)",
}


def summary(found: DataFrame) -> DataFrame:
    """One row of figures for each document of what scan_licenses() gives.

    score is 1 where a phrase stands, else the greatest containment of a notice, else 0.
    """
    base = F.array_distinct(F.col("places.label"))
    both = F.array_distinct(F.concat(F.col("places.label"), F.col("notices.label")))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("notices.containment"), F.lit(0.0))).alias("score"),
    )


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return summary(scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: Every block against every template; the templates are the join's input, and so are the same here.
OP13_SQL = rf"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
templates as (select label, list_distinct(string_split(wording, ' ')) as tokens from (values {", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)}) as t (label, wording)),
blocks as (select doc_id, list_distinct(words[b * 32 + 1:b * 32 + 64]) as own from (select doc_id, words, unnest(range(0, (len(words) + 31) // 32)) as b from d)),
met as (select doc_id, label, len(list_intersect(tokens, own)) as overlap, len(tokens) as m from blocks, templates where 100 * len(list_intersect(tokens, own)) >= 90 * len(tokens)),
phrases as (select * from (values ('mit', ['mit', 'license']), ('apache', ['apache', 'license']), ('gpl', ['general', 'public', 'license'])) as p (label, w)),
spots as (select doc_id, words, unnest(range(0, len(words))) as i from d where list_contains(words, 'license')),
places as (select doc_id, i, label from spots, phrases where words[i + 1] = w[1] and words[i + 1:i + len(w)] = w),
base as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from places group by doc_id),
labelled as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from places union all select doc_id, label from met) group by doc_id),
best as (select doc_id, max(overlap / m) as score from met group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(score, 0)::double end as score
from d left join base using (doc_id) left join labelled using (doc_id) left join best using (doc_id)
"""
