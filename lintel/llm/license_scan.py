"""License scans by diagonal voting.

All rolling word k-grams of all texts are joined with the k-grams of a fixed set of templates.  A hit
at word ``p`` of a text and word ``q`` of a template votes for the diagonal ``p - q``.  Votes are
counted per diagonal, neighbouring diagonals are merged (a few words more or less in the text), and
the merged span must hold most of the template's k-grams.  Only DataFrame functions are used; the
template side is a constant of a few hundred rows and is broadcast, so nothing but hits is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.llm.common import ascii_lower, table, whole_text

K = 3
#: Diagonals at most so many words apart belong to one span.
GAP = 2
#: A template counts as found if a span holds so much of its k-grams.
MIN_SHARE = 0.8
#: Bytes that separate words; what is left is [0-9a-z] and everything outside ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels, as the contract gives them.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
# Well-known sentences of public licenses and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files", "mit"),
    ("the software is provided as is without warranty of any kind express or implied", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in "
     "compliance with the license", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at every ASCII byte but letters and digits."""
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def grams_of(words: Column, k: int = K) -> Column:
    """All rolling k-grams, in order; none for a text of fewer words.

    The words are bound once, as the only element of an array, and not computed again per k-gram.
    """
    def grams(bound: Column) -> Column:
        return F.transform(F.slice(bound, 1, F.greatest(F.size(bound) - (k - 1), F.lit(0))),
                           lambda first, i: F.concat_ws(" ", first, *(F.get(bound, i + j) for j in range(1, k))))

    return F.get(F.transform(F.array(words), grams), 0)


def template_grams(spark: SparkSession, templates, phrases, k: int = K) -> DataFrame:
    """``(t, base, label, n_grams, q, __gram, __hash)``: one row per template position."""
    rows = [(t, base, label, len(words) - k + 1, q, " ".join(words[q:q + k]))
            for t, (base, (text, label)) in enumerate([(True, p) for p in phrases] + [(False, p) for p in templates])
            for words in [text.split()] for q in range(len(words) - k + 1)]
    return (spark.createDataFrame(rows, "t int, base boolean, label string, n_grams int, q int, __gram string")
            .withColumn("__hash", F.xxhash64("__gram")))


def license_hits(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K) -> DataFrame:
    """``(__id, __hash_of, t, base, label, n_grams, q, p)``: each k-gram of a text that stands in a template.

    The join is on the hash; equal text is a condition of it, so a hit is never a collision.
    """
    grams = (docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"),
                         F.posexplode(grams_of(words_of(whole_text()), k)).alias("p", "gram"))
             .withColumn("__h", F.xxhash64("gram")))
    known = F.broadcast(template_grams(docs.sparkSession, templates, phrases, k))  # constant
    return (grams.join(known, (F.col("__h") == F.col("__hash")) & (F.col("gram") == F.col("__gram")))
            .select("__id", "__text", "t", "base", "label", "n_grams", "q", "p"))


def license_spans(hits: DataFrame, gap: int = GAP, min_share: float = MIN_SHARE) -> DataFrame:
    """Spans ``(__id, __text, base, label, first_word, share)`` that hold up.

    A phrase of the base needs every k-gram on one diagonal.  Any other template needs
    ``min_share`` of its k-grams on neighbouring diagonals, in a stretch no longer than the template
    allows.  Repeated rows vote once.
    """
    votes = (hits.withColumn("diagonal", F.col("p") - F.col("q"))
             .groupBy("__id", "__text", "t", "base", "label", "n_grams", "diagonal")
             .agg(F.collect_set("q").alias("qs"), F.min("p").alias("first"), F.max("p").alias("last")))
    exact = (votes.filter(F.col("base") & (F.size("qs") == F.col("n_grams")))
             .select("__id", "__text", "base", "label", F.col("diagonal").alias("first_word"), F.lit(1.0).alias("share")))
    by_diagonal = Window.partitionBy("__id", "__text", "t").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > gap).cast("int")
    merged = (votes.filter(~F.col("base"))
              .withColumn("run", F.sum(F.coalesce(new, F.lit(0))).over(by_diagonal))
              .groupBy("__id", "__text", "t", "base", "label", "n_grams", "run")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("found"),
                   F.min("first").alias("first_word"), F.max("last").alias("last")))
    near = (merged.withColumn("share", F.col("found") / F.col("n_grams"))
            .filter((F.col("share") >= min_share) & (F.col("last") - F.col("first_word") <= 2 * F.col("n_grams")))
            .select("__id", "__text", "base", "label", "first_word", "share"))
    return exact.unionByName(near)


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, gap: int = GAP,
                 min_share: float = MIN_SHARE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A null text counts as empty; a text with fewer than k words has no hits.  Rows are told apart by
    doc_id and text, so repeated rows get equal results and a null doc_id is a value like another.
    ``score`` is the largest share of a template that was found, 0 if none.
    """
    spans = license_spans(license_hits(docs, templates, phrases, k), gap, min_share)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = (spans.groupBy("__id", "__text")
             .agg(F.count_if("base").alias("n_base"),
                  F.min(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("first_word"),
                  F.max(F.when(F.col("base"), F.col("first_word"))).cast("long").alias("last_word"),
                  labels(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
                  labels(F.col("label")).alias("labels"), F.max("share").alias("score")))
    rows = docs.select("doc_id", F.xxhash64("text").alias("__t"),
                       F.size(words_of(whole_text())).cast("long").alias("n_words"))
    return (rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__text")), "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same scan in one DuckDB text; templates as a values list."""
    rows = ", ".join(f"({t}, {str(base).lower()}, '{label}', '{text}')" for t, (base, (text, label)) in enumerate(
        [(True, p) for p in PHRASES] + [(False, p) for p in TEMPLATES]))
    grams = "list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])"
    return rf"""
with d as (select doc_id, md5(coalesce(text, '')) as h, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as words from documents),
v(t, base, label, txt) as (values {rows}),
tw as (select *, string_split(txt, ' ') as words from v),
tg as (select t, base, label, len(words) - 2 as n_grams, unnest({grams}) as gram, generate_subscripts({grams}, 1) - 1 as q from tw),
dg as (select distinct doc_id, h, unnest({grams}) as gram, generate_subscripts({grams}, 1) - 1 as p from d),
hits as (select doc_id, h, t, base, label, n_grams, q, p, p - q as diagonal from dg join tg using (gram)),
votes as (select doc_id, h, t, base, label, n_grams, diagonal, list(distinct q) as qs, min(p) as first, max(p) as last
          from hits group by all),
exact as (select doc_id, h, base, label, diagonal as first_word, 1.0::double as share from votes
          where base and len(qs) = n_grams),
gaps as (select *, case when diagonal - lag(diagonal) over (partition by doc_id, h, t order by diagonal) > {GAP} then 1 else 0 end as new
         from votes where not base),
runs as (select *, sum(new) over (partition by doc_id, h, t order by diagonal) as run from gaps),
merged as (select doc_id, h, t, base, label, n_grams, run, len(list_distinct(flatten(list(qs)))) as found,
                  min(first) as first_word, max(last) as last from runs group by all),
near as (select doc_id, h, base, label, first_word, found::double / n_grams as share from merged
         where found::double / n_grams >= {MIN_SHARE} and last - first_word <= 2 * n_grams),
spans as (select * from exact union all select * from near),
found as (select doc_id, h, count(*) filter (base) as n_base, min(first_word) filter (base) as first_word,
                 max(first_word) filter (base) as last_word,
                 coalesce(array_to_string(list_sort(list(distinct label) filter (base)), ','), '') as base_labels,
                 array_to_string(list_sort(list(distinct label)), ',') as labels, max(share) as score
          from spans group by doc_id, h)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base,
       cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score
from d left join found f on d.doc_id is not distinct from f.doc_id and d.h = f.h
"""


ORACLE = _oracle()
