"""Benchmark decontamination: one Aho-Corasick automaton over the normalised words of all items.

The patterns are all windows of ``WINDOW`` words of the items (a shorter item is one window), each with a
blank around every word, so a pattern only ever matches whole words.  A text is normalised the same
way and scanned once; matches are word ranges, which are mapped back to characters of the text.

The automaton is sent to every task, so its size is bounded: patterns with their items beyond
``AUTOMATON_BYTES`` are dealt by hash to further automata, and each of these costs one more scan.  A window that very many
items share is dealt over all of them by item.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.bpe import _chunks
from lintel.llm.common import table, tidy
from lintel.llm.words import SEGMENT, normal, normal_words, word_lists
from lintel.session import stored

WINDOW = 10
#: Bytes of patterns and item ids in one automaton; its nodes take up to a hundred times as much in a worker.
AUTOMATON_BYTES = 4 << 20
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``(pattern, item)``: the words of each window and the id (as a string) of an item that has it."""
    words = items.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(window - 1), F.lit(1)))
    return words.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(window)), " "))).alias("pattern")).distinct()


@lru_cache(maxsize=1)
def _automaton(spec: str):
    """The automaton of ``[[pattern, items], ...]`` with the words and the items of each pattern."""
    import ahocorasick

    patterns = json.loads(spec)
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, (pattern, _) in enumerate(patterns):
        found.add_word(f" {pattern} ".encode().decode("latin-1"), i)
    found.make_automaton()
    return found, [p.count(" ") + 1 for p, _ in patterns], [items for _, items in patterns]


def find(raw: bytes, automaton, segment: int = SEGMENT) -> tuple[int, list[int], list[int]]:
    """Words of the text, and of each match the last word and the pattern."""
    n = passed = 0
    scan, last, patterns = None, [], []
    for words in word_lists(raw, segment):
        if not words:
            continue
        line = b" ".join([b"", *words, b""] if scan is None else [*words, b""])
        if scan is None:
            scan = automaton.iter(line.decode("latin-1"))
        else:
            scan.set(line.decode("latin-1"))  # goes on in the state it was in
        matches = list(scan)
        if matches:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
            closes = np.searchsorted(blanks, np.array([end for end, _ in matches]) - passed)
            last += (closes + (n if passed else -1)).tolist()
            patterns += [p for _, p in matches]
        n, passed = n + len(words), passed + len(line)
    return n, last, patterns


def char_spans(raw: bytes, ranges: np.ndarray) -> list[dict[str, int]]:
    """Characters of the text from the first word's start to the last word's end, for each range of words."""
    if not len(ranges):
        return []
    word = np.frombuffer(normal(raw), np.uint8) != 32
    edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
    chars = np.zeros(len(raw) + 1, np.int32)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=chars[1:])
    return [{"start": int(chars[edges[2 * a]]), "end": int(chars[edges[2 * b - 1]])} for a, b in ranges]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, spans, items``.

    A word is hit if it stands inside an occurrence of a window of some item.  ``spans`` are the maximal runs of hit words as
    characters ``start`` to ``end`` (exclusive) of the text as given; ``items`` are the ids, as strings
    in their order, of the items with a window in the text.

    ``docs`` needs ``doc_id, text`` and ``items`` needs ``item_id, text``; other columns of whatever name
    are not looked at.  A null or wordless text has no words, no spans and no items; an item without words
    matches nothing; the windows of an item without an id hit words, but there is no id to list.  Repeated rows
    of ``docs`` give repeated results, repeated items or ids count once.  A very long text is split a megabyte
    at a time, with matches running across.  Without items nothing is hit.
    """
    spark = docs.sparkSession
    pairs = stored(item_windows(items, window), "windows")
    size = pairs.agg(F.sum(F.octet_length("pattern") + F.coalesce(F.octet_length("item"), F.lit(0)) + 8)).first()[0] or 0
    groups = max(1, -(-size // automaton_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<long>").alias("hit"), F.array().cast("array<string>").alias("items"))
    for group in range(groups):
        own = (pairs.filter(F.pmod(F.xxhash64("pattern", "item"), F.lit(groups)) == group)
               .groupBy("pattern").agg(F.collect_list("item").alias("items")))
        spec = spark.sparkContext.broadcast(json.dumps([[r["pattern"], r["items"]] for r in own.collect()]))  # automaton_bytes at most
        rows = rows.mapInArrow(_scan(spec), f"doc_id {kind}, text string, n_words long, hit array<long>, items array<string>")
        if group < groups - 1:
            rows = stored(rows, "scanned")
    return rows.mapInArrow(_spans, f"doc_id {kind}, n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>")


def _scan(spec):
    """Add what one automaton finds to the hit word ranges and the items found so far."""
    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, widths, ids = _automaton(spec.value)
        for batch in _chunks(batches, "text"):
            counts, hits, items = [], [], []
            for text, old, listed in zip(batch.column("text"), batch.column("hit"), batch.column("items")):
                raw = (text.as_py() or "").encode()
                if not widths:
                    counts.append(sum(map(len, word_lists(raw))))
                    last = patterns = []
                else:
                    n, last, patterns = find(raw, automaton)
                    counts.append(n)
                hit, found = old.as_py(), listed.as_py()
                if last:
                    ranges = np.array(hit, np.int64).reshape(-1, 2)
                    width = np.array([widths[p] for p in patterns], np.int64)
                    ends = np.array(last, np.int64) + 1
                    hit = merged(np.concatenate([ranges[:, 0], ends - width]), np.concatenate([ranges[:, 1], ends])).ravel().tolist()
                    found = sorted({*found, *(i for p in set(patterns) for i in ids[p])})
                hits.append(hit)
                items.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int64())),
                 pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "hit", "items"])

    return scan


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The union of ranges as sorted, disjoint ranges that do not touch."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return np.stack([starts[first], reach[np.r_[first[1:] - 1, len(reach) - 1]]], 1)


@tidy
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ranges = [np.array(h.as_py(), np.int64).reshape(-1, 2) for h in batch.column("hit")]
        spans = [char_spans(t.as_py().encode(), r) if len(r) else [] for t, r in zip(batch.column("text"), ranges)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_words"), pa.array([int((r[:, 1] - r[:, 0]).sum()) for r in ranges], pa.int64()),
             pa.array(spans, pa.list_(SPAN)), batch.column("items")], names=["doc_id", "n_words", "n_hit", "spans", "items"])


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows of every width that items have, as lists of words, joined with those of the documents; for small tables.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
p as (select distinct item, words[s:s + 9] as k from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as s from b where len(words) > 0)),
l as (select distinct len(k) as n from p),
g as (select doc_id, s, n, words[s:s + n - 1] as k from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as s from d, l)),
m as (select doc_id, s, n, item from g join p using (k)),
h as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(s, s + n)) as i from m) group by doc_id),
i as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
      from (select distinct doc_id, item from m where item is not null) group by doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join i using (doc_id)
"""
