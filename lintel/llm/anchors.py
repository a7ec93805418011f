"""Substring duplicates over words, by fixed-block anchors.

Every text gives its non-overlapping blocks of ``BLOCK`` words as references and all its rolling
windows of ``BLOCK`` words as probes.  A repeat of ``2 * BLOCK - 1`` words covers a whole block
wherever the blocks happen to lie, so each is met by some probe.  Hits are extended: around each
hit all windows of full length are hashed anew and compared, and those that agree join up to maximal
repeats.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import buckets_for, table, text_bytes, tidy
from lintel.llm.packed import (DONE, FOUND, MATCH, PACKED, batch_of, found_rows, group_extremes, home_column, keyed,
                               meet, pack, ship, unpack)

#: Words of a repeat, and of an anchor block: a repeat of 2 * 7 - 1 words holds a whole block.
LENGTH = 13
#: Bytes of text per bucket; more text gives more buckets.
BUCKET = 16 << 20
SEGMENT = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, the powers of an odd base, and those of its inverse."""
    rng = np.random.default_rng(20)
    base = int(rng.integers(1 << 62)) * 2 + 1
    powers = np.full(SEGMENT + 2, base, np.uint64)
    inverse = np.full(SEGMENT + 2, pow(base, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return rng.integers(1 << 63, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1), np.cumprod(powers), np.cumprod(inverse)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash per word of a text, computed over whole segments of it at a time."""
    numbers, powers, inverse = _tables()
    out, at, size = [], 0, len(raw)
    while at < size:
        end = min(size, at + SEGMENT)
        if end < size:  # cut behind white space; a longer word than a segment is hashed alone
            cut = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut > at:
                end = cut + 1
            else:
                stops = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := raw.find(c, end)) >= 0]
                end = min(stops, default=size)
                out.extend(np.frombuffer(hashlib.blake2b(w, digest_size=8).digest(), np.uint64) for w in raw[at:end].split())
                at = end
                continue
        a = np.frombuffer(raw, np.uint8, end - at, at)
        word = (a != 32) & ((a < 9) | (a > 13))
        edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, stop = edge[::2], edge[1::2]
        total = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(numbers[a] * inverse[:len(a)], out=total[1:])
        out.append(mixed((total[stop] - total[start]) * powers[stop] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rolling(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A 64-bit hash per window of ``n`` word hashes."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(seed) + words[i:i + len(out)]
    return mixed(out)


def texts_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, the text of each word, and each text's first word."""
    each = [word_hashes(t.encode()) for t in texts]
    counts = np.array([len(w) for w in each], np.int64)
    return (np.concatenate(each) if each else np.zeros(0, np.uint64), np.repeat(np.arange(len(texts)), counts),
            np.cumsum(counts) - counts)


def block_occurrences(block: int):
    """All rolling windows of ``block`` words; those at multiples of ``block`` are references."""
    def read(texts: list[str]):
        words, doc, first = texts_words(texts)
        h = rolling(words, block, 0x9E3779B97F4A7C15)
        inside = doc[:len(h)] == doc[block - 1:] if len(h) else np.zeros(0, bool)
        doc, h = doc[:len(h)][inside], h[inside]
        pos = np.flatnonzero(inside) - first[doc]
        return doc, pos, h, pos % block == 0

    return read


def by_document(table: pa.Table) -> dict[tuple[int, int], np.ndarray]:
    """Found places by document."""
    o, tag, pos = unpack(table)
    order = np.lexsort((pos, tag, o))
    o, tag, pos = o[order], tag[order], pos[order]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (tag[1:] != tag[:-1])]) if len(o) else np.zeros(0, int)
    return {(int(o[a]), int(tag[a])): pos[a:b] for a, b in zip(new, [*new[1:], len(o)])}


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a window of ``length`` that begins at one of ``starts``."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + length, size), -1)
    return np.cumsum(marks[:-1]) > 0


def extend(texts: DataFrame, hits: DataFrame, length: int, block: int, buckets: int) -> DataFrame:
    """Packed windows of ``length`` words around every hit, hashed with 96 bits."""
    @tidy
    def read(key, own, hit):
        places = by_document(hit) if hit.num_rows else {}
        cols: list[list[np.ndarray]] = []
        for o, tag, text in zip(own["__o"].to_pylist(), own["__tag"].to_pylist(), own["text"]) if places else ():
            at = places.get((o, tag))
            if at is None:
                continue
            words = word_hashes(text.as_py().encode())
            n = len(words) - length + 1
            if n <= 0:
                continue
            low = np.maximum(at - (length - block), 0)
            start = np.flatnonzero(covered(low[low < n], length - block + 1, n)) if len(at) else at
            cols.append([np.full(len(start), o), np.full(len(start), tag, np.int64), start,
                         rolling(words, length, 0xBF58476D1CE4E5B9)[start],
                         (rolling(words, length, 0x94D049BB133111EB)[start] >> np.uint64(32)).astype(np.uint32)])
        if not cols:
            return pa.Table.from_batches([batch_of([], PACKED)])
        o, tag, pos, h, g = (np.concatenate(c) for c in zip(*cols))
        order = np.lexsort((pos, tag, o))
        o, tag, pos, h, g = o[order], tag[order], pos[order], h[order], g[order]
        low, _ = group_extremes(h ^ (g.astype(np.uint64) << np.uint64(32)), o)
        done = low < o  # a later document's window: its first place here stands for it elsewhere
        spread = ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        rows = [*pack(MATCH, spread[~done], o[~done], tag[~done], pos[~done], h[~done], g[~done]),
                *pack(DONE, np.full(done.sum(), key[0].as_py() % buckets, np.int32), o[done], tag[done], pos[done])]
        return pa.Table.from_batches([batch_of(rows, PACKED)])

    return texts.groupBy("home").cogroup(hits.groupBy("home")).applyInArrow(read, PACKED)


def repeats(windows: DataFrame, homes: int) -> DataFrame:
    """Windows whose words also start in an earlier document."""
    @tidy
    def match(key, table):
        kind = table["kind"].to_numpy()
        done = unpack(table.filter(pa.array(kind == DONE)))
        o, tag, pos, h, g = unpack(table.filter(pa.array(kind == MATCH)), np.uint64, np.uint32)
        both = np.empty(len(h), [("h", np.uint64), ("g", np.uint32)])
        both["h"], both["g"] = h, g
        order = np.lexsort((g, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        low, _ = group_extremes(of, o)
        hit = low < o
        rows = found_rows(homes, *(np.concatenate([a, b[hit]]) for a, b in zip(done, (o, tag, pos))))
        return pa.Table.from_batches([batch_of(rows, FOUND)])

    return windows.groupBy("bucket").applyInArrow(match, FOUND)


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, spans, kept``.

    A word goes if a window of ``length`` words covers it that also starts in a document with a smaller
    doc_id; all windows are judged on the texts as given.  ``spans`` are the removed stretches
    as word ranges, ``kept`` the other words joined by one space.  A null text has no words; a null
    doc_id comes after all others; rows with equal doc_id do not remove each other's words, repeated
    rows get equal results.
    """
    spark, block = docs.sparkSession, (length + 1) // 2
    buckets = buckets_for(spark, text_bytes(docs), bucket_bytes)
    own = keyed(docs.select("doc_id", "text"))
    texts = own.withColumn("home", home_column(buckets))
    hits = meet(ship(own, block_occurrences(block), buckets), buckets)
    found = repeats(extend(texts, hits, length, block, buckets), buckets)

    @tidy
    def cut(key, own, hit):
        places = by_document(hit) if hit.num_rows else {}
        out: dict[str, list] = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
        for o, tag, text in zip(own["__o"].to_pylist(), own["__tag"].to_pylist(), own["text"]):
            words = text.as_py().encode().split()
            gone = covered(places.get((o, tag), np.zeros(0, np.int64)), length, len(words))
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["spans"].append(edges.tolist())
            out["kept"].append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(edges) else words).decode())
        kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.int64()), "kept": pa.string()}
        return pa.table({"doc_id": own["doc_id"], **{c: pa.array(v, kinds[c]) for c, v in out.items()}})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (texts.groupBy("home").cogroup(found.groupBy("home"))
            .applyInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, spans array<long>, kept string"))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: All windows grouped as lists of words; for small tables.
ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
           from documents),
g as (select doc_id, s, words[s:s + 12] as k from (select doc_id, words, unnest(range(1, len(words) - 11)) as s from w)),
f as (select k, min(doc_id) as first_doc from g group by k),
gone as (select distinct doc_id, s + unnest(range(0, 13)) as i from g join f using (k) where first_doc < doc_id),
u as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as txt, count(*) as n from u anti join gone using (doc_id, i) group by doc_id)
select w.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(txt, '')) as kept_sha256
from w left join kept using (doc_id)
"""
