"""Suffix-array dedup of bytes.

A string of ``LENGTH`` bytes is found through its anchor: the least of its hashed ``GRAM``-byte strings.
Equal strings have equal anchors at equal offsets, wherever they stand, so the bytes around equal
anchors of different documents meet in one bucket and nothing else needs to.  There a suffix array
is built in two stages: suffixes smaller than their successors are sorted directly, all others are
induced by scans over the buckets of first bytes.  Adjacent common prefixes of ``LENGTH`` or more bytes are
repeats.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.anchors import mixed
from lintel.llm.common import buckets_for, table, text_bytes, tidy
from lintel.llm.packed import DONE, MATCH, PACKED, batch_of, home_column, home_of, keyed, meet, pack, runs, ship, unpack

LENGTH = 50
GRAM = 24
#: Never part of UTF-8; closes each piece of text in a bucket.
END = 0xFF
BUCKET = 8 << 20
SEGMENT = 1 << 20
#: So many buckets of contexts for each bucket of text.
FINER = 4
SPANS = "home int, o binary, tag binary, n binary, pos binary, h binary"


@lru_cache(maxsize=1)
def _numbers() -> np.ndarray:
    return np.random.default_rng(50).integers(1 << 63, size=256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(a: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each string of ``gram`` bytes, by joining strings of doubling lengths."""
    rest, size, at, cur, out = gram, 1, 0, _numbers()[a], None
    n = len(a) - gram + 1
    factor = 0x9E3779B97F4A7C15
    while rest:
        if rest & 1:
            piece = cur[at:at + n]
            out = piece if out is None else out * np.uint64(0xBF58476D1CE4E5B9) + piece
            at += size
        rest >>= 1
        if rest:
            cur = cur[:-size] * np.uint64(factor) + cur[size:]
            factor = (factor * 3 + 0x94D049BB133111EA) % (1 << 64)
            size *= 2
    return mixed(out)


def slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all strings of ``length`` bytes; equal least hashes all count."""
    width = length - gram + 1
    places, hashes = [], []
    for at in range(0, len(raw) - length + 1, SEGMENT):
        a = np.frombuffer(raw, np.uint8, min(len(raw) - at, SEGMENT + length - 1), at)
        x = gram_hashes(a, gram)
        least = slide(x, width, np.minimum)
        edge = np.zeros(width - 1, np.uint64)
        own = np.flatnonzero(slide(np.concatenate([edge, least, edge]), width, np.maximum) == x)
        places.append(own + at)
        hashes.append(x[own])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pos, first = np.unique(np.concatenate(places), return_index=True)
    return pos, np.concatenate(hashes)[first]


def anchor_occurrences(length: int, gram: int):
    def read(texts: list[str]):
        found = [anchors(t.encode(), length, gram) for t in texts]
        doc = np.repeat(np.arange(len(texts)), [len(p) for p, _ in found])
        pos, h = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (0, 1))
        return doc, pos, h, np.ones(len(doc), bool)

    return read


def same_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the number of its group, and a first row of each group; rows of a group are equal bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    words = wide.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(rows), bool)
    new[1:] = (words[order][1:] != words[order][:-1]).any(1)
    group = np.empty(len(rows), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def contexts(texts: DataFrame, hits: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """The bytes around every anchor that documents share, packed by anchor.

    Of equal contexts in one task the earliest goes on; those of later documents are repeats of it.
    """
    side = length - gram

    @tidy
    def read(key, own, hit):
        import zstandard

        places = unpack(hit) if hit.num_rows else None
        cols: list[list[np.ndarray]] = []
        if places is not None:
            order = np.lexsort((places[2], places[1], places[0]))
            o, tag, pos = (p[order] for p in places)
            for own_o, own_tag, text in zip(own["__o"].to_pylist(), own["__tag"].to_pylist(), own["text"]):
                lo, hi = np.searchsorted(o, [own_o, own_o + 1]) if own_o < np.iinfo(np.int64).max else (
                    np.searchsorted(o, own_o), len(o))
                at = np.unique(pos[lo:hi][tag[lo:hi] == own_tag])
                if not len(at):
                    continue
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                ends = np.full(side, END, np.uint8)
                padded = np.concatenate([ends, raw, ends])
                for part in range(0, len(at), 1 << 16):
                    some = at[part:part + (1 << 16)]
                    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * side + gram)[some]
                    cols.append([np.full(len(some), own_o), np.full(len(some), own_tag, np.int64), some, around])
        if not cols:
            return pa.Table.from_batches([batch_of([], PACKED)])
        o, tag, pos = (np.concatenate([c[i] for c in cols]) for i in range(3))
        around = np.concatenate([c[3] for c in cols])
        order = np.lexsort((pos, tag, o))
        o, tag, pos, around = o[order], tag[order], pos[order], around[order]
        group, first = same_rows(around)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, group, o)
        done = least[group] < o
        middle = np.ascontiguousarray(around[:, side:side + gram])
        h = gram_hashes_of_rows(middle)
        spread = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        rows = [*pack(DONE, np.full(done.sum(), key[0].as_py() % buckets, np.int32), *whole(o[done], tag[done], pos[done], around[done], length, side))]
        squeeze = zstandard.ZstdCompressor(level=1)
        send = np.flatnonzero(~done)
        send = send[np.argsort(spread[send], kind="stable")]
        cut = np.flatnonzero(np.diff(spread[send], prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(send)]):
            s = send[lo:hi]
            rows.append((int(spread[s[0]]), MATCH, *runs(o[s], tag[s], pos[s]), b"", squeeze.compress(around[s].tobytes())))
        return pa.Table.from_batches([batch_of(rows, PACKED)])

    return texts.groupBy("home").cogroup(hits.groupBy("home")).applyInArrow(read, PACKED)


def gram_hashes_of_rows(rows: np.ndarray) -> np.ndarray:
    return gram_hashes(rows.ravel(), rows.shape[1])[::rows.shape[1]]


def whole(o, tag, pos, around, length: int, side: int):
    """All windows of each context, as one stretch of starts: where it begins and how many there are."""
    real = around != END
    left = side - real[:, :side].sum(1)  # ends stand only before or behind the text
    right = side - real[:, -side:].sum(1)
    start, count = pos - side + left, side + 1 - left - right
    fit = count > 0
    return o[fit], tag[fit], start[fit], count[fit].astype(np.uint8)


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first ``depth`` bytes, and the packed bytes by place.

    ``wanted`` marks the suffixes asked for; those from which they are induced come with them.

    ``text`` must end with ``depth`` closing bytes.  A suffix is small if it precedes its successor:
    its first byte is smaller than the next other one.  Small suffixes are sorted directly, eight
    bytes at a time, only ties going on.  Then buckets of first bytes are scanned upwards: each
    suffix puts the one before it at the end of what its bucket has so far, if that one is large.
    Large suffixes come before the small ones of their bucket.
    """
    n = len(text)
    eight = np.concatenate([text, np.full(7, END, np.uint8)])
    for size, wider in ((1, np.uint16), (2, np.uint32), (4, np.uint64)):
        eight = eight[:-size].astype(wider) << wider(8 * size) | eight[size:]
    up, down = np.zeros(n, bool), np.zeros(n, bool)
    up[:-1], down[:-1] = text[1:] > text[:-1], text[1:] < text[:-1]
    up[-1] = True
    turn = np.flatnonzero(up | down)  # where a suffix and its successor first differ
    small = np.repeat(up[turn], np.diff(turn, prepend=-1))
    if wanted is None:
        wanted = np.ones(n, bool)
    else:  # a large suffix is induced from its successors, up to the next small one
        first = np.flatnonzero(wanted & ~small)
        direct = np.flatnonzero(small)
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, first, 1)
        np.add.at(marks, direct[np.searchsorted(direct, first)] + 1, -1)
        wanted = wanted | (np.cumsum(marks[:-1]) > 0)
    order = np.flatnonzero(small & wanted)
    order = order[np.argsort(eight[order], kind="stable")]
    key = eight[order]
    tied = np.zeros(len(order) + 1, bool)
    tied[1:-1] = key[1:] == key[:-1]
    for at in range(8, depth, 8):
        inside = np.flatnonzero(tied[:-1] | tied[1:])
        if not len(inside):
            break
        rank = np.cumsum(~tied[:-1])[inside]
        key = eight[np.minimum(order[inside] + at, n - 1)]
        by = np.lexsort((key, rank))
        order[inside] = order[inside][by]
        key = key[by]
        still = np.zeros(len(order) + 1, bool)
        still[inside[1:]] = tied[inside[1:]] & (key[1:] == key[:-1])
        tied = still
    first = text[order]
    bounds = np.searchsorted(first, np.arange(257))
    large: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(chunk: np.ndarray, byte: int) -> np.ndarray:
        """Deals what precedes the chunk's suffixes to its buckets; returns what falls into this one."""
        before = chunk[chunk > 0] - 1
        before = before[~small[before] & wanted[before]]
        if not len(before):
            return before
        of = text[before]
        before = before[np.argsort(of, kind="stable")]
        counts = np.bincount(of, minlength=256)
        at = np.cumsum(counts) - counts
        for b in np.flatnonzero(counts):
            if b != byte:
                large[b].append(before[at[b]:at[b] + counts[b]])
        return before[at[byte]:at[byte] + counts[byte]]

    for byte in range(256):
        chunk = np.concatenate(large[byte]) if large[byte] else order[:0]
        while len(chunk):
            out.append(chunk)
            chunk = induce(chunk, byte)
        chunk = order[bounds[byte]:bounds[byte + 1]]
        if len(chunk):
            out.append(chunk)
            induce(chunk, byte)
    return np.concatenate(out), eight


def common_prefixes(suffixes: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to ``depth`` rounded up to eights."""
    n, out = len(eight), np.zeros(len(suffixes), np.int64)
    alive = np.arange(1, len(suffixes))
    for at in range(0, depth, 8):
        a, b = suffixes[alive] + at, suffixes[alive - 1] + at
        inside = (a < n) & (b < n)
        alive, a, b = alive[inside], a[inside], b[inside]
        differ = eight[a] ^ eight[b]
        unlike = differ.byteswap().view(np.uint8).reshape(-1, 8) != 0
        out[alive] += np.where(differ == 0, 8, unlike.argmax(1))
        alive = alive[differ == 0]
    return out


def repeated_windows(rows: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each context (a row of bytes) and offset: whether that window also stands in a context of lower ``least``."""
    width = rows.shape[1]
    offsets = width - length + 1
    text = np.concatenate([np.column_stack([rows, np.full(len(rows), END, np.uint8)]).ravel(),
                           np.full(64, END, np.uint8)])
    wanted = np.arange(len(text)) % (width + 1) < offsets
    wanted[len(rows) * (width + 1):] = False
    suffixes, eight = suffix_array(text, length, wanted)
    stop = np.flatnonzero(text == END)
    room = stop[np.searchsorted(stop, suffixes)] - suffixes
    shared = common_prefixes(suffixes, eight, length)
    joined = (shared >= length) & (room >= length)
    joined[1:] &= room[:-1] >= length
    group = np.cumsum(~joined) - 1
    row, offset = suffixes // (width + 1), suffixes % (width + 1)
    real = (room >= length) & (row < len(rows))
    row, offset, group = row[real], offset[real], group[real]
    low = np.full(group.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, least[row])
    out = np.zeros((len(rows), offsets), bool)
    out[row, offset] = low[group] < least[row]
    return out


def repeated(packed: DataFrame, length: int, gram: int, homes: int) -> DataFrame:
    """Stretches of window starts that are repeats, packed for their documents' homes."""
    side = length - gram

    @tidy
    def match(key, table):
        import zstandard

        kind = table["kind"].to_numpy()
        found = [unpack(table.filter(pa.array(kind == DONE)), np.uint8)]
        own = table.filter(pa.array(kind == MATCH))
        if own.num_rows:
            o, tag, pos = unpack(own)
            open_ = zstandard.ZstdDecompressor()
            around = np.frombuffer(b"".join(open_.decompress(x) for x in own["g"].to_pylist()),
                                   np.uint8).reshape(len(o), 2 * side + gram)
            group, first = same_rows(around)
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, group, o)
            later = least[group] < o
            found.append(whole(o[later], tag[later], pos[later], around[later], length, side))
            gone = repeated_windows(around[first], least, length)
            head = np.flatnonzero(~later)
            edge = np.diff(gone[group[head]], prepend=False, append=False, axis=1)
            row, at = np.nonzero(edge)
            row, start, stop = head[row[::2]], at[::2], at[1::2]
            found.append((o[row], tag[row], pos[row] - side + start, (stop - start).astype(np.uint8)))
        o, tag, pos, count = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.lexsort((pos, tag, o))
        o, tag, pos, count = o[order], tag[order], pos[order], count[order]
        rows = [(r[0], *r[2:7]) for r in pack(DONE, home_of(o, tag, homes), o, tag, pos, count)]
        return pa.Table.from_batches([batch_of(rows, SPANS)])

    return packed.groupBy("bucket").applyInArrow(match, SPANS)


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET,
                          cut_text: bool = False) -> DataFrame:
    """All columns of ``docs``, each row with ``n_bytes, n_removed, spans, kept``.

    A byte of the UTF-8 text goes if ``length`` bytes that cover it also start in a document with a
    smaller doc_id; all strings are judged on the texts as given and lie within one document.
    ``spans`` are the removed stretches as byte ranges, ``kept`` the other bytes; columns of ``docs``
    with these names are replaced.  A null text
    has no bytes; a null doc_id comes after all others; rows with equal doc_id do not remove each
    other's bytes, repeated rows get equal results.  With ``cut_text`` the columns are those of ``docs``
    alone, and ``text`` holds what is left, without characters that a cut broke.
    """
    spark = docs.sparkSession
    buckets = buckets_for(spark, text_bytes(docs), bucket_bytes)
    kinds = {} if cut_text else {"n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": pa.list_(pa.int64()), "kept": pa.binary()}
    given = [c for c in docs.columns if c not in kinds]
    # The other columns travel as one, so their names cannot meet those used here.
    own = keyed(docs.select("doc_id", "text", F.struct(F.lit(1).alias("_"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(given) if c != "text")).alias("rest")))
    texts = own.withColumn("home", home_column(buckets)).select("home", "__o", "__tag", "text", "rest")
    hits = meet(ship(own, anchor_occurrences(length, gram), buckets), buckets)
    found = repeated(contexts(texts, hits, length, gram, FINER * buckets), length, gram, buckets)

    @tidy
    def cut(key, own, hit):
        o, tag, pos, count = unpack(hit, np.uint8) if hit.num_rows else (np.zeros(0, np.int64),) * 4
        order = np.argsort(o, kind="stable")
        o, tag, pos, count = o[order], tag[order], pos[order], count[order]
        out: list[tuple] = []
        for own_o, own_tag, text in zip(own["__o"].to_pylist(), own["__tag"].to_pylist(), own["text"]):
            raw = text.as_py().encode()
            a = np.frombuffer(raw, np.uint8)
            lo, hi = np.searchsorted(o, own_o, "left"), np.searchsorted(o, own_o, "right")
            mine = tag[lo:hi] == own_tag
            marks = np.zeros(len(a) + 1, np.int64)
            np.add.at(marks, pos[lo:hi][mine], 1)
            np.add.at(marks, pos[lo:hi][mine] + count[lo:hi][mine].astype(np.int64) + (length - 1), -1)
            gone = np.cumsum(marks[:-1]) > 0
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            out.append((len(a), int(gone.sum()), edges.tolist(), a[~gone].tobytes() if len(edges) else raw))
        text = pa.array([x[3].decode("utf-8", "ignore") for x in out], pa.string()) if cut_text else own["text"]
        rest = own["rest"].combine_chunks()
        return pa.table({**{c: text if c == "text" else rest.field(f"c{i}") for i, c in enumerate(given)},
                         **{c: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate(kinds.items())}})

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in given)
    more = "" if cut_text else ", n_bytes long, n_removed long, spans array<long>, kept binary"
    return texts.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(cut, fields + more)


def dedup_text(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; a character that a cut breaks goes with it.

    A null text becomes an empty one; other columns stay.
    """
    return remove_repeated_bytes(docs, length, cut_text=True).select(*docs.columns)


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of 50 bytes as text in hexadecimal digits; for small tables.
ORACLE = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
g as (select doc_id, s, substr(x, 2 * s + 1, 100) as k from (select doc_id, x, unnest(range(0, n - 49)) as s from h)),
f as (select k, min(doc_id) as first_doc from g group by k),
hit as (select doc_id, s from g join f using (k) where first_doc < doc_id),
new as (select *, case when s - lag(s) over (partition by doc_id order by s) <= 50 then 0 else 1 end as fresh from hit),
run as (select *, sum(fresh) over (partition by doc_id order by s) as r from new),
span as (select doc_id, r, min(s) as a, max(s) + 50 as b from run group by doc_id, r),
edge as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from span),
cut as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last_end,
               string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as kept
        from edge join h using (doc_id) group by doc_id)
select h.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last_end, 0) + 1))) as kept_sha256
from h left join cut using (doc_id)
"""
