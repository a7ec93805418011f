"""Occurrences on their way through a shuffle: many per row, in columns of bytes.

An occurrence is a hash at a place of a document.  A document is known by ``o`` (its doc_id, or the
largest long if null) and a tag: a 64-bit hash of its text wherever two texts may have one ``o``, else 0, which costs
nothing once compressed.  Rows hold runs: one entry per document, then the places within it as differences.  Bytes of equal rank
stand together, which compresses well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.bpe import _chunks
from lintel.llm.common import NO_ID, tidy

#: Kinds of packed rows: to be matched in their bucket, or already decided and only passing through.
MATCH, DONE = 0, 1
PACKED = "bucket int, kind int, o binary, tag binary, n binary, pos binary, h binary, g binary"
FOUND = "home int, o binary, tag binary, n binary, pos binary"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__o`` and ``__tag`` in front; null texts become empty.

    Rows without a doc_id are told apart by their texts, and all rows are if any doc_id is repeated.
    """
    repeated = (docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                .filter("n > 1").limit(1).count())
    of_text = F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit(""))))
    tag = of_text if repeated else F.when(F.col("doc_id").isNull(), of_text).otherwise(F.lit(0))
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).cast("long").alias("__o"), tag.cast("long").alias("__tag"),
                       *docs.columns).withColumn("text", F.coalesce("text", F.lit("")))


def home_column(homes: int) -> Column:
    """The home of a document: the bucket in which its text waits for what is found about it."""
    return F.pmod(F.col("__o").bitwiseXOR(F.shiftright("__o", 17)).bitwiseXOR(F.col("__tag")), F.lit(homes)).cast("int")


def home_of(o: np.ndarray, tag: np.ndarray, homes: int) -> np.ndarray:
    return ((o ^ (o >> 17) ^ tag) % homes).astype(np.int32)


def planes(a: np.ndarray) -> bytes:
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def runs(o: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Occurrences in order of document and place as run bytes."""
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] < pos[:-1])
    first = np.flatnonzero(new)
    step = np.diff(pos, prepend=0)
    step[first] = pos[first]
    return (planes(o[first].astype(np.int64)), planes(tag[first].astype(np.int64)),
            planes(np.diff(first, append=len(o)).astype(np.uint32)), planes(step.astype(np.uint32)))


def unruns(o: bytes, tag: bytes, n: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    count = unplanes(n, np.uint32).astype(np.int64)
    step = unplanes(pos, np.uint32).astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(count) - count
    base = np.repeat(total[first] - step[first], count) if len(count) else total
    return np.repeat(unplanes(o, np.int64), count), np.repeat(unplanes(tag, np.int64), count), total - base


def pack(kind: int, bucket: np.ndarray, o: np.ndarray, tag: np.ndarray, pos: np.ndarray, h: np.ndarray | None = None,
         g: np.ndarray | None = None) -> Iterator[tuple]:
    """One row per bucket; occurrences must come in order of document and place."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for at, end in zip(cut, [*cut[1:], len(order)]):
        own = order[at:end]
        yield (int(bucket[own[0]]), kind, *runs(o[own], tag[own], pos[own]),
               planes(h[own]) if h is not None else b"", planes(g[own]) if g is not None else b"")


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    to = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], to[k]) for i, k in enumerate(kinds)], names=list(names))


def unpack(table: pa.Table, h: type | None = None, g: type | None = None) -> list[np.ndarray]:
    """All occurrences of packed rows: ``o, tag, pos`` and, if asked for, ``h`` and ``g``."""
    cols = {c: table[c].to_pylist() for c in table.column_names}
    parts = [unruns(*x) for x in zip(cols["o"], cols["tag"], cols["n"], cols["pos"])]
    out = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
           for i, t in enumerate((np.int64, np.int64, np.int64))]
    for name, dtype in (("h", h), ("g", g)):
        if dtype is not None:
            out.append(np.concatenate([unplanes(x, dtype) for x in cols[name]]) if parts else np.zeros(0, dtype))
    return out


def found_rows(homes: int, o: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> list[tuple]:
    """Occurrences as packed rows for their documents' homes."""
    order = np.lexsort((pos, tag, o))
    o, tag, pos = o[order], tag[order], pos[order]
    return [(r[0], *r[2:6]) for r in pack(DONE, home_of(o, tag, homes), o, tag, pos)]


def group_extremes(h: np.ndarray, o: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per occurrence the smallest ``o`` of its hash (among those marked ``first``) and the largest of all."""
    _, of = np.unique(h, return_inverse=True)
    low = np.full(of.max(initial=-1) + 1, np.iinfo(np.int64).max)
    high = np.full(len(low), np.iinfo(np.int64).min)
    np.minimum.at(low, of if first is None else of[first], o if first is None else o[first])
    np.maximum.at(high, of, o)
    return low[of], high[of]


def ship(docs: DataFrame, occurrences, buckets: int) -> DataFrame:
    """Packed rows of what ``occurrences(texts)`` finds: ``doc index, pos, hash, is reference``.

    Within a chunk what is decided is sent as decided: a later document's occurrence of a chunk's
    own reference needs no match elsewhere, so a frequent hash costs its bucket little per chunk.
    """
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "text", 3 << 20):
            own_o = batch.column("__o").to_numpy()
            own_tag = batch.column("__tag").to_numpy()
            doc, pos, h, ref = occurrences(batch.column("text").to_pylist())
            if not len(doc):
                continue
            o, tag = own_o[doc], own_tag[doc]
            low, high = group_extremes(h, o, ref)
            done = (low < o) | (ref & (high > o))
            send = ~done | (ref & (low == o))
            spread = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            small = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rows = [*pack(MATCH, spread[send], o[send], tag[send], pos[send], small[send], ref[send].astype(np.uint8)),
                    *pack(DONE, (spread[done] * 0 + int(own_o[0] % buckets)), o[done], tag[done], pos[done])]
            yield batch_of(rows, PACKED)

    return docs.select("__o", "__tag", "text").mapInArrow(read, PACKED)


def meet(packed: DataFrame, homes: int) -> DataFrame:
    """Occurrences whose hash some earlier document has as a reference, or that are such references.

    Hashes are 32 bits within a bucket of bounded size: a chance match costs a later check, no more.
    """
    @tidy
    def match(key, table):
        kind = table["kind"].to_numpy()
        done = unpack(table.filter(pa.array(kind == DONE)))
        o, tag, pos, h, ref = unpack(table.filter(pa.array(kind == MATCH)), np.uint32, np.uint8)
        low, high = group_extremes(h, o, ref.astype(bool))
        hit = (low < o) | (ref.astype(bool) & (high > o))
        rows = found_rows(homes, *(np.concatenate([a, b[hit]]) for a, b in zip(done, (o, tag, pos))))
        return pa.Table.from_batches([batch_of(rows, FOUND)])

    return packed.groupBy("bucket").applyInArrow(match, FOUND)
