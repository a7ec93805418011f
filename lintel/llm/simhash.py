"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at ``RADIUS`` or fewer differing bits.  Each bit position gets a vector
of ``RADIUS + 1`` bits; each non-zero vector ``v`` gives a mask of the positions whose vector has an odd
inner product with ``v``.  The vectors of ``RADIUS`` differing positions span less than the whole space, so some ``v`` is orthogonal to all of them: its mask avoids
every difference.  Hence each linked pair agrees on the masked bits of at least one of the 31 tables;
none is lost.

Only distinct fingerprints enter the tables.  Within a bucket a spanning forest stands for all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.bpe import _chunks
from lintel.llm.common import NO_ID, table, tidy, union
from lintel.plans.components import connected_components
from lintel.session import stored

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Buckets of up to so many fingerprints are compared as a list in one row; larger ones meet at midpoints.
LIST = 1024


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """One mask per non-zero vector; positions take the non-zero vectors in turn."""
    vectors = 1 << (radius + 1)
    of = [1 + i % (vectors - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(of[i] & v).count("1") % 2) for v in range(1, vectors)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of each run of ``shingle`` words; of all words if there are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(b" ".join(words), SEED)]
    line = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = (starts[shingle:] - 1).tolist()
    return [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends)]


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text; 0 if it has no words."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if not words:
        return 0
    hashes = shingle_hashes(words, shingle)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_hash, fp)``: the fingerprint as a signed long.  A null text counts as empty."""
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, "text"):
            found = [signed(simhash((t or "").encode(), shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())],
                                             names=["doc_id", "text_hash", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        read, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links of at most ``radius`` bits connect among a few fingerprints."""
    left = np.unique(prints.astype(np.uint64))
    out = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(left ^ at) <= radius
            out.extend((int(at), int(x)) for x in left[near])
            todo.extend(left[near])
            left = left[~near]
    return out


def _forests(radius: int):
    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = [e for row in batch.column("fps").to_pylist() for e in forest(np.array(row, np.int64), radius)]
            a = np.array(edges, np.uint64).reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["left_id", "right_id"])

    return read


def links(prints: DataFrame, radius: int = RADIUS, list_size: int = LIST) -> DataFrame:
    """``(left_id, right_id)`` between distinct fingerprints ``fp``: enough links for the same components.

    Buckets of two give their pair, buckets of up to ``list_size`` a spanning forest.  The members of
    a larger bucket are linked through midpoints: fingerprints within an even ``radius`` differ from some
    common point by half of it each, and all that reach one point that way are linked.  A point is
    reached by a bounded number of fingerprints (those that differ from it in half the radius), so no list grows
    with the data, and each member gives a constant number of rows.
    """
    free = [[i for i in range(BITS) if not m >> i & 1] for m in masks(radius)]
    keys = F.array(*(F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
                     for v, m in enumerate(masks(radius))))
    rows = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.v", "k.key")
    counts = stored(rows.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                    .filter("n > 1"), "buckets")
    near = F.bit_count(F.col("left_id").bitwiseXOR(F.col("right_id"))) <= radius
    two = counts.filter("n = 2").select(F.col("a").alias("left_id"), F.col("b").alias("right_id")).filter(near)
    few = (rows.join(counts.filter(f"n > 2 and n <= {list_size}").select("v", "key"), ["v", "key"])
           .groupBy("v", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
           .mapInArrow(_forests(radius), "left_id long, right_id long"))
    found = [two, few]
    if counts.filter(f"n > {list_size}").limit(1).count():
        half = radius // 2
        flips = F.array(*(F.array(*(F.lit(signed(sum(1 << i for i in c))) for n in range(half + 1)
                                    for c in combinations(f, n))) for f in free))
        at = F.explode(F.transform(F.get(flips, F.col("v")), lambda x: F.col("fp").bitwiseXOR(x)))
        meet = (rows.join(counts.filter(f"n > {list_size}").select("v", "key"), ["v", "key"])
                .select("v", "fp", at.alias("point"))
                .groupBy("v", "point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1))
        found.append(meet.select(F.array_min("fps").alias("left_id"), F.explode("fps").alias("right_id"))
                     .filter("left_id <> right_id"))
    return union(found).distinct()


def components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, list_size: int = LIST) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` per row; ``root`` names a component by a fingerprint."""
    found = stored(fingerprints(docs, shingle), "fingerprints")
    prints = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    edges = stored(links(prints, radius, list_size), "links")
    joined = connected_components(edges)
    roots = stored(prints.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
                   .select("fp", "first", F.coalesce("component", "fp").alias("root")), "roots")
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    return (found.join(roots.join(ids, "root").select("fp", "root", "component_id"), "fp")
            .select("doc_id", "text_hash", "fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, list_size: int = LIST) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``.

    Components are those of all links; the id is the smallest doc_id in it, null only if every
    doc_id in it is null.  Repeated rows are rows of their own.  Texts without words have fingerprint
    0 and link like any other.
    """
    return components(docs, radius, shingle, list_size).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (nulls last), all columns as they were.

    Of repeated rows one stays.
    """
    last = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    return rows_of(docs, components(docs).groupBy("root").agg(F.min(F.struct(last.alias("o"), "text_hash")).alias("first")))


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``first``, a struct of id and text hash, names; of repeated rows one."""
    keep = chosen.select(F.col("first.o").alias("__o"), F.col("first.text_hash").alias("__text"))
    rows = docs.withColumns({"__o": F.coalesce(F.col("doc_id"), F.lit(NO_ID)), "__text": F.xxhash64("text")})
    return rows.join(keep, ["__o", "__text"], "left_semi").dropDuplicates(["__o", "__text"]).select(*docs.columns)


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
