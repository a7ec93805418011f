"""Exact top-k search by a vector-approximation file.

Each component is kept as a small cell number.  A scan of the cells bounds every score from both
sides; what cannot reach the k-th best lower bound is out.  The exact vectors of the others are read
in the order of their upper bounds until the k-th exact score is above every bound left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.llm.common import table
from lintel.llm.vectors import matrix, nearest, queries, representatives, valid
from lintel.session import stored

#: Cells per component: two to this power at most.
BITS = 6
#: Rows of a block of vectors and of a block of queries; a task holds one of each.
VECTORS, QUERIES = 8_192, 2_048


def cells(vectors: DataFrame, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """``(key, cells)``: one byte per component."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = ((matrix(batch.column("vec"), np.int64) - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([r.tobytes() for r in own], pa.binary())],
                                             names=["key", "cells"])

    return vectors.select("key", "vec").mapInArrow(read, "key long, cells binary")


def exact_scores(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Reads the exact vectors of ``(key, vec_key)`` pairs: adds ``ids`` and ``score``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.einsum("ij,ij->i", matrix(batch.column("q"), np.int64), matrix(batch.column("vec"), np.int64)) \
                if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), pa.array(score)],
                                             names=["key", "ids", "score"])

    own = reps.select(F.col("key").alias("vec_key"), "vec", "ids")
    return (pairs.select("key", "vec_key").join(own, "vec_key").join(reps.select("key", F.col("vec").alias("q")), "key")
            .select("key", "ids", "q", "vec").mapInArrow(read, "key long, ids array<long>, score long"))


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding",
          bits: int = BITS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the exact ``k`` best by integer inner product of floor(scale * x).

    Queries are the rows whose id is divisible by ``every``, candidates all rows but the query's
    own; ties go to the smaller id.  Vectors that are null, of an odd length or hold null or
    non-finite components take no part, nor do rows without an id; repeated rows count once.
    Scores must fit 64-bit integers.
    """
    real = F.col(vector).cast("array<double>")
    whole = valid(df, vec_id, real, nonzero=False).select(
        "vec_id", F.transform("vec", lambda x: F.floor(scale * x).cast("long")).alias("vec"))
    reps = stored(representatives(whole, k), "vectors")
    asked = stored(queries(whole, reps, every), "queries")
    # The extent of each component: as many rows as a vector has components.
    extent = (reps.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
              .orderBy("d").collect())
    if not extent:
        return nearest(reps.select("key", "ids", F.lit(0).cast("long").alias("score")), asked, k)
    low = np.array([r.lo for r in extent], np.int64)
    high = np.array([r.hi for r in extent], np.int64)
    width = np.maximum(1, -(-(high - low + 1) // (1 << bits)))
    n, n_asked = reps.count(), asked.select("key").distinct().count()
    blocks, parts = -(-n // VECTORS), max(1, -(-n_asked // QUERIES))
    each = lambda m, name: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    mine = lambda m: F.pmod(F.xxhash64("key"), F.lit(m)).cast("int")
    # Every block of cells meets every block of queries once: a query set against all rows.
    file = cells(reps, low, width).select("key", "cells", mine(blocks).alias("block"), each(parts, "part"))
    ask = (reps.join(asked.select("key").distinct(), "key", "left_semi")
           .select("key", "vec", mine(parts).alias("part"), each(blocks, "block")))

    def scan(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if own.num_rows and asking.num_rows:
            cell = np.frombuffer(b"".join(own["cells"].to_pylist()), np.uint8).reshape(own.num_rows, -1).astype(np.int64)
            bottom = (low + cell * width).astype(np.float64)
            top = np.minimum(low + cell * width + width - 1, high).astype(np.float64)
            q = matrix(asking["vec"], np.float64)
            for at in range(0, len(q), 256):
                up, down = np.maximum(q[at:at + 256], 0), np.minimum(q[at:at + 256], 0)
                upper = up @ top.T + down @ bottom.T
                lower = up @ bottom.T + down @ top.T
                kth = np.partition(lower, -(k + 1), axis=1)[:, -(k + 1)] if lower.shape[1] > k + 1 else lower.min(1)
                a, b = np.nonzero(upper >= kth[:, None])
                out.append((a + at, b, upper[a, b], lower[a, b]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t)
                for i, t in enumerate((np.int64, np.int64, float, float))]
        return pa.table({"key": asking["key"].take(pa.array(cols[0])), "vec_key": own["key"].take(pa.array(cols[1])),
                         "upper": pa.array(cols[2]), "lower": pa.array(cols[3])})

    bounded = stored(file.groupBy("block", "part").cogroup(ask.groupBy("block", "part"))
                     .applyInArrow(scan, "key long, vec_key long, upper double, lower double"), "bounds")
    by_lower = Window.partitionBy("key").orderBy(F.desc("lower"), "vec_key")
    by_upper = Window.partitionBy("key").orderBy(F.desc("upper"), "vec_key")
    kth = (bounded.withColumn("rn", F.row_number().over(by_lower)).filter(F.col("rn") <= k + 1)
           .groupBy("key").agg(F.min("lower").alias("kth"), F.count(F.lit(1)).alias("n")))
    alive = stored(bounded.join(kth, "key").filter((F.col("upper") >= F.col("kth")) | (F.col("n") <= k))
                   .withColumn("rn", F.row_number().over(by_upper)).select("key", "vec_key", "upper", "rn"), "alive")
    first = stored(exact_scores(alive.filter(F.col("rn") <= 2 * (k + 1)), reps), "first")
    by_score = Window.partitionBy("key").orderBy(F.desc("score"))
    certain = (first.withColumn("rn", F.row_number().over(by_score)).filter(F.col("rn") == k + 1)
               .select("key", F.col("score").alias("certain")))
    rest = alive.filter(F.col("rn") > 2 * (k + 1)).join(certain, "key").filter("upper >= certain")
    return nearest(first.unionByName(exact_scores(rest, reps)), asked, k)


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


#: The whole product in SQL, for small tables.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as vec
           from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select distinct vec_id, generate_subscripts(vec, 1) as d, unnest(vec) as x from v),
s as (select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
      from c q join c on q.d = c.d and q.vec_id <> c.vec_id where q.vec_id % 20 = 0 group by 1, 2)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""
