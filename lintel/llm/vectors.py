"""What both vector searches share: valid vectors, equal vectors as one, results per query."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid(df: DataFrame, vec_id: str, vector: Column, nonzero: bool) -> DataFrame:
    """``(vec_id, vec)`` of the rows that take part: no null id, vector or component, all finite.

    Vectors take part only in the table's most frequent length (the shorter of equals).  Repeated
    rows count once.
    """
    rows = df.select(F.col(vec_id).alias("vec_id"), vector.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    width = (rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.desc("n"), "d").first())
    return rows.filter(F.size("vec") == (width.d if width else 0))


def representatives(rows: DataFrame, k: int) -> DataFrame:
    """``(key, vec, ids)``: each distinct vector with its ``k + 1`` smallest ids; the smallest is its key.

    More ids of one vector than that cannot be among the k nearest of any query, as equal vectors
    tie and smaller ids come first.  The limit applies before the shuffle, so a vector shared by a
    third of all rows costs a few rows per task.
    """
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = rows.withColumn("rn", F.dense_rank().over(first)).filter(F.col("rn") <= k + 1)
    return (few.groupBy("vec").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
            .select(F.col("ids")[0].alias("key"), "vec", "ids"))


def queries(rows: DataFrame, reps: DataFrame, every: int) -> DataFrame:
    """``(query_id, key)`` of the rows whose id is divisible by ``every``."""
    asked = rows.filter(F.col("vec_id") % every == 0).distinct()
    return asked.join(reps.select("key", "vec"), "vec").select(F.col("vec_id").alias("query_id"), "key")


def nearest(found: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from ``(key, ids, score)``, a query itself left out.

    Per distinct query vector k + 1 candidates are kept, so that k remain without the query's own.
    """
    by_key = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    top = (found.select("key", "score", F.explode("ids").alias("vec_id"))
           .groupBy("key", "vec_id").agg(F.max("score").alias("score"))
           .withColumn("rn", F.row_number().over(by_key)).filter(F.col("rn") <= k + 1).drop("rn"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.join(top, "key").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return (pairs.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1) \
        if len(column) else np.zeros((0, 0), dtype)
