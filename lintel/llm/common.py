"""Helpers shared by the operators of this package."""

from __future__ import annotations

import inspect
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in most operators here.
WORD = r"[^\x20\x09-\x0D]+"
ARROW_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Sorts a row without a doc_id behind every other row.
NO_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables.

    Tasks import this package.  A local session is told where it lies; on a cluster it is installed
    or sent with ``--py-files``, like any other.
    """
    context = spark.sparkContext
    if re.match(r"local(\[[^-]*\])?$", context.master):
        context.addFile(str(Path(__file__).resolve().parent.parent), recursive=True)
    if context.getConf().get(ARROW_BATCH) is None:  # rows here are whole texts: keep the batches for Python small
        spark.conf.set(ARROW_BATCH, "8m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: the size from which operators derive how many buckets they need."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_for(spark: SparkSession, size: int, bucket_bytes: int) -> int:
    """So many buckets that each holds about ``bucket_bytes``, and none of the cluster's tasks idles."""
    return max(shuffle_partitions(spark), -(-size // bucket_bytes))


def release() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks, other tasks need it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library; it decides by itself


def tidy(work):
    """``work``, a function for mapInArrow or applyInArrow, with ``release`` after each call."""
    if inspect.isgeneratorfunction(work):
        def run(batches):
            try:
                yield from work(batches)
            finally:
                release()
    elif work.__code__.co_argcount == 2:
        def run(first, second):
            try:
                return work(first, second)
            finally:
                release()
    else:
        def run(key, first, second):
            try:
                return work(key, first, second)
            finally:
                release()
    return run


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
