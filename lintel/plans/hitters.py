"""Frequent join keys of a written table, kept next to it.

A table that several joins meet is scanned for hot keys once, for all its keys together, when it is
written; the joins then read a few kilobytes.  The scan reads the key columns alone.  It follows the write
instead of riding on it: an accumulator would send every task's sketch to the driver, which at a
million tasks is more than a driver holds, while here sketches are merged by tasks.

Each batch keeps its own sketches, so an appended batch never makes the table be scanned again, and a
batch that is written again replaces them.  What is tracked grows with the rows: a sketch of m items
finds every key that holds more than 3.5/m of the rows, so ``4 * rows / HOT_ROWS`` items find every hot
key up to 2.5 * 10^11 rows a batch, where the limit of a sketch is reached.  Hot keys only choose which keys
are spread; results never depend on them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lintel.plans.skew import HOT_ROWS, MERGERS, TRACKED_ITEMS, HotKeys, key_code, may_be_hot
from lintel.session import exists

MOST_TRACKED = 1_000_000
MOST_FOUND = 100_000


def _name(keys: Sequence[str]) -> str:
    return ",".join(keys)


def _beside(path: str) -> str:
    return f"{path.rstrip('/')}.hitters"


class Hitters:
    """Hot keys of one table by their columns, as ``salted_lookup`` and ``split_lag`` take them for ``hot``."""

    def __init__(self, found: dict[str, HotKeys]):
        self._found = found

    def of(self, keys: Sequence[str]) -> HotKeys:
        """Hot keys over ``keys``; a KeyError if the table was not sketched by them."""
        return self._found[_name(keys)]


def tracked_items(rows: int, min_rows: int = HOT_ROWS) -> int:
    """Items a sketch over ``rows`` rows has to track to find every key of ``min_rows`` rows."""
    return max(TRACKED_ITEMS, min(MOST_TRACKED, 4 * rows // min_rows))


def _sketches(df: DataFrame, key_lists: Iterable[Sequence[str]], tracked: int, min_rows: int | None = None) -> DataFrame | None:
    """``keys, sketch``: a bounded number of sketches for each list of keys, all from one scan.

    With ``min_rows`` None if a cheaper scan shows that no key has so many rows in ``df`` alone.
    """
    key_lists = [list(keys) for keys in key_lists]
    if min_rows is not None and not may_be_hot(df, key_lists, min_rows):
        return None
    codes = df.select(*[key_code(df, keys).alias(f"c{i}") for i, keys in enumerate(key_lists)],
                      (F.spark_partition_id() % MERGERS).alias("merger"))
    merged = codes.groupBy("merger").agg(*[
        F.expr(f"approx_top_k_accumulate(c{i}, {tracked})").alias(f"s{i}") for i in range(len(key_lists))])
    return merged.select(F.explode(F.array(*[
        F.struct(F.lit(_name(keys)).alias("keys"), F.col(f"s{i}").alias("sketch"))
        for i, keys in enumerate(key_lists)])).alias("s")).select("s.*")


def _estimate(sketches: DataFrame | None, names: Iterable[str], min_rows: int) -> Hitters:
    if sketches is None:
        return Hitters({name: [] for name in names})
    combined = sketches.groupBy("keys").agg(F.expr(
        f"approx_top_k_estimate(approx_top_k_combine(sketch, {MOST_TRACKED}), {MOST_FOUND})").alias("top"))
    hot = (combined.select("keys", F.explode("top").alias("t"))
           .filter(F.col("t.count") >= min_rows).select("keys", "t.item", "t.count"))
    found = {name: [] for name in names}
    for keys, item, count in hot.collect():
        found[keys].append((item, -(-count // min_rows) + 1))
    return Hitters(found)


def find_hitters(df: DataFrame, *key_lists: Sequence[str], rows: int = 0, min_rows: int = HOT_ROWS) -> Hitters:
    """Hot keys of a table for several joins, from one scan of its key columns.

    ``rows`` is about how many rows it has, if that is known.
    """
    return _estimate(_sketches(df, key_lists, tracked_items(rows, min_rows), min_rows), map(_name, key_lists), min_rows)


def keep_hitters(written: DataFrame, path: str, batch: str, *key_lists: Sequence[str], rows: int = 0,
                 min_rows: int = HOT_ROWS) -> None:
    """Sketch the rows of one written batch of the table at ``path``; a repeated batch replaces its sketches.

    Every batch has to be sketched by the same keys, null and empty batches included.
    """
    sketches = _sketches(written, key_lists, tracked_items(rows, min_rows))
    sketches.coalesce(1).write.mode("overwrite").parquet(f"{_beside(path)}/batch={batch}")


def write_keyed(df: DataFrame, path: str, batch: str, *key_lists: Sequence[str], min_rows: int = HOT_ROWS) -> None:
    """Write a batch of the table at ``path``, in its own folder, and its sketches; a repeated batch replaces both."""
    folder, seen = f"{path.rstrip('/')}/batch={batch}", Observation(f"rows-{batch}")
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    keep_hitters(written, path, batch, *key_lists, rows=seen.get["rows"], min_rows=min_rows)


def kept_hitters(spark: SparkSession, path: str, *key_lists: Sequence[str], min_rows: int = HOT_ROWS) -> Hitters:
    """Hot keys over all batches kept next to the table at ``path``; reads sketches, not the table."""
    if not exists(spark, _beside(path)):
        raise FileNotFoundError(f"no key sketches next to {path}")
    return _estimate(spark.read.parquet(_beside(path)), map(_name, key_lists), min_rows)
