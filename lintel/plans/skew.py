"""Joins and ordered look-backs that stay spread out when one key is hot.

Rows are counted by buckets of the hashed key first, which mostly proves that there
is no hot key.  Else hot keys are found with a frequent-items sketch over the hashed key: one scan
of the key columns, no shuffle of keys, and every key that holds more than a
few thousandths of the rows is found.  Only keys with at least ``HOT_ROWS``
rows count, and never more than ``HOT_KEYS`` of them, so the list is safe to
broadcast.  The sketch only chooses which keys to spread; results never depend
on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

HOT_ROWS = 1_000_000
HOT_KEYS = 1_000
TRACKED_ITEMS = 4_096
MERGERS = 64
CODE_BUCKETS = 16_384
BROADCAST_ROWS = 100_000

_UNHASHABLE = (T.MapType, T.VariantType)

HotKeys = list[tuple[int, int]]


def checked_broadcast(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the table is small."""
    if table.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(table)
    return table


def key_code(df: DataFrame, keys: Sequence[str], like: DataFrame | None = None) -> Column:
    """Hash of the key, computed with the key types of ``like``."""
    types = {f.name: f.dataType for f in (like or df).schema.fields}
    return F.xxhash64(*[F.col(k).cast(types[k]) for k in keys])


def may_be_hot(df: DataFrame, key_lists: Sequence[Sequence[str]], min_rows: int = HOT_ROWS) -> bool:
    """Whether a key of ``min_rows`` rows is possible: some bucket of key hashes holds that many.

    Counting buckets costs a fraction of a sketch, and nearly all tables need no more than this.
    """
    bucket = F.explode(F.array(*[
        F.pmod(key_code(df, keys), F.lit(CODE_BUCKETS)).cast("int") * F.lit(len(key_lists)) + F.lit(i)
        for i, keys in enumerate(key_lists)])) if len(key_lists) > 1 else F.pmod(key_code(df, key_lists[0]), F.lit(CODE_BUCKETS))
    counts = df.select(bucket.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return (counts.agg(F.max("n")).first()[0] or 0) >= min_rows


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = HOT_ROWS) -> HotKeys:
    """``(hash of key, salts)`` of the hot keys; a salt is worth about ``min_rows`` rows."""
    if not may_be_hot(df, [keys], min_rows):
        return []
    codes = df.select(key_code(df, keys).alias("code"),
                      (F.spark_partition_id() % MERGERS).alias("merger"))
    sketches = codes.groupBy("merger").agg(
        F.expr(f"approx_top_k_accumulate(code, {TRACKED_ITEMS})").alias("sketch"))
    # grouped, as an empty table has no sketch to combine
    top = sketches.groupBy(F.lit(0).alias("all")).agg(F.expr(
        f"approx_top_k_estimate(approx_top_k_combine(sketch, {TRACKED_ITEMS}), {HOT_KEYS})").alias("top")).first()
    return [(t["item"], -(-t["count"] // min_rows) + 1) for t in (top["top"] if top else []) if t["count"] >= min_rows]


def _spread(df: DataFrame) -> Column:
    """A number that depends on the row alone, so a re-run task repeats it."""
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, _UNHASHABLE)]
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols])


def _with_salts(df: DataFrame, code: Column, hot: HotKeys) -> DataFrame:
    """Add ``_salts``: how many tasks the row's key is spread over, null unless hot."""
    table = df.sparkSession.createDataFrame(hot, "_code long, _salts long")
    return df.withColumn("_code", code).join(F.broadcast(table), "_code", "left").drop("_code")


def salted_lookup(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left",
                  hot: HotKeys | None = None, counted_on: DataFrame | None = None,
                  min_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join ``big`` to a table with few rows per key.

    Rows of a hot key are spread over as many tasks as its size asks for, and
    the few lookup rows of that key are repeated once per salt.  Null keys
    match nothing but are spread the same way instead of piling up in one task.
    Without a hot key this is a plain join.  ``counted_on`` is a cheaper table
    to look for hot keys in: one that has at least the rows of ``big`` under
    every key, such as the table ``big`` was filtered from.  ``hot`` are its hot
    keys, if they are known (``plans.hitters``), so nothing is scanned for them.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(big if counted_on is None else counted_on, keys, min_rows)
    if not hot:
        return big.join(lookup, keys, how)
    seen = big if counted_on is None else counted_on
    left = (
        _with_salts(big, key_code(big, keys, seen), hot)
        .withColumn("_salt", F.coalesce(F.pmod(_spread(big), F.col("_salts")), F.lit(0)))
        .drop("_salts")
    )
    right = (
        _with_salts(lookup.dropna(subset=keys), key_code(lookup, keys, seen), hot)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts") - 1, F.lit(0)))))
        .drop("_salts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def dealt_once(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> DataFrame:
    """Distinct rows with known ``keys``, ready for an inner ``salted_lookup`` by these keys.

    Without a hot key the rows are dealt by ``keys`` before they are made distinct, so the join
    that follows finds them in place.
    """
    known = df.dropna(subset=list(keys))
    return (known if hot else known.repartition(*keys)).distinct()


def split_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
              slices: Sequence[Column], min_rows: int = HOT_ROWS, hot: HotKeys | None = None) -> DataFrame:
    """Add struct ``_prev`` holding ``values`` of the previous row of the key.

    ``order`` must be a total order up to fully equal rows and the key columns
    must not be null.  A hot key is cut into ``slices`` -- expressions that
    never decrease along ``order``, such as the day and then the hour -- so no
    task sorts the whole key; the last row of each slice is carried to the
    next slice of the same key.  ``hot`` are the hot keys, if they are known.
    """
    keys, order = list(keys), list(order)
    if hot is None:
        hot = hot_keys(df, keys, min_rows)
    if not hot:
        whole = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("_prev", F.lag(F.struct(*values)).over(whole))
    sliced = (
        _with_salts(df, key_code(df, keys), hot)
        .withColumn("_slice", F.when(
            F.col("_salts").isNotNull(), F.struct(*[s.alias(f"s{i}") for i, s in enumerate(slices)])))
        .drop("_salts")
    )
    kept = F.struct(*values)
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    ends = (
        sliced.filter(F.col("_slice").isNotNull())
        .groupBy(*keys, "_slice")
        .agg(F.max_by(kept, F.struct(*order)).alias("_last"))
    )
    carried = ends.select(
        *keys, "_slice",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_slice")).alias("_carried"))
    return (
        sliced.withColumn("_inner", F.lag(kept).over(within))
        .join(carried, [*keys, "_slice"], "left")
        .withColumn("_prev", F.coalesce("_inner", "_carried"))
        .drop("_inner", "_carried", "_slice")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key.

    An aggregate rather than ``row_number``: every task reduces its own rows to
    one per key before the shuffle, so a hot key costs no more than any other.
    Ties fall to the remaining columns in name order.
    """
    keys, order = list(keys), list(order)
    rest = sorted(c for c in df.columns if c not in keys and c not in order)
    return (
        df.groupBy(*keys)
        .agg(F.max(F.struct(*order, *rest)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def spread_write(df: DataFrame, *partition_cols: str) -> DataFrame:
    """Rebalance before a partitioned write: few files, large partitions split."""
    return df.hint("rebalance", *[F.col(c) for c in partition_cols])
