"""A table of current state that a batch changes bucket by bucket.

Rows lie in a fixed number of buckets by a hash of their key.  A batch reads and writes only the
buckets its keys fall in, as a new version next to the old files, and then writes a manifest that names the valid
version of every bucket.  Readers follow the newest whole manifest, so a run that fails before it leaves the
state as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.history import fold_seen
from lintel.session import exists, stored

#: Buckets of a new table; the driver holds one small row for each.
BUCKETS = 4_096


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def state_version(spark: SparkSession, path: str) -> int | None:
    """The newest version whose manifest is whole."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/version=*/_SUCCESS")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root)
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or []), default=None)


def manifest(spark: SparkSession, path: str) -> dict[int, int]:
    """The valid version of each bucket that has rows."""
    version = state_version(spark, path)
    if version is None:
        return {}
    return {r["bucket"]: r["valid"] for r in spark.read.parquet(f"{path}/manifest/version={version}").collect()}


def _files(spark: SparkSession, path: str, valid: dict[int, int]) -> DataFrame | None:
    if not valid:
        return None
    folders = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(valid.items())]
    return spark.read.option("basePath", f"{path}/data").parquet(*folders).drop("version")


def read_state(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the current state; None before the first batch."""
    rows = _files(spark, path, manifest(spark, path))
    return None if rows is None else rows.drop("bucket")


def merge_into_state(batch: DataFrame, path: str, key: Sequence[str], version: int, order: Sequence[str] = ("observed_at",),
                     seen: str = "observed_at", buckets: int = BUCKETS) -> list[int]:
    """Fold a batch into the state at ``path``; returns the buckets that were written.

    ``version`` numbers the batches upwards.  One that the state already holds changes nothing, so
    a batch may be repeated.  A table keeps the number of buckets it was begun with.
    """
    spark, key = batch.sparkSession, list(key)
    newest = state_version(spark, path)
    if newest is not None and version <= newest:
        return []
    valid = manifest(spark, path)
    if newest is not None:
        buckets = spark.read.parquet(f"{path}/manifest/version={newest}").agg(F.max("buckets")).first()[0] or buckets
    landed = stored(batch.withColumns({"first_seen_at": F.col(seen), "last_seen_at": F.col(seen), "bucket": _bucket(key, buckets)}), "landed")
    touched = sorted(r["bucket"] for r in landed.select("bucket").distinct().collect())  # ``buckets`` rows at most
    old = _files(spark, path, {b: valid[b] for b in touched if b in valid})
    both = landed if old is None else landed.unionByName(old.select(*landed.columns))
    folded = fold_seen(both.repartition("bucket"), ["bucket", *key], order)
    folded.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    rows = [(b, v, buckets) for b, v in sorted((valid | dict.fromkeys(touched, version)).items())]
    (spark.createDataFrame(rows, "bucket int, valid long, buckets int").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/manifest/version={version}"))
    return touched


def unused_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """``(version, bucket)`` of the data folders that the newest manifest no longer names."""
    if not exists(spark, f"{path}/data"):
        return None
    have = spark.read.parquet(f"{path}/data").select(F.col("version").cast("long"), "bucket").distinct()
    named = spark.createDataFrame([(v, b) for b, v in manifest(spark, path).items()], "version long, bucket int")
    return have.join(named, ["version", "bucket"], "left_anti")
