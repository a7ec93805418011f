"""Counts kept per batch, so that turnaround and coverage never read the history again.

A batch adds a few rows, one per jurisdiction and number of days or one per source, in its own folder.  Batches hold
different rows, as snapshots do; one that is loaded again replaces its own counts.  What is read grows with
batches times groups, not with rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.operators.history import coverage_of, source_counts
from lintel.operators.reviews import baseline_of, turnaround_counts
from lintel.session import exists

#: Read with a fixed schema: a path without batches, or with empty ones, is a table without rows.
_SOURCES = T.StructType([T.StructField("source", T.StringType()), T.StructField("rows", T.LongType()),
                         T.StructField("newest", T.DateType())])


def _turnaround_schema(reviews: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("jurisdiction_id", reviews.schema["jurisdiction_id"].dataType),
                         T.StructField("days", T.IntegerType()), T.StructField("n", T.LongType())])


def _put(counts: DataFrame, path: str, batch: str) -> None:
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def _all(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def add_turnaround(reviews: DataFrame, path: str, batch: str) -> None:
    """Keep a batch's completed fire reviews per jurisdiction and number of days."""
    _put(turnaround_counts(reviews), path, batch)


def kept_baseline(reviews: DataFrame, path: str) -> DataFrame:
    """``turnaround_baseline`` over all batches kept at ``path``; ``reviews`` only lends its types and is not read."""
    return baseline_of(_all(reviews.sparkSession, path, _turnaround_schema(reviews)))


def add_sources(landed: DataFrame, path: str, batch: str) -> None:
    """Keep a batch's rows and newest day per source."""
    _put(source_counts(landed.withColumn("landed_on", F.col("landed_on").cast("date"))), path, batch)


def kept_coverage(expected: DataFrame, path: str, as_of: date, max_age_days: int = 30) -> DataFrame:
    """``source_coverage`` over all batches kept at ``path``."""
    return coverage_of(expected, _all(expected.sparkSession, path, _SOURCES), as_of, max_age_days)
