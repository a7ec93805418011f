"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.session import stored


def numbered(df: DataFrame, order: list[Column], name: str = "place", kind: str = "int") -> DataFrame:
    """``df`` with each row's place in ``order``, from 1, as ``kind`` (a table may have more rows than an int counts).

    Rows are dealt and sorted in ranges once and written with their place in the range, which is then shifted by the
    sizes of the ranges before it; the sizes are one number per range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # range above, place in it below
    ranges = stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", at)
                    .withColumns({"_range": F.shiftright("_at", 33).cast("int"), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
    sizes = {r["_range"]: r["n"] for r in ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    shifts, total = [], 0
    for part in sorted(sizes):
        shifts.append((part, total))
        total += sizes[part]
    before = spark.createDataFrame(shifts, "_range int, _before long")
    return (ranges.join(F.broadcast(before), "_range")
            .withColumn(name, (F.col("_at") + F.col("_before") + 1).cast(kind)).drop("_range", "_before", "_at"))
