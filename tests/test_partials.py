"""Kept counts give what a run over everything gives, batch after batch."""

from datetime import date

from pyspark.sql import functions as F

from lintel.operators import history, partials, reviews
from lintel.session import scratch_path

SCHEMA = "jurisdiction_id int, department string, status string, opened_on date, status_date date"


def review_rows(spark, rows=400):
    days = (F.col("id") * 7 % 23).cast("int")
    return spark.range(rows).select(
        "id", (F.col("id") % 3).cast("int").alias("jurisdiction_id"),
        F.when(F.col("id") % 5 == 0, F.lit("Zoning")).otherwise(F.lit("Fire Marshal")).alias("department"),
        F.when(F.col("id") % 4 == 0, F.lit("In Review")).otherwise(F.lit("Approved")).alias("status"),
        F.lit(date(2001, 1, 1)).alias("opened_on"), F.date_add(F.lit(date(2001, 1, 1)), days - 2).alias("status_date"))


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def test_turnaround_after_every_batch(spark):
    rows, path = review_rows(spark), scratch_path(spark, "turnaround")
    assert partials.kept_baseline(rows, path).count() == 0
    for batch in range(5):
        partials.add_turnaround(rows.filter(F.col("id") % 5 == batch), path, str(batch))
        same(partials.kept_baseline(rows, path), reviews.turnaround_baseline(rows.filter(F.col("id") % 5 <= batch)))
    partials.add_turnaround(rows.filter(F.col("id") % 5 == 2), path, "2")
    partials.add_turnaround(rows.limit(0), path, "empty")
    same(partials.kept_baseline(rows, path), reviews.turnaround_baseline(rows))


def test_null_dates_and_jurisdictions(spark):
    rows = spark.createDataFrame(
        [(None, "Fire", "Approved", date(2001, 1, 1), date(2001, 1, 9)), (1, "Fire", "Approved", None, date(2001, 1, 9)),
         (1, None, "Approved", date(2001, 1, 1), date(2001, 1, 9)), (1, "Fire", None, date(2001, 1, 1), date(2001, 1, 4))], SCHEMA)
    path = scratch_path(spark, "turnaround")
    partials.add_turnaround(rows, path, "1")
    same(partials.kept_baseline(rows, path), reviews.turnaround_baseline(rows))


def test_coverage_after_every_batch(spark):
    landed = spark.range(100).select(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"),
        F.date_add(F.lit(date(2001, 1, 1)), F.col("id").cast("int")).alias("landed_on"))
    expected = spark.createDataFrame([(f"s{i}", i != 1) for i in range(6)], "source string, source_verified boolean")
    path, day = scratch_path(spark, "sources"), date(2001, 4, 20)
    same(partials.kept_coverage(expected, path, day), history.source_coverage(expected, landed.limit(0), day))
    for batch in (0, 1, 2, 1):
        partials.add_sources(landed.filter(F.dayofmonth("landed_on") % 3 == batch), path, str(batch))
    same(partials.kept_coverage(expected, path, day), history.source_coverage(expected, landed, day))


def test_the_monitor_takes_a_kept_baseline(spark):
    rows = review_rows(spark).drop("id").withColumns({
        "record_number": F.lit("A"), "cycle_number": F.lit(1), "reviewer_name": F.lit("r"), "due_date": F.lit(None).cast("date"),
        "comment_text": F.lit("c"), "observed_at": F.col("status_date").cast("timestamp")})
    path = scratch_path(spark, "turnaround")
    partials.add_turnaround(rows, path, "1")
    kept = partials.kept_baseline(rows, path)
    same(reviews.hot_signals(rows, date(2001, 8, 1), baseline=kept), reviews.hot_signals(rows, date(2001, 8, 1)))
