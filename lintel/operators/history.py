"""Snapshots, upserts, crawl plans and source coverage."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.plans.skew import checked_broadcast, salted_lookup, spread_write
from lintel.schemas import PERMIT_KEY


def current_state(snapshots: DataFrame, key: Sequence[str], order: Sequence[str] = ("observed_at",),
                  seen: str = "observed_at") -> DataFrame:
    """Latest row per key with first and last time seen, in one aggregation."""
    key, order = list(key), list(order)
    rest = sorted(c for c in snapshots.columns if c not in key and c not in order)
    return (
        snapshots.groupBy(*key)
        .agg(F.max(F.struct(*order, *rest)).alias("_row"),
             F.min(seen).alias("first_seen_at"), F.max(seen).alias("last_seen_at"))
        .select(*key, "_row.*", "first_seen_at", "last_seen_at")
    )


def merge_batch(current: DataFrame, batch: DataFrame, key: Sequence[str],
                order: Sequence[str] = ("observed_at",), seen: str = "observed_at") -> DataFrame:
    """Upsert a batch into current state; seen times only ever widen.

    Replaying a batch changes nothing, so a re-run after a failure is safe.
    """
    landed = batch.withColumns({"first_seen_at": F.col(seen), "last_seen_at": F.col(seen)})
    return fold_seen(current.unionByName(landed), key, order)


def fold_seen(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key of rows that carry ``first_seen_at`` and ``last_seen_at``."""
    key, order, times = list(key), list(order), ("first_seen_at", "last_seen_at")
    rest = sorted(c for c in rows.columns if c not in key and c not in order and c not in times)
    return (
        rows.groupBy(*key)
        .agg(F.max(F.struct(*order, *rest)).alias("_row"),
             F.min("first_seen_at").alias("first_seen_at"),
             F.max("last_seen_at").alias("last_seen_at"))
        .select(*key, "_row.*", "first_seen_at", "last_seen_at")
    )


def advance_watermark(watermark: DataFrame, batch: DataFrame, landed: str = "applied_date") -> DataFrame:
    """Latest landed date per jurisdiction; never moves back."""
    seen = batch.select("jurisdiction_id", F.col(landed).alias("landed_through"))
    return (watermark.select("jurisdiction_id", "landed_through").unionByName(seen)
            .groupBy("jurisdiction_id").agg(F.max("landed_through").alias("landed_through")))


def with_touched(permits: DataFrame, reviews: DataFrame, changed: str = "changed_on") -> DataFrame:
    """``permits`` with ``touched_on``: the later of the last status change and the last review status."""
    last = reviews.groupBy(*PERMIT_KEY).agg(F.max("status_date").alias("_reviewed"))
    return (salted_lookup(permits, last, PERMIT_KEY, "left", hot=[])
            .withColumn("touched_on", F.greatest(F.col(changed), F.col("_reviewed"))).drop("_reviewed"))


def daily_plan(permits: DataFrame, as_of: date, closed: Sequence[str],
               touched: str = "touched_on", pull_days: int = 7, recheck_days: int = 90) -> DataFrame:
    """Permits to fetch today: recent ones, and open ones touched lately.

    One pass: each permit gets the reason it is on the plan.
    """
    recent = F.col("applied_date").between(F.date_sub(F.lit(as_of), pull_days), F.lit(as_of))
    still_open = F.col("finaled_date").isNull() & ~F.col("status").isin(*closed)
    stirred = F.col(touched).between(F.date_sub(F.lit(as_of), recheck_days), F.lit(as_of))
    reason = F.when(recent, F.lit("recent")).when(still_open & stirred, F.lit("recheck"))
    return permits.withColumn("plan_reason", reason).filter(F.col("plan_reason").isNotNull())


def backfill_plan(jurisdictions: DataFrame, since: date, until: date, done: DataFrame) -> DataFrame:
    """Days still to pull per enabled jurisdiction."""
    days = (jurisdictions.filter("enabled")
            .select("jurisdiction_id",
                    F.explode(F.sequence(F.lit(since), F.lit(until))).alias("pull_date")))
    finished = done.select("jurisdiction_id", "pull_date").distinct()
    return days.join(finished, ["jurisdiction_id", "pull_date"], "left_anti")


def needs_fetch(stubs: DataFrame, cache: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stubs that are new or whose status differs from the cached one."""
    known = cache.select(*key, F.col("status").alias("cached_status"), F.lit(True).alias("_known"))
    joined = salted_lookup(stubs, known, key, "left")
    return (
        joined.filter(F.col("_known").isNull() | ~F.col("status").eqNullSafe(F.col("cached_status")))
        .withColumn("fetch_reason", F.when(F.col("_known").isNull(), F.lit("new"))
                    .otherwise(F.lit("status_changed")))
        .drop("_known")
    )


def pacing_audit(fetch_log: DataFrame, default_gap: float = 2.0,
                 limits: DataFrame | None = None) -> DataFrame:
    """Requests that followed another request to the same host too soon.

    Few hosts carry the whole log, so each host is cut into time slots.  Inside
    a slot the previous request is a plain look-back; the first request of a
    slot looks at the latest request of earlier slots, taken from one row per
    host and slot.
    """
    slot = fetch_log.withColumn("_slot", F.date_trunc("minute", F.col("ts")))
    within = Window.partitionBy("host", "_slot").orderBy("ts", "request_id")
    ends = slot.groupBy("host", "_slot").agg(F.max("ts").alias("_end"))
    carried = ends.select(
        "host", "_slot",
        F.lag("_end").over(Window.partitionBy("host").orderBy("_slot")).alias("_carried"))
    paced = (
        slot.withColumn("_inner", F.lag("ts").over(within))
        .join(carried, ["host", "_slot"], "left")
        .withColumn("previous_ts", F.coalesce("_inner", "_carried"))
        .drop("_inner", "_carried", "_slot")
    )
    if limits is not None:
        paced = (paced.join(checked_broadcast(limits.select("host", "gap_seconds")), "host", "left")
                 .withColumn("gap_seconds", F.coalesce("gap_seconds", F.lit(default_gap))))
    else:
        paced = paced.withColumn("gap_seconds", F.lit(default_gap))
    gap = F.timestamp_diff("MICROSECOND", F.col("previous_ts"), F.col("ts")) / F.lit(1e6)
    return paced.withColumn("gap", gap).filter(F.col("gap") < F.col("gap_seconds"))


def source_counts(landed: DataFrame) -> DataFrame:
    """Rows and newest day per source; counts of disjoint batches add up."""
    return landed.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.max("landed_on").alias("newest"))


def source_coverage(expected: DataFrame, landed: DataFrame, as_of: date, max_age_days: int = 30) -> DataFrame:
    """What each expected source has really delivered, said plainly."""
    return coverage_of(expected, source_counts(landed), as_of, max_age_days)


def coverage_of(expected: DataFrame, counts: DataFrame, as_of: date, max_age_days: int = 30) -> DataFrame:
    """``source_coverage`` from ``source_counts``, of one batch or of many."""
    seen = counts.groupBy("source").agg(F.sum("rows").alias("rows"), F.max("newest").alias("newest"))
    return (
        expected.join(seen, "source", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
        .withColumn("age_days", F.datediff(F.lit(as_of), "newest"))
        .withColumn("coverage", F.when(F.col("rows") == 0, F.lit("no rows"))
                    .when(F.col("age_days") > max_age_days, F.lit("stale"))
                    .when(~F.col("source_verified"), F.lit("unverified"))
                    .otherwise(F.lit("ok")))
    )


def write_snapshot(df: DataFrame, path: str, batch: str, observed: str = "observed_at") -> None:
    """Append a batch to the snapshots by jurisdiction and day.

    A re-run of the same batch replaces what it wrote before and nothing else,
    so two batches of one day stand side by side.
    """
    dated = df.withColumns({"observed_on": F.to_date(observed), "batch": F.lit(batch)})
    (spread_write(dated, "jurisdiction_id", "observed_on")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("jurisdiction_id", "observed_on", "batch").parquet(path))
