"""Capability gaps: which firms have to send engineering out."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.patterns import is_commercial
from lintel.operators.validate import guarded
from lintel.plans.skew import HotKeys, dealt_once, hot_keys, salted_lookup
from lintel.schemas import PERMIT_KEY

FP_CONTRACTOR = ("FP_CONTRACTOR",)
ENGINEERING_CA = ("CA",)
FP_PE = ("PE_FP",)


def _holds(types: Sequence[str], active_only: bool = True) -> Column:
    held = F.col("license_type").isin(*types)
    return held & (F.lower("status") == "active") if active_only else held


def license_flags(licenses: DataFrame) -> DataFrame:
    """All three licence facts per company in one pass over the registry."""
    return (
        licenses.dropna(subset=["company_id"]).groupBy("company_id").agg(
            F.bool_or(_holds(FP_CONTRACTOR)).alias("is_fp_contractor"),
            F.bool_or(_holds(ENGINEERING_CA)).alias("has_engineering_ca"),
            F.bool_or(_holds(FP_PE)).alias("has_fp_pe_on_record"),
            F.min(F.struct((~_holds(FP_CONTRACTOR + ENGINEERING_CA)).alias("other"),
                           "license_number"))["license_number"].alias("main_license"))
    )


def _flag(companies: DataFrame, licenses: DataFrame, types: Sequence[str], name: str) -> DataFrame:
    holders = licenses.filter(_holds(types)).select("company_id").distinct().withColumn(name, F.lit(True))
    return (companies.join(holders, "company_id", "left")
            .withColumn(name, F.coalesce(name, F.lit(False))))


def flag_fp_contractor(companies: DataFrame, licenses: DataFrame) -> DataFrame:
    """Holds an active fire protection contractor licence."""
    return _flag(companies, licenses, FP_CONTRACTOR, "is_fp_contractor")


def flag_engineering_ca(companies: DataFrame, licenses: DataFrame) -> DataFrame:
    """Holds a Certificate of Authorization."""
    return _flag(companies, licenses, ENGINEERING_CA, "has_engineering_ca")


def flag_fp_pe(companies: DataFrame, licenses: DataFrame) -> DataFrame:
    """Has an engineer of the fire protection discipline on record."""
    return _flag(companies, licenses, FP_PE, "has_fp_pe_on_record")


def permit_volume_12mo(parties: DataFrame, permits: DataFrame, as_of: date,
                       by: Sequence[str] = (), hot: HotKeys | None = None) -> DataFrame:
    """Distinct commercial permits of the last twelve months per company; ``hot`` are the parties' hot permits."""
    day = F.col("applied_date")
    recent = (permits.filter((day > F.add_months(F.lit(as_of), -12)) & (day <= F.lit(as_of)))
              .filter(is_commercial(F.col("record_type"), F.col("description")))
              .select(*PERMIT_KEY, *by).distinct())
    if hot is None:
        hot = hot_keys(parties, PERMIT_KEY)
    named = dealt_once(parties.dropna(subset=["company_id"]).select("company_id", *PERMIT_KEY), PERMIT_KEY, hot)
    return (salted_lookup(named, recent, PERMIT_KEY, "inner", hot=hot, counted_on=parties)
            .groupBy("company_id", *by).agg(F.count(F.lit(1)).alias("permit_volume_12mo")))


def capability(companies: DataFrame, licenses: DataFrame, volume: DataFrame) -> DataFrame:
    """Companies with licence flags and permit volume; every side has one row per company."""
    flags = ["is_fp_contractor", "has_engineering_ca", "has_fp_pe_on_record"]
    return (
        companies.join(license_flags(licenses), "company_id", "left")
        .join(volume, "company_id", "left")
        .withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})
        .withColumn("permit_volume_12mo", F.coalesce("permit_volume_12mo", F.lit(0)))
    )


def on_list_a() -> Column:
    return (F.col("is_fp_contractor") & ~F.col("has_engineering_ca")
            & ~F.col("has_fp_pe_on_record") & (F.col("permit_volume_12mo") > 0))


def on_list_b() -> Column:
    return (F.col("has_engineering_ca") & ~F.col("has_fp_pe_on_record")
            & (F.col("permit_volume_12mo") > 0))


def target_list_a(flagged: DataFrame) -> DataFrame:
    """Active fire protection contractors with no CA, no FP engineer and recent permits."""
    return flagged.filter(on_list_a()).withColumn("list", F.lit("A"))


def target_list_b(flagged: DataFrame) -> DataFrame:
    """Firms with a CA and recent commercial permits but no FP engineer."""
    return flagged.filter(on_list_b()).withColumn("list", F.lit("B"))


def target_lists(flagged: DataFrame) -> DataFrame:
    """Both lists; a firm is on at most one because A requires what B forbids."""
    which = F.when(on_list_a(), F.lit("A")).when(on_list_b(), F.lit("B"))
    return flagged.withColumn("list", which).filter(F.col("list").isNotNull())


def coverage_guard(flagged: DataFrame, coverage: DataFrame, registries: Sequence[str]) -> DataFrame:
    """The same rows; the job fails when a registry behind a "has none" is missing or stale."""
    needed = coverage.filter(F.col("source").isin(*registries))
    usable = F.count(F.when(~F.col("coverage").isin("no rows", "stale"), 1))
    message = F.concat(F.lit("registries without usable data: "),
                       F.concat_ws(", ", F.array_sort(F.collect_set(
                           F.when(F.col("coverage").isin("no rows", "stale"), F.col("source"))))),
                       F.lit(f" of {', '.join(registries)}"))
    guard = needed.agg(F.when(usable < len(set(registries)), F.raise_error(message))
                       .otherwise(F.lit(True)).cast("boolean").alias("covered"))
    return guarded(flagged, guard)


REASONS = {
    "A": "active fire protection contractor, no certificate of authorization, no FP engineer on record",
    "B": "certificate of authorization and recent commercial permits, no FP engineer on record",
}


def targets(listed: DataFrame, limit: int = 50) -> DataFrame:
    """The report: busiest firms first, ties by id, with the reason in words."""
    reason = F.concat(
        F.when(F.col("list") == "A", F.lit(REASONS["A"])).otherwise(F.lit(REASONS["B"])),
        F.lit("; "), F.col("permit_volume_12mo").cast("string"), F.lit(" permits in 12 months"))
    return (
        listed.orderBy(F.desc("permit_volume_12mo"), "company_id").limit(limit)
        .select(F.col("canonical_name").alias("company"), "phone",
                F.col("main_license").alias("license"),
                F.col("permit_volume_12mo").alias("permit_count"), reason.alias("reason"))
    )
