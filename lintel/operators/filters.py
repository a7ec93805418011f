"""Row filters over permits, reviews and licences."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions import patterns as P
from lintel.plans.skew import checked_broadcast


def filter_window(permits: DataFrame, since: date, until: date,
                  record_types: Sequence[str] | None = None) -> DataFrame:
    """Date-range search, optionally by record type."""
    kept = permits.filter(F.col("applied_date").between(F.lit(since), F.lit(until)))
    return kept.filter(F.col("record_type").isin(*record_types)) if record_types else kept


def classify_commercial(permits: DataFrame, strict: bool = True) -> DataFrame:
    """Add the rule that keeps or drops each permit."""
    return permits.withColumn(
        "matched_rule", P.commercial_rule(F.col("record_type"), F.col("description"), strict))


def commercial_only(permits: DataFrame, strict: bool = True) -> DataFrame:
    return classify_commercial(permits, strict).filter(F.col("matched_rule").startswith("include:"))


def niche_match(permits: DataFrame) -> DataFrame:
    """Permits in a high-value niche, with the niches they hit."""
    text = F.concat_ws(" ", *[c for c in ("occupancy_type", "record_type", "description")
                              if c in permits.columns])
    return (permits.withColumn("niches", P.niche_hits(text, F.col("square_footage")))
            .filter(F.size("niches") > 0))


def license_filter(licenses: DataFrame, types: Sequence[str] | None = None,
                   active_only: bool = True, discipline: str | None = None) -> DataFrame:
    kept = licenses.filter(F.col("license_type").isin(*types)) if types else licenses
    if active_only:
        kept = kept.filter(F.lower("status") == "active")
    return kept.filter(F.lower("discipline") == discipline.lower()) if discipline else kept


def with_jurisdiction(df: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """Rows of enabled jurisdictions with the jurisdiction's own columns."""
    enabled = jurisdictions.filter("enabled").drop("enabled")
    return df.join(checked_broadcast(enabled), "jurisdiction_id")


def by_county(df: DataFrame, jurisdictions: DataFrame, county: str) -> DataFrame:
    """Rows whose jurisdiction lies in the county."""
    chosen = jurisdictions.filter(F.lower("county") == county.lower()).select("jurisdiction_id", "county")
    return df.join(checked_broadcast(chosen), "jurisdiction_id")


def with_county(df: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    return df.join(checked_broadcast(jurisdictions.select("jurisdiction_id", "county")),
                   "jurisdiction_id")


def local_date(df: DataFrame, jurisdictions: DataFrame, instant: str, name: str) -> DataFrame:
    """Business date of a UTC instant in the jurisdiction's own time zone."""
    zones = checked_broadcast(jurisdictions.select("jurisdiction_id", "timezone"))
    return (df.join(zones, "jurisdiction_id")
            .withColumn(name, F.to_date(F.from_utc_timestamp(F.col(instant).cast("timestamp"),
                                                             F.col("timezone"))))
            .drop("timezone"))
