"""Whole jobs: harvest, monitor, targets, seals, leads and digest.

Each stage that several later stages read is written to the shared folder once
(``stored``), the way the tables of the data model are kept between runs.

A job that meets a table under several keys takes its ``hitters`` (``plans.hitters``): the hot keys kept with
the table by ``keep_hitters`` under REVIEW_KEYS, PARTY_KEYS or SEAL_KEYS.  Without them it looks for hot keys itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators import capability, filters, history, reports, resolve, reviews, scoring, seals
from lintel.operators.validate import RowCountCheck, validate
from lintel.plans.hitters import Hitters, find_hitters
from lintel.schemas import PERMIT_KEY, PERMIT_RULES, REVIEW_KEY, FieldRule
from lintel.session import exists, stored

REVIEW_KEYS = [REVIEW_KEY]
PARTY_KEYS = [PERMIT_KEY, ["company_id"]]
SEAL_KEYS = [["license_key"], ["document_id"]]


def harvest(landed: DataFrame, path: str, batch: str, rules: Sequence[FieldRule] = PERMIT_RULES,
            label: str = "harvest") -> DataFrame:
    """Validate landed permits, keep commercial work, append the snapshot; returns the rejects.

    Fails when nothing valid has landed: an empty harvest never looks like a good one.
    """
    accepted, rejects = validate(landed, rules)
    checked = RowCountCheck(accepted, label)
    history.write_snapshot(filters.commercial_only(checked.df), path, batch)
    checked.verify()
    return rejects


def monitor(snapshots: DataFrame, as_of: date, alerts: DataFrame | None = None,
            hitters: Hitters | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """New HOT signals of the review snapshots; ``alerts`` is everything sent before, ``baseline`` a kept turnaround."""
    hot = hitters and hitters.of(REVIEW_KEY)
    return stored(reviews.hot_signals(snapshots, as_of, alerts, hot, baseline), "hot")


def alert_history(spark: SparkSession, path: str, before: date | None = None) -> DataFrame | None:
    """Every cycle that the runs kept at ``path`` have alerted, None if there are none.

    ``before`` leaves out later runs.
    """
    if not exists(spark, path):
        return None
    runs = spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("date"))
    if before is not None:
        runs = runs.filter(F.col("run_date") < F.lit(before))
    return reviews.fold_runs(runs, "run_date")


def monitor_run(snapshots: DataFrame, as_of: date, path: str, baseline: DataFrame | None = None) -> DataFrame:
    """The monitor of one day, with the history of alerts kept at ``path``: returns the new alerts.

    A run adds its signals as its own partition, those already sent included, whose reasons are folded into the history.
    Nothing before is written again, and a run that is repeated replaces its own partition and
    looks only at runs before it, so it gives the same alerts again and none twice.
    """
    spark = snapshots.sparkSession
    before = alert_history(spark, path, as_of)
    picked = stored(reviews.hot_signals(snapshots, as_of, baseline=baseline), "picked")
    new = picked if before is None else stored(reviews.not_sent(picked, before), "new-alerts")
    picked.write.mode("overwrite").parquet(f"{path}/run_date={as_of.isoformat()}")
    return new


def target_firms(companies: DataFrame, licenses: DataFrame, parties: DataFrame, permits: DataFrame,
                 as_of: date, coverage: DataFrame, registries: Sequence[str],
                 jurisdictions: DataFrame | None = None, county: str | None = None,
               hitters: Hitters | None = None) -> DataFrame:
    """Firms on list A or B, optionally by permits of one county; ``hitters`` are those of ``parties``.

    The job refuses to call a licence missing while a registry behind it is empty or stale.
    """
    if county is not None:
        permits = filters.by_county(permits, jurisdictions, county)
    volume = capability.permit_volume_12mo(parties, permits, as_of, hot=hitters and hitters.of(PERMIT_KEY))
    flagged = capability.capability(companies, licenses, volume)
    flagged = capability.coverage_guard(flagged, coverage, registries)
    return stored(capability.target_lists(flagged), "targets")


def companies_of(members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clustered members, companies, and the pairs a person has to look at."""
    clustered, queue = resolve.resolve_members(members)
    clustered = stored(clustered, "members")
    return clustered, resolve.build_company(clustered), queue


def seal_index(candidates: DataFrame, licenses: DataFrame, documents: DataFrame,
               permits: DataFrame, jurisdictions: DataFrame, hitters: Hitters | None = None) -> DataFrame:
    """Validated seals with permit, date and county; a seal dates from its permit's issue, else from the download.

    ``hitters`` are those of ``candidates`` with their ``license_key``; without them one scan finds both keys'.
    """
    if hitters is None:
        hitters = find_hitters(seals.with_license_key(candidates), *SEAL_KEYS)
    by_license, by_document = (hitters.of(keys) for keys in SEAL_KEYS)
    checked = seals.validate_seal(seals.best_method(candidates), licenses, counted_on=candidates, hot=by_license)
    dated = seals.dated_documents(documents, permits)
    known = seals.with_permit(checked.filter("validated"), dated, counted_on=candidates, hot=by_document)
    return stored(filters.with_county(known, jurisdictions), "seals")


def reliance(index: DataFrame, parties: DataFrame, as_of: date, limit: int) -> DataFrame:
    """Contractors that rely on one overloaded engineer."""
    edges = seals.engineer_client_map(index, parties, ["contractor"])
    return scoring.overloaded_reliance(seals.sole_engineer_contractors(edges),
                                       seals.overloaded_engineers(index, as_of, limit))


def lead_facts(permits: DataFrame, snapshots: DataFrame, hot: DataFrame) -> DataFrame:
    return stored(scoring.permit_facts(permits, reviews.permit_review_status(snapshots), hot), "facts")


def score(facts: DataFrame, parties: DataFrame, listed: DataFrame, relying: DataFrame,
          contacts: DataFrame, weights: Mapping[str, int], as_of: date,
          hitters: Hitters | None = None) -> DataFrame:
    """Scored leads of a run; store them if several steps read them.  ``hitters`` are those of ``parties``."""
    if hitters is None:
        hitters = find_hitters(parties, *PARTY_KEYS)
    companies = scoring.company_facts(listed, relying, scoring.last_contacts(contacts, as_of))
    candidates = scoring.lead_candidates(facts, parties, listed, hot=hitters.of(PERMIT_KEY))
    return scoring.score_leads(candidates, companies, weights, as_of, counted_on=parties, hot=hitters.of(["company_id"]))


def digest(run_date: date, hot: DataFrame, permits: DataFrame, leads: DataFrame, listed: DataFrame,
           earlier_permits: DataFrame, earlier_targets: DataFrame,
           min_score: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines of the daily brief, and the run's permits and targets to be kept for the next one.

    ``earlier_permits`` and ``earlier_targets`` are all such rows of former runs.  What is kept is just
    what the lines show.
    """
    new_leads = stored(reports.digest_new_leads(leads, earlier_permits, min_score), "new-leads")
    new_targets = stored(reports.digest_new_targets(listed, earlier_targets), "new-targets")
    lines = reports.digest_lines(run_date, reports.digest_hot(hot, permits), new_leads, new_targets)
    return lines, *digest_run_rows(run_date, new_leads, new_targets)


def digest_run_rows(run_date: date, new_leads: DataFrame, new_targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a run has shown, in the columns that the next run's "new" rules read."""
    day = F.lit(run_date).alias("run_date")
    return (new_leads.select(day, *PERMIT_KEY).distinct(), new_targets.select(day, "company_id", "list").distinct())
