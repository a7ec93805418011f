"""Lead candidates, points and scores.

Every ``pts_`` function is a column over the facts of one lead.  Facts are
gathered per permit and per company first, each side one row per key, so a lead
meets two lookups whatever the number of signals.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions import patterns as P
from lintel.functions import points as S
from lintel.plans.skew import HotKeys, dealt_once, hot_keys, salted_lookup
from lintel.schemas import PERMIT_KEY

Weights = Mapping[str, int]
SIGNALS = ["pts_rejection", "pts_repeat", "pts_target", "pts_niche", "pts_valuation",
           "pts_overloaded", "pts_recency", "pts_contacted"]


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0)).cast(S.RECENCY_TYPE)


def pts_rejection(weights: Weights, as_of: date, last_adverse: str = "last_adverse_on") -> Column:
    age = S.days_before(F.col(last_adverse), F.lit(as_of))
    return _points(age <= S.REJECTION_DAYS, weights["recent_rejection"])


def pts_repeat(weights: Weights, cycles: str = "fire_cycles") -> Column:
    return _points(F.col(cycles) >= 2, weights["repeat_cycle"])


def pts_target(weights: Weights, which: str = "list") -> Column:
    return (F.when(F.col(which) == "A", F.lit(weights["target_list_a"]))
            .when(F.col(which) == "B", F.lit(weights["target_list_b"]))
            .otherwise(F.lit(0)).cast(S.RECENCY_TYPE))


def pts_niche(weights: Weights, niches: str = "niches") -> Column:
    """Once per lead, however many niches the permit is in."""
    return _points(F.size(niches) > 0, weights["niche"])


def pts_valuation(weights: Weights, valuation: str = "valuation") -> Column:
    band = S.valuation_band(F.col(valuation))
    return (F.when(band == "high", F.lit(weights["valuation_high"]))
            .when(band == "mid", F.lit(weights["valuation_mid"]))
            .otherwise(F.lit(0)).cast(S.RECENCY_TYPE))


def pts_overloaded(weights: Weights, overloaded: str = "relies_on_overloaded") -> Column:
    return _points(F.col(overloaded), weights["overloaded_engineer"])


def pts_recency(weights: Weights, as_of: date, applied: str = "applied_date") -> Column:
    share = S.recency_share(F.col(applied), F.lit(as_of))
    return (share * F.lit(weights["recent_application"])).cast(S.RECENCY_TYPE)


def pts_contacted(weights: Weights, as_of: date, contacted: str = "last_contact_on") -> Column:
    age = S.days_before(F.col(contacted), F.lit(as_of))
    return _points(age <= S.CONTACT_DAYS, weights["recently_contacted"])


def overloaded_reliance(sole: DataFrame, overloaded: DataFrame) -> DataFrame:
    """Contractors whose only sealing engineer is overloaded."""
    return (sole.join(overloaded.select("license_key"), "license_key", "left_semi")
            .select("company_id", F.lit(True).alias("relies_on_overloaded")))


def last_contacts(contacts: DataFrame, as_of: date) -> DataFrame:
    """Latest contact up to ``as_of`` per company."""
    return (contacts.filter(F.col("contacted_on") <= F.lit(as_of))
            .groupBy("company_id").agg(F.max("contacted_on").alias("last_contact_on")))


def permit_facts(permits: DataFrame, review_status: DataFrame, hot: DataFrame) -> DataFrame:
    """What scoring needs to know of a permit, one row each."""
    text = F.concat_ws(" ", *[c for c in ("occupancy_type", "record_type", "description")
                              if c in permits.columns])
    alerted = hot.select(*PERMIT_KEY).distinct().withColumn("is_hot", F.lit(True))
    return (
        permits.select(
            *PERMIT_KEY, "applied_date", "valuation",
            P.niche_hits(text, F.col("square_footage")).alias("niches"),
            P.is_commercial(F.col("record_type"), F.col("description")).alias("is_commercial"))
        .join(review_status.select(*PERMIT_KEY, "fire_cycles", "last_adverse_on"), PERMIT_KEY, "left")
        .join(alerted, PERMIT_KEY, "left")
        .withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    )


def company_facts(listed: DataFrame, reliance: DataFrame, contacts: DataFrame) -> DataFrame:
    """What scoring needs to know of a company, one row each."""
    return (
        listed.select("company_id", "list")
        .join(reliance, "company_id", "full_outer")
        .join(contacts, "company_id", "full_outer")
    )


def lead_candidates(facts: DataFrame, parties: DataFrame, listed: DataFrame,
                    hot: HotKeys | None = None) -> DataFrame:
    """Companies on a HOT or commercial permit, and listed companies without one.

    One row per company and permit, permit null for a listed company that is on
    none of them.  ``hot`` are the parties' hot permits, if known.
    """
    worth = facts.filter(F.col("is_hot") | F.col("is_commercial"))
    if hot is None:
        hot = hot_keys(parties, PERMIT_KEY)
    named = dealt_once(parties.dropna(subset=["company_id"]).select("company_id", *PERMIT_KEY), PERMIT_KEY, hot)
    on_permit = salted_lookup(named, worth, PERMIT_KEY, "inner", hot=hot, counted_on=parties)
    alone = listed.select("company_id").distinct().join(
        on_permit.select("company_id").distinct(), "company_id", "left_anti")
    return on_permit.unionByName(alone, allowMissingColumns=True)


def score_leads(candidates: DataFrame, companies: DataFrame, weights: Weights, as_of: date,
                counted_on: DataFrame | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Points per signal, their sum, and a breakdown that explains the sum.

    ``hot`` are the hot companies of ``counted_on``, if known.
    """
    by_permit = {  # before the rows are dealt by company, so that points travel and not what they come from
        "pts_rejection": pts_rejection(weights, as_of), "pts_repeat": pts_repeat(weights), "pts_niche": pts_niche(weights),
        "pts_valuation": pts_valuation(weights), "pts_recency": pts_recency(weights, as_of)}
    slim = candidates.select("company_id", *PERMIT_KEY, "is_hot", *(points.alias(name) for name, points in by_permit.items()))
    facts = salted_lookup(slim, companies, ["company_id"], "left", hot=hot, counted_on=counted_on)
    pointed = facts.withColumns({
        "pts_target": pts_target(weights), "pts_overloaded": pts_overloaded(weights),
        "pts_contacted": pts_contacted(weights, as_of),
    })
    total = sum((F.col(s) for s in SIGNALS[1:]), F.col(SIGNALS[0]))
    breakdown = F.to_json(F.struct(*[F.col(s) for s in SIGNALS]))
    return (pointed.withColumn("score", total.cast(S.RECENCY_TYPE))
            .withColumn("score_breakdown", breakdown)
            .select("company_id", *PERMIT_KEY, "score", *SIGNALS, "score_breakdown", "is_hot", "list"))


def with_next_action(leads: DataFrame) -> DataFrame:
    """Stage and next action of a lead that has none yet."""
    action = (F.when(F.col("pts_contacted") < 0, F.lit("wait: contacted lately"))
              .when(F.col("pts_rejection") > 0, F.lit("call: recent fire review rejection"))
              .when(F.col("pts_repeat") > 0, F.lit("call: repeat fire review"))
              .when(F.col("pts_target") > 0, F.lit("introduce: needs outside sealing"))
              .otherwise(F.lit("watch")))
    return leads.withColumns({"stage": F.lit("new"), "next_action": action})


def actionable(leads: DataFrame, as_of: date) -> DataFrame:
    """Leads that are not snoozed beyond ``as_of``."""
    return leads.filter(F.col("snoozed_until").isNull() | (F.col("snoozed_until") <= F.lit(as_of)))


def top_leads(leads: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """Highest scores of the run, or per group; ties by company and permit."""
    order = [F.desc("score"), F.asc("company_id"), *[F.asc_nulls_first(c) for c in PERMIT_KEY]]
    if by is None:
        return leads.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return leads.withColumn("place", place).filter(F.col("place") <= k)


def score_explain(leads: DataFrame) -> DataFrame:
    """The breakdown as rows, one per signal that counted."""
    key = ["company_id", *PERMIT_KEY]
    return (leads.select(*key, *SIGNALS)
            .unpivot(key, SIGNALS, "signal", "points").filter("points <> 0"))
