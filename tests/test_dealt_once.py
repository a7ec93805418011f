"""Rows that several steps need by one key are dealt once, with the rows that the single steps give."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

from lintel.operators import capability, reviews, scoring, seals
from lintel.schemas import PERMIT_KEY

AS_OF = date(2026, 6, 20)
REVIEW = ("jurisdiction_id int, record_number long, cycle_number int, department string, reviewer_name string, "
          "status string, status_date date, due_date date, opened_on date, comment_text string, observed_at timestamp")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"Exchange (hash|range|round|Single)", plan))


def rows(df):
    return sorted(map(repr, df.collect()))


def some_reviews(spark):
    dice = random.Random(3)
    first = date(2026, 6, 1)

    def day():
        return dice.choice([None, *(first + timedelta(days=d) for d in range(8))])

    table = [(dice.choice([1, 2]), dice.choice([None, 5, 6, 7]), dice.choice([None, 1, 2, 3]),
              dice.choice(["Fire Marshal", "Life Safety", "Zoning"]), dice.choice([None, "a", "b"]),
              dice.choice([None, "Rejected", "Denied", "Approved", "In Review", "Pending"]), day(), day(), day(),
              dice.choice([None, "x", "y"]), dice.choice([None, datetime(2026, 6, 1, 5), datetime(2026, 6, 2, 5)]))
             for _ in range(600)]
    return spark.createDataFrame(table + table[:60], REVIEW)


def test_signals_at_once_are_those_of_the_rules(spark):
    fire = some_reviews(spark).filter("department <> 'Zoning'")
    baseline = spark.createDataFrame([(1, 3.0, 9.0, 40)], "jurisdiction_id int, p50_days double, p90_days double, completed long")
    rejected = reviews.hot_rejections(reviews.status_transitions(fire, hot=[]))
    stalled = reviews.stalled_signals(reviews.stalled_reviews(fire, baseline, AS_OF), AS_OF)
    alone = rejected.unionByName(reviews.repeat_cycle(fire)).unionByName(stalled)
    at_once = reviews.signals_at_once(fire, baseline, AS_OF)
    assert {r.reason for r in alone.collect()} == {"rejection", "repeat_cycle", "stalled"}
    assert rows(at_once.select(*alone.columns)) == rows(alone)


def test_the_monitor_deals_reviews_once(spark):
    fire = some_reviews(spark)
    baseline = spark.createDataFrame([(1, 3.0, 9.0, 40)], "jurisdiction_id int, p50_days double, p90_days double, completed long")
    assert exchanges(reviews.hot_signals(fire, AS_OF, hot=[], baseline=baseline)) == 1


def test_parties_are_dealt_once(spark):
    parties = spark.createDataFrame([(1, 5, 9, "owner"), (1, 5, 9, "agent"), (1, 5, None, "agent"), (1, None, 9, "agent"), (1, 6, 8, "owner")],
                                    "jurisdiction_id int, record_number long, company_id long, role string")
    permits = spark.createDataFrame([(1, 5, AS_OF, "Tenant Improvement", "Kitchen hood"), (1, 6, AS_OF, "Roofing", "Re-roof")],
                                    "jurisdiction_id int, record_number long, applied_date date, record_type string, description string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        volume = capability.permit_volume_12mo(parties, permits, AS_OF, hot=[])
        assert exchanges(volume) == 3  # parties, permits, companies
        assert rows(volume) == ["Row(company_id=9, permit_volume_12mo=1)"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_best_method_deals_candidates_once(spark):
    table = [(1, 0, "ocr"), (1, 0, "pdf_text"), (1, 0, "pdf_text"), (1, 1, "ocr"), (1, 1, None), (2, 0, None), (2, 0, "other"),
             (None, 0, "ocr"), (3, None, "ocr")]
    candidates = spark.createDataFrame(table, "document_id int, page_number int, extraction_method string")
    best = seals.best_method(candidates)
    assert best.columns == candidates.columns
    assert rows(best) == rows(candidates.filter("(document_id = 1) and (page_number = 1 or extraction_method = 'pdf_text')").dropna())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(seals.best_method(candidates)) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_points_travel_instead_of_facts(spark):
    facts = spark.createDataFrame([(9, 1, 5, AS_OF, 3000000.0, ["high_rise"], True, 2, AS_OF, True)],
                                  "company_id long, jurisdiction_id int, record_number long, applied_date date, valuation double, "
                                  "niches array<string>, is_commercial boolean, fire_cycles int, last_adverse_on date, is_hot boolean")
    companies = spark.createDataFrame([(9, "A", True, None)], "company_id long, list string, relies_on_overloaded boolean, last_contact_on date")
    weights = {k: 10 for k in ("recent_rejection", "repeat_cycle", "target_list_a", "target_list_b", "niche", "valuation_high",
                               "valuation_mid", "overloaded_engineer", "recent_application", "recently_contacted")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        leads = scoring.score_leads(facts, companies, weights, AS_OF, hot=[])
        plan = leads._jdf.queryExecution().executedPlan().toString()
        found = leads.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [int(r.score) for r in found] == [70]
    join = plan[plan.index("SortMergeJoin"):]
    assert "niches" not in join[:join.index("Exchange hashpartitioning")]


def test_page_words_are_not_sorted_before_they_are_dealt(spark):
    words = spark.createDataFrame([(1, 0, 0.2, 0.1, "c"), (1, 0, 0.1, 0.5, "b"), (1, 0, 0.1, 0.2, "a"), (1, 1, 0.1, 0.1, "d"),
                                   (None, 0, 0.1, 0.1, "e"), (None, 0, 0.0, 0.1, None)],
                                  "document_id int, page_number int, y0 double, x0 double, word string")
    text = seals.page_text(words)
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("ObjectHashAggregate") < plan.index("Exchange hashpartitioning") and exchanges(text) == 1
    assert rows(text.select("page_text")) == ["Row(page_text='a b c')", "Row(page_text='d')", "Row(page_text='e')"]
