"""Steps that the lead run and the digest share do their work once, with the same rows."""

import random

from pyspark.sql import functions as F

from lintel.operators import reports, reviews
from lintel.plans import hitters, order, skew
from test_dealt_once import AS_OF, rows, some_reviews


def test_signals_are_picked_where_they_fire(spark):
    fire = some_reviews(spark).filter("department <> 'Zoning'")
    baseline = spark.createDataFrame([(1, 3.0, 9.0, 40)], "jurisdiction_id int, p50_days double, p90_days double, completed long")
    picked = reviews.hot_signals(fire, AS_OF, hot=[], baseline=baseline)
    wanted = reviews.pick_signals(reviews.signals_at_once(fire, baseline, AS_OF))
    assert picked.columns == wanted.columns and rows(picked) == rows(wanted) and picked.count() > 5
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "Generate" not in plan


def test_no_sketch_where_no_key_can_be_hot(spark, monkeypatch):
    table = spark.range(5_000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b"))
    assert [t[1] for t in skew.hot_keys(table, ["a"], 700)] == [3] * 7
    assert hitters.find_hitters(table, ["a"], ["a", "b"], min_rows=700).of(["a", "b"]) == []
    assert len(hitters.find_hitters(table, ["a"], ["a", "b"], min_rows=700).of(["a"])) == 7
    monkeypatch.setattr(skew, "TRACKED_ITEMS", None)  # a sketch would fail
    monkeypatch.setattr(hitters, "tracked_items", lambda *_: None)
    assert skew.hot_keys(table, ["a"], 800) == []
    assert hitters.find_hitters(table, ["a"], ["b"], min_rows=2_000).of(["b"]) == []


def test_rows_are_dealt_once_to_be_numbered(spark):
    dice = random.Random(5)
    given = [(dice.choice([None, *range(400)]), i) for i in range(3_000)]
    table = spark.createDataFrame(given, "a int, i int").repartition(7)
    placed = order.numbered(table, [F.desc("a"), F.col("i")])
    assert "Exchange hash" not in placed._jdf.queryExecution().executedPlan().toString()
    wanted = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [tuple(r) for r in placed.orderBy("place").collect()] == [(*r, n + 1) for n, r in enumerate(wanted)]
    assert placed.schema["place"].dataType.simpleString() == "int"
    assert order.numbered(table.limit(0), [F.col("a")]).count() == 0


def test_hot_lines_as_before(spark):
    signals = spark.createDataFrame(
        [(1, 5, 2, "rejection", "Fire", "Denied", AS_OF, "x"), (1, 6, None, "other", None, None, None, None)],
        "jurisdiction_id int, record_number long, cycle_number int, reason string, department string, status string, signal_date date, comment_text string")
    permits = spark.createDataFrame([(1, 5, "Shop")], "jurisdiction_id int, record_number long, description string")
    lines = reports.digest_hot(signals, permits)
    assert "format_string" not in lines._jdf.queryExecution().analyzed().toString().lower()
    assert [r.line for r in lines.orderBy("record_number").collect()] == [
        f"- Permit 5 (Shop), cycle 2, Fire: Denied on {AS_OF}. > \"x\" {reports.OPENINGS['rejection']}",
        "- Permit 6 (no description), cycle null, null: null on null. > \"\" null"]
