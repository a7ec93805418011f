"""Acceptance cases: review monitor, guards, pages, targets, seals, scores, streams."""

import json
import os
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lintel.config import load_weights
from lintel.operators import capability, history, reports, resolve, reviews, scoring, seals
from lintel.operators.state import manifest, merge_into_state, read_state, unused_versions
from lintel.operators.validate import RowCountCheck, assert_nonempty, validate
from lintel.plans import jobs
from lintel.schemas import TABLES, FieldRule
from lintel.session import scratch_path, stored
from lintel.sources import extracts, sinks
from lintel.streaming import hot, ingest

REVIEW = ("jurisdiction_id int, record_number long, cycle_number int, department string, reviewer_name string, "
          "status string, status_date date, due_date date, opened_on date, comment_text string, observed_at timestamp")


def review(status, day, cycle=1, department="Fire Marshal", permit=7, due=None, opened=None, comment="c", seen=None):
    when = date(2026, 6, day)
    return (1, permit, cycle, department, "r", status, when, due, opened, comment, seen or datetime(2026, 6, day, 12))


def tuples(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_schemas_parse(spark):
    for ddl in TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def test_two_snapshots_give_one_hot_signal(spark):
    previous = [review("In Review", 1), review("Approved", 1, department="Zoning")]
    current = [review("Corrections Required", 9, comment='See sheet FP-1: "no riser"'),
               review("Rejected", 9, department="Zoning")]
    both = spark.createDataFrame(previous + current, REVIEW)
    rejected = reviews.hot_rejections(reviews.status_transitions(both))
    alerts = reviews.emit_hot([rejected])
    assert tuples(alerts, "record_number", "cycle_number", "reason", "comment_text") == [
        (7, 1, "rejection", 'See sheet FP-1: "no riser"')]
    assert reviews.emit_hot([rejected], alerts).count() == 0
    diff = reviews.review_diff(spark.createDataFrame(previous, REVIEW), spark.createDataFrame(current, REVIEW))
    assert tuples(diff, "department", "change") == [("Fire Marshal", "changed"), ("Zoning", "changed")]


def test_transitions(spark):
    data = [review("Rejected", 1), review("Rejected", 2), review("Approved", 3), review("Denied", 4)]
    moved = reviews.status_transitions(spark.createDataFrame(data, REVIEW))
    assert tuples(reviews.hot_rejections(moved), "status", "signal_date") == [
        ("Denied", date(2026, 6, 4)), ("Rejected", date(2026, 6, 1))]
    split = reviews.status_transitions(spark.createDataFrame(data, REVIEW), min_rows=2)
    assert tuples(split, "status_date", "previous_status") == tuples(moved, "status_date", "previous_status")


def test_reasons_priority_and_escalation(spark):
    data = [review("In Review", 1, cycle=2, due=date(2026, 6, 2))]
    df = spark.createDataFrame(data, REVIEW)
    as_of = date(2026, 6, 20)
    first = reviews.hot_signals(df, as_of)
    assert tuples(first, "reason", "reasons") == [("repeat_cycle", ["repeat_cycle", "stalled"])]
    later = spark.createDataFrame(data + [review("Rejected", 18, cycle=2, comment="later")], REVIEW)
    assert reviews.hot_signals(later, as_of, first).count() == 0
    rejected = reviews.hot_rejections(reviews.status_transitions(later))
    again = reviews.emit_hot([rejected], first, allow_escalation=True)
    assert tuples(again, "reason") == [("rejection",)]
    kept = reviews.update_history(first, reviews.emit_hot([rejected]))
    assert tuples(kept, "reason", "reasons", "comment_text", "signal_date") == [
        ("rejection", ["rejection", "repeat_cycle", "stalled"], "later", date(2026, 6, 1))]


def test_stalled_needs_a_baseline(spark):
    opened = date(2026, 5, 1)
    open_one = [review("In Review", 1, permit=99, opened=opened)]
    done = [review("Approved", 2, permit=i, opened=date(2026, 6, 1)) for i in range(20)]
    as_of = date(2026, 6, 20)

    def basis(data):
        df = spark.createDataFrame(data, REVIEW)
        return tuples(reviews.stalled_reviews(df, reviews.turnaround_baseline(df), as_of), "stall_basis")

    assert basis(open_one + done[:19]) == [("no baseline",)]
    assert basis(open_one + done) == [("over p90",)]
    due = [review("In Review", 1, due=as_of), review("In Review", 1, permit=8, due=as_of - timedelta(days=1))]
    assert basis(due) == [("past due",)]


def test_zero_rows_are_loud(spark):
    empty = spark.range(0)
    with pytest.raises(Exception, match="permits: zero rows"):
        assert_nonempty(empty, "permits").collect()
    with pytest.raises(Exception, match="permits: zero rows"):
        assert_nonempty(spark.range(3).limit(0), "permits").filter("id = 1").count()
    assert assert_nonempty(spark.range(3), "permits").count() == 3
    assert assert_nonempty(spark.range(3), "permits").filter("id = 1").count() == 1
    check = RowCountCheck(empty, "permits")
    check.df.collect()
    with pytest.raises(ValueError, match="zero rows"):
        check.verify()
    check = RowCountCheck(spark.range(4), "rows")
    check.df.collect()
    assert check.verify() == 4


def test_missing_registry_is_loud(spark):
    flagged = spark.createDataFrame([(1,)], "company_id int")
    expected = spark.createDataFrame([("fire", True), ("board", True)], "source string, source_verified boolean")
    as_of = date(2026, 7, 1)

    def guarded(landed):
        facts = spark.createDataFrame(landed, "source string, landed_on date")
        return capability.coverage_guard(flagged, history.source_coverage(expected, facts, as_of), ["fire", "board"])

    assert guarded([("fire", as_of), ("board", as_of)]).count() == 1
    with pytest.raises(Exception, match="board"):
        guarded([("fire", as_of)]).collect()
    with pytest.raises(Exception, match="fire"):
        guarded([("fire", date(2025, 1, 1)), ("board", as_of)]).collect()
    only = history.source_coverage(expected.filter("source = 'fire'"),
                                   spark.createDataFrame([("fire", as_of)], "source string, landed_on date"), as_of)
    with pytest.raises(Exception, match="registries"):
        capability.coverage_guard(flagged, only, ["fire", "board"]).collect()


PAGE = """<html><head><title>Permit BLD-1 &amp; more</title></head><body>
<dl><dt>Record Number:</dt><dd>BLD-1</dd><dt>Type:</dt><dd>Tenant Improvement</dd><dt>Status:</dt><dd>In Review</dd>
<dt>Address:</dt><dd>1 Main St</dd><dt>Applied:</dt><dd>2026-06-03</dd></dl>
<table><caption>Parties</caption><tr><th>Role</th><th>Name</th></tr><tr><td>contractor</td><td>Acme Fire, LLC</td></tr>
<tr><td>owner</td><td></td></tr></table>
<table><caption>Reviews</caption><tr><th>Department</th><th>Cycle</th><th>Status</th></tr>
<tr><td>Fire</td><td>2</td><td>Corrections</td></tr></table>
<p>First<p>Second <a href="/docs/a.pdf?x=1&amp;y=2">Set A</a></p><a href="/home">Home</a></body></html>"""


def test_saved_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, "w", "<p>broken <b")], "page_id long, url string, html string")
    parsed = extracts.parse_detail_pages(pages)
    detail = extracts.permit_details(parsed.filter("page_id = 1"), {
        "record_number": "Record Number", "record_type": "Type", "status": "Status", "address": "Address",
        "applied_date": "Applied", "valuation": "Valuation"})
    assert tuple(detail.first())[2:] == ("BLD-1", "Tenant Improvement", "In Review", "1 Main St", "2026-06-03", None)
    rules = [FieldRule("record_number", required=True), FieldRule("applied_date", "date", True), FieldRule("valuation", "decimal(14,2)")]
    assert validate(detail, rules)[0].first().applied_date == date(2026, 6, 3)
    parties = extracts.detail_rows(parsed, "parties", {"role": "Role", "raw_name": "Name"})
    assert tuples(parties, "role", "raw_name") == [("contractor", "Acme Fire, LLC"), ("owner", None)]
    assert tuples(extracts.detail_rows(parsed, "Reviews", {"cycle": "Cycle", "s": "Status"}), "cycle", "s") == [("2", "Corrections")]
    assert tuples(extracts.list_documents(parsed, r"(?i)\.pdf(\?|$)"), "portal_url", "title") == [("/docs/a.pdf?x=1&y=2", "Set A")]
    first = parsed.filter("page_id = 1").first()
    assert first.title == "Permit BLD-1 & more" and first.paragraphs == ["First", "Second Set A"]
    assert parsed.filter("page_id = 2").first().title == ""


def test_extract_keeps_payload_and_flags_junk(spark):
    path = scratch_path(spark, "extract")
    spark.createDataFrame([('{"a": {"n": 1}, "extra": [1, 2]}',), ("not json",)], "value string").write.text(path)
    got = extracts.read_permit_extract(spark, path, "rows", {"n": "$.a.n"})
    assert tuples(got, "n", "is_corrupt", "raw_payload") == sorted(
        [("1", False, '{"a": {"n": 1}, "extra": [1, 2]}'), (None, True, "not json")], key=repr)
    path = scratch_path(spark, "features")
    spark.createDataFrame([('{"features": [{"attributes": {"n": 5}}, {"attributes": {"n": 6}}]}',), ("oops",)], "value string").write.text(path)
    got = extracts.read_permit_extract(spark, path, "features", {"n": "$.attributes.n"})
    assert tuples(got, "n", "is_corrupt") == [("5", False), ("6", False), (None, True)]


def test_bulk_licences(spark):
    path = scratch_path(spark, "bulk")
    lines = ["number,name,state", '100,"Acme, Inc",FL', "101,Beta,GA", "broken"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    good, bad = extracts.read_license_bulk(spark, path, "number int, name string, state string", header=lines[0])
    assert tuples(good, "number", "name", "state") == [(100, "Acme, Inc", "FL"), (101, "Beta", "GA")]
    assert tuples(bad, "malformed_line") == [("broken",)]


def capability_tables(spark):
    companies = spark.createDataFrame([(i, f"Firm {i}", f"555{i}") for i in range(1, 6)], "company_id int, canonical_name string, phone string")
    licenses = spark.createDataFrame([
        (1, "FP_CONTRACTOR", "10", "Active"), (2, "FP_CONTRACTOR", "20", "Inactive"),
        (3, "FP_CONTRACTOR", "30", "Active"), (3, "CA", "31", "Active"),
        (4, "CA", "40", "Active"), (4, "PE_FP", "41", "Active"), (5, "FP_CONTRACTOR", "50", "Active")],
        "company_id int, license_type string, license_number string, status string")
    permits = spark.createDataFrame([(1, n, "New Construction", "Office", d) for n, d in [
        (1, date(2026, 6, 1)), (2, date(2025, 7, 2)), (3, date(2025, 7, 1)), (4, date(2026, 7, 2))]],
        "jurisdiction_id int, record_number long, record_type string, description string, applied_date date")
    parties = spark.createDataFrame([(1, n, c, "contractor") for n in (1, 2, 3, 4) for c in (1, 2, 3, 4)] + [(1, 1, 1, "owner")],
                                    "jurisdiction_id int, record_number long, company_id int, role string")
    return companies, licenses, permits, parties


def test_target_report(spark):
    companies, licenses, permits, parties = capability_tables(spark)
    volume = capability.permit_volume_12mo(parties, permits, date(2026, 7, 1))
    assert tuples(volume, "company_id", "permit_volume_12mo") == [(1, 2), (2, 2), (3, 2), (4, 2)]
    listed = capability.target_lists(capability.capability(companies, licenses, volume))
    assert tuples(listed, "company_id", "list") == [(1, "A"), (3, "B")]
    path = scratch_path(spark, "targets")
    sinks.write_targets_csv(capability.targets(listed.filter("list = 'A'")), path)
    part = next(f for f in os.listdir(path) if f.endswith(".csv"))
    lines = open(f"{path}/{part}").read().splitlines()
    assert lines[0] == "company,phone,license,permit_count,reason"
    assert lines[1].startswith("Firm 1,5551,10,2,")


def test_seal_report(spark):
    dated = spark.createDataFrame([
        ("11", "Ann", "Seminole", 1, 1, date(2026, 1, 1)), ("11", "Ann", "Lake", 1, 2, date(2026, 2, 1)),
        ("11", "Ann", "Seminole", 1, 1, date(2026, 3, 1)), ("22", "Bo", "Seminole", 1, 1, date(2024, 1, 1))],
        "license_key string, engineer_name string, county string, jurisdiction_id int, record_number long, sealed_on date")
    parties = spark.createDataFrame([(1, 1, 5, "contractor"), (1, 1, 6, "owner"), (1, 2, 5, "contractor"), (1, 2, 7, "engineer")],
                                    "jurisdiction_id int, record_number long, company_id int, role string")
    report = seals.seal_report(dated, parties, since=date(2025, 1, 1))
    assert tuples(report, "engineer_name", "license_key", "seals", "clients", "counties") == [
        ("Ann", "11", 3, 2, ["Lake", "Seminole"])]
    assert tuples(seals.sole_engineer_contractors(seals.engineer_client_map(dated.filter("license_key = '11'"), parties, ["contractor"])),
                  "company_id", "license_key", "seals") == [(5, "11", 3)]
    assert tuples(seals.peak_year_load(dated), "license_key", "peak_seals") == [("11", 3), ("22", 1)]


def test_words(spark):
    words = spark.createDataFrame([(1, 0, 0, "B", .6, .8, .7, .9, 50.), (1, 0, 0, "A", .5, .6, .6, .7, 50.), (1, 0, 90, "C", .1, .1, .2, .2, 90.)],
                                  "document_id int, page_number int, rotation int, word string, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert tuples(seals.page_text(words), "page_text") == [("C A B",)]
    assert tuples(seals.region_words(words), "word") == [("A",), ("B",)]
    assert tuples(seals.best_rotation(words), "rotation", "ocr_confidence") == [(90, 90.0)]


def lead_tables(spark):
    as_of = date(2026, 7, 1)
    facts = spark.createDataFrame([(1, 1, date(2026, 6, 20), "3000000", ["data_center"], True, 2, date(2026, 6, 25), True),
                                   (1, 2, date(2024, 6, 20), "1000", [], False, None, None, False)],
                                  "jurisdiction_id int, record_number long, applied_date date, v string, niches array<string>, "
                                  "is_commercial boolean, fire_cycles int, last_adverse_on date, is_hot boolean").withColumn(
        "valuation", F.col("v").cast("decimal(14,2)")).drop("v")
    parties = spark.createDataFrame([(1, 1, 5, "owner"), (1, 1, 5, "contractor"), (1, 2, 6, "owner"), (1, 1, None, "agent")],
                                    "jurisdiction_id int, record_number long, company_id int, role string")
    listed = spark.createDataFrame([(5, "A"), (8, "B")], "company_id int, list string")
    reliance = spark.createDataFrame([(5, True)], "company_id int, relies_on_overloaded boolean")
    contacts = scoring.last_contacts(spark.createDataFrame([(8, date(2026, 6, 30)), (8, date(2026, 8, 1))], "company_id int, contacted_on date"), as_of)
    candidates = scoring.lead_candidates(facts, parties, listed)
    return scoring.score_leads(candidates, scoring.company_facts(listed, reliance, contacts), load_weights(), as_of)


def test_scores_explain_themselves(spark):
    leads = lead_tables(spark)
    rows = {(r.company_id, r.record_number): r for r in leads.collect()}
    assert set(rows) == {(5, 1), (8, None)}
    assert float(rows[(5, 1)].score) == 40 + 15 + 30 + 25 + 15 + 10 + 10
    assert float(rows[(8, None)].score) == 20 - 50
    for r in rows.values():
        assert sum(json.loads(r.score_breakdown).values()) == float(r.score)
    assert scoring.score_explain(leads).count() == 7 + 2
    actions = {r.company_id: r.next_action for r in scoring.with_next_action(leads).collect()}
    assert actions == {5: "call: recent fire review rejection", 8: "wait: contacted lately"}


def test_snooze(spark):
    leads = spark.createDataFrame([(1, None), (2, date(2026, 7, 1)), (3, date(2026, 7, 2))], "company_id int, snoozed_until date")
    assert tuples(scoring.actionable(leads, date(2026, 7, 1)), "company_id") == [(1,), (2,)]


def test_export_and_split(spark):
    df = spark.createDataFrame([(1, ["b", "a"], "Ann", "555"), (2, None, "Ann", None)], "id int, tags array<string>, name string, phone string")
    assert tuples(reports.export_flat(df), "id", "tags") == [(1, "b; a"), (2, None)]
    public, private = sinks.split_private(df, ["name", "phone"], "key")
    assert "Ann" not in str(public.collect())
    assert private.count() == 2 and public.select("name").distinct().count() == 1
    with pytest.raises(ValueError):
        sinks.split_private(df, ["name"], "")


def test_digest_file(spark):
    lines = spark.createDataFrame([(1, 1, '- Permit 1 "a<b"'), (0, 0, "# Digest"), (1, 0, "## HOT")], "section int, place int, line string")
    folder = scratch_path(spark, "digests")
    name = sinks.write_digest(lines, folder, date(2026, 7, 1))
    assert [r.value for r in spark.read.text(name).collect()] == ["# Digest", "## HOT", '- Permit 1 "a<b"']
    name = sinks.write_digest(lines, folder, date(2026, 7, 1), html=True)
    assert [r.value for r in spark.read.text(name).collect()] == ["<h1>Digest</h1>", "<h2>HOT</h2>", '<p>Permit 1 "a&lt;b"</p>']


def test_review_queue_keeps_decisions(spark):
    ddl = "left_key string, right_key string, decision string"
    queue = spark.createDataFrame([("a", "b", "rejected")], ddl)
    new = spark.createDataFrame([("a", "b", "review"), ("c", "d", "review")], ddl)
    assert tuples(resolve.review_queue_append(queue, new), "left_key", "decision") == [("a", "rejected"), ("c", "review")]


def test_merge_batch_replay(spark):
    ddl = "k int, status string, observed_at timestamp"
    one = spark.createDataFrame([(1, "a", datetime(2026, 1, 1)), (2, "a", datetime(2026, 1, 1))], ddl)
    two = spark.createDataFrame([(1, "b", datetime(2026, 1, 5))], ddl)
    current = history.current_state(one, ["k"])
    merged = history.merge_batch(current, two, ["k"])
    assert tuples(merged, "k", "status", "first_seen_at", "last_seen_at") == [
        (1, "b", datetime(2026, 1, 1), datetime(2026, 1, 5)), (2, "a", datetime(2026, 1, 1), datetime(2026, 1, 1))]
    again = history.merge_batch(merged, two, ["k"])
    assert tuples(again, *merged.columns) == tuples(merged, *merged.columns)


def test_pacing_across_slots(spark):
    at = datetime(2026, 1, 1, 0, 0, 59)
    log = spark.createDataFrame([("h", at, 1), ("h", at + timedelta(seconds=1.5), 2), ("h", at + timedelta(seconds=60), 3),
                                 ("g", at, 4)], "host string, ts timestamp, request_id int")
    assert tuples(history.pacing_audit(log), "request_id", "gap") == [(2, 1.5)]
    limits = spark.createDataFrame([("h", 59.0)], "host string, gap_seconds double")
    assert tuples(history.pacing_audit(log, limits=limits), "request_id") == [(2,), (3,)]


def land(spark, folder, rows):
    (spark.createDataFrame(rows, REVIEW).select(*[c.split()[0] for c in REVIEW.split(", ")])
     .coalesce(1).write.mode("append").parquet(folder))


def test_hot_stream_alerts_once(spark):
    landing, out, ckpt = (scratch_path(spark, x) for x in ("land", "out", "ckpt"))

    def run():
        stream = spark.readStream.schema(REVIEW).parquet(landing)
        (hot.hot_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
        return tuples(spark.read.schema(hot.SIGNAL).parquet(out), "record_number", "cycle_number", "status", "comment_text")

    hot.use_rocksdb(spark)
    try:
        land(spark, landing, [review("In Review", 1), review("Rejected", 2, department="Zoning"), review("Approved", 5, permit=8)])
        assert run() == []
        land(spark, landing, [review("Rejected", 4, comment="one"), review("Denied", 3, permit=8, comment="late")])
        assert run() == [(7, 1, "Rejected", "one")]
        land(spark, landing, [review("Approved", 6), review("Rejected", 7, comment="two"), review("Rejected", 8, cycle=2, comment="new cycle")])
        assert run() == [(7, 1, "Rejected", "one"), (7, 2, "Rejected", "new cycle")]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")


def streamed(spark, landing, out, ckpt, **how):
    hot.use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(REVIEW).parquet(landing)
        (hot.hot_stream(stream, hot.RULES, **how).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")
    return tuples(spark.read.schema(hot.SIGNAL).parquet(out), "record_number", "cycle_number", "reason", "comment_text")


def test_hot_stream_goes_on_from_history(spark):
    landing, out, ckpt = (scratch_path(spark, x) for x in ("land", "out", "ckpt"))
    past = spark.createDataFrame([
        review("Rejected", 1, comment="sent"), review("Rejected", 1, permit=8, comment="known, not sent"),
        review("In Review", 1, permit=9, comment="open"), review("Approved", 1, cycle=2, permit=10)], REVIEW)
    sent = spark.createDataFrame([(1, 7, 1, "rejection")], "jurisdiction_id int, record_number long, cycle_number int, reason string")
    known = stored(hot.known_state(past, sent), "known")
    land(spark, landing, [
        review("Approved", 2), review("Rejected", 3, comment="cycle has alerted"),
        review("Denied", 2, permit=8, comment="was adverse already"), review("Rejected", 2, permit=9, comment="new"),
        review("In Review", 2, cycle=2, permit=10, comment="second cycle known"), review("In Review", 2, cycle=3, permit=10, comment="third")])
    want = [(9, 1, "rejection", "new"), (10, 3, "repeat_cycle", "third")]
    assert streamed(spark, landing, out, ckpt, known=known) == sorted(want, key=repr)
    assert streamed(spark, landing, out, ckpt, known=known) == sorted(want, key=repr)  # again from the checkpoint
    land(spark, landing, [review("Denied", 9, permit=9), review("Rejected", 9, cycle=3, permit=10)])
    assert streamed(spark, landing, out, ckpt, known=known) == sorted(want, key=repr)


def test_hot_stream_stalls_by_timer(spark):
    landing, out, ckpt = (scratch_path(spark, x) for x in ("land", "out", "ckpt"))
    baseline = spark.createDataFrame([(1, 4.0, 5.5, 20)], "jurisdiction_id int, p50_days double, p90_days double, completed long")
    known = stored(hot.known_state(
        spark.createDataFrame([review("In Review", 1, permit=6, due=date(2026, 6, 4), comment="waits since")], REVIEW),
        spark.createDataFrame([], "jurisdiction_id int, record_number long, cycle_number int, reason string"), baseline), "known")
    land(spark, landing, [
        review("In Review", 1, due=date(2026, 6, 8), comment="due"), review("In Review", 1, permit=8, opened=date(2026, 6, 3), comment="old"),
        review("In Review", 1, permit=9, due=date(2026, 6, 2), comment="closed later"), review("Approved", 3, permit=9),
        review("In Review", 1, permit=10, comment="no date")])
    how = {"known": known, "baseline": baseline}
    assert streamed(spark, landing, out, ckpt, **how) == []
    land(spark, landing, [review("Approved", 8, permit=50)])  # the clock stands at the 8th
    assert streamed(spark, landing, out, ckpt, **how) == [(6, 1, "stalled", "waits since")]
    # a row behind the clock is followed, and keeps its review from stalling
    land(spark, landing, [review("Approved", 5, permit=8), review("Rejected", 2, permit=60, comment="behind"), review("Approved", 9, permit=50)])
    want = [(6, 1, "stalled", "waits since"), (60, 1, "rejection", "behind"), (7, 1, "stalled", "due")]
    assert streamed(spark, landing, out, ckpt, **how) == want
    assert tuples(spark.read.parquet(out).filter("record_number = 7"), "signal_date") == [(date(2026, 6, 9),)]
    land(spark, landing, [review("Rejected", 20, comment="stalled before"), review("Approved", 25, permit=50)])
    assert streamed(spark, landing, out, ckpt, **how) == want


def test_monitor_run_keeps_history(spark):
    path = scratch_path(spark, "alerts")
    day = lambda n, *rows: tuples(jobs.monitor_run(spark.createDataFrame(list(rows), REVIEW), date(2026, 6, n), path), "record_number", "cycle_number", "reason")
    first = [review("In Review", 1), review("In Review", 1, permit=8, due=date(2026, 6, 3))]
    assert day(4, *first) == [(8, 1, "stalled")]
    second = [*first, review("Rejected", 5, permit=8), review("Rejected", 5)]
    assert day(6, *second) == [(7, 1, "rejection")]
    assert day(6, *second) == [(7, 1, "rejection")]  # repeated, the same again
    assert day(7, *second) == []
    kept = jobs.alert_history(spark, path)
    assert tuples(kept, "record_number", "reason", "signal_date", "reasons") == [
        (7, "rejection", date(2026, 6, 5), ["rejection"]), (8, "rejection", date(2026, 6, 4), ["rejection", "stalled"])]


def test_hot_stream_text_keys_and_missing_dates(spark):
    landing, out, ckpt = (scratch_path(spark, x) for x in ("land", "out", "ckpt"))
    rows = spark.createDataFrame([review("Rejected", 4, comment="one"), review("Rejected", 5, permit=8)], REVIEW)
    rows = rows.withColumn("record_number", F.concat(F.lit("B-"), "record_number"))
    missing = rows.limit(1).withColumn("status_date", F.lit(None).cast("date"))
    rows.unionByName(missing).coalesce(1).write.parquet(landing)
    stream = spark.readStream.schema(rows.schema).parquet(landing)
    (hot.hot_stream(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination())
    assert tuples(spark.read.parquet(out), "record_number") == [("B-7",), ("B-8",)]
    assert hot.undated(spark.read.parquet(landing)).count() == 1


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from lintel.session import clean_run, is_local, run_dir

    assert [is_local(m) for m in ("local", "local[8]", "local[*]")] == [True] * 3
    assert not any(is_local(m) for m in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]"))
    stored(spark.range(3), "some")
    clean_run(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def test_parties_link_by_numbers_of_one_company_only(spark):
    ddl = "member_id string, raw_name string, phone string, address string, email string, license_type string, license_number string"
    members = spark.createDataFrame([("a", "Alpha", None, None, None, "CA", "12345"), ("b", "Beta", None, None, None, "PE_FP", "12345"),
                                     ("c", "Gamma", None, None, None, "CA", "777")], ddl)
    clustered = resolve.normalize_members(members).withColumn("company_id", F.col("member_id"))
    parties = spark.createDataFrame([("Beta Inc", "12345"), ("Someone", "0777"), ("Nobody", "12345")], "raw_name string, license_number string")
    assert tuples(resolve.link_parties(parties, clustered), "raw_name", "company_id", "link_basis") == [
        ("Beta Inc", "b", "name"), ("Nobody", None, None), ("Someone", "c", "license")]
    people = spark.createDataFrame([("X", "PE_FP", "12345"), ("Alpha", "PE_OTHER", "12345")], "raw_name string, license_type string, license_number string")
    assert tuples(resolve.link_person(people, clustered), "raw_name", "company_id", "link_basis") == [
        ("Alpha", "a", "name"), ("X", "b", "license")]


def test_context_of_a_repeated_number(spark):
    text = "x" * 150 + " FL PE 12345 first " + "y" * 300 + " FL PE 12345 second"
    pages = spark.createDataFrame([(1, text), (2, "PIPE 4000 and PE 5000")], "document_id int, page_text string")
    found = seals.extract_pe(pages).filter("document_id = 1").orderBy("ordinal").collect()
    assert "first" in found[0].raw_text and "second" not in found[0].raw_text
    assert "second" in found[1].raw_text and "first" not in found[1].raw_text
    loose = seals.extract_pe(pages, strict=False).filter("document_id = 2").orderBy("ordinal").collect()
    assert [r.license_number for r in loose] == ["4000", "5000"]
    assert all(r.raw_text == "PIPE 4000 and PE 5000" for r in loose)


def test_ingest_stream_in_two_runs(spark):
    landing, table, ckpt = (scratch_path(spark, x) for x in ("land", "table", "ckpt"))
    schema = "jurisdiction_id string, record_number string, record_type string, status string, applied_date string, valuation string, square_footage string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(landing)
        ingest.permit_ingest_stream(spark, landing, schema, table, ckpt).awaitTermination()
        return tuples(ingest.current_permits(spark, table), "record_number", "status")

    assert run([("1", "A", "t", "Open", "2026-01-01", "1", "2"), ("1", "B", "t", "Open", "junk", None, None)]) == [("A", "Open")]
    assert run([("1", "A", "t", "Closed", "2026-01-01", None, None), ("1", "C", "t", "Open", "2026-01-02", None, None)]) == [
        ("A", "Closed"), ("C", "Open")]
    assert spark.read.parquet(f"{table}/rejected").count() == 1
    ingest.compact(spark, table, f"{table}/base")
    assert spark.read.parquet(f"{table}/base").count() == 2


def test_ingest_keeps_broken_lines_and_counts_a_file_once(spark, tmp_path):
    landing, table, ckpt, target = tmp_path / "land", *(scratch_path(spark, x) for x in ("table", "ckpt", "state"))
    schema = "jurisdiction_id string, record_number string, record_type string, status string, applied_date string, valuation string, square_footage string"
    good = lambda n, status: json.dumps({"jurisdiction_id": 1, "record_number": n, "record_type": "t", "status": status,
                                         "applied_date": "2026-01-01", "valuation": 12.5, "extra": {"a": [1, None]}})

    def run(folder, name, *lines):
        (landing / folder).mkdir(parents=True, exist_ok=True)
        (landing / folder / name).write_text("\n".join(lines) + "\n")
        ingest.permit_ingest_stream(spark, str(landing), schema, table, ckpt).awaitTermination()
        written = ingest.fold(spark, table, target, buckets=1000)
        accepted = tuples(spark.read.parquet(f"{table}/accepted"), "record_number", "status")
        return accepted, tuples(spark.read.parquet(f"{table}/rejected"), "line"), len(written)

    broken = ['{"record_number": "B", "sta', "[1, 2]", "5", good("", "Open")]
    want = [("A", "Open"), ("C", "Open")], [(b,) for b in sorted(broken, key=lambda b: repr((b,)))]
    assert run("one", "a.json", good("A", "Open"), "", good("C", "Open"), *broken) == (*want, 2)
    assert run("two", "a.json", good("A", "Open"), good("C", "Open"), *broken) == (*want, 0)  # the same file again
    assert run("two", "b.json", good("A", "Closed")) == ([("A", "Closed"), *want[0]], want[1], 1)
    kept = read_state(spark, target)
    assert tuples(kept, "record_number", "status", "valuation") == [("A", "Closed", Decimal("12.50")), ("C", "Open", Decimal("12.50"))]
    assert {json.loads(r.raw_payload)["extra"]["a"][0] for r in kept.collect()} == {1}
    assert tuples(ingest.current_permits(spark, table), "record_number", "status", "raw_payload") == tuples(kept, "record_number", "status", "raw_payload")
    rejected = spark.read.parquet(f"{table}/rejected")
    assert tuples(rejected.filter("payload is not null and reject_reasons[0] like 'record%'").select(
        F.try_variant_get("payload", "$.valuation", "double").alias("v"), F.col("reject_reasons")[0].alias("r")), "v", "r") == [(12.5, "record_number:missing")]


def test_state_batches_touch_only_their_buckets(spark):
    path, at = scratch_path(spark, "state"), lambda n: datetime(2026, 7, n)
    batch = lambda n, ids, mark: spark.createDataFrame([(i, mark, at(n)) for i in ids], "k long, status string, observed_at timestamp")
    assert read_state(spark, path) is None
    assert len(merge_into_state(batch(1, range(5_000), "new"), path, ["k"], 1, buckets=100)) == 100
    before = manifest(spark, path)
    assert merge_into_state(batch(2, [7], "seen"), path, ["k"], 2) == [b for b, v in manifest(spark, path).items() if v == 2]
    assert sum(a != b for a, b in zip(before.values(), manifest(spark, path).values())) == 1  # 1 of 100, on 100 buckets as begun
    assert [(r.version, r.bucket) for r in unused_versions(spark, path).collect()] == [(1, b) for b, v in manifest(spark, path).items() if v == 2]
    state = read_state(spark, path)
    assert state.count() == 5_000
    assert tuples(state.filter("k in (7, 8)"), "k", "status", "first_seen_at", "last_seen_at") == [(7, "seen", at(1), at(2)), (8, "new", at(1), at(1))]
    # an older row widens what has been seen and replaces nothing; a batch the state holds changes nothing
    merge_into_state(batch(1, [7, 9_000], "late"), path, ["k"], 3)
    assert merge_into_state(batch(9, [7], "again"), path, ["k"], 3) == []
    # a run that fails while it writes leaves the state as it was
    failing = batch(5, range(50), "lost").withColumn("status", F.when(F.col("k") == 49, F.raise_error(F.lit("boom"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="boom"):
        merge_into_state(failing, path, ["k"], 4)
    half = batch(5, range(50), "lost").withColumns({"first_seen_at": F.col("observed_at"), "last_seen_at": F.col("observed_at"), "bucket": F.lit(3)})
    half.write.partitionBy("bucket").parquet(f"{path}/data/version=4")  # files, but no manifest
    assert tuples(read_state(spark, path).filter("k in (7, 9000) or status = 'lost'"), "k", "status") == [(7, "seen"), (9_000, "late")]
    merge_into_state(batch(5, [9_000], "next"), path, ["k"], 4)
    assert tuples(read_state(spark, path).filter("status in ('lost', 'next')"), "k") == [(9_000,)]


def test_snapshot_batches_stand_side_by_side(spark):
    path = scratch_path(spark, "snapshots")
    at = datetime(2026, 7, 1, 9)
    one = spark.createDataFrame([(1, "A", at), (2, "B", at)], "jurisdiction_id int, record_number string, observed_at timestamp")
    two = spark.createDataFrame([(1, "C", at)], one.schema)
    for df, batch in ((one, "b1"), (two, "b2"), (one, "b1")):
        history.write_snapshot(df, path, batch)
    assert tuples(spark.read.parquet(path), "record_number", "batch") == [("A", "b1"), ("B", "b1"), ("C", "b2")]


def test_harvest_keeps_commercial_and_refuses_nothing(spark):
    from lintel.plans.jobs import harvest

    at = datetime(2026, 7, 1, 9)
    schema = ("jurisdiction_id string, record_number string, record_type string, description string, status string, "
              "applied_date string, observed_at timestamp")
    rules = [FieldRule("jurisdiction_id", "int", True), FieldRule("applied_date", "date", True)]
    path = scratch_path(spark, "harvest")
    landed = spark.createDataFrame([("1", "A", "New Construction", "shop", "Open", "2026-06-30", at),
                                    ("1", "B", "Roofing", "roof", "Open", "2026-06-30", at),
                                    ("1", "C", "Alteration", "x", "Open", "someday", at)], schema)
    rejects = harvest(landed, path, "b1", rules)
    assert tuples(rejects, "record_number", "reject_reasons") == [("C", ["applied_date:not_date"])]
    assert tuples(spark.read.parquet(path), "record_number") == [("A",)]
    with pytest.raises(Exception, match="orange: zero rows"):
        harvest(landed.limit(0), path, "b2", rules, label="orange")
