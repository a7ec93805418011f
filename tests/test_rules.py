"""Edges of the text, name, number and point rules."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lintel.config import load_jurisdictions, load_weights
from lintel.functions import names as N
from lintel.functions import patterns as P
from lintel.functions import points as S
from lintel.operators import filters, scoring, seals

DAY = date(2026, 7, 1)


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_company_names(spark):
    cases = {
        "Acme Fire, L.L.C.": "ACME FIRE", "ACME COMPANY COLUMBIA CO": "ACME COLUMBIA",
        "Smith & Sons Engineering, P.A.": "SMITH SONS ENGINEERING",
        "Fire Services of Florida, Inc.": "FIRE", "  A-1   Sprinkler Corp ": "A 1 SPRINKLER",
        "Inc.": None, "": None, None: None, "O'Neil Group": "ONEIL",
    }
    got = values(spark, N.normalize_company(F.col("n")), [(c,) for c in cases], "n string")
    assert got == list(cases.values())


def test_normalize_is_idempotent(spark):
    names = [("Acme Co of Florida LLC",), ("A.B.C. & D/E-F Inc",), ("Co Co Co",), ("Über Fire PA",)]
    once = N.normalize_company(F.col("n"))
    df = spark.createDataFrame(names, "n string").select(once.alias("n"))
    twice = [r[0] for r in df.select(N.normalize_company(F.col("n"))).collect()]
    assert twice == [r[0] for r in df.collect()]


def test_contact_keys(spark):
    df = spark.createDataFrame([("+1 (407) 555-0100", " A@X.Com", "12 North Main Street, Suite #4, Orlando, FL 32801-1234", "00012-ab"),
                                ("555-0100", " ", " ", "000")], "p string, e string, a string, l string")
    rows = df.select(N.phone_key(F.col("p")), N.email_key(F.col("e")), N.address_key(F.col("a")),
                     N.zip5(F.col("a")), N.license_key(F.col("l"))).collect()
    assert tuple(rows[0]) == ("4075550100", "a@x.com", "12 N MAIN ST UNIT UNIT 4 ORLANDO FL 32801 1234", "32801", "12AB")
    assert tuple(rows[1]) == (None, None, None, None, None)


def test_commercial_rule(spark):
    cases = [
        ("Sign", "Neighborhood sign", "exclude:sign"),
        ("Commercial", "Kitchen hood", "include:fire_system"),
        ("Roofing", "Fire sprinklers retrofit", "include:fire_system"),
        ("Single Family", "sprinkler", "exclude:single_family"),
        ("New Construction", "Pool deck", "exclude:pool"),
        ("Tenant Improvement", "Office", "include:tenant_improvement"),
        ("Commercial", "Buildout", "include:tenant_improvement"),
        ("Change of Occupancy", None, "include:change_of_occupancy"),
        (None, None, "exclude:no_match"),
    ]
    rule = P.commercial_rule(F.col("t"), F.col("d"))
    assert values(spark, rule, [c[:2] for c in cases], "t string, d string") == [c[2] for c in cases]
    literal = P.commercial_rule(F.col("t"), F.col("d"), strict=False)
    assert values(spark, literal, [("Other", "Neighborhood watch")], "t string, d string") == ["include:fire_system"]


def test_departments_and_statuses(spark):
    fire = values(spark, P.is_fire_department(F.col("d")),
                  [("FIRE Marshal",), ("Life Safety",), ("fpb",), ("Zoning",), (None,)], "d string")
    assert fire == [True, True, True, False, False]
    cases = ["Rejected", "DENIED", "Corrections Required", "Approved with Comments", "Revise", "Resubmittal",
             "Disapproved", "Incomplete", "Not Approved", "Approved", None]
    assert values(spark, P.is_adverse(F.col("s")), [(c,) for c in cases], "s string") == [True] * 9 + [False] * 2
    assert values(spark, P.is_adverse(F.col("s"), exempt="approved with comments"),
                  [("Approved with comments",)], "s string") == [False]


def test_niches(spark):
    df = spark.createDataFrame([("Warehouse", 100_000), ("Warehouse", 100_001), ("Data centers and BATTERY room", 5),
                                ("High-rise, assisted living", None), ("process vessel", 1)],
                               "description string, square_footage int").withColumn("record_type", F.lit(""))
    assert [r.niches for r in filters.niche_match(df).collect()] == [
        ["large_warehouse"], ["data_center", "battery_ess"], ["assisted_living", "high_rise"]]


@pytest.mark.parametrize("text, pe, ca", [
    ("sealed FL PE 12345 and CA # 2001", ["12345"], ["2001"]),
    ("PIPE 4000 here", [], []),
    ("PE# 1234567", [], []),
    ("pe#123456 License No. 54321, LICENSE # 4444", ["123456", "54321", "4444"], []),
    ("PE 12345 PE 12345", ["12345", "12345"], []),
    ("C.A. 9999; Certificate of Authorization #123456", [], ["9999", "123456"]),
])
def test_seal_numbers(spark, text, pe, ca):
    page = spark.createDataFrame([(1, text)], "document_id int, page_text string")
    assert [r.license_number for r in seals.extract_pe(page).orderBy("ordinal").collect()] == pe
    assert [r.license_number for r in seals.extract_ca(page).orderBy("ordinal").collect()] == ca


def test_context(spark):
    text = "x" * 150 + " PIPE 12345 " + "y" * 150 + " PE 12345 " + "z" * 150
    page = spark.createDataFrame([(1, text)], "document_id int, page_text string")
    context = seals.extract_pe(page).first().raw_text
    assert context == "y" * 99 + " PE 12345 " + "z" * 99


def test_valuation_and_recency(spark):
    weights = load_weights()
    df = spark.createDataFrame([(Decimal("2000000.01"),), (Decimal(2000000),), (Decimal(500000),),
                                (Decimal("499999.99"),), (None,)], "valuation decimal(14,2)")
    assert [int(r[0]) for r in df.select(scoring.pts_valuation(weights)).collect()] == [15, 8, 8, 0, 0]
    ages = [0, 30, 105, 180, 400, -1]
    rows = [(DAY - timedelta(days=a),) for a in ages] + [(None,)]
    got = values(spark, S.recency_share(F.col("applied_date"), F.lit(DAY)), rows, "applied_date date")
    assert got == [1.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.0]


def test_day_limits(spark):
    weights = load_weights()
    rows = [(DAY - timedelta(days=a),) for a in (0, 14, 15, -1)] + [(None,)]
    df = spark.createDataFrame(rows, "d date")
    assert [int(r[0]) for r in df.select(scoring.pts_rejection(weights, DAY, "d")).collect()] == [40, 40, 0, 0, 0]
    rows = [(DAY - timedelta(days=a),) for a in (0, 30, 31, -1)]
    df = spark.createDataFrame(rows, "d date")
    assert [int(r[0]) for r in df.select(scoring.pts_contacted(weights, DAY, "d")).collect()] == [-50, -50, 0, 0]


def test_config(spark):
    assert load_weights()["target_list_a"] == 30
    jurisdictions = load_jurisdictions(spark)
    assert jurisdictions.count() == 6
    assert jurisdictions.filter("source_verified").count() == 0
