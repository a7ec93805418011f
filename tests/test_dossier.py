"""The dossier lists aliases, people, permits and leads themselves, and multiplies none of them."""

from lintel.operators import reports


def test_dossier_names_every_part(spark):
    frame = spark.createDataFrame
    key = "jurisdiction_id int, record_number string"
    company = frame([("c1", "Alpha LLC", "ALPHA", "1"), ("c2", "Beta", "BETA", "2")],
                    "company_id string, canonical_name string, normalized_key string, phone string")
    values = frame([("c1", "alias", "Alpha LLC", 3), ("c1", "alias", "Alpha, Inc.", 1), ("c1", "phone", "1", 4),
                    ("c2", "alias", "Beta", 1)], "company_id string, kind string, value string, seen long")
    people = frame([("c1", "Pat Doe", "PE_FP", "11"), ("c1", "Sam Roe", "PE_OTHER", "12"), (None, "Nobody", "PE_FP", "13")],
                   "company_id string, raw_name string, license_type string, license_number string")
    parties = frame([("c1", "owner", 1, "A-1"), ("c1", "owner", 1, "A-2"), ("c1", "owner", 1, "A-2"), ("c2", "owner", 1, "B-1")],
                    f"company_id string, role string, {key}")
    permits = frame([(1, "A-1", "Issued", "Shell"), (1, "B-1", "Issued", None)], f"{key}, status string, description string")
    leads = frame([("c1", 1, "A-1", 40.0), ("c1", 1, "A-2", 55.0), ("c1", None, None, 20.0), ("c2", 1, "B-1", 9.0)],
                  f"company_id string, {key}, score double")
    licenses = frame([], "company_id string, license_type string, license_number string, status string")
    seen = frame([(1, "B-1", "Fire", "Open")], f"{key}, department string, status string")
    edges = frame([], "license_key string, company_id string, seals long")
    found = reports.company_dossier(frame([("alpha llc",)], "name string"), company, licenses, parties, seen, edges, leads,
                                    values, people, permits)
    got = {}
    for r in found.collect():
        assert r.company_id == "c1"
        got.setdefault(r.section, []).append((r.item, r.detail))
    assert {k: sorted(v) for k, v in got.items()} == {
        "company": [("Alpha LLC", "1")], "permits": [("owner", "2")], "leads": [("3", "55.0")],
        "alias": [("Alpha LLC", "3"), ("Alpha, Inc.", "1")],
        "person": [("Pat Doe", "PE_FP 11"), ("Sam Roe", "PE_OTHER 12")],
        "permit": [("1 A-1", "owner, Issued, Shell"), ("1 A-2", "owner")],
        "lead": [("", "20.0"), ("1 A-1", "40.0"), ("1 A-2", "55.0")]}


def test_parts_read_again_are_worked_out_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(reports, "stored", lambda df, label: kept.append((label, df.count())) or df, raising=False)
    frame, key = spark.createDataFrame, "jurisdiction_id int, record_number string"
    parties = frame([("c1", "owner", 1, "A")] * 2 + [("c2", "owner", 1, "A")], f"company_id string, role string, {key}")
    leads = frame([("c1", 1, "A", 40.0), ("c2", 1, "A", 9.0)], f"company_id string, {key}, score double")
    company = frame([("c1", "Alpha", "ALPHA", "1")], "company_id string, canonical_name string, normalized_key string, phone string")
    reports.company_dossier(
        frame([("alpha",)], "name string"), company, frame([], "company_id string, license_type string, license_number string, status string"),
        parties, frame([], f"{key}, department string, status string"), frame([], "license_key string, company_id string, seals long"),
        leads, permits=frame([], f"{key}, status string, description string"))
    assert kept == [("own", 1), ("own-leads", 1)]
