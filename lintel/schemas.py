"""Declared schemas and field rules.  Nothing is inferred from landed data."""

from __future__ import annotations

from dataclasses import dataclass

PERMIT_KEY = ["jurisdiction_id", "record_number"]
REVIEW_KEY = [*PERMIT_KEY, "cycle_number", "department"]

# The allowed party roles and seal extraction methods.
PARTY_ROLES = ("applicant", "owner", "contractor", "engineer", "architect", "agent")
EXTRACTION_METHODS = ("digital_signature", "pdf_text", "ocr")

_PROVENANCE = ("source_url string, first_seen_at timestamp, last_seen_at timestamp, "
               "raw_payload string")

_TABLES = {
    "jurisdiction": "jurisdiction_id int, slug string, display_name string, platform string, "
                    "base_url string, timezone string, notes string, county string, "
                    "enabled boolean, source_verified boolean",
    "permit": "jurisdiction_id int, record_number string, record_type string, "
              "record_subtype string, description string, status string, applied_date date, "
              "issued_date date, finaled_date date, valuation decimal(14,2), "
              "square_footage int, occupancy_type string, street string, city string, "
              "state string, zip string, parcel_id string, lat double, lon double, "
              "portal_url string",
    "party": "jurisdiction_id int, record_number string, role string, raw_name string, "
             "company_id string, license_number string, phone string, email string, "
             "address string",
    "review": "jurisdiction_id int, record_number string, cycle_number int, "
              "department string, reviewer_name string, status string, status_date date, "
              "due_date date, comment_text string, observed_at timestamp",
    "document": "document_id string, jurisdiction_id int, record_number string, title string, "
                "portal_url string, local_path string, sha256 string, page_count int, "
                "downloaded_at timestamp",
    "seal": "document_id string, page_number int, engineer_name string, "
            "license_number string, discipline string, firm_name string, "
            "extraction_method string, confidence double, "
            "bbox struct<x0:double,y0:double,x1:double,y1:double>, raw_text string",
    "company": "company_id string, canonical_name string, normalized_key string, "
               "aliases array<string>, license_numbers array<string>, phone string, "
               "website string, address string, has_engineering_ca boolean, "
               "has_fp_pe_on_record boolean, is_fp_contractor boolean",
    "person": "person_id string, name string, license_number string, license_type string, "
              "discipline string, status string, address string, state string, "
              "company_id string",
    "license": "source string, license_type string, license_number string, class string, "
               "status string, business_name string, qualifier string, discipline string, "
               "address string, state string, phone string",
    "lead": "company_id string, jurisdiction_id int, record_number string, score decimal(9,4), "
            "score_breakdown string, stage string, next_action string, notes string, "
            "snoozed_until date",
    "review_queue": "left_key string, right_key string, score double, reason string, "
                    "decision string",
    "hot_signal": "jurisdiction_id int, record_number string, cycle_number int, "
                  "reason string, department string, status string, signal_date date, "
                  "comment_text string, reasons array<string>",
    "watermark": "jurisdiction_id int, landed_through date",
    "contact_log": "company_id string, contacted_on date",
    "digest_permit": "run_date date, jurisdiction_id int, record_number string",
    "digest_target": "run_date date, company_id string, list string",
}

_PLAIN = {"review_queue", "hot_signal", "watermark", "contact_log", "digest_permit", "digest_target"}

# DDL text, as ``spark.read.schema`` and ``createDataFrame`` take it.
TABLES: dict[str, str] = {
    name: ddl if name in _PLAIN else f"{ddl}, {_PROVENANCE}" for name, ddl in _TABLES.items()
}


@dataclass(frozen=True)
class FieldRule:
    """What one landed field must satisfy before it becomes a typed column."""

    name: str
    type: str = "string"
    required: bool = False
    allowed: tuple[str, ...] = ()


PERMIT_RULES = [
    FieldRule("jurisdiction_id", "int", required=True),
    FieldRule("record_number", "string", required=True),
    FieldRule("record_type", "string", required=True),
    FieldRule("status", "string", required=True),
    FieldRule("applied_date", "date", required=True),
    FieldRule("valuation", "decimal(14,2)"),
    FieldRule("square_footage", "int"),
]

PARTY_RULES = [
    FieldRule("record_number", "string", required=True),
    FieldRule("role", "string", required=True, allowed=PARTY_ROLES),
    FieldRule("raw_name", "string", required=True),
]

REVIEW_RULES = [
    FieldRule("jurisdiction_id", "int", required=True),
    FieldRule("record_number", "string", required=True),
    FieldRule("cycle_number", "int", required=True),
    FieldRule("department", "string", required=True),
    FieldRule("status", "string", required=True),
    FieldRule("status_date", "date", required=True),
    FieldRule("due_date", "date"),
]

DOCUMENT_RULES = [
    FieldRule("record_number", "string", required=True),
    FieldRule("sha256", "string", required=True),
]

SEAL_RULES = [
    FieldRule("extraction_method", "string", required=True, allowed=EXTRACTION_METHODS),
    FieldRule("license_number", "string", required=True),
]

LICENSE_RULES = [
    FieldRule("license_type", "string", required=True),
    FieldRule("license_number", "string", required=True),
    FieldRule("status", "string", required=True),
]
