"""Company name, contact and licence keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words dropped from company names.
COMPANY_SUFFIXES = ("INC", "LLC", "CORP", "CO", "COMPANY", "PA", "LTD", "GROUP", "SERVICES",
                    "OF FLORIDA")

# Street words and their short forms.
STREET_WORDS = {
    "STREET": "ST", "AVENUE": "AVE", "BOULEVARD": "BLVD", "ROAD": "RD", "DRIVE": "DR",
    "LANE": "LN", "COURT": "CT", "PARKWAY": "PKWY", "HIGHWAY": "HWY", "CIRCLE": "CIR",
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W",
    "SUITE": "UNIT", "STE": "UNIT", "APT": "UNIT", "APARTMENT": "UNIT",
}


def suffix_pattern() -> str:
    longest_first = sorted(COMPANY_SUFFIXES, key=lambda s: (-len(s), s))
    return rf"\b(?:{'|'.join(longest_first)})\b"


def normalize_company(name: Column) -> Column:
    """Comparison key of a company name; null when nothing is left.

    Joining marks become spaces, other punctuation goes without a trace so that
    "L.L.C." reads "LLC", then suffix words go as whole words.
    """
    text = F.regexp_replace(F.upper(name), r"[&/-]", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")
    text = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), suffix_pattern(), "")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def phone_key(phone: Column) -> Column:
    """Last ten digits; shorter numbers give no key."""
    digits = F.regexp_replace(phone, r"[^0-9]", "")
    return F.when(F.length(digits) >= 10, F.substring(digits, -10, 10))


def email_key(email: Column) -> Column:
    return F.nullif(F.lower(F.trim(email)), F.lit(""))


def address_key(address: Column) -> Column:
    """Upper case, no punctuation, street words in their short form."""
    text = F.regexp_replace(F.upper(address), r"#", " UNIT ")
    text = F.trim(F.regexp_replace(text, r"[^A-Z0-9]+", " "))
    short = F.create_map(*[F.lit(w) for pair in STREET_WORDS.items() for w in pair])
    words = F.transform(F.split(text, " "),
                        lambda w: F.coalesce(F.try_element_at(short, w), w))
    return F.nullif(F.array_join(words, " "), F.lit(""))


def zip5(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, r"\b(\d{5})(?:-\d{4})?\s*$", 1), F.lit(""))


def license_key(number: Column) -> Column:
    """Upper case, no blanks or marks, no leading zeros."""
    text = F.regexp_replace(F.upper(number), r"[^A-Z0-9]", "")
    return F.nullif(F.regexp_replace(text, r"^0+", ""), F.lit(""))
