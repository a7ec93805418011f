"""Text rules: departments, statuses, commercial work, niches, seal numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what is watched, kept and extracted.
FIRE_DEPARTMENT = r"fire|life safety|fire marshal|FPB"
ADVERSE_STATUS = (r"reject|denied|corrections|comments|revise|resubmit|disapprov|incomplete"
                  r"|not approved")
FIRE_SYSTEM = r"sprinkler|fire alarm|fire suppression|standpipe|hood|clean agent|FACP|NFPA"
WORK_TYPES = [
    ("new_construction", r"new construction"),
    ("shell", r"shell"),
    ("tenant_improvement", r"tenant improvement|build-?out"),
    ("alteration", r"alteration"),
    ("addition", r"addition"),
    ("change_of_occupancy", r"change of occupancy"),
]
EXCLUDED_WORK = [
    ("single_family", r"single[- ]family"),
    ("roofing", r"roofing|re-?roof"),
    ("mechanical_only", r"mechanical[- ]only"),
    ("pool", r"pool"),
    ("fence", r"fence"),
    ("sign", r"sign"),
]
NICHES = [
    ("data_center", r"data cent(?:er|re)"),
    ("battery_ess", r"battery|ESS"),
    ("assisted_living", r"assisted living"),
    ("high_rise", r"high[- ]rise"),
    ("clean_agent", r"clean agent"),
]
WAREHOUSE = r"warehouse"
WAREHOUSE_SQUARE_FEET = 100_000
PE_NUMBER = r"(?:FL\s*PE|PE\s*#?|LICENSE\s*(?:NO\.?|#))\s*(\d{4,6})"
CA_NUMBER = r"(?:CA|C\.A\.|CERTIFICATE OF AUTHORIZATION)\s*#?\s*(\d{3,6})"
OPEN_REVIEW = r"in review|under review|pending|received|assigned|routed"


def any_case(pattern: str) -> str:
    return f"(?i)(?:{pattern})"


def whole_words(pattern: str) -> str:
    """Word edges on both ends, plural allowed: "hood" must not hit "Neighborhood"."""
    return rf"(?i)\b(?:{pattern})s?\b"


def rule(pattern: str, strict: bool = True) -> str:
    return whole_words(pattern) if strict else any_case(pattern)


def number_rule(pattern: str, strict: bool = True) -> str:
    """Licence numbers: strict keeps "PIPE 4000" and seven-digit numbers out."""
    return rf"(?i)\b{pattern}\b" if strict else rf"(?i){pattern}"


def is_fire_department(department: Column) -> Column:
    return F.coalesce(department.rlike(any_case(FIRE_DEPARTMENT)), F.lit(False))


def is_adverse(status: Column, exempt: str | None = None) -> Column:
    """Adverse status; ``exempt`` optionally names statuses to leave out."""
    hit = F.coalesce(status.rlike(any_case(ADVERSE_STATUS)), F.lit(False))
    if exempt:
        hit = hit & ~F.coalesce(status.rlike(any_case(exempt)), F.lit(False))
    return hit


def is_open_review(status: Column) -> Column:
    return F.coalesce(status.rlike(any_case(OPEN_REVIEW)), F.lit(False))


def _named(text: Column, rules: list[tuple[str, str]], verdict: str, strict: bool) -> Column:
    """Name of the first rule that matches a text known to match one of them."""
    named = F.when(text.rlike(rule(rules[0][1], strict)), F.lit(f"{verdict}:{rules[0][0]}"))
    for name, pattern in rules[1:]:
        named = named.when(text.rlike(rule(pattern, strict)), F.lit(f"{verdict}:{name}"))
    return named


def _any_of(text: Column, rules: list[tuple[str, str]], strict: bool) -> Column:
    return text.rlike(rule("|".join(pattern for _, pattern in rules), strict))


def commercial_rule(record_type: Column, description: Column, strict: bool = True) -> Column:
    """Name of the rule that keeps or drops a permit.

    A single-family record is always dropped; a fire-system keyword keeps
    anything else; other exclusions beat the work-type list.  Each list is one
    pattern first, so a text is scanned four times however long the lists are.
    """
    text = F.concat_ws(" ", record_type, description)
    return (
        F.when(_any_of(text, EXCLUDED_WORK[:1], strict), F.lit(f"exclude:{EXCLUDED_WORK[0][0]}"))
        .when(text.rlike(rule(FIRE_SYSTEM, strict)), F.lit("include:fire_system"))
        .when(_any_of(text, EXCLUDED_WORK[1:], strict), _named(text, EXCLUDED_WORK[1:], "exclude", strict))
        .when(_any_of(text, WORK_TYPES, strict), _named(text, WORK_TYPES, "include", strict))
        .otherwise(F.lit("exclude:no_match"))
    )


def is_commercial(record_type: Column, description: Column, strict: bool = True) -> Column:
    """The verdict alone, where the name of the rule is not wanted."""
    text = F.concat_ws(" ", record_type, description)
    return ~_any_of(text, EXCLUDED_WORK[:1], strict) & (
        text.rlike(rule(FIRE_SYSTEM, strict))
        | (_any_of(text, WORK_TYPES, strict) & ~_any_of(text, EXCLUDED_WORK[1:], strict)))


def niche_hits(text: Column, square_footage: Column) -> Column:
    """Array of high-value niches a permit falls in."""
    hits = [F.when(text.rlike(whole_words(p)), F.lit(n)) for n, p in NICHES]
    big = text.rlike(whole_words(WAREHOUSE)) & (square_footage > WAREHOUSE_SQUARE_FEET)
    hits.append(F.when(big, F.lit("large_warehouse")))
    return F.array_compact(F.array(*hits))
