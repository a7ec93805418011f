"""Queries: validation, filters, history and ingest planning."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lintel.catalog.bindings import AS_OF, SNAPSHOT_CUT
from lintel.catalog.registry import query
from lintel.functions import patterns as P
from lintel.operators import filters, history, partials, state
from lintel.operators.validate import assert_nonempty, validate
from lintel.schemas import PARTY_ROLES, PERMIT_RULES, REVIEW_RULES, FieldRule
from lintel.session import scratch_path

_LANDED = """select jurisdiction_id, cast(record_number as varchar(20)) as record_number, record_type,
    case when record_number % 101 = 0 then '' else status end as status,
    case when record_number % 89 = 0 then '13/45/2001' else cast(applied_date as varchar(20)) end as applied_date,
    case when record_number % 97 = 0 then 'n/a' else cast(valuation as varchar(20)) end as valuation,
    case when record_number % 103 = 0 then 'large' else cast(square_footage as varchar(20)) end as square_footage
  from {permits}"""

_LANDED_DUCK = "landed as (" + _LANDED.replace("{permits}", "b_permit") + ")"


def _landed(t):
    return t.spark.sql(_LANDED, permits=t.b_permit)


@query("validate_accepted", f"""
with {_LANDED_DUCK}
select jurisdiction_id, record_number, record_type, status, try_cast(applied_date as date) as applied_date,
  try_cast(valuation as decimal(14,2)) as valuation, try_cast(square_footage as int) as square_footage
from landed
where status <> '' and try_cast(applied_date as date) is not null
  and try_cast(valuation as decimal(14,2)) is not null and try_cast(square_footage as int) is not null""")
def validate_accepted(t):
    return validate(_landed(t), PERMIT_RULES)[0]


@query("validate_rejects", f"""
with {_LANDED_DUCK}, tagged as (
  select *, concat_ws(',',
    case when status = '' then 'status:missing' end,
    case when try_cast(applied_date as date) is null then 'applied_date:not_date' end,
    case when try_cast(valuation as decimal(14,2)) is null then 'valuation:not_decimal' end,
    case when try_cast(square_footage as int) is null then 'square_footage:not_int' end) as reject_reasons
  from landed)
select * from tagged where reject_reasons <> ''""")
def validate_rejects(t):
    rejects = validate(_landed(t), PERMIT_RULES)[1]
    return rejects.withColumn("reject_reasons", F.array_join("reject_reasons", ","))


@query("validate_roles", """
select role, count(*) as parties from b_party_raw
where role not in ('applicant', 'owner', 'contractor', 'architect') group by role""")
def validate_roles(t):
    known = tuple(r for r in PARTY_ROLES if r not in ("engineer", "agent"))
    rejects = validate(t.b_party_raw, [FieldRule("role", "string", True, known)])[1]
    return rejects.groupBy("role").agg(F.count(F.lit(1)).alias("parties"))


@query("assert_nonempty", "select jurisdiction_id, count(*) as permits from b_permit group by jurisdiction_id")
def nonempty(t):
    return (assert_nonempty(t.b_permit, "permits").groupBy("jurisdiction_id")
            .agg(F.count(F.lit(1)).alias("permits")))


@query("filter_window", """
select jurisdiction_id, record_number, record_type, applied_date from b_permit
where applied_date between date '2000-01-01' and date '2000-12-31'
  and record_type in ('New Construction', 'Tenant Improvement')""")
def filter_window(t):
    return (filters.filter_window(t.b_permit, date(2000, 1, 1), date(2000, 12, 31),
                                  ["New Construction", "Tenant Improvement"])
            .select("jurisdiction_id", "record_number", "record_type", "applied_date"))


_RULES_STRICT = """case
    when regexp_matches(txt, '(?i)\\b(single[- ]family)s?\\b') then 'exclude:single_family'
    when regexp_matches(txt, '(?i)\\b(sprinkler|fire alarm|fire suppression|standpipe|hood|clean agent|FACP|NFPA)s?\\b')
      then 'include:fire_system'
    when regexp_matches(txt, '(?i)\\b(roofing|re-?roof)s?\\b') then 'exclude:roofing'
    when regexp_matches(txt, '(?i)\\b(mechanical[- ]only)s?\\b') then 'exclude:mechanical_only'
    when regexp_matches(txt, '(?i)\\b(pool)s?\\b') then 'exclude:pool'
    when regexp_matches(txt, '(?i)\\b(fence)s?\\b') then 'exclude:fence'
    when regexp_matches(txt, '(?i)\\b(sign)s?\\b') then 'exclude:sign'
    when regexp_matches(txt, '(?i)\\b(new construction)s?\\b') then 'include:new_construction'
    when regexp_matches(txt, '(?i)\\b(shell)s?\\b') then 'include:shell'
    when regexp_matches(txt, '(?i)\\b(tenant improvement|build-?out)s?\\b') then 'include:tenant_improvement'
    when regexp_matches(txt, '(?i)\\b(alteration)s?\\b') then 'include:alteration'
    when regexp_matches(txt, '(?i)\\b(addition)s?\\b') then 'include:addition'
    when regexp_matches(txt, '(?i)\\b(change of occupancy)s?\\b') then 'include:change_of_occupancy'
    else 'exclude:no_match' end"""
_TXT = "(select *, concat(record_type, ' ', description) as txt from b_permit)"


@query("commercial_only", f"""
select * from (select record_number, record_type, description, {_RULES_STRICT} as matched_rule from {_TXT})
where matched_rule like 'include:%'""")
def commercial_only(t):
    return (filters.commercial_only(t.b_permit)
            .select("record_number", "record_type", "description", "matched_rule"))


@query("commercial_rule_literal", """
select matched_rule, count(*) as permits from (
  select case
    when txt similar to '(?i).*single[- ]family.*' then 'exclude:single_family'
    when regexp_matches(txt, '(?i)sprinkler|fire alarm|fire suppression|standpipe|hood|clean agent|FACP|NFPA')
      then 'include:fire_system'
    when regexp_matches(txt, '(?i)roofing|re-?roof') then 'exclude:roofing'
    when regexp_matches(txt, '(?i)mechanical[- ]only') then 'exclude:mechanical_only'
    when regexp_matches(txt, '(?i)pool') then 'exclude:pool'
    when regexp_matches(txt, '(?i)fence') then 'exclude:fence'
    when regexp_matches(txt, '(?i)sign') then 'exclude:sign'
    when regexp_matches(txt, '(?i)new construction') then 'include:new_construction'
    when regexp_matches(txt, '(?i)shell') then 'include:shell'
    when regexp_matches(txt, '(?i)tenant improvement|build-?out') then 'include:tenant_improvement'
    else 'exclude:no_match' end as matched_rule
  from """ + _TXT + """) group by matched_rule""")
def commercial_rule_literal(t):
    return (filters.classify_commercial(t.b_permit, strict=False)
            .groupBy("matched_rule").agg(F.count(F.lit(1)).alias("permits")))


@query("fire_departments", """
select department, regexp_matches(department, '(?i)fire|life safety|fire marshal|FPB') as is_fire,
  count(*) as reviews from b_review group by all""")
def fire_departments(t):
    return (t.b_review.groupBy("department", P.is_fire_department(F.col("department")).alias("is_fire"))
            .agg(F.count(F.lit(1)).alias("reviews")))


@query("adverse_statuses", """
select status, regexp_matches(status,
  '(?i)reject|denied|corrections|comments|revise|resubmit|disapprov|incomplete|not approved') as is_adverse,
  count(*) as reviews from b_review group by all""")
def adverse_statuses(t):
    return (t.b_review.groupBy("status", P.is_adverse(F.col("status")).alias("is_adverse"))
            .agg(F.count(F.lit(1)).alias("reviews")))


@query("niche_match", f"""
select * from (select record_number, concat_ws(',',
    case when regexp_matches(txt, '(?i)\\bdata cent(er|re)s?\\b') then 'data_center' end,
    case when regexp_matches(txt, '(?i)\\b(battery|ESS)s?\\b') then 'battery_ess' end,
    case when regexp_matches(txt, '(?i)\\bassisted livings?\\b') then 'assisted_living' end,
    case when regexp_matches(txt, '(?i)\\bhigh[- ]rises?\\b') then 'high_rise' end,
    case when regexp_matches(txt, '(?i)\\bclean agents?\\b') then 'clean_agent' end,
    case when regexp_matches(txt, '(?i)\\bwarehouses?\\b') and square_footage > 100000
      then 'large_warehouse' end) as niches from {_TXT})
where niches <> ''""")
def niche_match(t):
    return filters.niche_match(t.b_permit).select("record_number",
                                                  F.array_join("niches", ",").alias("niches"))


@query("license_filter", """
select license_number, license_type, state from b_license
where license_type in ('FP_CONTRACTOR', 'PE_FP') and status = 'Active'""")
def license_filter(t):
    return (filters.license_filter(t.b_license, ["FP_CONTRACTOR", "PE_FP"])
            .select("license_number", "license_type", "state"))


@query("by_county", """
select county, record_number, applied_date from b_permit join b_jurisdiction using (jurisdiction_id)
where county = 'ASIA'""")
def by_county(t):
    return (filters.by_county(t.b_permit, t.b_jurisdiction, "asia")
            .select("county", "record_number", "applied_date"))


@query("with_jurisdiction", """
select slug, county, timezone, source_verified, count(*) as permits
from b_permit join b_jurisdiction using (jurisdiction_id) where enabled group by all""")
def with_jurisdiction(t):
    return (filters.with_jurisdiction(t.b_permit, t.b_jurisdiction)
            .groupBy("slug", "county", "timezone", "source_verified")
            .agg(F.count(F.lit(1)).alias("permits")))


@query("local_date", """
select local_day, count(*) as events from (
  select cast(timezone(timezone, timezone('UTC', ts)) as date) as local_day
  from events join b_jurisdiction on jurisdiction_id = user_id % 25) group by local_day""")
def local_date(t):
    events = t.events.withColumn("jurisdiction_id", (F.col("user_id") % 25).cast("int"))
    return (filters.local_date(events, t.b_jurisdiction, "ts", "local_day")
            .groupBy("local_day").agg(F.count(F.lit(1)).alias("events")))


_SEEN = "jurisdiction_id, record_number, cycle_number, department"


@query("current_state", f"""
select {_SEEN}, status, status_date, observed_at, comment_text, first_seen_at, last_seen_at from (
  select *, min(observed_at) over k as first_seen_at, max(observed_at) over k as last_seen_at,
    row_number() over (partition by {_SEEN} order by status_date desc, observed_at desc, comment_text desc,
      due_date desc nulls last, opened_on desc, reviewer_name desc, status desc) as rn
  from b_review window k as (partition by {_SEEN})) where rn = 1""")
def current_state(t):
    return (history.current_state(t.b_review, _SEEN.split(", "), ["status_date", "observed_at"])
            .select(*_SEEN.split(", "), "status", "status_date", "observed_at", "comment_text",
                    "first_seen_at", "last_seen_at"))


@query("merge_batch", f"""
select {_SEEN}, status, status_date, first_seen_at, last_seen_at from (
  select *, min(observed_at) over k as first_seen_at, max(observed_at) over k as last_seen_at,
    row_number() over (partition by {_SEEN} order by status_date desc, observed_at desc, comment_text desc,
      due_date desc nulls last, opened_on desc, reviewer_name desc, status desc) as rn
  from b_review window k as (partition by {_SEEN})) where rn = 1""")
def merge_batch(t):
    key, order = _SEEN.split(", "), ["status_date", "observed_at"]
    early = F.col("status_date") < F.lit(SNAPSHOT_CUT)
    current = history.current_state(t.b_review.filter(early), key, order)
    return (history.merge_batch(current, t.b_review.filter(~early), key, order)
            .select(*key, "status", "status_date", "first_seen_at", "last_seen_at"))


@query("merge_into_state", f"""
select {_SEEN}, status, status_date, first_seen_at, last_seen_at from (
  select *, min(observed_at) over k as first_seen_at, max(observed_at) over k as last_seen_at,
    row_number() over (partition by {_SEEN} order by status_date desc, observed_at desc, comment_text desc,
      due_date desc nulls last, opened_on desc, reviewer_name desc, status desc) as rn
  from b_review window k as (partition by {_SEEN})) where rn = 1""")
def merge_into_state(t):
    """The same state as one fold, from three batches into a bucketed table, one of them twice."""
    key, order, path = _SEEN.split(", "), ["status_date", "observed_at"], scratch_path(t.spark, "state")
    part = F.when(F.col("status_date") < F.lit(SNAPSHOT_CUT), F.lit(0)).otherwise(1 + F.col("record_number") % 2)
    for version in (0, 1, 1, 2):
        state.merge_into_state(t.b_review.filter(part == version), path, key, version, order, buckets=64)
    return state.read_state(t.spark, path).select(*key, "status", "status_date", "first_seen_at", "last_seen_at")


@query("advance_watermark", """
select jurisdiction_id, max(applied_date) as landed_through from b_permit group by jurisdiction_id""")
def advance_watermark(t):
    early = t.b_permit.filter(F.col("applied_date") < F.lit(SNAPSHOT_CUT))
    late = t.b_permit.filter(F.col("applied_date") >= F.lit(SNAPSHOT_CUT))
    first = history.advance_watermark(
        early.select("jurisdiction_id", F.col("applied_date").alias("landed_through")), early)
    return history.advance_watermark(first, late)


@query("validate_reviews", """
select status_date is null as rejected, count(*) as reviews from (
  select case when cycle_number % 7 <> 0 then status_date end as status_date from b_review) group by all""")
def validate_reviews(t):
    """Reviews whose date is missing in every seventh cycle, split by the review rules."""
    landed = t.b_review.select("jurisdiction_id", "record_number", "cycle_number", "department", "status", "due_date",
                               F.when(F.col("cycle_number") % 7 != 0, F.col("status_date")).alias("status_date"))
    accepted, rejects = validate(landed, REVIEW_RULES)
    return accepted.select(F.lit(False).alias("rejected")).unionByName(
        rejects.select(F.lit(True).alias("rejected"))).groupBy("rejected").agg(F.count(F.lit(1)).alias("reviews"))


@query("daily_plan", """
with r as (select jurisdiction_id, record_number, max(status_date) as reviewed_on from b_review group by all),
p as (select q.*, greatest(changed_on, reviewed_on) as touched_on from b_permit q left join r using (jurisdiction_id, record_number))
select record_number, case when applied_date between date '2001-07-25' and date '2001-08-01' then 'recent'
  else 'recheck' end as plan_reason from p
where applied_date between date '2001-07-25' and date '2001-08-01'
  or (finaled_date is null and status <> 'Issued'
      and touched_on between date '2001-05-03' and date '2001-08-01')""")
def daily_plan(t):
    return history.daily_plan(history.with_touched(t.b_permit, t.b_review), AS_OF, ["Issued"]).select("record_number", "plan_reason")


@query("backfill_plan", """
select jurisdiction_id, pull_date from (
  select jurisdiction_id, cast(unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 day)) as date)
    as pull_date from b_jurisdiction where enabled)
where (jurisdiction_id, pull_date) not in (select jurisdiction_id, applied_date from b_permit)""")
def backfill_plan(t):
    done = t.b_permit.select("jurisdiction_id", F.col("applied_date").alias("pull_date"))
    return history.backfill_plan(t.b_jurisdiction, date(1995, 1, 1), AS_OF, done)


@query("needs_fetch", """
with cache as (select record_number, max(status) as status from b_review group by record_number)
select p.record_number, p.status, c.status as cached_status,
  case when c.record_number is null then 'new' else 'status_changed' end as fetch_reason
from b_permit p left join cache c on p.record_number = c.record_number
where c.record_number is null or p.status is distinct from c.status""")
def needs_fetch(t):
    cache = t.b_review.groupBy("record_number").agg(F.max("status").alias("status"))
    stubs = t.b_permit.select("record_number", "status")
    return history.needs_fetch(stubs, cache, ["record_number"])


@query("pacing_audit", """
select * from (
  select host, request_id, ts, lag(ts) over (partition by host order by ts, request_id) as previous_ts
  from b_fetch_log)
where previous_ts is not null and date_diff('microsecond', previous_ts, ts) < 120000000""")
def pacing_audit(t):
    return (history.pacing_audit(t.b_fetch_log, default_gap=120.0)
            .select("host", "request_id", "ts", "previous_ts"))


_COVERAGE = """
with expected as (
  select slug as source, source_verified from b_jurisdiction
  union all select distinct concat('registry ', county), true from b_jurisdiction),
seen as (select slug as source, count(*) as n, max(applied_date) as newest
  from b_permit join b_jurisdiction using (jurisdiction_id) group by slug)
select source, coalesce(n, 0) as rows, newest,
  cast(date_diff('day', newest, date '2001-08-01') as int) as age_days,
  case when coalesce(n, 0) = 0 then 'no rows' when date_diff('day', newest, date '2001-08-01') > 5 then 'stale'
    when not source_verified then 'unverified' else 'ok' end as coverage
from expected left join seen using (source)"""


def _sources(t):
    """Landed rows by source, and the sources that are expected."""
    jurisdictions = t.b_jurisdiction
    landed = (t.b_permit.select("jurisdiction_id", F.col("applied_date").alias("landed_on"))
              .join(jurisdictions.select("jurisdiction_id", F.col("slug").alias("source")), "jurisdiction_id"))
    expected = jurisdictions.select(F.col("slug").alias("source"), "source_verified").unionByName(
        jurisdictions.select(F.concat(F.lit("registry "), "county").alias("source")).distinct()
        .withColumn("source_verified", F.lit(True)))
    return landed, expected


@query("source_coverage", _COVERAGE)
def source_coverage(t):
    landed, expected = _sources(t)
    return (history.source_coverage(expected, landed, AS_OF, max_age_days=5)
            .select("source", "rows", "newest", "age_days", "coverage"))


@query("source_coverage_kept", _COVERAGE)
def source_coverage_kept(t):
    """The same from counts kept by five batches, one of them loaded twice."""
    landed, expected = _sources(t)
    path = scratch_path(t.spark, "sources")
    for batch in (0, 1, 2, 3, 4, 1):
        partials.add_sources(landed.filter(F.pmod(F.month("landed_on"), F.lit(5)) == batch), path, str(batch))
    return (partials.kept_coverage(expected, path, AS_OF, max_age_days=5)
            .select("source", "rows", "newest", "age_days", "coverage"))
