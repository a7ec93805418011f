"""Queries: capability flags, volumes and target lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.catalog.bindings import AS_OF
from lintel.catalog.permits import _RULES_STRICT, _TXT
from lintel.catalog.registry import query
from lintel.operators import capability, filters, history

_COMMERCIAL = f"commercial as (select * from (select *, {_RULES_STRICT} as matched_rule from {_TXT}) where matched_rule like 'include:%')"
_RECENT = "applied_date > date '2000-08-01' and applied_date <= date '2001-08-01'"
_VOLUME = f"""volume as (
  select company_id, count(distinct record_number) as permit_volume_12mo
  from b_party join commercial using (jurisdiction_id, record_number) where {_RECENT} group by company_id)"""
FLAGGED = f"""{_COMMERCIAL}, {_VOLUME}, flagged as (
  select company_id, canonical_name, phone, coalesce(permit_volume_12mo, 0) as permit_volume_12mo,
    exists (select 1 from b_license l where l.company_id = c.company_id and license_type = 'FP_CONTRACTOR'
      and status = 'Active') as is_fp_contractor,
    exists (select 1 from b_license l where l.company_id = c.company_id and license_type = 'CA'
      and status = 'Active') as has_engineering_ca,
    exists (select 1 from b_license l where l.company_id = c.company_id and license_type = 'PE_FP'
      and status = 'Active') as has_fp_pe_on_record,
    (select min(license_number) from b_license l where l.company_id = c.company_id) as main_license
  from b_company c left join volume using (company_id)),
listed as (
  select *, case when is_fp_contractor and not has_engineering_ca and not has_fp_pe_on_record then 'A'
    when has_engineering_ca and not has_fp_pe_on_record then 'B' end as list
  from flagged where permit_volume_12mo > 0)"""


def flagged(t):
    volume = capability.permit_volume_12mo(t.b_party, t.b_permit, AS_OF)
    return capability.capability(t.b_company, t.b_license, volume)


_FLAGS = """select company_id, canonical_name, phone, normalized_key,
  coalesce(bool_or(license_type = '{0}' and status = 'Active'), false) as {1}
from b_company left join b_license using (company_id) group by all"""


@query("flag_fp_contractor", _FLAGS.format("FP_CONTRACTOR", "is_fp_contractor"))
def flag_fp_contractor(t):
    return capability.flag_fp_contractor(t.b_company, t.b_license)


@query("flag_engineering_ca", _FLAGS.format("CA", "has_engineering_ca"))
def flag_engineering_ca(t):
    return capability.flag_engineering_ca(t.b_company, t.b_license)


@query("flag_fp_pe", _FLAGS.format("PE_FP", "has_fp_pe_on_record"))
def flag_fp_pe(t):
    return capability.flag_fp_pe(t.b_company, t.b_license)


@query("permit_volume_12mo", f"with {_COMMERCIAL}, {_VOLUME} select * from volume")
def permit_volume_12mo(t):
    return capability.permit_volume_12mo(t.b_party, t.b_permit, AS_OF)


@query("capability_flags", f"""with {FLAGGED} select company_id, is_fp_contractor, has_engineering_ca,
  has_fp_pe_on_record, permit_volume_12mo from flagged""")
def capability_flags(t):
    return flagged(t).select("company_id", "is_fp_contractor", "has_engineering_ca", "has_fp_pe_on_record",
                             "permit_volume_12mo")


@query("target_list_a", f"with {FLAGGED} select company_id, permit_volume_12mo, list from listed where list = 'A'")
def target_list_a(t):
    return capability.target_list_a(flagged(t)).select("company_id", "permit_volume_12mo", "list")


@query("target_list_b", f"with {FLAGGED} select company_id, permit_volume_12mo, list from listed where list = 'B'")
def target_list_b(t):
    return capability.target_list_b(flagged(t)).select("company_id", "permit_volume_12mo", "list")


@query("coverage_guard", f"with {FLAGGED} select company_id, list from listed where list is not null")
def coverage_guard(t):
    landed = t.b_license.select(F.lit("board").alias("source"), F.lit(AS_OF).alias("landed_on"))
    expected = t.b_license.select("source").distinct().withColumn("source_verified", F.lit(True))
    coverage = history.source_coverage(expected, landed, AS_OF)
    return (capability.coverage_guard(capability.target_lists(flagged(t)), coverage, ["board"])
            .select("company_id", "list"))


@query("targets_by_county", f"""
with {_COMMERCIAL}, county_volume as (
  select company_id, count(distinct record_number) as permit_volume_12mo
  from b_party join commercial using (jurisdiction_id, record_number) join b_jurisdiction using (jurisdiction_id)
  where {_RECENT} and county = 'EUROPE' group by company_id),
types as (select company_id, min(license_number) as license, bool_or(license_type = 'FP_CONTRACTOR' and status = 'Active') as fp,
  bool_or(license_type = 'CA' and status = 'Active') as ca, bool_or(license_type = 'PE_FP' and status = 'Active') as pe
  from b_license group by company_id)
select canonical_name as company, phone, license, permit_volume_12mo as permit_count,
  concat('active fire protection contractor, no certificate of authorization, no FP engineer on record; ',
    permit_volume_12mo, ' permits in 12 months') as reason
from b_company join county_volume using (company_id) join types using (company_id)
where fp and not ca and not pe order by permit_volume_12mo desc, company_id limit 50""")
def targets_by_county(t):
    permits = filters.by_county(t.b_permit, t.b_jurisdiction, "EUROPE")
    volume = capability.permit_volume_12mo(t.b_party, permits, AS_OF)
    found = capability.capability(t.b_company, t.b_license, volume)
    return capability.targets(capability.target_list_a(found), limit=50)
