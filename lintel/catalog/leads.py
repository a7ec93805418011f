"""Queries: points, leads, digest, dossier and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.catalog import capability as cap
from lintel.catalog import seals as sl
from lintel.catalog.bindings import AS_OF
from lintel.catalog.registry import query
from lintel.catalog.reviews import _ALL
from lintel.config import load_weights
from lintel.operators import reports, reviews, scoring, seals
from lintel.operators.filters import niche_match as with_niches
from lintel.plans import jobs
from lintel.plans.hitters import find_hitters, kept_hitters, write_keyed
from lintel.session import scratch_path, stored

WEIGHTS = load_weights()


def _coverage(t):
    """How well each licence registry is covered."""
    return t.b_license.groupBy("source").agg(
        F.when(F.count(F.lit(1)) > 0, F.lit("fresh")).otherwise(F.lit("no rows")).alias("coverage"))


_DAY = "date '2001-08-01'"
_FIRE = "regexp_matches(department, '(?i)fire|life safety|fire marshal|FPB')"
_ADVERSE = ("regexp_matches(status, '(?i)reject|denied|corrections|comments|revise|resubmit|disapprov"
            "|incomplete|not approved')")
_STATUS = f"""review_status as (
  select jurisdiction_id, record_number, max(cycle_number) as fire_cycles,
    max(case when {_ADVERSE} then status_date end) as last_adverse_on
  from b_review where {_FIRE} group by all)"""
_AGE = "date_diff('day', {0}, " + _DAY + ")"


def _pts(condition, points):
    return f"cast(case when {condition} then {points} else 0 end as decimal(9,4))"


_P = {
    "pts_rejection": _pts(f"last_adverse_on is not null and {_AGE.format('last_adverse_on')} between 0 and 14", 40),
    "pts_repeat": _pts("fire_cycles >= 2", 15),
    "pts_target": "cast(case list when 'A' then 30 when 'B' then 20 else 0 end as decimal(9,4))",
    "pts_niche": _pts("niches <> ''", 25),
    "pts_valuation": "cast(case when valuation > 2000000 then 15 when valuation >= 500000 then 8 else 0 end as decimal(9,4))",
    "pts_overloaded": _pts("relies_on_overloaded", 10),
    "pts_recency": f"""cast(case when applied_date is null or {_AGE.format('applied_date')} < 0 then 0::double
      when {_AGE.format('applied_date')} <= 30 then 10::double
      when {_AGE.format('applied_date')} < 180 then (180 - {_AGE.format('applied_date')})::double / 150 * 10
      else 0::double end as decimal(9,4))""",
    "pts_contacted": _pts(f"last_contact_on is not null and {_AGE.format('last_contact_on')} between 0 and 30", -50),
}

_NICHES = """concat_ws(',',
    case when regexp_matches(txt, '(?i)\\bdata cent(er|re)s?\\b') then 'data_center' end,
    case when regexp_matches(txt, '(?i)\\b(battery|ESS)s?\\b') then 'battery_ess' end,
    case when regexp_matches(txt, '(?i)\\bassisted livings?\\b') then 'assisted_living' end,
    case when regexp_matches(txt, '(?i)\\bhigh[- ]rises?\\b') then 'high_rise' end,
    case when regexp_matches(txt, '(?i)\\bclean agents?\\b') then 'clean_agent' end,
    case when regexp_matches(txt, '(?i)\\bwarehouses?\\b') and square_footage > 100000 then 'large_warehouse' end)"""

_CONTACTS = f"""contacted as (select company_id, max(contacted_on) as last_contact_on from b_contact
  where contacted_on <= {_DAY} group by company_id)"""
_RELIES = "relies as (select company_id, true as relies_on_overloaded from sole semi join overloaded using (license_key))"

_LEADS = f"""{_ALL}, {cap.FLAGGED}, {sl.SOLE}, {sl.OVERLOADED}, {_RELIES}, {_CONTACTS}, {_STATUS},
permit_facts as (
  select p.jurisdiction_id, p.record_number, applied_date, valuation, {_NICHES} as niches,
    c.record_number is not null as is_commercial, h.record_number is not null as is_hot, fire_cycles, last_adverse_on
  from (select *, concat(record_type, ' ', description) as txt from b_permit) p
  left join (select record_number from commercial) c on c.record_number = p.record_number
  left join (select distinct record_number from picked) h on h.record_number = p.record_number
  left join review_status r on r.jurisdiction_id = p.jurisdiction_id and r.record_number = p.record_number),
on_permit as (
  select distinct company_id, f.* from b_party join permit_facts f using (jurisdiction_id, record_number)
  where is_hot or is_commercial),
candidates as (
  select company_id, jurisdiction_id, record_number, applied_date, valuation, niches, is_hot, fire_cycles,
    last_adverse_on from on_permit
  union all by name
  select company_id from listed where list is not null and company_id not in (select company_id from on_permit)),
leads as (
  select company_id, jurisdiction_id, record_number, {', '.join(f'{v} as {k}' for k, v in _P.items())}
  from candidates left join (select company_id, list from listed where list is not null) using (company_id)
  left join relies using (company_id) left join contacted using (company_id)),
scored_leads as (select *, cast({' + '.join(_P)} as decimal(9,4)) as score from leads)"""


def _listed(t, hitters=None):
    return jobs.target_firms(t.b_company, t.b_license, t.b_party, t.b_permit, AS_OF, _coverage(t), ["board"],
                             hitters=hitters)


def _hot(t, hitters=None):
    return jobs.monitor(t.b_review, AS_OF, hitters=hitters)


def _facts(t):
    return jobs.lead_facts(t.b_permit, t.b_review, _hot(t))


def _reliance(t):
    return jobs.reliance(sl.dated(t), t.b_party, AS_OF, limit=4)


def leads(t, hot=None, listed=None, index=None):
    parties = find_hitters(t.b_party, *jobs.PARTY_KEYS)
    hot = _hot(t) if hot is None else hot
    listed = _listed(t, parties) if listed is None else listed
    index = sl.dated(t) if index is None else index
    return jobs.score(jobs.lead_facts(t.b_permit, t.b_review, hot), t.b_party, listed,
                      jobs.reliance(index, t.b_party, AS_OF, limit=4), t.b_contact, WEIGHTS, AS_OF, parties)


@query("points_rejection", f"""with {_STATUS}
select jurisdiction_id, record_number, {_P['pts_rejection']} as points from review_status""")
def points_rejection(t):
    return reviews.permit_review_status(t.b_review).select(
        "jurisdiction_id", "record_number", scoring.pts_rejection(WEIGHTS, AS_OF).alias("points"))


@query("points_repeat", f"""with {_STATUS}
select jurisdiction_id, record_number, {_P['pts_repeat']} as points from review_status""")
def points_repeat(t):
    return reviews.permit_review_status(t.b_review).select(
        "jurisdiction_id", "record_number", scoring.pts_repeat(WEIGHTS).alias("points"))


@query("points_target", f"""with {cap.FLAGGED}
select company_id, {_P['pts_target']} as points from listed where list is not null""")
def points_target(t):
    return _listed(t).select("company_id", scoring.pts_target(WEIGHTS).alias("points"))


@query("points_niche", f"""select record_number, {_P['pts_niche']} as points from (
  select record_number, {_NICHES} as niches from (select *, concat(record_type, ' ', description) as txt from b_permit))
where niches <> ''""")
def points_niche(t):
    return with_niches(t.b_permit).select("record_number", scoring.pts_niche(WEIGHTS).alias("points"))


@query("points_valuation", f"select record_number, valuation, {_P['pts_valuation']} as points from b_permit")
def points_valuation(t):
    return t.b_permit.select("record_number", "valuation", scoring.pts_valuation(WEIGHTS).alias("points"))


@query("points_overloaded", f"""with {sl.SOLE}, {sl.OVERLOADED}, {_RELIES}
select company_id, {_P['pts_overloaded']} as points from relies""")
def points_overloaded(t):
    return _reliance(t).select("company_id", scoring.pts_overloaded(WEIGHTS).alias("points"))


@query("points_recency", f"select record_number, {_P['pts_recency']} as points from b_permit")
def points_recency(t):
    return t.b_permit.select("record_number", scoring.pts_recency(WEIGHTS, AS_OF).alias("points"))


@query("points_contacted", f"with {_CONTACTS} select company_id, {_P['pts_contacted']} as points from contacted")
def points_contacted(t):
    return scoring.last_contacts(t.b_contact, AS_OF).select(
        "company_id", scoring.pts_contacted(WEIGHTS, AS_OF).alias("points"))


@query("lead_candidates", f"""with {_LEADS}
select company_id, jurisdiction_id, record_number, coalesce(is_hot, false) as is_hot from candidates""")
def lead_candidates(t):
    found = scoring.lead_candidates(_facts(t), t.b_party, _listed(t))
    return found.select("company_id", "jurisdiction_id", "record_number",
                        F.coalesce("is_hot", F.lit(False)).alias("is_hot"))


@query("score_leads", f"""with {_LEADS}
select company_id, jurisdiction_id, record_number, score, {', '.join(_P)} from scored_leads""")
def score_leads(t):
    return leads(t).select("company_id", "jurisdiction_id", "record_number", "score", *scoring.SIGNALS)


@query("score_leads_kept_keys", f"""with {_LEADS}
select company_id, jurisdiction_id, record_number, score, {', '.join(_P)} from scored_leads""")
def score_leads_kept_keys(t):
    """The same run over tables that came in two batches and keep their hot keys: no table is scanned for them."""
    def kept(df, name, first, key_lists):
        path = scratch_path(t.spark, name)
        for batch, rows in (("1", df.filter(first)), ("2", df.filter(~first))):
            write_keyed(rows, path, batch, *key_lists)
        return t.spark.read.schema(df.schema).parquet(path), kept_hitters(t.spark, path, *key_lists)

    even = F.col("record_number") % 2 == 0
    reviews_, review_keys = kept(t.b_review, "reviews", even, jobs.REVIEW_KEYS)
    parties, party_keys = kept(t.b_party, "parties", even, jobs.PARTY_KEYS)
    candidates, seal_keys = kept(seals.with_license_key(t.b_seal_candidate), "candidates",
                                 F.col("document_id") % 2 == 0, jobs.SEAL_KEYS)
    found = _scored(t, reviews_, parties, candidates, review_keys, party_keys, seal_keys)
    return found.select("company_id", "jurisdiction_id", "record_number", "score", *scoring.SIGNALS)


def _scored(t, reviews_, parties, candidates, review_keys=None, party_keys=None, seal_keys=None):
    listed = jobs.target_firms(t.b_company, t.b_license, parties, t.b_permit, AS_OF, _coverage(t), ["board"],
                               hitters=party_keys)
    index = jobs.seal_index(candidates, t.b_license, t.b_document, t.b_permit, t.b_jurisdiction, seal_keys)
    facts = jobs.lead_facts(t.b_permit, reviews_, jobs.monitor(reviews_, AS_OF, hitters=review_keys))
    return jobs.score(facts, parties, listed, jobs.reliance(index, parties, AS_OF, limit=4), t.b_contact,
                      WEIGHTS, AS_OF, party_keys)


@query("actionable_leads", f"""with {_LEADS}
select company_id, record_number, score, 'new' as stage,
  case when pts_contacted < 0 then 'wait: contacted lately' when pts_rejection > 0 then 'call: recent fire review rejection'
    when pts_repeat > 0 then 'call: repeat fire review' when pts_target > 0 then 'introduce: needs outside sealing'
    else 'watch' end as next_action
from scored_leads left join contacted using (company_id)
where last_contact_on is null or last_contact_on + 10 <= {_DAY}""")
def actionable_leads(t):
    snoozed = scoring.last_contacts(t.b_contact, AS_OF).select(
        "company_id", F.date_add("last_contact_on", 10).alias("snoozed_until"))
    found = scoring.with_next_action(leads(t)).join(snoozed, "company_id", "left")
    return scoring.actionable(found, AS_OF).select("company_id", "record_number", "score", "stage", "next_action")


_LEAD_ORDER = "score desc, company_id, jurisdiction_id nulls first, record_number nulls first"


@query("top_leads", f"""with {_LEADS}
select company_id, jurisdiction_id, record_number, score from scored_leads order by {_LEAD_ORDER} limit 100""")
def top_leads(t):
    return scoring.top_leads(leads(t), k=100).select("company_id", "jurisdiction_id", "record_number", "score")


@query("top_leads_by_jurisdiction", f"""with {_LEADS}
select company_id, jurisdiction_id, record_number, score, place from (
  select *, cast(row_number() over (partition by jurisdiction_id order by {_LEAD_ORDER}) as int) as place
  from scored_leads) where place <= 10""")
def top_leads_by_jurisdiction(t):
    return (scoring.top_leads(leads(t), k=10, by="jurisdiction_id")
            .select("company_id", "jurisdiction_id", "record_number", "score", "place"))


@query("score_explain", f"""with {_LEADS}
select company_id, jurisdiction_id, record_number, signal, points from (
  unpivot (select company_id, jurisdiction_id, record_number, {', '.join(_P)} from scored_leads)
  on {', '.join(_P)} into name signal value points) where points <> 0""")
def score_explain(t):
    return scoring.score_explain(leads(t))


_OPENING = ("case reason when 'rejection' then 'Your fire review came back with comments; we can turn a sealed response around quickly.' "
            "when 'repeat_cycle' then 'Your permit is on another fire review cycle; a second pair of eyes may close it.' "
            "else 'Your fire review has been waiting; we can check what is holding it.' end")
_HOT_LINES = f"""hot_lines as (
  select jurisdiction_id, record_number, cycle_number, signal_date,
    concat('- Permit ', record_number, ' (', description, '), cycle ', cycle_number, ', ', department, ': ', h.status,
      ' on ', strftime(signal_date, '%Y-%m-%d'), '. > "', comment_text, '" ', {_OPENING}) as line
  from picked h left join b_permit using (jurisdiction_id, record_number))"""


@query("digest_hot", f"with {_ALL}, {_HOT_LINES} select * from hot_lines")
def digest_hot(t):
    return reports.digest_hot(_hot(t), t.b_permit)


_NEW_LEADS = """new_leads as (
  select jurisdiction_id, record_number, company_id, score from (
    select *, row_number() over (partition by jurisdiction_id, record_number order by score desc, company_id) as rn
    from scored_leads where record_number is not null and score >= 40)
  where rn = 1 and record_number not in (select record_number from b_permit where applied_date < date '1999-01-01'))"""


def _earlier(t):
    return t.b_permit.filter("applied_date < date '1999-01-01'")


def _earlier_targets(t):
    return t.b_license.filter("license_type = 'CA' and state = 'FL'").select(
        "company_id", F.lit("B").alias("list"))


@query("digest_new_leads", f"with {_LEADS}, {_NEW_LEADS} select * from new_leads")
def digest_new_leads(t):
    return reports.digest_new_leads(leads(t), _earlier(t), min_score=40)


_NEW_TARGETS = """new_targets as (
  select company_id, list from listed where list is not null
  except select company_id, 'B' from b_license where license_type = 'CA' and state = 'FL')"""


@query("digest_new_targets", f"with {cap.FLAGGED}, {_NEW_TARGETS} select * from new_targets")
def digest_new_targets(t):
    return reports.digest_new_targets(_listed(t), _earlier_targets(t))


@query("digest_lines", f"""with {_LEADS}, {_HOT_LINES}, {_NEW_LEADS}, {_NEW_TARGETS}
select 0 as section, 0 as place, '# Digest 2001-08-01' as line union all select 1, 0, '## HOT fire reviews'
union all select 2, 0, '## New high-score permits' union all select 3, 0, '## New target firms'
union all select 1, cast(row_number() over (order by signal_date desc, jurisdiction_id, record_number, cycle_number) as int),
  line from hot_lines
union all select 2, cast(row_number() over (order by score desc, company_id, jurisdiction_id, record_number) as int),
  concat('- Permit ', record_number, ', company ', company_id, ': score ', score) from new_leads
union all select 3, cast(row_number() over (order by list, company_id) as int),
  concat('- Company ', company_id, ' now on list ', list) from new_targets""")
def digest_lines(t):
    hot, listed = _hot(t), _listed(t)
    lines, _, _ = jobs.digest(AS_OF, hot, t.b_permit, leads(t, hot, listed), listed, _earlier(t),
                              _earlier_targets(t), min_score=40)
    return lines


@query("digest_second_run", f"""with {_LEADS}, {_HOT_LINES},
best_lead as (select * from (
    select *, row_number() over (partition by jurisdiction_id, record_number order by score desc, company_id) as rn
    from scored_leads where record_number is not null and score >= 40) where rn = 1)
select 'permit' as kind, cast(record_number as varchar) as item, company_id, cast(score as varchar) as detail
from best_lead where jurisdiction_id % 2 = 1
union all select 'target', list, company_id, null from listed where list is not null and company_id % 3 <> 0
union all select 'hot lines', null, null, cast(count(*) as varchar) from hot_lines""")
def digest_second_run(t):
    """Day one sees even jurisdictions and every third firm; day two what is left, over day one's run rows."""
    hot, listed = _hot(t), _listed(t)
    scored = stored(leads(t, hot, listed), "leads")
    none = t.b_permit.limit(0).select(F.lit(AS_OF).alias("run_date"), "jurisdiction_id", "record_number")
    no_firm = listed.limit(0).select(F.lit(AS_OF).alias("run_date"), "company_id", "list")
    _, permits, firms = jobs.digest(AS_OF, hot, t.b_permit, scored.filter("jurisdiction_id % 2 = 0"),
                                    listed.filter("company_id % 3 = 0"), none, no_firm, min_score=40)
    lines, permits, firms = jobs.digest(AS_OF, hot, t.b_permit, scored, listed, permits, firms, min_score=40)
    best = scored.groupBy("jurisdiction_id", "record_number").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "company_id")).alias("b"))
    new = permits.join(best, ["jurisdiction_id", "record_number"])
    text = F.lit(None).cast("string")
    return (new.select(F.lit("permit").alias("kind"), F.col("record_number").cast("string").alias("item"), "b.company_id",
                       (-F.col("b.s")).cast("string").alias("detail"))
            .unionByName(firms.select(F.lit("target").alias("kind"), F.col("list").alias("item"), "company_id",
                                      text.alias("detail")))
            .unionByName(lines.filter("section = 1 and place > 0").agg(F.count(F.lit(1)).cast("string").alias("detail"))
                         .select(F.lit("hot lines").alias("kind"), text.alias("item"),
                                 F.lit(None).cast("bigint").alias("company_id"), "detail")))


@query("company_dossier", f"""with {_LEADS}, dossier_edges as (
  select license_key, company_id, cast(sum(n) as bigint) as seals
  from (select jurisdiction_id, record_number, license_key, count(*) as n from dated group by all)
  join (select distinct jurisdiction_id, record_number, company_id from b_party where role <> 'engineer')
    using (jurisdiction_id, record_number) group by license_key, company_id),
own as (select distinct company_id, role, jurisdiction_id, record_number from b_party)
select company_id, 'company' as section, canonical_name as item, phone as detail from b_company
union all select company_id, 'license', concat(license_type, ' ', license_number), status from b_license
union all select company_id, 'permits', role, cast(count(*) as varchar) from own join b_company using (company_id) group by all
union all select company_id, 'fire reviews', status, cast(count(*) as varchar) from
  (select distinct company_id, jurisdiction_id, record_number from own join b_company using (company_id))
  join (select * from b_review where {_FIRE}) using (jurisdiction_id, record_number) group by company_id, status
union all select company_id, 'sealing engineer', license_key, cast(seals as varchar) from dossier_edges join b_company using (company_id)
union all select company_id, 'leads', cast(count(*) as varchar), cast(max(score) as varchar)
  from scored_leads join b_company using (company_id) group by company_id""")
def company_dossier(t):
    index = sl.dated(t)
    return reports.company_dossier(
        t.b_company.select(F.col("canonical_name").alias("name")), t.b_company, t.b_license, t.b_party,
        t.b_review, seals.engineer_client_map(index, t.b_party), leads(t, index=index))


@query("company_dossier_whole", f"""with {_LEADS}, dossier_edges as (
  select license_key, company_id, cast(sum(n) as bigint) as seals
  from (select jurisdiction_id, record_number, license_key, count(*) as n from dated group by all)
  join (select distinct jurisdiction_id, record_number, company_id from b_party where role <> 'engineer')
    using (jurisdiction_id, record_number) group by license_key, company_id),
own as (select distinct company_id, role, jurisdiction_id, record_number from b_party)
select company_id, 'company' as section, canonical_name as item, phone as detail from b_company
union all select company_id, 'license', concat(license_type, ' ', license_number), status from b_license
union all select company_id, 'permits', role, cast(count(*) as varchar) from own join b_company using (company_id) group by all
union all select company_id, 'fire reviews', status, cast(count(*) as varchar) from
  (select distinct company_id, jurisdiction_id, record_number from own join b_company using (company_id))
  join (select * from b_review where {_FIRE}) using (jurisdiction_id, record_number) group by company_id, status
union all select company_id, 'sealing engineer', license_key, cast(seals as varchar) from dossier_edges join b_company using (company_id)
union all select company_id, 'leads', cast(count(*) as varchar), cast(max(score) as varchar)
  from scored_leads join b_company using (company_id) group by company_id
union all select company_id, 'alias', holder_name, cast(count(*) as varchar) from b_license join b_company using (company_id)
  group by company_id, holder_name
union all select company_id, 'person', holder_name, concat(license_type, ' ', license_number) from b_license
  join b_company using (company_id) where license_type in ('PE_FP', 'PE_OTHER')
union all select company_id, 'permit', concat(jurisdiction_id, ' ', record_number), concat_ws(', ', role, status, description)
  from own join b_company using (company_id) left join b_permit using (jurisdiction_id, record_number)
union all select company_id, 'lead', concat_ws(' ', jurisdiction_id, record_number), cast(score as varchar)
  from scored_leads join b_company using (company_id)""")
def company_dossier_whole(t):
    """With aliases and people as the licences of these tables name them."""
    index = sl.dated(t)
    values = (t.b_license.groupBy("company_id", F.lit("alias").alias("kind"), F.col("holder_name").alias("value"))
              .agg(F.count(F.lit(1)).alias("seen")))
    people = t.b_license.filter("license_type in ('PE_FP', 'PE_OTHER')").withColumnRenamed("holder_name", "raw_name")
    return reports.company_dossier(
        t.b_company.select(F.col("canonical_name").alias("name")), t.b_company, t.b_license, t.b_party, t.b_review,
        seals.engineer_client_map(index, t.b_party), leads(t, index=index), values, people, t.b_permit)


_BREAKDOWN = "concat_ws('; ', " + ", ".join(f"case when {p} <> 0 then concat('{p}=', {p}) end" for p in _P) + ")"


@query("export_leads", f"""with {_LEADS}
select company_id, jurisdiction_id, record_number, score, {_BREAKDOWN} as score_breakdown from scored_leads""")
def export_leads(t):
    parts = F.array_compact(F.array(*(F.when(F.col(p) != 0, F.concat(F.lit(f"{p}="), F.col(p).cast("string"))) for p in scoring.SIGNALS)))
    return reports.export_flat(leads(t).withColumn("score_breakdown", parts),
                               ["company_id", "jurisdiction_id", "record_number", "score", "score_breakdown"])


@query("export_flat", f"""with {_ALL}
select jurisdiction_id, record_number, cycle_number, reason, signal_date, replace(reasons, ',', '; ') as reasons from picked""")
def export_flat(t):
    return reports.export_flat(_hot(t), ["jurisdiction_id", "record_number", "cycle_number", "reason",
                                         "signal_date", "reasons"])
