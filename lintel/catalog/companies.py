"""Queries: name and contact keys, matching, clusters, companies, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.catalog.registry import query
from lintel.operators import clusters, resolve
from lintel.plans.similar import similar_pairs
from lintel.session import ensure_checkpoint_dir, scratch_path, stored

_KEY = """nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(
    upper(raw_name), '[&/-]', ' ', 'g'), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+', ' ', 'g')),
    '\\b(OF FLORIDA|SERVICES|COMPANY|GROUP|CORP|INC|LLC|LTD|CO|PA)\\b', '', 'g'), '\\s+', ' ', 'g')), '')"""
_DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"
_STREET = """array_to_string(list_transform(string_split(trim(regexp_replace(
    replace(upper(address), '#', ' UNIT '), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda w: case w
      when 'STREET' then 'ST' when 'AVENUE' then 'AVE' when 'BOULEVARD' then 'BLVD' when 'ROAD' then 'RD'
      when 'DRIVE' then 'DR' when 'LANE' then 'LN' when 'COURT' then 'CT' when 'PARKWAY' then 'PKWY'
      when 'HIGHWAY' then 'HWY' when 'CIRCLE' then 'CIR' when 'NORTH' then 'N' when 'SOUTH' then 'S'
      when 'EAST' then 'E' when 'WEST' then 'W' when 'SUITE' then 'UNIT' when 'STE' then 'UNIT'
      when 'APT' then 'UNIT' when 'APARTMENT' then 'UNIT' else w end), ' ')"""
_LICENSE = ("nullif(regexp_replace(regexp_replace(upper(license_number), '[^A-Z0-9]', '', 'g'), "
            "'^0+', ''), '')")

_MEMBERS = f"""m as (
  select member_id, source, raw_name, license_type, {_KEY} as normalized_key,
    case when length({_DIGITS}) >= 10 then right({_DIGITS}, 10) end as phone_key,
    nullif(lower(trim(email)), '') as email_key, nullif({_STREET}, '') as address_key,
    nullif(regexp_extract(address, '\\b(\\d{{5}})(?:-\\d{{4}})?\\s*$', 1), '') as zip5,
    {_LICENSE} as license_key
  from b_member)"""

_LICENSE_EDGES = """license_edges as (
  select g.left_id, m.member_id as right_id, 'license' as basis
  from m join (select license_type, license_key, min(member_id) as left_id from m group by all) g
    using (license_type, license_key) where m.member_id <> g.left_id)"""
_NAME_EDGES = """name_edges as (
  select g.left_id, m.member_id as right_id, 'name' as basis
  from m join (select normalized_key, min(member_id) as left_id from m group by all) g
    using (normalized_key) where m.member_id <> g.left_id)"""

_SCORED = """contacts as (
  select distinct normalized_key as name, 'phone' as kind, phone_key as contact from m
    where normalized_key is not null and phone_key is not null
  union select normalized_key, 'address', address_key from m
    where normalized_key is not null and address_key is not null),
pairs as (
  select a.name as left_key, b.name as right_key, bool_or(a.kind = 'phone') as shared_phone,
    bool_or(a.kind = 'address') as shared_address
  from contacts a join contacts b on a.kind = b.kind and a.contact = b.contact and a.name < b.name
  group by all),
sets as (
  select *, list_sort(list_distinct(string_split(left_key, ' '))) as ta,
    list_sort(list_distinct(string_split(right_key, ' '))) as tb from pairs),
parts as (
  select left_key, right_key, shared_phone, shared_address,
    array_to_string(list_filter(ta, lambda w: list_contains(tb, w)), ' ') as both_words,
    array_to_string(list_filter(ta, lambda w: not list_contains(tb, w)), ' ') as only_a,
    array_to_string(list_filter(tb, lambda w: not list_contains(ta, w)), ' ') as only_b from sets),
walk as (
  select left_key, right_key, only_a, only_b, 0 as i,
    list_transform(range(0, length(only_b)), lambda j: 0) as row_lcs from parts
  union all
  select left_key, right_key, only_a, only_b, i + 1, list_transform(range(1, length(only_b) + 1), lambda j: list_max(
    list_transform(range(1, j + 1), lambda k: greatest(row_lcs[k],
      case when substr(only_a, i + 1, 1) = substr(only_b, cast(k as int), 1)
        then (case when k > 1 then row_lcs[k - 1] else 0 end) + 1 else 0 end))))
  from walk where i < length(only_a)),
lcs as (select left_key, right_key, coalesce(row_lcs[length(only_b)], 0) as same
  from walk where i = length(only_a)),
scored as (
  select left_key, right_key, shared_phone, shared_address,
    case when both_words <> '' and (only_a = '' or only_b = '') then 100.0::double
    else greatest(
      100.0::double - 100.0::double * (length(only_a) + length(only_b) - 2 * same) / (2 * joint + length(only_a) + length(only_b)),
      case when both_words <> '' then 100.0::double - 100.0::double * (1 + length(only_a)) / (2 * length(both_words) + 1 + length(only_a)) else 0 end,
      case when both_words <> '' then 100.0::double - 100.0::double * (1 + length(only_b)) / (2 * length(both_words) + 1 + length(only_b)) else 0 end)
    end as score
  from (select *, length(both_words) + case when both_words = '' then 0 else 1 end as joint from parts)
  join lcs using (left_key, right_key))"""

_SIMILAR = """similar_edges as (
  select a.first_id as left_id, b.first_id as right_id from scored
  join (select normalized_key, min(member_id) as first_id from m group by all) a on a.normalized_key = left_key
  join (select normalized_key, min(member_id) as first_id from m group by all) b on b.normalized_key = right_key
  where score >= 92)"""
_REACH = """undirected as (select left_id as u, right_id as v from {0} union select right_id, left_id from {0}),
reach(node, other) as (select member_id, member_id from m
  union select node, v from reach join undirected on other = u)"""
_EDGES = "edges as (select left_id, right_id from license_edges union select left_id, right_id from name_edges {0})"
_CLUSTERED = (f"{_MEMBERS}, {_SCORED}, {_LICENSE_EDGES}, {_NAME_EDGES}, {_SIMILAR}, "
              f"{_EDGES.format('union select left_id, right_id from similar_edges')}, {_REACH.format('edges')}, "
              "clustered as (select m.*, company_id from m join "
              "(select node as member_id, min(other) as company_id from reach group by node) using (member_id))")


def _keyed(t):
    return resolve.normalize_members(t.b_member)


@query("normalize_company", f"with {_MEMBERS} select member_id, raw_name, normalized_key from m")
def normalize_company(t):
    return _keyed(t).select("member_id", "raw_name", "normalized_key")


@query("normalize_contact", f"""
with {_MEMBERS} select member_id, phone_key, email_key, address_key, zip5, license_key from m""")
def normalize_contact(t):
    return _keyed(t).select("member_id", "phone_key", "email_key", "address_key", "zip5", "license_key")


@query("match_license", f"with {_MEMBERS}, {_LICENSE_EDGES} select * from license_edges")
def match_license(t):
    return resolve.match_license(_keyed(t))


@query("match_name", f"with {_MEMBERS}, {_NAME_EDGES} select * from name_edges")
def match_name(t):
    return resolve.match_name(_keyed(t))


@query("candidate_pairs", f"""
with recursive {_MEMBERS}, {_SCORED} select left_key, right_key, shared_phone, shared_address from scored
where score >= 85""")
def candidate_pairs(t):
    return resolve.candidate_pairs(_keyed(t)).drop("score")


@query("candidate_pairs_by_signature", f"""
with recursive {_MEMBERS}, {_SCORED} select left_key, right_key, shared_phone, shared_address from scored
where score >= 85""")
def candidate_pairs_by_signature(t):
    return similar_pairs(resolve.name_contacts(_keyed(t)), small_block=1).drop("score")


@query("token_set_ratio", f"""
with recursive {_MEMBERS}, {_SCORED} select left_key, right_key, round(score, 6) as score from scored
where score >= 85""")
def token_set_ratio(t):
    return resolve.candidate_pairs(_keyed(t)).select("left_key", "right_key", F.round("score", 6).alias("score"))


_FIRST_LAST = _SCORED.replace("from contacts a join contacts b on a.kind = b.kind and a.contact = b.contact and a.name < b.name", """
  from contacts b join (select kind, contact, min(name) as name from contacts group by all
    union select kind, contact, max(name) from contacts group by all) a
  on a.kind = b.kind and a.contact = b.contact and a.name <> b.name""")


@query("token_set_ratio_any", f"""
with recursive {_MEMBERS}, {_FIRST_LAST} select left_key, right_key, round(score, 6) as score from scored""")
def token_set_ratio_any(t):
    """Scores of any height: every name against the first and the last that shares its phone or address."""
    ensure_checkpoint_dir(t.spark)
    contacts = resolve.name_contacts(_keyed(t)).checkpoint()
    ends = contacts.groupBy("kind", "contact").agg(F.array(F.min("name"), F.max("name")).alias("e"))
    pairs = (contacts.join(ends.select("kind", "contact", F.explode("e").alias("left_key")), ["kind", "contact"])
             .filter("left_key <> name").select("left_key", F.col("name").alias("right_key")).distinct())
    return resolve.score_pairs(pairs).withColumn("score", F.round("score", 6))


@query("resolve_merges", f"""
with recursive {_MEMBERS}, {_SCORED} select left_key, right_key, shared_phone, shared_address from scored
where score >= 92""")
def resolve_merges(t):
    merges, _ = resolve.resolve_pairs(resolve.candidate_pairs(_keyed(t)))
    return merges.select("left_key", "right_key", "shared_phone", "shared_address")


@query("review_queue", f"""
with recursive {_MEMBERS}, {_SCORED} select left_key, right_key, shared_phone, shared_address,
  'similar, below merge score' as reason from scored where score >= 85 and score < 92""")
def review_queue(t):
    _, queue = resolve.resolve_pairs(resolve.candidate_pairs(_keyed(t)))
    return queue.select("left_key", "right_key", "shared_phone", "shared_address", "reason")


@query("cluster_exact", f"""
with recursive {_MEMBERS}, {_LICENSE_EDGES}, {_NAME_EDGES}, {_EDGES.format('')}, {_REACH.format('edges')}
select node as member_id, min(other) as company_id from reach group by node""")
def cluster_exact(t):
    keyed = _keyed(t)
    return resolve.cluster(keyed, resolve.match_license(keyed).unionByName(resolve.match_name(keyed)))


@query("resolve_companies", f"with recursive {_CLUSTERED} select member_id, company_id from clustered")
def resolve_companies(t):
    return resolve.resolve_members(t.b_member)[0].select("member_id", "company_id")


@query("resolve_in_batches", f"with recursive {_CLUSTERED} select member_id, company_id from clustered")
def resolve_in_batches(t):
    """Permit members, then all others, then the merges by score as decided pairs: the clusters of one run over all."""
    keyed, path = stored(_keyed(t), "keyed"), scratch_path(t.spark, "clusters")
    permits = F.col("source").eqNullSafe("permit")
    merges, _ = resolve.resolve_pairs(resolve.candidate_pairs(keyed))
    clusters.add_members(keyed.filter(permits), path, 1, buckets=64)
    clusters.add_members(keyed.filter(~permits), path, 2)
    clusters.add_members(keyed.limit(0), path, 3, merges)
    return clusters.read_clusters(t.spark, path, "string")


def _exact(t):
    keyed = _keyed(t)
    edges = resolve.match_license(keyed).unionByName(resolve.match_name(keyed))
    return keyed.join(resolve.cluster(keyed, edges), "member_id")


_EXACT = (f"{_MEMBERS}, {_LICENSE_EDGES}, {_NAME_EDGES}, {_EDGES.format('')}, {_REACH.format('edges')}, "
          "clustered as (select m.*, company_id from m join "
          "(select node as member_id, min(other) as company_id from reach group by node) using (member_id))")


@query("build_company", f"""
with recursive {_EXACT}
select company_id,
  (select raw_name from clustered c where c.company_id = x.company_id and raw_name is not null
     group by raw_name order by count(*) desc, raw_name limit 1) as canonical_name,
  (select phone_key from clustered c where c.company_id = x.company_id and phone_key is not null
     group by phone_key order by count(*) desc, phone_key limit 1) as phone,
  count(distinct raw_name) as n_aliases, count(distinct license_key) as n_licenses
from clustered x group by company_id""")
def build_company(t):
    return resolve.build_company(_exact(t)).select("company_id", "canonical_name", "phone", "n_aliases", "n_licenses")


@query("company_values", f"""
with recursive {_EXACT}
select company_id, 'alias' as kind, raw_name as value, count(*) as seen from clustered where raw_name is not null group by all
union all select company_id, 'license', license_key, count(*) from clustered where license_key is not null group by all
union all select company_id, 'phone', phone_key, count(*) from clustered where phone_key is not null group by all
union all select company_id, 'address', address_key, count(*) from clustered where address_key is not null group by all
union all select company_id, 'name_key', normalized_key, count(*) from clustered where normalized_key is not null group by all""")
def company_values(t):
    return resolve.company_values(_exact(t))


_LINKED = f"""
with recursive {_EXACT},
by_license as (select LICENSE_COLUMNS, min(company_id) as id from clustered where license_key is not null
  group by all having count(distinct company_id) = 1),
by_name as (select normalized_key, min(company_id) as id from clustered where normalized_key is not null group by all)
select COLUMNS_WANTED, coalesce(l.id, n.id) as company_id,
  case when l.id is not null then 'license' when n.id is not null then 'name' end as link_basis
from (select *, {_LICENSE} as lk, {_KEY} as nk from ROWS_WANTED) p
left join by_license l on LICENSE_RULE left join by_name n on n.normalized_key = p.nk"""


def _linked(columns, rows, by_type=False):
    """Numbers of one board for people; for parties numbers that one company alone holds."""
    keys, rule = "license_key", "l.license_key = p.lk"
    if by_type:
        keys, rule = "license_type, license_key", f"{rule} and l.license_type = p.license_type"
    return (_LINKED.replace("COLUMNS_WANTED", columns).replace("ROWS_WANTED", rows)
            .replace("LICENSE_COLUMNS", keys).replace("LICENSE_RULE", rule))


@query("link_parties", _linked("record_number, role, raw_name, p.license_number", "b_party_raw"))
def link_parties(t):
    return (resolve.link_parties(t.b_party_raw, _exact(t))
            .select("record_number", "role", "raw_name", "license_number", "company_id", "link_basis"))


_PEOPLE = "(select license_number, holder_name as raw_name, license_type from b_license)"


@query("link_person", _linked("raw_name, p.license_number, p.license_type", _PEOPLE, by_type=True))
def link_person(t):
    people = t.b_license.select("license_number", F.col("holder_name").alias("raw_name"), "license_type")
    return (resolve.link_person(people, _exact(t))
            .select("raw_name", "license_number", "license_type", "company_id", "link_basis"))


@query("review_queue_append", f"""
with recursive {_MEMBERS}, {_SCORED} select left_key, right_key, 'decided' as decision from scored
where score >= 85 and score < 92 and shared_phone
union all select left_key, right_key, 'review' from scored where score >= 85 and score < 92 and not shared_phone""")
def review_queue_append(t):
    _, queue = resolve.resolve_pairs(resolve.candidate_pairs(_keyed(t)))
    slim = queue.select("left_key", "right_key", "decision", "shared_phone")
    held = slim.filter("shared_phone").drop("shared_phone").withColumn("decision", F.lit("decided"))
    return resolve.review_queue_append(held, slim.drop("shared_phone"))
