"""Views that shape the driver tables like permits, reviews, parties and seals.

The text of a view is shared by Spark and DuckDB; only table references and the
hash function are spelled per engine.  Views are inputs only: the operators
under test are written separately for each engine.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2001, 8, 1)
SNAPSHOT_CUT = date(1998, 7, 1)

_JUR = "cast((({0} * 37) % 1009) % 25 as int)"

VIEWS: dict[str, str] = {
    "b_jurisdiction": """
        select n_nationkey as jurisdiction_id, n_name as slug, r_name as county,
          case when n_nationkey % 3 = 0 then 'America/New_York' else 'America/Chicago' end as timezone,
          n_nationkey % 12 <> 11 as enabled, n_nationkey % 4 <> 0 as source_verified
        from nation join region on n_regionkey = r_regionkey""",
    "b_permit": f"""
        select {_JUR.format('o_orderkey')} as jurisdiction_id, o_orderkey as record_number,
          case o_orderstatus when 'F' then 'Finaled' when 'O' then 'In Review' else 'Issued' end as status,
          cast(o_orderdate as date) as applied_date,
          cast(o_orderdate as date) + 30 as issued_date,
          case when o_orderstatus = 'F' then cast(o_orderdate as date) + 200 end as finaled_date,
          cast(o_orderdate as date) + cast(o_custkey % 400 as int) as changed_on,
          cast(o_totalprice * 10 as decimal(14,2)) as valuation,
          cast((o_orderkey * 37) % 200000 as int) as square_footage,
          case o_custkey % 5 when 0 then 'New Construction' when 1 then 'Tenant Improvement'
            when 2 then 'Single Family Residential' when 3 then 'Roofing' else 'Sign' end as record_type,
          case (o_custkey + o_orderkey) % 7 when 0 then 'Warehouse shell' when 1 then 'Neighborhood sign'
            when 2 then 'Fire sprinkler retrofit' when 3 then 'Data center build-out'
            when 4 then 'Battery ESS room' when 5 then 'Re-roof' else 'Kitchen hood' end as description
        from orders""",
    "b_review": f"""
        select {_JUR.format('l_orderkey')} as jurisdiction_id, l_orderkey as record_number,
          l_linenumber as cycle_number,
          case l_returnflag when 'A' then 'Fire Marshal' when 'R' then 'Life Safety'
            else 'Zoning' end as department,
          concat('reviewer ', cast(l_suppkey % 40 as varchar(20))) as reviewer_name,
          case cast(l_quantity as int) % 4 when 0 then 'Corrections Required' when 1 then 'Approved'
            when 2 then 'In Review' else 'Rejected' end as status,
          cast(l_shipdate as date) as status_date,
          case when l_partkey % 3 = 0 then cast(l_shipdate as date) + 14 end as due_date,
          cast(l_shipdate as date) - cast(l_quantity as int) as opened_on,
          concat('item ', cast(l_partkey as varchar(20)), ' see sheet ',
            cast(l_suppkey as varchar(20))) as comment_text,
          l_shipdate as observed_at
        from lineitem""",
    "b_party": f"""
        select {_JUR.format('l_orderkey')} as jurisdiction_id, l_orderkey as record_number,
          l_partkey + l_suppkey as company_id,
          case l_linenumber when 1 then 'applicant' when 2 then 'owner' when 3 then 'contractor'
            when 4 then 'engineer' when 5 then 'architect' else 'agent' end as role
        from lineitem""",
    "b_party_raw": f"""
        select {_JUR.format('l_orderkey')} as jurisdiction_id, l_orderkey as record_number,
          case l_linenumber when 1 then 'applicant' when 2 then 'owner' when 3 then 'contractor'
            when 4 then 'engineer' when 5 then 'architect' else 'agent' end as role,
          case when l_partkey % 4 = 0 then concat('Supplier ', cast(l_suppkey as varchar(20)), ', Inc.')
            when l_partkey % 4 = 1 then concat('SUPPLIER ', cast(l_partkey % 300 as varchar(20)), ' of Florida')
            when l_partkey % 4 = 2 then 'Owner Builder' else ' , Inc.' end as raw_name,
          case when l_partkey % 3 = 0 then concat('0', cast(10000 + l_partkey % 900 as varchar(20)))
            end as license_number
        from lineitem""",
    "b_member": """
        select concat('p', cast(s_suppkey as varchar(20))) as member_id, 'permit' as source,
          concat('Supplier ', cast(s_suppkey as varchar(20)),
            case s_suppkey % 4 when 0 then ', L.L.C.' when 1 then ' Company' when 2 then ' of Florida, Inc.'
              else ' Columbia Group' end) as raw_name,
          concat('(407) 555-', lpad(cast(s_suppkey % 10000 as varchar(20)), 4, '0')) as phone,
          concat(cast(s_suppkey % 90 as varchar(20)), ' North Main Street, Suite #',
            cast(s_nationkey as varchar(20)), ', Orlando, FL 328', lpad(cast(s_nationkey as varchar(20)), 2, '0')) as address,
          concat(' Office', cast(s_suppkey as varchar(20)), '@Example.COM ') as email,
          case s_suppkey % 3 when 0 then 'FP_CONTRACTOR' when 1 then 'CA' end as license_type,
          concat('00', cast(10000 + s_suppkey as varchar(20))) as license_number
        from supplier
        union all
        select concat('r', cast(c_custkey as varchar(20))), 'registry',
          concat('SUPPLIER ', cast(c_custkey % 200 as varchar(20)),
            case c_custkey % 3 when 0 then ' LLC' when 1 then ' CO' else '' end),
          concat('1-407-555-', lpad(cast(c_custkey % 300 as varchar(20)), 4, '0')),
          concat(cast(c_custkey % 90 as varchar(20)), ' N. MAIN ST, UNIT ',
            cast(c_nationkey as varchar(20)), ', ORLANDO FL 328', lpad(cast(c_nationkey as varchar(20)), 2, '0'), '-1234'),
          concat('c', cast(c_custkey as varchar(20)), '@example.com'),
          case c_mktsegment when 'BUILDING' then 'FP_CONTRACTOR' when 'MACHINERY' then 'CA' end,
          cast(10000 + c_custkey as varchar(20))
        from customer""",
    "b_company": """
        select c_custkey as company_id, concat('Supplier ', cast(c_custkey as varchar(20)), ' LLC') as canonical_name,
          concat('SUPPLIER ', cast(c_custkey as varchar(20))) as normalized_key,
          concat('407555', lpad(cast(c_custkey % 10000 as varchar(20)), 4, '0')) as phone
        from customer""",
    "b_license": """
        select 'board' as source, c_custkey as company_id,
          case c_mktsegment when 'BUILDING' then 'FP_CONTRACTOR' when 'MACHINERY' then 'CA'
            when 'HOUSEHOLD' then 'PE_FP' when 'AUTOMOBILE' then 'PE_OTHER' else 'ARCHITECT' end as license_type,
          cast(10000 + c_custkey as varchar(20)) as license_number,
          case when c_acctbal > 0 then 'Active' else 'Inactive' end as status,
          case c_mktsegment when 'HOUSEHOLD' then 'fire protection' when 'AUTOMOBILE' then 'civil' end as discipline,
          c_name as holder_name,
          case when c_nationkey < 20 then 'FL' else 'GA' end as state
        from customer""",
    "b_document": f"""
        select l_orderkey * 8 + l_linenumber as document_id,
          {_JUR.format('l_orderkey')} as jurisdiction_id, l_orderkey as record_number,
          min(cast(l_shipdate as date)) as downloaded_on
        from lineitem group by l_orderkey, l_linenumber""",
    "b_seal_candidate": """
        select l_orderkey * 8 + l_linenumber as document_id, cast(l_suppkey % 3 as int) as page_number,
          case l_returnflag when 'R' then 'digital_signature' when 'N' then 'pdf_text' else 'ocr' end
            as extraction_method,
          cast(10000 + l_partkey as varchar(20)) as license_number,
          case when l_returnflag = 'R' then concat('Customer#', lpad(cast(l_partkey as varchar(20)), 9, '0'))
            end as engineer_name,
          cast(cast(l_discount * 1000 as int) as double) / 100 as ocr_confidence
        from lineitem""",
    "b_contact": """
        select user_id as company_id, cast(ts as date) - 8200 as contacted_on from events""",
    "b_fetch_log": """
        select concat('host', cast(user_id % 6 as varchar(20))) as host, ts, event_id as request_id,
          event_type as outcome
        from events""",
    "b_page_text": """
        select doc_id as document_id, doc_id % 15000 as record_number, SHA(text) as sha256,
          case when doc_id % 3 = 0 then concat(text, ' FL PE ', cast(10000 + doc_id % 700 as varchar(20)),
                 ' CA # ', cast(2000 + doc_id % 50 as varchar(20)), ' and sheet 2 ', doc_id,
                 ' FL PE ', cast(10000 + doc_id % 700 as varchar(20)), ' CA # ', cast(2000 + doc_id % 50 as varchar(20)))
               when doc_id % 3 = 1 then concat(text, ' PIPE 4000 PE# 1234567 License No. ',
                 cast(20000 + doc_id % 90 as varchar(20)))
               else text end as page_text
        from documents""",
    "b_status_event": """
        select user_id as record_number, event_id, ts as observed_at, event_type as status from events""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "pages"]


def _used(text: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b(?:from|join) {t}\b", text)]


class Tables:
    """Driver tables and views of one scale folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if not name.startswith("b_"):
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = re.sub(r"SHA\((\w+)\)", r"sha2(\1, 256)", VIEWS[name])
        used = _used(text)
        for table in used:
            text = re.sub(rf"\b(from|join) {table}\b", rf"\1 {{{table}}}", text)
        return self.spark.sql(text, **{t: getattr(self, t) for t in used})


def oracle_text(body: str) -> str:
    """Put the views a query mentions in front of it, in DuckDB's spelling."""
    body = body.strip()
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    views = [f"{n} as ({re.sub(r'SHA[(]', 'sha256(', VIEWS[n]).strip()})" for n in names]
    if not views:
        return body
    head = ",\n".join(views)
    recursive = body.startswith("with recursive ")
    if recursive:
        return f"with recursive {head},\n{body[len('with recursive '):]}"
    if body.startswith("with "):
        return f"with {head},\n{body[len('with '):]}"
    return f"with {head}\n{body}"
