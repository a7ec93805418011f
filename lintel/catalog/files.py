"""Queries: extracts written from the driver tables and read back, pages, documents, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.catalog import capability as cap
from lintel.catalog.capability import FLAGGED
from lintel.catalog.registry import query
from lintel.operators import capability, history
from lintel.operators.validate import validate
from lintel.schemas import FieldRule
from lintel.session import scratch_path
from lintel.sources import extracts, sinks

_RULES = [FieldRule("record_number", "bigint", True), FieldRule("status", "string", True),
          FieldRule("applied_date", "date", True), FieldRule("valuation", "decimal(14,2)", True)]
_EXTRACT = "select record_number, status, applied_date, valuation from b_permit"


def _renamed(t):
    return t.b_permit.select(
        F.struct(F.col("record_number").alias("permitNo"), F.col("status").alias("st"),
                 F.date_format("applied_date", "yyyy-MM-dd").alias("applied"),
                 F.col("valuation").alias("value")).alias("r"), "record_number")


@query("read_permit_rows", _EXTRACT)
def read_permit_rows(t):
    path = scratch_path(t.spark, "rows")
    _renamed(t).select(F.to_json("r").alias("value")).write.text(path)
    landed = extracts.read_permit_extract(t.spark, path, "rows", {
        "record_number": "$.permitNo", "status": "$.st", "applied_date": "$.applied", "valuation": "$.value"})
    return validate(landed, _RULES)[0].select("record_number", "status", "applied_date", "valuation")


@query("read_permit_features", _EXTRACT)
def read_permit_features(t):
    path = scratch_path(t.spark, "features")
    pages = (_renamed(t).groupBy(F.expr("record_number div 500").alias("page"))
             .agg(F.collect_list(F.struct(F.col("r").alias("attributes"))).alias("features")))
    pages.select(F.to_json(F.struct("features")).alias("value")).write.text(path)
    landed = extracts.read_permit_extract(t.spark, path, "features", {
        "record_number": "$.attributes.permitNo", "status": "$.attributes.st",
        "applied_date": "$.attributes.applied", "valuation": "$.attributes.value"})
    return validate(landed, _RULES)[0].select("record_number", "status", "applied_date", "valuation")


_BULK = """case when status = 'Inactive' then concat(license_number, ',', license_type) else
  concat_ws(',', license_number, license_type, status, holder_name, state) end"""


def _bulk(t):
    path = scratch_path(t.spark, "bulk")
    t.b_license.select(F.expr(_BULK).alias("value")).write.text(path)
    return extracts.read_license_bulk(
        t.spark, path, "license_number int, license_type string, status string, holder_name string, state string")


@query("read_license_bulk", """
select cast(license_number as int) as license_number, license_type, status, holder_name, state from b_license
where status <> 'Inactive'""")
def read_license_bulk(t):
    return _bulk(t)[0].drop("raw_payload")


@query("license_bulk_rejects", """
select concat(license_number, ',', license_type) as malformed_line from b_license where status = 'Inactive'""")
def license_bulk_rejects(t):
    return _bulk(t)[1]


_TEXT = """trim(regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&middot;', '·'),
  '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query("parse_detail_pages", f"""
select page_id, url, {_TEXT.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} as title,
  cast(len(regexp_extract_all(html, '<a ')) as int) as links,
  cast(len(regexp_extract_all(html, '<p>')) as int) as paragraphs from pages""")
def parse_detail_pages(t):
    return extracts.parse_detail_pages(t.pages).select(
        "page_id", "url", "title", F.size("links").alias("links"), F.size("paragraphs").alias("paragraphs"))


@query("list_documents", f"""
select page_id, cast(generate_subscripts(hrefs, 1) - 1 as int) as position, unnest(hrefs) as portal_url
from (select page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) as hrefs from pages)""")
def list_documents(t):
    return extracts.list_documents(extracts.parse_detail_pages(t.pages)).select("page_id", "position", "portal_url")


_FILES = "select doc_id // 25 as folder, string_agg(concat(text, chr(10)), '' order by doc_id) as body from documents group by all"


@query("document_manifest", f"""
select folder, strlen(body) as length, case when strlen(body) <= 80000 then sha256(body) end as sha256,
  strlen(body) > 80000 as oversize from ({_FILES})""")
def document_manifest(t):
    path = scratch_path(t.spark, "documents")
    (t.documents.select(F.expr("doc_id div 25").alias("folder"), "doc_id", "text")
     .repartition("folder").sortWithinPartitions("folder", "doc_id").drop("doc_id")
     .write.partitionBy("folder").text(path))
    found = extracts.document_manifest(t.spark, path, max_bytes=80_000, glob="*.txt")
    return found.select(F.regexp_extract("path", r"folder=(\d+)", 1).cast("long").alias("folder"),
                        "length", "sha256", "oversize")


@query("write_snapshot", """
select jurisdiction_id, cast(date_trunc('year', observed_at) as date) as observed_on, count(*) as rows,
  cast(sum(cycle_number) as bigint) as cycles from b_review group by all""")
def write_snapshot(t):
    path = scratch_path(t.spark, "snapshots")
    yearly = t.b_review.withColumn("observed_at", F.date_trunc("year", "observed_at"))
    history.write_snapshot(yearly, path, batch="first")
    history.write_snapshot(yearly, path, batch="first")
    return (t.spark.read.parquet(path).groupBy("jurisdiction_id", "observed_on")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("cycle_number").alias("cycles")))


@query("write_targets_csv", f"""
with {FLAGGED}
select canonical_name as company, phone, main_license as license, cast(permit_volume_12mo as varchar) as permit_count
from listed where list = 'A' order by permit_volume_12mo desc, company_id limit 50""")
def write_targets_csv(t):
    path = scratch_path(t.spark, "targets")
    sinks.write_targets_csv(capability.targets(capability.target_list_a(cap.flagged(t)), 50), path)
    return (t.spark.read.option("header", True).csv(path)
            .select("company", "phone", "license", "permit_count"))


_SECRET = "not a secret: a fixed key for comparison"  # real runs bring their own


def _hidden(text):
    return f"sha256(concat('{_SECRET}', chr(30), sha256(concat('{_SECRET}', chr(31), {text}))))"


_PRIVATE = ["canonical_name", "normalized_key", "phone"]
_KEY_TEXT = "concat_ws(chr(31), company_id, canonical_name, normalized_key, phone)"


@query("split_private_public", f"""
select company_id, {', '.join(f'{_hidden(c)} as {c}' for c in _PRIVATE)},
  {_hidden(_KEY_TEXT)} as private_key from b_company""")
def split_private_public(t):
    return sinks.split_private(t.b_company, _PRIVATE, _SECRET)[0]


@query("split_private_private", f"""
select distinct {_hidden(_KEY_TEXT)} as private_key, {', '.join(_PRIVATE)} from b_company""")
def split_private_private(t):
    return sinks.split_private(t.b_company, _PRIVATE, _SECRET)[1]
