"""Queries: documents, word boxes, extraction and the seal index."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lintel.catalog.bindings import AS_OF
from lintel.catalog.registry import query
from lintel.operators import seals
from lintel.plans import jobs

# Words of the documents laid out on pages of 60 lines and 10 columns.
_WORDS = """words as (
  select document_id, cast(pos // 600 as int) as page_number, cast((pos % 4) * 90 as int) as rotation, word,
    cast(pos % 10 as double) / 10 as x0, cast(pos % 10 + 1 as double) / 10 as x1,
    cast((pos // 10) % 60 as double) / 60 as y0, cast((pos // 10) % 60 + 1 as double) / 60 as y1,
    cast((pos * 7 + document_id) % 101 as double) as confidence
  from (select doc_id as document_id, unnest(string_split(text, ' ')) as word,
          generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents)
  where word <> '')"""


def _words(t):
    pos = F.col("pos")
    return (
        t.documents.select(F.col("doc_id").alias("document_id"),
                           F.posexplode(F.split("text", " ")).alias("pos", "word"))
        .filter("word <> ''")
        .select("document_id", F.expr("cast(pos div 600 as int)").alias("page_number"),
                ((pos % 4) * 90).cast("int").alias("rotation"), "word",
                ((pos % 10).cast("double") / 10).alias("x0"), ((pos % 10 + 1).cast("double") / 10).alias("x1"),
                F.expr("cast((pos div 10) % 60 as double) / 60").alias("y0"),
                F.expr("cast((pos div 10) % 60 + 1 as double) / 60").alias("y1"),
                ((pos * 7 + F.col("document_id")) % 101).cast("double").alias("confidence"))
    )


@query("dedupe_documents", """
select sha256, min(document_id) as document_id, count(*) as copies, count(distinct record_number) as permits
from b_page_text group by sha256""")
def dedupe_documents(t):
    return seals.dedupe_documents(t.b_page_text)


@query("document_references", "select distinct sha256, record_number from b_page_text")
def document_references(t):
    return seals.document_references(t.b_page_text)


@query("region_words", f"""
with {_WORDS} select document_id, page_number, count(*) as words,
  count(*) filter (where x0 >= 0.75 and y0 >= 0.70 and x1 <= 1 and y1 <= 1) as in_crop
from words where x0 >= 0.5 and y0 >= 0.5 and x1 <= 1 and y1 <= 1 group by all""")
def region_words(t):
    quadrant = seals.region_words(_words(t))
    crop = seals.region_words(quadrant, seals.OCR_CROP).groupBy("document_id", "page_number").agg(
        F.count(F.lit(1)).alias("in_crop"))
    return (quadrant.groupBy("document_id", "page_number").agg(F.count(F.lit(1)).alias("words"))
            .join(crop, ["document_id", "page_number"], "left")
            .withColumn("in_crop", F.coalesce("in_crop", F.lit(0))))


@query("page_text", f"""
with {_WORDS} select document_id, page_number, string_agg(word, ' ' order by y0, x0, word) as page_text
from words group by all""")
def page_text(t):
    return seals.page_text(_words(t))


@query("best_rotation", f"""
with {_WORDS}, means as (select document_id, page_number, rotation, avg(confidence) as mean from words group by all)
select document_id, page_number, rotation, mean as ocr_confidence from (
  select *, row_number() over (partition by document_id, page_number order by mean desc, rotation) as rn from means)
where rn = 1""")
def best_rotation(t):
    return seals.best_rotation(_words(t))


_HITS = """select document_id, cast(ordinal as int) as ordinal, license_number, matched, raw_text from (
  select document_id, unnest(numbers) as license_number, unnest(matches) as matched,
    generate_subscripts(matches, 1) as ordinal,
    unnest(list_transform(range(1, len(matches) + 1), lambda i: substring(page_text, greatest(places[i] - 100, 1)::int,
      (places[i] - greatest(places[i] - 100, 1) + length(matches[i]) + 100)::int))) as raw_text
  from (select *, list_transform(range(1, len(matches) + 1), lambda i: 1 + list_sum(list_transform(pieces[1:i], lambda p: length(p)))
            + coalesce(list_sum(list_transform(matches[1:i - 1], lambda m: length(m))), 0)) as places
    from (select document_id, page_text, regexp_extract_all(page_text, '{0}', 1) as numbers,
            regexp_extract_all(page_text, '{0}', 0) as matches, string_split_regex(page_text, '{0}') as pieces
          from b_page_text)))"""
_PE = r"(?i)\b(?:FL\s*PE|PE\s*#?|LICENSE\s*(?:NO\.?|#))\s*(\d{4,6})\b"
_CA = r"(?i)\b(?:CA|C\.A\.|CERTIFICATE OF AUTHORIZATION)\s*#?\s*(\d{3,6})\b"


@query("extract_pe", _HITS.format(_PE))
def extract_pe(t):
    return seals.extract_pe(t.b_page_text.select("document_id", "page_text"))


@query("extract_ca", _HITS.format(_CA))
def extract_ca(t):
    return seals.extract_ca(t.b_page_text.select("document_id", "page_text"))


@query("extract_pe_literal", _HITS.format(r"(?i)(?:FL\s*PE|PE\s*#?|LICENSE\s*(?:NO\.?|#))\s*(\d{4,6})"))
def extract_pe_literal(t):
    return seals.extract_pe(t.b_page_text.select("document_id", "page_text"), strict=False)


_BEST = """best as (
  select document_id, page_number, extraction_method, license_number, engineer_name, ocr_confidence from (
    select *, case extraction_method when 'digital_signature' then 0 when 'pdf_text' then 1 else 2 end as r,
      min(r) over (partition by document_id, page_number) as top_rank from b_seal_candidate)
  where r = top_rank)"""


@query("best_method", f"with {_BEST} select * from best")
def best_method(t):
    return seals.best_method(t.b_seal_candidate)


@query("seal_confidence", """
select extraction_method, round(case extraction_method when 'digital_signature' then 0.98::double
  when 'pdf_text' then 0.85::double else 0.60::double * ocr_confidence end, 6) as confidence, count(*) as seals
from b_seal_candidate group by all""")
def seal_confidence(t):
    sure = seals.seal_confidence(F.col("extraction_method"), F.col("ocr_confidence"))
    return (t.b_seal_candidate.groupBy("extraction_method", F.round(sure, 6).alias("confidence"))
            .agg(F.count(F.lit(1)).alias("seals")))


_DATED = f"""{_BEST}, board as (
  select * from (select *, row_number() over (partition by license_number order by status = 'Active' desc,
      holder_name desc, discipline desc nulls last, state desc) as rn
    from b_license where license_type in ('PE_FP', 'PE_OTHER')) where rn = 1),
checked as (
  select best.* exclude (engineer_name, license_number), best.license_number as license_key,
    l.license_number is not null as validated,
    coalesce(upper(engineer_name) <> upper(holder_name), false) as name_disagrees,
    coalesce(engineer_name, holder_name) as engineer_name, discipline, state as engineer_state
  from best left join board l on l.license_number = best.license_number),
dated as (
  select checked.*, d.jurisdiction_id, d.record_number, coalesce(p.issued_date, d.downloaded_on) as sealed_on, county
  from checked join b_document d using (document_id) join b_jurisdiction using (jurisdiction_id)
  left join b_permit p on p.jurisdiction_id = d.jurisdiction_id and p.record_number = d.record_number where validated)"""


def checked(t):
    candidates = t.b_seal_candidate
    return seals.validate_seal(seals.best_method(candidates), t.b_license, counted_on=candidates)


def dated(t):
    return jobs.seal_index(t.b_seal_candidate, t.b_license, t.b_document, t.b_permit, t.b_jurisdiction)


@query("validate_seal", f"""with {_DATED} select document_id, page_number, license_key, validated, name_disagrees,
  engineer_name, discipline, engineer_state from checked""")
def validate_seal(t):
    return checked(t).select("document_id", "page_number", "license_key", "validated", "name_disagrees",
                             "engineer_name", "discipline", "engineer_state")


@query("top_engineers", f"""with {_DATED} select * from (
  select county, license_key, count(*) as seals,
    cast(rank() over (partition by county order by count(*) desc) as int) as place
  from dated where lower(trim(discipline)) = 'fire protection' group by county, license_key) where place <= 20""")
def top_engineers(t):
    return seals.top_engineers(dated(t), k=20)


_EDGES = """edges as (
  select license_key, company_id, cast(sum(n) as bigint) as seals, min(f) as first_on, max(l) as last_on
  from (select jurisdiction_id, record_number, license_key, count(*) as n, min(sealed_on) as f, max(sealed_on) as l
        from dated group by all)
  join (select distinct jurisdiction_id, record_number, company_id from b_party where role {0})
    using (jurisdiction_id, record_number)
  group by license_key, company_id)"""


@query("engineer_client_map", f"with {_DATED}, {_EDGES.format('<> $$engineer$$')} select * from edges")
def engineer_client_map(t):
    return seals.engineer_client_map(dated(t), t.b_party)


def sole(t):
    return seals.sole_engineer_contractors(seals.engineer_client_map(dated(t), t.b_party, ["contractor"]))


SOLE = f"{_DATED}, {_EDGES.format('= $$contractor$$')}, sole as (select company_id, min(license_key) as license_key, " \
       "cast(sum(seals) as bigint) as seals from edges group by company_id having count(*) = 1)"


@query("sole_engineer_contractors", f"with {SOLE} select * from sole")
def sole_engineer_contractors(t):
    return sole(t)


@query("out_of_state_sealers", f"""with {_DATED} select license_key, engineer_state, min(engineer_name) as engineer_name,
  count(*) as seals from checked where validated and engineer_state <> 'FL' group by license_key, engineer_state""")
def out_of_state_sealers(t):
    return seals.out_of_state_sealers(checked(t))


OVERLOADED = """overloaded as (select license_key, count(*) as seals_12mo from dated
  where sealed_on > date '2000-08-01' and sealed_on <= date '2001-08-01' group by license_key having count(*) > 4)"""


@query("overloaded_engineers", f"with {_DATED}, {OVERLOADED} select * from overloaded")
def overloaded_engineers(t):
    return seals.overloaded_engineers(dated(t), AS_OF, limit=4)


@query("peak_year_load", f"""with {_DATED} select license_key, cast(max(load) as bigint) as peak_seals from (
  select license_key, sum(n) over (partition by license_key order by sealed_on
    range between interval 364 day preceding and current row) as load
  from (select license_key, sealed_on, count(*) as n from dated group by all)) group by license_key""")
def peak_year_load(t):
    return seals.peak_year_load(dated(t))


@query("seal_report", f"""with {_DATED}, kept as (
  select * from dated where county = 'AMERICA' and sealed_on >= date '2000-01-01')
select license_key, engineer_name, seals, coalesce(clients, 0) as clients, counties from (
  select license_key, min(engineer_name) as engineer_name, count(*) as seals,
    string_agg(distinct county, ', ' order by county) as counties from kept group by license_key)
left join (select license_key, count(distinct company_id) as clients
  from kept join b_party using (jurisdiction_id, record_number) where role <> 'engineer' group by license_key)
  using (license_key)""")
def seal_report(t):
    return (seals.seal_report(dated(t), t.b_party, "america", date(2000, 1, 1))
            .withColumn("counties", F.array_join("counties", ", ")))
