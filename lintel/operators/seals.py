"""Seal index: from documents, word boxes and page text to who seals what for whom."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lintel.functions import names as N
from lintel.functions import patterns as P
from lintel.functions.points import OVERLOADED_SEALS
from lintel.plans.skew import HotKeys, salted_lookup
from lintel.schemas import EXTRACTION_METHODS, PERMIT_KEY

# Page regions as (x0, y0, x1, y1) shares of the page, and confidences.
LOWER_RIGHT_QUADRANT = (0.5, 0.5, 1.0, 1.0)
OCR_CROP = (0.75, 0.70, 1.0, 1.0)
CONFIDENCE = {"digital_signature": 0.98, "pdf_text": 0.85, "ocr": 0.60}
CONTEXT = 200
FIRE_PROTECTION = "fire protection"
CLIENT_ROLES = ("applicant", "owner", "contractor", "architect", "agent")


def dedupe_documents(manifest: DataFrame) -> DataFrame:
    """One row per distinct content, with the copy that is kept and how many there are."""
    return manifest.groupBy("sha256").agg(
        F.min("document_id").alias("document_id"), F.count(F.lit(1)).alias("copies"),
        F.countDistinct("record_number").alias("permits"))


def document_references(manifest: DataFrame) -> DataFrame:
    """Every permit that refers to a content, one row each, so popular content stays rows."""
    return manifest.select("sha256", "record_number").distinct()


def region_words(words: DataFrame, box: tuple[float, float, float, float] = LOWER_RIGHT_QUADRANT) -> DataFrame:
    """Words whose box lies in the region; coordinates are shares of the page."""
    x0, y0, x1, y1 = box
    return words.filter((F.col("x0") >= x0) & (F.col("x1") <= x1)
                        & (F.col("y0") >= y0) & (F.col("y1") <= y1))


def page_text(words: DataFrame) -> DataFrame:
    """Words of a page in reading order, as the page's text (one cell per page by definition)."""
    page = ["document_id", "page_number"]
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "word")))
    return words.select(*page, "y0", "x0", "word").repartition(*page).groupBy(*page).agg(
        F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("page_text"))


def best_rotation(words: DataFrame) -> DataFrame:
    """Rotation of each page with the highest mean OCR confidence, lowest angle on ties."""
    page = ["document_id", "page_number"]
    means = words.groupBy(*page, "rotation").agg(F.avg("confidence").alias("mean"))
    best = F.min(F.struct((-F.col("mean")).alias("m"), "rotation"))
    return (means.groupBy(*page).agg(best.alias("b"))
            .select(*page, "b.rotation", (-F.col("b.m")).alias("ocr_confidence")))


def context_of(text: Column, matched: Column, at: Column, around: int = CONTEXT) -> Column:
    """A match that begins at ``at`` (from 1) with the text on both sides of it."""
    half = around // 2
    start = F.greatest(at - half, F.lit(1))
    return F.substring(text, start, at - start + F.length(matched) + half)


def match_places(pieces: Column, matches: Column) -> Column:
    """Where each match begins, from the pieces between the matches of the same pattern."""
    lengths = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches,
                         lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("own")))
    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(lengths, start, lambda done, x: F.struct(
        (done["next"] + x["gap"] + x["own"]).alias("next"),
        F.array_append(done["at"], done["next"] + x["gap"]).alias("at")), lambda done: done["at"])


def extract_numbers(pages: DataFrame, pattern: str, strict: bool = True, text: str = "page_text") -> DataFrame:
    """Every licence number found in a page, in order, with its context.

    All spellings are one pattern, so a spelling inside another is not counted
    twice.  Pages without a hit are dropped at their first scan.  One list of
    matches and one of the pieces between them give every match its own place.
    """
    found = P.number_rule(pattern, strict)
    kept = [c for c in pages.columns if c != text]
    lists = pages.filter(F.col(text).rlike(found)).select(
        *kept, text, F.regexp_extract_all(F.col(text), F.lit(found), F.lit(0)).alias("_matches"),
        F.split(F.col(text), found).alias("_pieces"))
    hits = lists.select(*kept, text, F.posexplode_outer(
        F.arrays_zip(F.col("_matches").alias("matched"), match_places(F.col("_pieces"), F.col("_matches")).alias("at")))
        .alias("_i", "_hit"))
    matched, at = F.col("_hit").getField("matched"), F.col("_hit").getField("at")
    return hits.select(
        *kept, (F.col("_i") + 1).alias("ordinal"),
        F.regexp_extract(matched, r"(\d+)$", 1).alias("license_number"), matched.alias("matched"),
        context_of(F.col(text), matched, at).alias("raw_text"))


def extract_pe(pages: DataFrame, strict: bool = True) -> DataFrame:
    return extract_numbers(pages, P.PE_NUMBER, strict)


def extract_ca(pages: DataFrame, strict: bool = True) -> DataFrame:
    return extract_numbers(pages, P.CA_NUMBER, strict)


def _method_rank(method: Column) -> Column:
    order = F.create_map(*[F.lit(v) for i, m in enumerate(EXTRACTION_METHODS) for v in (m, i)])
    return F.try_element_at(order, method)


def best_method(candidates: DataFrame) -> DataFrame:
    """Seals of the best method that yielded anything on the page."""
    page = ["document_id", "page_number"]
    ranked = candidates.withColumn("_rank", _method_rank(F.col("extraction_method")))
    best = F.min("_rank").over(Window.partitionBy(*page))  # a page has few candidates
    return (ranked.dropna(subset=page).withColumn("_best", best).filter("_rank = _best")
            .select(*page, *(c for c in candidates.columns if c not in page)))


def seal_confidence(method: Column, ocr_confidence: Column) -> Column:
    """Fixed per method; OCR is its base times the mean OCR confidence (0 to 1)."""
    return (F.when(method == "digital_signature", F.lit(CONFIDENCE["digital_signature"]))
            .when(method == "pdf_text", F.lit(CONFIDENCE["pdf_text"]))
            .when(method == "ocr", F.lit(CONFIDENCE["ocr"]) * F.coalesce(ocr_confidence, F.lit(1.0))))


def with_license_key(seals: DataFrame) -> DataFrame:
    """Seals with ``license_key``, the number as the board spells it."""
    return seals.withColumn("license_key", N.license_key(F.col("license_number")))


def validate_seal(seals: DataFrame, licenses: DataFrame,
                  pe_types: Sequence[str] = ("PE_FP", "PE_OTHER"),
                  counted_on: DataFrame | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Check each number against the board; missing particulars come from the licence.

    Unknown numbers stay, marked ``validated = false``.  ``hot`` are the hot licence keys of
    ``counted_on``, if known.
    """
    holder = F.max(F.struct((F.lower("status") == "active").alias("active"), "holder_name",
                            "discipline", "state"))
    registry = (
        licenses.filter(F.col("license_type").isin(*pe_types))
        .groupBy(N.license_key(F.col("license_number")).alias("license_key"))
        .agg(holder.alias("_holder")))
    found = salted_lookup(with_license_key(seals), registry, ["license_key"], "left", hot=hot,
                          counted_on=with_license_key(seals if counted_on is None else counted_on))
    read = F.col("engineer_name")
    return (
        found.withColumn("validated", F.col("_holder").isNotNull())
        .withColumn("name_disagrees", F.coalesce(
            F.upper(F.trim(read)) != F.upper(F.trim(F.col("_holder.holder_name"))), F.lit(False)))
        .withColumn("engineer_name", F.coalesce(read, F.col("_holder.holder_name")))
        .withColumn("discipline", F.col("_holder.discipline"))
        .withColumn("engineer_state", F.col("_holder.state"))
        .drop("_holder")
    )


def with_permit(seals: DataFrame, documents: DataFrame,
                counted_on: DataFrame | None = None, hot: HotKeys | None = None) -> DataFrame:
    """Attach permit and date of the document a seal sits on."""
    return salted_lookup(seals, documents.select("document_id", *PERMIT_KEY, "sealed_on"),
                         ["document_id"], "inner", hot=hot, counted_on=counted_on)


def fire_protection(dated: DataFrame) -> DataFrame:
    """Seals of engineers of the fire protection discipline."""
    return dated.filter(F.lower(F.trim("discipline")) == FIRE_PROTECTION)


def dated_documents(documents: DataFrame, permits: DataFrame) -> DataFrame:
    """``documents`` with ``sealed_on``: the permit's issue date, else the day of the download."""
    issued = permits.groupBy(*PERMIT_KEY).agg(F.max("issued_date").alias("_issued"))
    return (documents.join(issued, PERMIT_KEY, "left")
            .withColumn("sealed_on", F.coalesce("_issued", "downloaded_on")).drop("_issued"))


def top_engineers(dated: DataFrame, k: int) -> DataFrame:
    """Engineers with most fire protection seals per county; the rank filter prunes before the shuffle."""
    counts = fire_protection(dated).groupBy("county", "license_key").agg(F.count(F.lit(1)).alias("seals"))
    place = F.rank().over(Window.partitionBy("county").orderBy(F.desc("seals")))
    return counts.withColumn("place", place).filter(F.col("place") <= k)


def _engineer_permits(dated: DataFrame) -> DataFrame:
    """Seals reduced to one row per engineer and permit before they meet the parties."""
    return dated.groupBy(*PERMIT_KEY, "license_key").agg(
        F.count(F.lit(1)).alias("seals"), F.min("sealed_on").alias("first_on"),
        F.max("sealed_on").alias("last_on"))


def engineer_client_map(dated: DataFrame, parties: DataFrame,
                        roles: Sequence[str] = CLIENT_ROLES, hot: HotKeys | None = None) -> DataFrame:
    """Edges engineer to client with seal count and first and last date."""
    clients = (parties.filter(F.col("role").isin(*roles)).dropna(subset=["company_id"])
               .select(*PERMIT_KEY, "company_id").distinct())
    return (
        salted_lookup(_engineer_permits(dated), clients, PERMIT_KEY, "inner", hot=hot, counted_on=dated)
        .groupBy("license_key", "company_id")
        .agg(F.sum("seals").alias("seals"), F.min("first_on").alias("first_on"),
             F.max("last_on").alias("last_on"))
    )


def sole_engineer_contractors(edges: DataFrame) -> DataFrame:
    """Contractors whose seals all come from one engineer; ``edges`` is over contractor roles."""
    return (edges.groupBy("company_id")
            .agg(F.count(F.lit(1)).alias("engineers"), F.min("license_key").alias("license_key"),
                 F.sum("seals").alias("seals"))
            .filter("engineers = 1").drop("engineers"))


def out_of_state_sealers(validated: DataFrame, home: str = "FL") -> DataFrame:
    """Sealing engineers whose board address is in another state."""
    return (validated.filter(F.col("validated") & (F.col("engineer_state") != home))
            .groupBy("license_key", "engineer_state")
            .agg(F.min("engineer_name").alias("engineer_name"), F.count(F.lit(1)).alias("seals")))


def overloaded_engineers(dated: DataFrame, as_of: date, limit: int = OVERLOADED_SEALS) -> DataFrame:
    """Engineers with more than ``limit`` seals in the year up to ``as_of``."""
    day = F.col("sealed_on")
    return (dated.filter((day > F.date_sub(F.lit(as_of), 365)) & (day <= F.lit(as_of)))
            .groupBy("license_key").agg(F.count(F.lit(1)).alias("seals_12mo"))
            .filter(F.col("seals_12mo") > limit))


def peak_year_load(dated: DataFrame) -> DataFrame:
    """Highest seal count of any 365 days per engineer, over one row per engineer and day."""
    daily = (dated.groupBy("license_key", F.unix_date("sealed_on").alias("day"))
             .agg(F.count(F.lit(1)).alias("n")))
    year = Window.partitionBy("license_key").orderBy("day").rangeBetween(-364, 0)
    return (daily.withColumn("load", F.sum("n").over(year))
            .groupBy("license_key").agg(F.max("load").alias("peak_seals")))


def seal_report(dated: DataFrame, parties: DataFrame, county: str | None = None,
                since: date | None = None) -> DataFrame:
    """Engineer, number, seals, distinct clients and counties.

    Seals and clients are counted apart and then joined, one row per engineer
    on each side, so parties never multiply seals.
    """
    kept = dated
    if county:
        kept = kept.filter(F.lower("county") == county.lower())
    if since:
        kept = kept.filter(F.col("sealed_on") >= F.lit(since))
    work = kept.groupBy("license_key").agg(
        F.min("engineer_name").alias("engineer_name"), F.count(F.lit(1)).alias("seals"),
        F.array_sort(F.collect_set("county")).alias("counties"))
    clients = (engineer_client_map(kept, parties).groupBy("license_key")
               .agg(F.count(F.lit(1)).alias("clients")))
    return (work.join(clients, "license_key", "left")
            .withColumn("clients", F.coalesce("clients", F.lit(0))))
