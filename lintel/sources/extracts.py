"""Landed extracts, licence files, saved pages and downloaded documents as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions.pages import PARSED, read_pages

MAX_BYTES = 150 * 1024 * 1024


def read_permit_extract(spark: SparkSession, path: str, fmt: str, mapping: Mapping[str, str],
                        whole_files: bool = False) -> DataFrame:
    """Landed open-data JSON as string columns named by ``mapping`` (column -> JSON path).

    ``rows`` is one JSON object per record, ``features`` a page with a
    ``features`` list.  Field names are never built in.  The payload is kept
    whole in ``raw_payload``; a record that is not JSON has ``is_corrupt`` set.
    """
    lines = spark.read.text(path, wholetext=whole_files).select(
        F.col("value"), F.col("_metadata.file_path").alias("source_url"))
    if fmt == "rows":
        records = lines.withColumn("payload", F.try_parse_json("value")).withColumnRenamed("value", "raw_payload")
    elif fmt == "features":
        page = F.from_json("value", "features array<variant>")
        records = (lines.withColumn("payload", F.explode_outer(page["features"]))
                   .withColumn("raw_payload", F.coalesce(F.to_json("payload"), F.col("value")))
                   .drop("value"))
    else:
        raise ValueError(f"unknown extract format {fmt!r}")
    fields = [F.try_variant_get("payload", p, "string").alias(c) for c, p in mapping.items()]
    return records.select(*fields, "raw_payload", "source_url", F.col("payload").isNull().alias("is_corrupt"))


def read_license_bulk(spark: SparkSession, path: str, layout: str, sep: str = ",",
                      header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Bulk licence file by its declared layout: licences and the lines that do not fit.

    Every row keeps its line as ``raw_payload``.  ``header`` is the header line
    to leave out, where the file has one.
    """
    lines = spark.read.text(path)
    if header is not None:
        lines = lines.filter(F.trim("value") != header)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed_line", "sep": sep}
    parsed = lines.filter(F.trim("value") != "").select(
        F.col("value").alias("raw_payload"),
        F.from_csv("value", f"{layout}, malformed_line string", options).alias("r"))
    good = parsed.filter(F.col("r.malformed_line").isNull()).select("r.*", "raw_payload").drop("malformed_line")
    bad = parsed.filter(F.col("r.malformed_line").isNotNull()).select(F.col("raw_payload").alias("malformed_line"))
    return good, bad


def parse_detail_pages(pages: DataFrame) -> DataFrame:
    """Saved pages parsed in Arrow batches; ``pages`` has page_id, url and html."""
    kept = pages.select("page_id", "url", "html")
    return kept.mapInPandas(read_pages, f"page_id bigint, url string, {PARSED}")


def permit_details(parsed: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Labelled fields of parsed pages as columns (column -> label on the page)."""
    def value(label):
        hits = F.filter("fields", lambda f: F.lower(f["label"]) == label.lower())
        return F.nullif(F.get(hits, F.lit(0))["value"], F.lit(""))

    return parsed.select("page_id", "url", *[value(label).alias(c) for c, label in labels.items()])


def detail_rows(parsed: DataFrame, caption: str, headings: Mapping[str, str]) -> DataFrame:
    """Rows of the tables with this caption: parties, reviews or documents of a page."""
    table = parsed.select("page_id", F.explode("tables").alias("t")).filter(
        F.lower("t.caption") == caption.lower())
    rows = table.select("page_id", F.col("t.header").alias("header"), F.posexplode("t.rows").alias("row", "cells"))

    def cell(heading):
        at = F.array_position(F.transform("header", lambda h: F.lower(h)), heading.lower())
        return F.nullif(F.when(at > 0, F.get("cells", (at - 1).cast("int"))), F.lit(""))

    return rows.select("page_id", "row", *[cell(h).alias(c) for c, h in headings.items()])


def list_documents(parsed: DataFrame, pattern: str | None = None) -> DataFrame:
    """Document links of parsed pages, optionally only those matching a pattern."""
    links = parsed.select("page_id", F.posexplode("links").alias("position", "link")).select(
        "page_id", "position", F.col("link.href").alias("portal_url"), F.col("link.text").alias("title"))
    return links.filter(F.col("portal_url").rlike(pattern)) if pattern else links


def document_manifest(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES,
                      glob: str = "*") -> DataFrame:
    """Downloaded files with size and hash.

    Oversize files stay in the manifest, marked and unread: the length filter
    reaches the source, so only files within the limit are opened.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(path))
    cols = ["path", "length", "modificationTime"]
    read = files.filter(F.col("length") <= max_bytes).select(
        *cols, F.sha2("content", 256).alias("sha256"), F.lit(False).alias("oversize"))
    left = files.filter(F.col("length") > max_bytes).select(
        *cols, F.lit(None).cast("string").alias("sha256"), F.lit(True).alias("oversize"))
    return read.unionByName(left)
