"""Digest sections, the company dossier and the flat export."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.names import normalize_company
from lintel.functions.patterns import is_fire_department
from lintel.plans.order import numbered
from lintel.plans.skew import checked_broadcast, salted_lookup
from lintel.schemas import PERMIT_KEY
from lintel.session import stored

OPENINGS = {
    "rejection": "Your fire review came back with comments; we can turn a sealed response around quickly.",
    "repeat_cycle": "Your permit is on another fire review cycle; a second pair of eyes may close it.",
    "stalled": "Your fire review has been waiting; we can check what is holding it.",
}


def _opening(reason: Column) -> Column:
    lines = F.create_map(*[F.lit(v) for pair in OPENINGS.items() for v in pair])
    return F.try_element_at(lines, reason)


def digest_hot(hot: DataFrame, permits: DataFrame) -> DataFrame:
    """All HOT signals with the comment quoted and an opening line."""
    about = salted_lookup(hot, permits.select(*PERMIT_KEY, "description"), PERMIT_KEY, "left", hot=[])
    def shown(value):
        return F.coalesce(value.cast("string"), F.lit("null"))

    line = F.concat(
        F.lit("- Permit "), shown(F.col("record_number")), F.lit(" ("), F.coalesce("description", F.lit("no description")),
        F.lit("), cycle "), shown(F.col("cycle_number")), F.lit(", "), shown(F.col("department")), F.lit(": "), shown(F.col("status")),
        F.lit(" on "), shown(F.date_format("signal_date", "yyyy-MM-dd")), F.lit(". > \""), F.coalesce("comment_text", F.lit("")),
        F.lit("\" "), shown(_opening(F.col("reason"))))
    return about.select(*PERMIT_KEY, "cycle_number", "signal_date", line.alias("line"))


def digest_new_leads(leads: DataFrame, earlier: DataFrame, min_score: float) -> DataFrame:
    """High-score permits that were not in an earlier digest, at their best lead."""
    best = (leads.filter((F.col("score") >= min_score) & F.col("record_number").isNotNull())
            .groupBy(*PERMIT_KEY)
            .agg(F.min(F.struct((-F.col("score")).alias("s"), "company_id")).alias("b"))
            .select(*PERMIT_KEY, "b.company_id", (-F.col("b.s")).alias("score")))
    return best.join(earlier.select(*PERMIT_KEY).distinct(), PERMIT_KEY, "left_anti")


def digest_new_targets(listed: DataFrame, earlier: DataFrame) -> DataFrame:
    """Companies newly on list A or B, moving lists included."""
    return listed.select("company_id", "list").join(
        earlier.select("company_id", "list").distinct(), ["company_id", "list"], "left_anti")


def digest_lines(run_date: date, hot: DataFrame, leads: DataFrame, targets: DataFrame) -> DataFrame:
    """The digest as ordered lines; every section is whole."""
    spark = hot.sparkSession
    heads = spark.createDataFrame(
        [(0, 0, f"# Digest {run_date.isoformat()}"), (1, 0, "## HOT fire reviews"),
         (2, 0, "## New high-score permits"), (3, 0, "## New target firms")],
        "section int, place int, line string")

    def ranked(rows, section, order, line):
        return (numbered(rows, order).withColumn("line", line)
                .select(F.lit(section).alias("section"), "place", "line"))

    lead_line = F.concat(F.lit("- Permit "), F.col("record_number").cast("string"), F.lit(", company "),
                         F.col("company_id").cast("string"), F.lit(": score "), F.col("score").cast("string"))
    target_line = F.concat(F.lit("- Company "), F.col("company_id").cast("string"), F.lit(" now on list "),
                           F.col("list"))
    return (
        heads
        .unionByName(ranked(hot, 1, [F.desc("signal_date"), *map(F.col, PERMIT_KEY), F.col("cycle_number"), F.col("line")], F.col("line")))
        .unionByName(ranked(leads, 2, [F.desc("score"), F.col("company_id"), *map(F.col, PERMIT_KEY)], lead_line))
        .unionByName(ranked(targets, 3, [F.col("list"), F.col("company_id")], target_line))
    )


def company_dossier(names: DataFrame, company: DataFrame, licenses: DataFrame, parties: DataFrame,
                    reviews: DataFrame, edges: DataFrame, leads: DataFrame, values: DataFrame | None = None,
                    people: DataFrame | None = None, permits: DataFrame | None = None) -> DataFrame:
    """Everything known of the named companies, as (company, section, item, detail) rows.

    Each part is reduced on its own before it is shown, so one part never
    multiplies another; ``names`` is the handful of names asked for.

    Rows of ``company_values`` add the aliases, linked ``people`` the people, and ``permits`` each
    permit a company is on and each of its leads; without them there are only counts of these.
    """
    asked = names.select(normalize_company(F.col("name")).alias("normalized_key")).dropna().distinct()
    found = company.join(asked, "normalized_key", "left_semi")
    ids = checked_broadcast(found.select("company_id"))

    def rows(df, section, item, detail):
        return df.select("company_id", F.lit(section).alias("section"),
                         item.cast("string").alias("item"), detail.cast("string").alias("detail"))

    own = stored(parties.join(ids, "company_id", "left_semi").select("company_id", "role", *PERMIT_KEY).distinct(), "own")
    roles = own.groupBy("company_id", "role").agg(F.count(F.lit(1)).alias("n"))
    fire = reviews.filter(is_fire_department(F.col("department")))
    seen = salted_lookup(fire.select(*PERMIT_KEY, "status"),
                         own.select("company_id", *PERMIT_KEY).distinct(), PERMIT_KEY, "inner")
    statuses = seen.groupBy("company_id", "status").agg(F.count(F.lit(1)).alias("n"))
    leads = leads.join(ids, "company_id", "left_semi").select("company_id", *PERMIT_KEY, "score")
    if permits is not None:  # counted and listed
        leads = stored(leads, "own-leads")
    scored = (leads.groupBy("company_id")
              .agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")))
    place = F.concat_ws(" ", *PERMIT_KEY)
    more = []
    if values is not None:
        more.append(rows(values.filter("kind = 'alias'").join(ids, "company_id", "left_semi"), "alias",
                         F.col("value"), F.col("seen")))
    if people is not None:
        more.append(rows(people.join(ids, "company_id", "left_semi"), "person", F.col("raw_name"),
                         F.concat_ws(" ", "license_type", "license_number")))
    if permits is not None:
        known = salted_lookup(own, permits.select(*PERMIT_KEY, "status", "description"), PERMIT_KEY, "left", hot=[])
        more += [rows(known, "permit", place, F.concat_ws(", ", "role", "status", "description")),
                 rows(leads, "lead", place, F.col("score"))]
    return reduce(DataFrame.unionByName, more, (
        rows(found, "company", F.col("canonical_name"), F.col("phone"))
        .unionByName(rows(licenses.join(ids, "company_id", "left_semi"), "license",
                          F.concat_ws(" ", "license_type", "license_number"), F.col("status")))
        .unionByName(rows(roles, "permits", F.col("role"), F.col("n")))
        .unionByName(rows(statuses, "fire reviews", F.col("status"), F.col("n")))
        .unionByName(rows(edges.join(ids, "company_id", "left_semi"), "sealing engineer",
                          F.col("license_key"), F.col("seals")))
        .unionByName(rows(scored, "leads", F.col("n"), F.col("best")))
    ))


def export_flat(leads: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One flat row per lead: arrays joined, structs as JSON, everything else as it is."""
    flat = []
    for field in leads.schema.fields:
        kind = field.dataType.typeName()
        if kind == "array":
            flat.append(F.array_join(F.col(field.name).cast("array<string>"), "; ").alias(field.name))
        elif kind in ("struct", "map"):
            flat.append(F.to_json(field.name).alias(field.name))
        else:
            flat.append(F.col(field.name))
    out = leads.select(*flat)
    return out.select(*columns) if columns else out
