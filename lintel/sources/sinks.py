"""Writers: targets, export, digest, and the private/public split."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.operators.reports import export_flat


def write_targets_csv(targets: DataFrame, path: str) -> None:
    """The target report as CSV with a header; the report is already limited to its top rows."""
    targets.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_export(leads: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Flat CRM file set, in as many parts as the leads need."""
    export_flat(leads, columns).write.mode("overwrite").option("header", True).csv(path)


def _html(line: Column) -> Column:
    safe = F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))
    return (F.when(line.startswith("## "), F.concat(F.lit("<h2>"), F.substring(safe, F.lit(4), F.length(safe)), F.lit("</h2>")))
            .when(line.startswith("# "), F.concat(F.lit("<h1>"), F.substring(safe, F.lit(3), F.length(safe)), F.lit("</h1>")))
            .otherwise(F.concat(F.lit("<p>"), F.regexp_replace(safe, "^- ", ""), F.lit("</p>"))))


def write_digest(lines: DataFrame, folder: str, run_date: date, html: bool = False) -> str:
    """A dated folder of text parts whose names are in the order of the digest's lines."""
    name = f"{folder.rstrip('/')}/{run_date.isoformat()}.{'html' if html else 'md'}"
    line = _html(F.col("line")) if html else F.col("line")
    (lines.orderBy("section", "place")
     .select(line.alias("value")).write.mode("overwrite").text(name))
    return name


def split_private(df: DataFrame, private: Sequence[str], secret: str) -> tuple[DataFrame, DataFrame]:
    """``(public, private)``: personal columns only in the private part, linked by a keyed hash.

    The public part carries a hash per personal column, so equal values can
    still be counted and joined; without ``secret`` it cannot be undone by
    trying all phone numbers.  Name columns derived from personal ones, such as
    a normalised name, as private too.
    """
    if not secret:
        raise ValueError("a secret is needed, or the hashes of guessable values can be undone")

    def hidden(text):
        inner = F.sha2(F.concat(F.lit(f"{secret}\u001f"), text), 256)
        return F.sha2(F.concat(F.lit(f"{secret}\u001e"), inner), 256)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    keyed = df.withColumn("private_key", hidden(F.concat_ws("\u001f", *text)))
    hashed = {c: hidden(F.col(c).cast("string")) for c in private}
    public = keyed.withColumns(hashed)
    return public, keyed.select("private_key", *private).distinct()
