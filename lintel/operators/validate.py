"""Accept/reject split and the loud-on-empty guard."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lintel.schemas import FieldRule


def _value(rule: FieldRule) -> Column:
    raw = F.nullif(F.trim(F.col(rule.name).cast("string")), F.lit(""))
    return raw if rule.type == "string" else raw.try_cast(rule.type)


def _problem(rule: FieldRule) -> Column:
    raw = F.nullif(F.trim(F.col(rule.name).cast("string")), F.lit(""))
    problem = F.when(F.lit(rule.required) & raw.isNull(), F.lit(f"{rule.name}:missing"))
    if rule.type != "string":
        problem = problem.when(raw.isNotNull() & raw.try_cast(rule.type).isNull(),
                               F.lit(f"{rule.name}:not_{rule.type.split('(')[0]}"))
    if rule.allowed:
        problem = problem.when(raw.isNotNull() & ~raw.isin(*rule.allowed),
                               F.lit(f"{rule.name}:not_allowed"))
    return problem


def validate(df: DataFrame, rules: Sequence[FieldRule]) -> tuple[DataFrame, DataFrame]:
    """Split landed rows into typed accepted rows and rejects with reasons.

    Rejected rows keep their landed values; a bad value never turns into a
    silent null.
    """
    tagged = df.withColumn("reject_reasons", F.array_compact(F.array(*[_problem(r) for r in rules])))
    ruled = {r.name: _value(r).alias(r.name) for r in rules}
    ok = (
        tagged.filter(F.size("reject_reasons") == 0)
        .select(*[ruled.get(c, F.col(c)) for c in df.columns])
    )
    return ok, tagged.filter(F.size("reject_reasons") > 0)


class RowCountCheck:
    """Counts rows while a job runs and complains afterwards if there were none."""

    def __init__(self, df: DataFrame, label: str):
        self.label = label
        self._seen = Observation(f"rows-{label}")
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"))

    def verify(self) -> int:
        """Call after the action that consumed ``df``."""
        rows = self._seen.get["rows"]
        if not rows:
            raise ValueError(f"{self.label}: zero rows")
        return rows


def guarded(rows: DataFrame, guard: DataFrame) -> DataFrame:
    """``rows``, in a job that also evaluates the one-row ``guard``.

    The guard is a leading branch that yields no row but has to run first, so
    it fails with the action even when the rows are empty.  Observing the
    branch keeps later filters from being pushed into it and folding it away.
    """
    nothing = guard.filter(~F.col(guard.columns[0])).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    return nothing.observe(f"guard-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows")).unionAll(rows)


def assert_nonempty(df: DataFrame, label: str) -> DataFrame:
    """The same rows; the job itself fails when there are none."""
    guard = df.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit(f"{label}: zero rows")))
                   .otherwise(F.lit(True)).cast("boolean").alias("some_rows"))
    return guarded(df, guard)
