"""Pick up newly landed extracts, append them to the snapshot table, and fold them into current state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lintel.operators.history import current_state
from lintel.operators.state import merge_into_state, state_version
from lintel.operators.validate import validate
from lintel.schemas import PERMIT_KEY, PERMIT_RULES, FieldRule
from lintel.session import stored

#: How long after the first landing of a file the same lines under the same name are known as repeated.
RELANDED = "30 days"


def landed_lines(spark: SparkSession, landing: str, schema: str, max_files: int = 1_000, relanded: str = RELANDED) -> DataFrame:
    """Landed JSON lines as a stream: the columns of ``schema``, the record as ``payload`` (VARIANT), the line, and where it is from.

    A line that is not JSON has no payload.  A line counts once per file name: a file that lands
    again, in whatever folder, within ``relanded`` adds only the lines it did not have.
    """
    lines = (spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").text(landing)
             .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source_url"),
                     F.col("_metadata.file_modification_time").alias("observed_at"), F.col("_metadata.file_name").alias("_file"))
             .filter(F.trim("line") != ""))
    once = (lines.withColumn("_line", F.sha2("line", 256)).withWatermark("observed_at", relanded)
            .dropDuplicatesWithinWatermark(["_file", "_line"]).drop("_file", "_line"))
    fields = [F.try_variant_get("payload", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name)
              for f in StructType.fromDDL(schema).fields]
    return once.withColumn("payload", F.try_parse_json("line")).select(*fields, "payload", "line", "source_url", "observed_at")


def split_lines(lines: DataFrame, rules: Sequence[FieldRule]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with their payload, and rejects with payload, line and reasons."""
    broken = F.col("payload").isNull() | (F.schema_of_variant("payload").startswith("OBJECT") == F.lit(False))
    accepted, rejects = validate(lines.filter(~broken), rules)
    unread = lines.filter(broken).withColumn("reject_reasons", F.array(F.lit("line:not_a_record")))
    return accepted.drop("line"), rejects.unionByName(unread)


def permit_ingest_stream(spark: SparkSession, landing: str, schema: str, table: str, checkpoint: str,
                         rules: Sequence[FieldRule] = PERMIT_RULES,
                         max_files: int = 1_000) -> StreamingQuery:
    """Validate landed JSON files batch by batch and append accepted and rejected rows.

    Each batch owns one partition of the table and replaces it when it is
    replayed, so a restart after a failure never doubles rows.  Appending keeps
    the cost of a batch at the size of the batch; ``current_permits`` folds the
    snapshots when they are read, ``fold`` folds new batches into a state table.
    """
    landed = landed_lines(spark, landing, schema, max_files)

    def append(batch: DataFrame, batch_id: int) -> None:
        lines = stored(batch, "lines")  # two tables are written from it, the files and the known lines are read once
        for name, rows in zip(("accepted", "rejected"), split_lines(lines, rules)):
            rows.write.mode("overwrite").parquet(f"{table}/{name}/batch_id={batch_id}")

    return (landed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _snapshots(spark: SparkSession, table: str) -> DataFrame:
    """Accepted rows of all batches, the record as text: a VARIANT has no order to fold by."""
    rows = spark.read.parquet(f"{table}/accepted")
    return rows.withColumn("raw_payload", F.to_json("payload")).drop("payload")


def current_permits(spark: SparkSession, table: str) -> DataFrame:
    """Current state of every permit over all batches landed so far."""
    return current_state(_snapshots(spark, table).drop("batch_id"), PERMIT_KEY)


def fold(spark: SparkSession, table: str, target: str, **how) -> list[int]:
    """Fold the batches that the state table at ``target`` does not hold yet; returns the buckets written.

    Only new batches are read, and of the state only the buckets they touch.
    """
    held = state_version(spark, target)
    rows = _snapshots(spark, table)
    new = rows if held is None else rows.filter(F.col("batch_id") > held)
    newest = new.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return []
    return merge_into_state(new.drop("batch_id"), target, PERMIT_KEY, int(newest), **how)


def compact(spark: SparkSession, table: str, target: str) -> None:
    """Fold all snapshots into a base table of current state."""
    current_permits(spark, table).write.mode("overwrite").parquet(target)
