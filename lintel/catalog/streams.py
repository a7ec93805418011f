"""Queries that run a stream to its end over files written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lintel.catalog.bindings import SNAPSHOT_CUT
from lintel.catalog.registry import query
from lintel.catalog.reviews import _ALL, _FIRE, _MOVES, _REJECTED
from lintel.operators import reviews
from lintel.operators.state import read_state
from lintel.schemas import FieldRule
from lintel.session import scratch_path, stored
from lintel.streaming import hot, ingest

_CYCLE = "jurisdiction_id, record_number, cycle_number"


@query("permit_ingest_stream", """
select jurisdiction_id, record_number, status, applied_date from b_permit where square_footage >= 2000""")
def permit_ingest_stream(t):
    landing, table = scratch_path(t.spark, "landing"), scratch_path(t.spark, "snapshots")
    applied = F.when(F.col("square_footage") < 2000, F.lit("13/45/2001")).otherwise(
        F.date_format("applied_date", "yyyy-MM-dd"))
    t.b_permit.select("jurisdiction_id", "record_number", "status", applied.alias("applied_date")).write.json(landing)
    rules = [FieldRule("jurisdiction_id", "int", True), FieldRule("record_number", "bigint", True),
             FieldRule("applied_date", "date", True)]
    ingest.permit_ingest_stream(
        t.spark, landing, "jurisdiction_id string, record_number string, status string, applied_date string",
        table, scratch_path(t.spark, "ingest"), rules).awaitTermination()
    return ingest.current_permits(t.spark, table).select(
        "jurisdiction_id", "record_number", "status", "applied_date")


@query("permit_ingest_rejects", """
select cast(record_number as varchar) as record_number,
  case when record_number % 50 = 0 then 'line:not_a_record' else 'applied_date:not_date' end as reason,
  case when record_number % 50 = 0 then concat('{"record_number":"', cast(record_number as varchar), '","sta') end as broken_line
from b_permit where record_number % 50 = 0 or square_footage < 2000""")
def permit_ingest_rejects(t):
    """Rejects of landed lines, some of them cut off, with one folder landing a second time and folded state read back."""
    landing, table, state = (scratch_path(t.spark, x) for x in ("landing", "snapshots", "state"))
    number = F.col("record_number").cast("string")
    applied = F.when(F.col("square_footage") < 2000, F.lit("13/45/2001")).otherwise(F.date_format("applied_date", "yyyy-MM-dd"))
    whole = F.to_json(F.struct("jurisdiction_id", number.alias("record_number"), "status", applied.alias("applied_date")))
    cut = F.concat(F.lit('{"record_number":"'), number, F.lit('","sta'))
    t.b_permit.select(F.when(F.col("record_number") % 50 == 0, cut).otherwise(whole).alias("value")).write.text(f"{landing}/first")
    rules = [FieldRule("jurisdiction_id", "int", True), FieldRule("record_number", "bigint", True), FieldRule("applied_date", "date", True)]
    schema, checkpoint = "jurisdiction_id string, record_number string, status string, applied_date string", scratch_path(t.spark, "ingest")
    hadoop = t.spark.sparkContext._jvm.org.apache.hadoop.fs
    for again in (False, True):
        if again:
            paths = [hadoop.Path(f"{landing}/{x}") for x in ("first", "again")]
            conf = t.spark.sparkContext._jsc.hadoopConfiguration()
            store = paths[0].getFileSystem(conf)
            hadoop.FileUtil.copy(store, paths[0], store, paths[1], False, conf)
        ingest.permit_ingest_stream(t.spark, landing, schema, table, checkpoint, rules).awaitTermination()
        ingest.fold(t.spark, table, state, buckets=32)
    accepted = read_state(t.spark, state).select(F.col("record_number").cast("string").alias("record_number"))
    rejected = t.spark.read.parquet(f"{table}/rejected")
    broken = F.col("payload").isNull()
    kept = F.when(broken, F.regexp_extract("line", '"record_number":"([0-9]+)"', 1)).otherwise(F.try_variant_get("payload", "$.record_number", "string"))
    return (rejected.select(kept.alias("record_number"), F.array_join("reject_reasons", ",").alias("reason"), F.when(broken, F.col("line")).alias("broken_line"))
            .join(accepted, "record_number", "left_anti"))


@query("hot_stream", f"""
with {_MOVES}, {_REJECTED}
select jurisdiction_id, cast(record_number as varchar) as record_number, cycle_number, reason, department, status,
  signal_date, comment_text from (
  select *, row_number() over (partition by {_CYCLE} order by signal_date, department, comment_text, status) as rn
  from rejected) where rn = 1""")
def hot_stream(t):
    landing, out = scratch_path(t.spark, "reviews"), scratch_path(t.spark, "alerts")
    rows = t.b_review.withColumn("record_number", F.col("record_number").cast("string"))
    rows.write.parquet(landing)
    stream = t.spark.readStream.schema(rows.schema).parquet(landing)
    hot.use_rocksdb(t.spark)
    (hot.hot_stream(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(t.spark, "stream")).trigger(availableNow=True)
     .start().awaitTermination())
    return t.spark.read.parquet(out)


#: The batch monitor as of the stream's last clock, without the cycles that had alerted before the cut.
_CLOCK = f"(select cast(max(observed_at) as date) from b_review where {_FIRE})"
_SEEDED = f"""
with {_ALL.replace("date '2001-08-01'", _CLOCK)}, sent as (
  select distinct {_CYCLE} from (select {_CYCLE}, signal_date from rejected union all select {_CYCLE}, signal_date from repeated)
  where signal_date < date '{SNAPSHOT_CUT.isoformat()}')
select {_CYCLE}, reason, department, status, signal_date, comment_text from picked anti join sent using ({_CYCLE})"""


@query("hot_stream_seeded", _SEEDED)
def hot_stream_seeded(t):
    """All three rules, started over what the batch monitor has seen and sent before the cut."""
    early = t.b_review.filter(F.col("status_date") < F.lit(SNAPSHOT_CUT))
    late = t.b_review.filter(F.col("status_date") >= F.lit(SNAPSHOT_CUT))
    sent = reviews.emit_hot([reviews.hot_rejections(reviews.status_transitions(early)), reviews.repeat_cycle(early)])
    baseline = stored(reviews.turnaround_baseline(t.b_review), "baseline")
    known = stored(hot.known_state(early, sent, baseline), "known")
    landing, out = scratch_path(t.spark, "reviews"), scratch_path(t.spark, "alerts")
    late.write.parquet(landing)
    stream = t.spark.readStream.schema(late.schema).parquet(landing)
    hot.use_rocksdb(t.spark)
    (hot.hot_stream(stream, hot.RULES, known, baseline).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", scratch_path(t.spark, "stream")).trigger(availableNow=True)
     .start().awaitTermination())
    return t.spark.read.parquet(out)
