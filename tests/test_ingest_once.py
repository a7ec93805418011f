"""A landed batch is read once, however many tables are written from it."""

from __future__ import annotations

from lintel.schemas import FieldRule
from lintel.session import scratch_path
from lintel.streaming import ingest


def test_a_landed_batch_is_read_once(spark):
    landing, table = scratch_path(spark, "landing"), scratch_path(spark, "table")
    lines = ['{"record_number": "1"}', '{"record_number": "x"}', "cut", '{"record_number": "1"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(landing)
    run = ingest.permit_ingest_stream(spark, landing, "record_number string", table, scratch_path(spark, "ingest"),
                                      [FieldRule("record_number", "bigint", True)])
    run.awaitTermination()
    assert sum(p.numInputRows for p in run.recentProgress) == len(lines)
    assert [r.record_number for r in spark.read.parquet(f"{table}/accepted").collect()] == [1]
    assert sorted(r.line for r in spark.read.parquet(f"{table}/rejected").collect()) == sorted(lines[1:3])
