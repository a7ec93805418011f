"""Hot keys kept next to a table: the same as a scan finds, over all its batches, without the scan."""

import uuid

import pytest
from pyspark.sql import functions as F

from lintel.catalog import leads
from lintel.catalog.bindings import Tables
from lintel.plans import hitters, jobs, skew
from lintel.session import scratch_path

KEYS = [["k"], ["a", "b"]]


def skewed(spark, rows=30_000):
    """A third of all rows under one key, a sixth without one, the others apart."""
    k = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 6 != 1, F.concat(F.lit("k"), "id"))
    return spark.range(rows).select("id", k.alias("k"), (F.col("id") % 2).alias("a"), (F.col("id") % 5).alias("b"))


def test_one_scan_finds_what_each_key_alone_does(spark):
    df = skewed(spark)
    found = hitters.find_hitters(df, *KEYS, min_rows=2_000)
    for keys in KEYS:
        assert sorted(found.of(keys)) == sorted(skew.hot_keys(df, keys, 2_000))
    assert len(found.of(["k"])) == 2 and len(found.of(["a", "b"])) == 10
    with pytest.raises(KeyError):
        found.of(["id"])


def test_empty_table_has_no_hot_keys(spark):
    none = skewed(spark).limit(0)
    assert hitters.find_hitters(none, *KEYS).of(["k"]) == []
    path = scratch_path(spark, "none")
    hitters.write_keyed(none, path, "1", *KEYS)
    assert hitters.kept_hitters(spark, path, *KEYS).of(["a", "b"]) == []


def test_tracked_items_grow_with_the_rows(spark):
    assert hitters.tracked_items(0) == skew.TRACKED_ITEMS
    assert hitters.tracked_items(10**11) == 400_000
    assert hitters.tracked_items(10**13) == hitters.MOST_TRACKED
    # 5,000 keys of 20 rows and as many rows under keys of their own: more hot keys than a fixed sketch tracks
    df = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 10_000).otherwise(-F.col("id")).alias("k"))
    assert len(hitters.find_hitters(df, ["k"], rows=200_000, min_rows=20).of(["k"])) == 5_000


def test_batches_add_up_and_a_repeated_batch_replaces_its_own(spark):
    df, path = skewed(spark), scratch_path(spark, "keyed")
    for batch in range(5):
        hitters.write_keyed(df.filter(F.col("id") % 5 == batch), path, str(batch), *KEYS, min_rows=2_000)
    hitters.write_keyed(df.filter(F.col("id") % 5 == 3), path, "3", *KEYS, min_rows=2_000)
    table = spark.read.schema(df.schema).parquet(path)
    assert table.count() == df.count()
    kept = hitters.kept_hitters(spark, path, *KEYS, min_rows=2_000)
    for keys in KEYS:
        assert sorted(kept.of(keys)) == sorted(skew.hot_keys(df, keys, 2_000))
    with pytest.raises(FileNotFoundError):
        hitters.kept_hitters(spark, f"{path}-elsewhere", *KEYS)


def test_known_hot_keys_change_no_result(spark):
    df = skewed(spark, 6_000).withColumn("day", F.date_add(F.lit("2001-01-01"), (F.col("id") % 40).cast("int")))
    known = hitters.find_hitters(df, *KEYS, min_rows=300)
    lookup = df.select("k").dropna().distinct().withColumn("length", F.length("k"))
    assert known.of(["k"])
    plain = df.join(lookup, ["k"], "left")
    assert sorted(map(str, skew.salted_lookup(df, lookup, ["k"], hot=known.of(["k"])).collect())) == sorted(map(str, plain.collect()))
    args = (df, ["a", "b"], ["day", "id"], ["id"], [F.col("day")])
    split = skew.split_lag(*args, hot=known.of(["a", "b"]))
    whole = skew.split_lag(*args, hot=[]).select(*split.columns)
    assert "_carried" in split._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))


def jobs_of(spark, monkeypatch, run):
    """Rows of a run, the Spark jobs it started, and how many tables it scanned for hot keys."""
    scans, group = [], uuid.uuid4().hex
    with monkeypatch.context() as patch:
        for module, name in ((skew, "hot_keys"), (hitters, "_sketches")):
            plain = getattr(module, name)
            patch.setattr(module, name, lambda *args, _plain=plain, **more: scans.append(1) or _plain(*args, **more))
        spark.sparkContext.setJobGroup(group, group)
        rows = sorted(map(str, run().collect()))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), len(scans)


def test_leads_over_kept_keys_scan_only_what_the_run_makes(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    tables = {"reviews": (t.b_review, jobs.REVIEW_KEYS), "parties": (t.b_party, jobs.PARTY_KEYS),
              "seals": (leads.seals.with_license_key(t.b_seal_candidate), jobs.SEAL_KEYS)}
    read, known = [], []
    for name, (df, keys) in tables.items():
        path = scratch_path(spark, name)
        hitters.write_keyed(df, path, "1", *keys, min_rows=4)
        read.append(spark.read.schema(df.schema).parquet(path))
        known.append(hitters.kept_hitters(spark, path, *keys))
        assert any(hitters.kept_hitters(spark, path, *keys, min_rows=2).of(k) for k in keys)
    plain, before, looked = jobs_of(spark, monkeypatch, lambda: leads._scored(t, *read))
    kept, after, left = jobs_of(spark, monkeypatch, lambda: leads._scored(t, *read, *known))
    assert kept == plain and kept
    assert (looked, left) == (5, 1)  # the seal index is made within the run
    assert after < before
    print("jobs", before, after)
