"""Clusters kept from batch to batch against one run over everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lintel.operators import clusters, resolve
from lintel.session import scratch_path

MEMBER = "member_id long, license_type string, license_key string, normalized_key string"


def members_of(rng, ids):
    """Members with few licences and names, so that batches meet; some have neither."""
    pick = lambda of, n: rng.choice([None, *(f"{of}{i}" for i in range(n))])
    return [(i, pick("T", 2), pick("L", 40), pick("N", 120)) for i in ids]


def whole_run(spark, members, pairs):
    df = spark.createDataFrame(members, MEMBER)
    merges = spark.createDataFrame(pairs, "left_key string, right_key string")
    edges = resolve.match_license(df).unionByName(resolve.match_name(df)).unionByName(resolve.merge_edges(df, merges))
    return resolve.cluster(df, edges)


def as_dict(df):
    rows = df.collect()
    found = {r.member_id: r.company_id for r in rows}
    assert len(found) == len(rows)
    return found


def test_ten_batches_equal_one_run(spark):
    rng, path = random.Random(3), scratch_path(spark, "clusters")
    ids = rng.sample(range(10_000), 200)
    held, pairs, before = [], [], {}
    for version in range(1, 11):
        batch = members_of(rng, ids[20 * version - 20:20 * version])
        if version == 4:
            batch += held[:5]  # members that come again
        decided = None
        if version in (3, 8):  # names of members that are there by now
            names = sorted({m[3] for m in held + batch if m[3]})
            pairs += (new := [tuple(rng.sample(names, 2)) for _ in range(4)])
            decided = spark.createDataFrame(new, "left_key string, right_key string")
        merged = clusters.add_members(spark.createDataFrame(batch, MEMBER), path, version, decided, buckets=16)
        held += batch
        now = as_dict(clusters.read_clusters(spark, path))
        # every cluster that lost its name is told of, and nothing else
        assert {(r.company_id, r.now) for r in merged.collect()} == {(c, now[m]) for m, c in before.items() if now[m] != c}
        before = now
        if version in (5, 10):
            assert now == as_dict(whole_run(spark, held, pairs))
        if version == 6:
            clusters.compact_clusters(spark, path, 6)  # held already, so nothing happens
            assert clusters._valid(spark, path)[0] == [1, 2, 3, 4, 5, 6]
    assert clusters.add_members(spark.createDataFrame(held[:3], MEMBER), path, 10).count() == 0
    clusters.compact_clusters(spark, path, 11)
    assert clusters._valid(spark, path) == ([11], 16)
    assert spark.read.parquet(f"{path}/forward/version=11").count() == 0
    assert as_dict(clusters.read_clusters(spark, path)) == before
    late = [(20_000, None, None, next(m[3] for m in held if m[3]))]  # joins by a holder kept from long ago
    clusters.add_members(spark.createDataFrame(late, MEMBER), path, 12)
    assert as_dict(clusters.read_clusters(spark, path)) == as_dict(whole_run(spark, held + late, pairs))


def test_batch_reads_and_writes_only_what_it_touches(spark):
    path = scratch_path(spark, "clusters")
    first = [(i, "T", f"L{i}", f"N{i}") for i in range(3_000)]
    clusters.add_members(spark.createDataFrame(first, MEMBER), path, 1, buckets=64)
    batch = [(9_000, "T", "L7", "N2000"), (9_001, "T", "L9001", None)]
    merged = clusters.add_members(spark.createDataFrame(batch, MEMBER), path, 2)
    assert merged.collect() == [(2_000, 7)]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{path}/nodes/version=2").select("node", "component").collect()) == [(9_000, 7), (9_001, 9_001)]
    assert [tuple(r) for r in spark.read.parquet(f"{path}/holders/version=2").select("key", "held_id").collect()] == [("T L9001", 9_001)]
    assert [tuple(r) for r in spark.read.parquet(f"{path}/forward/version=2").collect()] == [(2_000, 7)]
    plan = clusters._rows(spark, path, "nodes", "node long, component long", [3])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*version#\d+L IN \(1,2\).*bucket#\d+ = 3", plan)


def test_failed_batch_changes_nothing(spark):
    path = scratch_path(spark, "clusters")
    one = spark.createDataFrame([(1, "T", "A", "X"), (5, None, None, "Y"), (None, "T", "A", "Z")], MEMBER)
    clusters.add_members(one, path, 1, buckets=4)
    broken = spark.createDataFrame([(2, "T", "A", "Y")], MEMBER)
    commit, clusters._commit = clusters._commit, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError, match="lost"):
            clusters.add_members(broken, path, 2)
    finally:
        clusters._commit = commit
    assert as_dict(clusters.read_clusters(spark, path)) == {1: 1, 5: 5}
    other = spark.createDataFrame([(3, None, None, "Y")], MEMBER)
    clusters.add_members(other, path, 3)  # the files of version 2 stay unread
    assert as_dict(clusters.read_clusters(spark, path)) == {1: 1, 3: 3, 5: 3}
    empty = spark.createDataFrame([], MEMBER)
    assert clusters.add_members(empty, path, 4).count() == 0
    pairs = spark.createDataFrame([("X", "Y"), ("X", "unheard"), (None, "X")], "left_key string, right_key string")
    clusters.add_members(empty, path, 5, pairs)
    assert as_dict(clusters.read_clusters(spark, path)) == {1: 1, 3: 1, 5: 1}


def test_empty_start(spark):
    path = scratch_path(spark, "clusters")
    assert clusters.read_clusters(spark, path, "string").collect() == []
    clusters.add_members(spark.createDataFrame([], MEMBER), path, 1, buckets=4)
    assert clusters.read_clusters(spark, path).collect() == []
    lone = spark.createDataFrame([(4, None, None, None)], MEMBER).withColumn("extra", F.lit(1))
    clusters.add_members(lone, path, 2)
    assert as_dict(clusters.read_clusters(spark, path)) == {4: 4}
