"""Clusters that a batch changes without a run over everything.

Two tables are only ever added to, in buckets by a hash of their key: ``nodes`` (a member and the cluster
it was first put in) and ``holders`` (a licence or name, and one member that has it).  A third, ``forward``, says where
clusters have gone that were merged into others since.  A batch reads the buckets its own keys fall in, works on
edges between whole clusters, and adds its new members; rows of members that were there before are
never written again.  A manifest written last makes the batch valid, so one that fails changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.state import state_version
from lintel.plans.components import connected_components
from lintel.plans.skew import salted_lookup
from lintel.session import exists, stored

#: Buckets of new tables; the driver holds one number for each that a batch touches.
BUCKETS = 1_024
HOLDERS = "basis string, key string"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _valid(spark: SparkSession, path: str) -> tuple[list[int], int] | None:
    """The versions that are read, the newest last, and the number of buckets."""
    version = state_version(spark, path)
    if version is None:
        return None
    row = spark.read.parquet(f"{path}/manifest/version={version}").first()
    return list(row["versions"]), row["buckets"]


def _rows(spark: SparkSession, path: str, table: str, columns: str, only: list[int] | None = None) -> DataFrame:
    """A table's rows of all valid versions, of the buckets ``only`` if given."""
    valid, schema = _valid(spark, path), f"{columns}, version long, bucket int"
    if valid is None or not exists(spark, f"{path}/{table}"):
        return spark.createDataFrame([], schema).drop("version", "bucket")
    rows = spark.read.schema(schema).parquet(f"{path}/{table}").filter(F.col("version").isin(valid[0]))
    if only is not None:
        rows = rows.filter(F.col("bucket").isin(only))
    return rows.drop("version", "bucket")


def _forward(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(component, now)`` of the clusters that others have taken in since they were stored."""
    valid, schema = _valid(spark, path), f"component {kind}, now {kind}"
    if valid is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/forward/version={valid[0][-1]}")


def _resolved(nodes: DataFrame, forward: DataFrame) -> DataFrame:
    """``(node, component)`` as of now; a cluster may hold any share of the nodes."""
    found = salted_lookup(nodes, forward, ["component"], "left")
    return found.select("node", F.coalesce("now", "component").alias("component"))


def _touched(rows: DataFrame, keys: Sequence[str], buckets: int) -> list[int]:
    return sorted(r[0] for r in rows.select(_bucket(keys, buckets)).distinct().collect())  # ``buckets`` at most


def _add(rows: DataFrame, keys: Sequence[str], path: str, table: str, version: int, buckets: int) -> None:
    """Write rows as one version of a table, one file a bucket."""
    (rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").write.mode("overwrite")
     .partitionBy("bucket").parquet(f"{path}/{table}/version={version}"))


def _commit(spark: SparkSession, path: str, versions: list[int], buckets: int) -> None:
    (spark.createDataFrame([(versions, buckets)], "versions array<long>, buckets int").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/manifest/version={versions[-1]}"))


def read_clusters(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``(member_id, company_id)`` of every member; ``kind`` is the type of member ids."""
    nodes = _rows(spark, path, "nodes", f"node {kind}, component {kind}")
    return _resolved(nodes, _forward(spark, path, kind)).select(F.col("node").alias("member_id"), F.col("component").alias("company_id"))


def member_keys(members: DataFrame) -> DataFrame:
    """``(basis, key, member_id)``: the licence of each board and the name of members that have one."""
    each = F.explode(F.array(
        F.struct(F.lit("license").alias("basis"), F.concat("license_type", F.lit(" "), "license_key").alias("key")),
        F.struct(F.lit("name").alias("basis"), F.col("normalized_key").alias("key"))))
    return members.select("member_id", each.alias("k")).select("k.basis", "k.key", "member_id").dropna().distinct()


def add_members(members: DataFrame, path: str, version: int, decided: DataFrame | None = None,
                buckets: int = BUCKETS) -> DataFrame:
    """Add a batch to the clusters kept at ``path``; returns ``(company_id, now)`` of the clusters it merged into others.

    ``members`` carries comparison keys.  Equal licences and names link to whichever member has held them first,
    in this batch or an earlier one.  ``decided`` holds pairs of names (``left_key, right_key``) that are one
    company, by score or by a person's decision; a pair links as soon as members of both names are there, so pairs
    that wait for a name are brought again with its batch.  ``version`` numbers the batches upwards; a batch that
    is held already changes nothing.
    """
    spark, kind = members.sparkSession, members.schema["member_id"].dataType.simpleString()
    valid = _valid(spark, path)
    if valid is not None and version <= valid[0][-1]:
        return spark.createDataFrame([], f"company_id {kind}, now {kind}")
    before, buckets = valid or ([], buckets)

    keys = stored(member_keys(members), "batch-keys")
    firsts = keys.groupBy("basis", "key").agg(F.min("member_id").alias("first_id"))
    named = None if decided is None else stored(
        decided.select("left_key", "right_key").dropna().distinct(), "decided")
    asked = firsts.select("basis", "key")
    if named is not None:
        names = named.select(F.explode(F.array("left_key", "right_key")).alias("key"))
        asked = asked.unionByName(names.select(F.lit("name").alias("basis"), "key")).distinct()
    held = _rows(spark, path, "holders", f"{HOLDERS}, held_id {kind}", _touched(asked, ["basis", "key"], buckets))
    held = held.join(asked, ["basis", "key"], "left_semi")
    holders = stored(firsts.join(held, ["basis", "key"], "full").select(
        "basis", "key", F.coalesce("held_id", "first_id").alias("holder_id"), F.col("held_id").isNull().alias("new")), "holders")
    edges = (salted_lookup(keys, holders.drop("new"), ["basis", "key"], "inner")
             .select(F.col("holder_id").alias("left_id"), F.col("member_id").alias("right_id")))
    if named is not None:
        of_name = holders.filter("basis = 'name'")
        left = of_name.select(F.col("key").alias("left_key"), F.col("holder_id").alias("left_id"))
        right = of_name.select(F.col("key").alias("right_key"), F.col("holder_id").alias("right_id"))
        both = salted_lookup(salted_lookup(named, left, ["left_key"], "inner"), right, ["right_key"], "inner", counted_on=named)
        edges = edges.unionByName(both.select("left_id", "right_id"))

    _add(holders.filter("new").select("basis", "key", F.col("holder_id").alias("held_id")), ["basis", "key"],
         path, "holders", version, buckets)
    merged = _add_edges(members.select(F.col("member_id").alias("node")), stored(edges.filter("left_id <> right_id").distinct(), "batch-edges"),
                        path, version, buckets, kind)
    _commit(spark, path, [*before, version], buckets)
    return merged.select(F.col("component").alias("company_id"), "now")


def _add_edges(nodes: DataFrame, edges: DataFrame, path: str, version: int, buckets: int, kind: str) -> DataFrame:
    """Write the new nodes and where clusters go; returns ``(component, now)`` of those that this batch moves."""
    spark = nodes.sparkSession
    ends = stored(nodes.unionByName(edges.select(F.explode(F.array("left_id", "right_id")).alias("node")))
                  .dropna().distinct(), "batch-nodes")
    forward = _forward(spark, path, kind)
    known = _rows(spark, path, "nodes", f"node {kind}, component {kind}", _touched(ends, ["node"], buckets))
    known = _resolved(known.join(ends, "node", "left_semi"), forward)
    ends = stored(ends.join(known, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("new")), "labelled")

    label = ends.select("node", "component")
    between = salted_lookup(edges, label.toDF("left_id", "a"), ["left_id"], "inner")
    between = salted_lookup(between, label.toDF("right_id", "b"), ["right_id"], "inner", counted_on=edges)
    moved = stored(connected_components(between.filter("a <> b").select("a", "b").distinct(), "a", "b")
                   .filter("node <> component").select(F.col("node").alias("component"), F.col("component").alias("now")), "moved")

    new = salted_lookup(ends.filter("new").drop("new"), moved, ["component"], "left")
    _add(new.select("node", F.coalesce("now", "component").alias("component")), ["node"], path, "nodes", version, buckets)
    # A new node's own name was never stored as anybody's cluster, so nothing has to be sent on from it.
    merged = moved.join(ends.filter("new").select(F.col("node").alias("component")), "component", "left_anti")
    further = salted_lookup(forward.select(F.col("component").alias("was"), F.col("now").alias("component")), moved, ["component"], "left")
    (further.select(F.col("was").alias("component"), F.coalesce("now", "component").alias("now")).unionByName(merged)
     .write.mode("overwrite").parquet(f"{path}/forward/version={version}"))
    return merged


def compact_clusters(spark: SparkSession, path: str, version: int, kind: str = "long") -> None:
    """Write all tables anew as one version, with nothing left to send on; later batches read only from there."""
    valid = _valid(spark, path)
    if valid is None or version <= valid[0][-1]:
        return
    nodes = read_clusters(spark, path, kind).toDF("node", "component")
    _add(nodes, ["node"], path, "nodes", version, valid[1])
    _add(_rows(spark, path, "holders", f"{HOLDERS}, held_id {kind}"), ["basis", "key"], path, "holders", version, valid[1])
    spark.createDataFrame([], f"component {kind}, now {kind}").write.mode("overwrite").parquet(f"{path}/forward/version={version}")
    _commit(spark, path, [version], valid[1])
