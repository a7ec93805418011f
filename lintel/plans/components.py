"""Connected components of an edge table, by rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.plans.skew import HOT_ROWS, salted_lookup
from lintel.session import ensure_checkpoint_dir

#: Edges of one task, and tasks of a round at least: a round over few edges is not cut into as many files as a large one.
TASK_EDGES, LEAST_TASKS = 50_000, 8


def _tasks(rows: int) -> int:
    return max(LEAST_TASKS, -(-rows // TASK_EDGES))


def _lowest(edges: DataFrame, rows: int) -> DataFrame:
    """Per node ``u`` the lowest of itself and its neighbours ``v``, joined back to its edges.

    Fewer edges than a hot key needs prove that there is none to look for.
    """
    lowest = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted_lookup(edges, lowest, ["u"], "inner", hot=None if rows >= HOT_ROWS else [],
                         min_rows=HOT_ROWS).coalesce(_tasks(rows))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link every larger neighbour to the lowest node around."""
    return (_lowest(_both_ways(edges), 2 * rows).filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Link a node and its smaller neighbours to the lowest of them."""
    near = _lowest(edges, rows)
    return (near.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v")))
            .filter("u <> v"))


def connected_components(edges: DataFrame, left: str = "left_id", right: str = "right_id",
                         max_rounds: int = 50) -> DataFrame:
    """``(node, component)`` for every node on an edge; a component is named by its lowest node.

    Alternates large-star and small-star rounds until nothing moves; the number
    of rounds grows with the logarithm of the longest chain.  Each round is
    written to the shared checkpoint folder, so a lost executor costs at most
    the current round.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    stars = (edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
             .filter("u <> v").distinct().checkpoint())
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    before = stars.agg(total.alias("s"), F.count(F.lit(1)).alias("n")).first()
    stars = stars.coalesce(_tasks(before.n))
    for _ in range(max_rounds):
        stars = _small_star(_large_star(stars, before.n), before.n).distinct().coalesce(_tasks(before.n)).checkpoint()
        after = stars.agg(total.alias("s"), F.count(F.lit(1)).alias("n")).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().coalesce(_tasks(before.n))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
