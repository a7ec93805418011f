"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample; every row is dealt to one leaf per tree.  A query walks
all trees through one priority queue of margins and opens the most promising leaves; what lies in
them is ranked by the exact inner product.  Leaves and the queries that open them meet by shuffle.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.common import buckets_for, table
from lintel.llm.vectors import matrix, nearest, queries, representatives, valid
from lintel.session import stored

#: Distinct vectors the trees are fitted on at most, drawn by a hash of the vector.
FIT_ROWS = 20_000
TREES = 16
#: Rows a leaf should hold; at least ``LEAST`` of the sample.
LEAF, LEAST = 512, 8
#: A query opens this share of all leaves, and so many at least.  The share is what keeps recall above
#: 0.9 where vectors hardly cluster, at any size; where they do, less is enough.
SHARE, OPENED = 0.04, 96
SEED = 11


class Tree:
    """Nodes in arrays; ``left``/``right`` below zero are leaves ``-1 - leaf``."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.direction: list[np.ndarray] = []
        self.offset: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves = 0
        self.root = self._grow(sample, np.arange(len(sample)), leaf, rng)
        self.directions = np.array(self.direction, np.float32).reshape(len(self.direction), sample.shape[1])
        self.offsets = np.array(self.offset, np.float32)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(3):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                way = a - b
                along = sample[rows] @ way
                cut = float(np.median(along))
                right = along > cut
                if 0 < right.sum() < len(rows):
                    node = len(self.direction)
                    self.direction.append(way / (np.linalg.norm(way) or 1))
                    self.offset.append(cut / (np.linalg.norm(way) or 1))
                    self.left.append(0)
                    self.right.append(0)
                    self.left[node] = self._grow(sample, rows[~right], leaf, rng)
                    self.right[node] = self._grow(sample, rows[right], leaf, rng)
                    return node
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        at = np.full(len(vectors), self.root)
        left, right = np.array(self.left, np.int64), np.array(self.right, np.int64)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            over = np.einsum("ij,ij->i", vectors[inner], self.directions[node]) > self.offsets[node]
            at[inner] = np.where(over, right[node], left[node])
        return -1 - at


def search(forest: list[Tree], vectors: np.ndarray, opened: int) -> Iterator[list[tuple[int, int]]]:
    """Per query the ``(tree, leaf)`` to open, through one queue over all trees.

    A branch costs the squared margins of the cuts that are crossed on the way to it; the cheapest
    branch of any tree is next.
    """
    margins = [vectors @ t.directions.T - t.offsets for t in forest]
    for q in range(len(vectors)):
        rows = [m[q] for m in margins]
        queue = [(0.0, i, t.root) for i, t in enumerate(forest)]
        found: list[tuple[int, int]] = []
        while queue and len(found) < opened:
            cost, i, node = heapq.heappop(queue)
            tree, row = forest[i], rows[i]
            while node >= 0:
                margin = float(row[node])
                near, far = (tree.right[node], tree.left[node]) if margin > 0 else (tree.left[node], tree.right[node])
                heapq.heappush(queue, (cost + margin * margin, i, far))
                node = near
            found.append((i, -1 - node))
        yield found


def fit(reps: DataFrame, rows: int = FIT_ROWS, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> list[Tree]:
    """Trees over at most about ``rows`` distinct vectors; their size is bounded by that sample."""
    n = reps.count()
    share = F.pmod(F.xxhash64("vec"), F.lit(1 << 20)) < int(min(1.0, rows / max(n, 1)) * (1 << 20))
    sample = matrix(reps.filter(share).orderBy("key").select("vec").toArrow()["vec"], np.float32)
    rng = np.random.default_rng(seed)
    size = max(LEAST, int(leaf * min(1.0, len(sample) / max(n, 1))))
    return [Tree(sample, size, rng) for _ in range(trees)] if len(sample) else []


def nearest_neighbours(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
                       rows: int = FIT_ROWS, trees: int = TREES, leaf: int = LEAF, opened: int = OPENED,
                       share: float = SHARE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row whose id is divisible by ``every`` its ``k`` nearest found.

    Nearness is the inner product in double precision, ties go to the smaller id.  Vectors that are
    null, zero, of an odd length or hold null or non-finite components take no part, nor do rows
    without an id; repeated rows count once.  No rows, no result.  Recall is measured in the tests.
    """
    spark = df.sparkSession
    vectors = valid(df, vec_id, F.col(vector).cast("array<double>"), nonzero=True)
    reps = stored(representatives(vectors, k), "vectors")
    asked = stored(queries(vectors, reps, every), "queries")
    forest = fit(reps, rows, trees, leaf)
    opened = max(opened, math.ceil(share * sum(t.leaves for t in forest)))
    sent = spark.sparkContext.broadcast(forest)  # bounded by the fit sample
    visited = asked.select("key").distinct().count() * opened
    buckets = buckets_for(spark, reps.count() * trees + visited, 20_000)
    at = F.pmod(F.xxhash64("tree", "leaf"), F.lit(buckets)).alias("bucket")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 4096):
                part = batch.slice(piece, 4096)
                x = matrix(part.column("vec"), np.float32)
                for i, tree in enumerate(sent.value):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), i, np.int32)), pa.array(tree.leaf_of(x).astype(np.int32)), *part.columns],
                        names=["tree", "leaf", *part.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 512):
                part = batch.slice(piece, 512)
                paths = list(search(sent.value, matrix(part.column("vec"), np.float32), opened))
                row = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
                ids = np.array([x for p in paths for x in p], np.int32).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0]), pa.array(ids[:, 1]),
                                                  *(c.take(pa.array(row)) for c in part.columns)],
                                                 names=["tree", "leaf", *part.schema.names])

    kinds = "tree int, leaf int, key long, vec array<double>"
    index = reps.select("key", "vec", "ids").mapInArrow(deal, kinds + ", ids array<long>").select("*", at)
    visits = (reps.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vec")
              .mapInArrow(walk, kinds).select("*", at))

    def rank(own: pa.Table, visiting: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and visiting.num_rows:
            x, q = matrix(own["vec"], np.float64), matrix(visiting["vec"], np.float64)
            place = lambda t: t["tree"].to_numpy().astype(np.int64) << 32 | t["leaf"].to_numpy()
            here, there = place(own), place(visiting)
            order, qorder = np.argsort(here, kind="stable"), np.argsort(there, kind="stable")
            here, there = here[order], there[qorder]
            for leaf_id in np.unique(there):
                rows_ = order[slice(*np.searchsorted(here, [leaf_id, leaf_id + 1]))]
                asks = qorder[slice(*np.searchsorted(there, [leaf_id, leaf_id + 1]))]
                if not len(rows_):
                    continue
                for lo in range(0, len(asks), 256):
                    some = asks[lo:lo + 256]
                    rough = q[some] @ x[rows_].T
                    # Each leaf gives its k + 1 best, and ties of the last: rounding of the product differs by place.
                    kth = np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)] if len(rows_) > k + 1 else rough.min(1)
                    a, b = np.nonzero(rough >= (kth - 1e-9 * (1 + np.abs(kth)))[:, None])
                    out.append((some[a], rows_[b], np.einsum("ij,ij->i", q[some[a]], x[rows_[b]])))
        a, b = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
        score = np.concatenate([o[2] for o in out]) if out else np.zeros(0)
        return pa.table({"key": visiting["key"].take(pa.array(a)), "ids": own["ids"].take(pa.array(b)),
                         "score": pa.array(score)})

    found = (index.groupBy("bucket").cogroup(visits.groupBy("bucket"))
             .applyInArrow(rank, "key long, ids array<long>, score double"))
    return nearest(found, asked, k)


def op3_ann(spark, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))
