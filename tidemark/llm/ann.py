"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Inner product becomes distance by one more component (the largest norm's complement for vectors, zero for queries).
Each of PROJECTIONS random lines orders a block's vectors in a sorted array. A query opens a window around its own
projection on every line; virtual rehashing widens all windows by STEP, so only what is new is counted. A vector that
is inside at least THRESHOLD of the windows is verified by its exact inner product. The search of a block ends when its
k-th best verified vector lies within the radius that the windows stand for.

On unit vectors of 64 components without clusters, whose 20th neighbour lies at 0.81 of the median distance, doubled
radii end with four fifths of a block verified. With 120 lines, a threshold of 0.79 and steps of 1.12 a block verifies
a fifth at a recall of 0.96, but a search takes five times as long: to count is dearer there than to multiply 64
numbers. That choice pays for longer vectors or where neighbours stand out.

Vectors are dealt into blocks of about BLOCK. A task indexes a block once and lets up to about QUERIES queries stream
past it, so it holds a block and a batch; only a longer list of queries sends a block to another task as well. The best
of each block are merged by query. Equal vectors of a block are one entry with its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as wh

PROJECTIONS, THRESHOLD = 40, 0.70
#: Half of a window's width for radius 1: a vector at the radius is inside 83 of 100 windows.
HALF_WIDTH = 1.36
FIRST_RADIUS, STEP = 0.3, 2.0
BLOCK, QUERIES = 8192, 1 << 16
#: Most tasks of a search; beyond, a task takes several blocks one after the other.
MOST_TASKS = 100_000
SEED = 29


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): vectors that are not null, empty or zero and hold only finite numbers, as doubles."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Index:
    """The sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, largest: float):
        x = np.ascontiguousarray(x)
        _, lead, which = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).reshape(-1), return_index=True, return_inverse=True)
        self.x, order = x[lead], np.lexsort((ids, which))
        self.members, self.start = ids[order], np.searchsorted(which[order], np.arange(len(lead) + 1))
        self.largest, dim = largest, x.shape[1]
        rest = np.sqrt(np.maximum(largest**2 - (self.x**2).sum(1), 0))
        self.lines = np.random.default_rng([SEED, dim]).standard_normal((dim + 1, PROJECTIONS))
        p = np.column_stack([self.x, rest]) @ self.lines
        self.order = np.argsort(p, 0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(p.T, self.order, 1)
        self.flat = self.order.reshape(-1).astype(np.int32)
        # one ascending array of all lines: each is shifted beyond the one before, so that one search serves them all
        self.shift = np.arange(PROJECTIONS) * (4 * np.abs(p).max() + 1)
        self.all = (self.sorted + self.shift[:, None]).reshape(-1)
        self.first = np.arange(PROJECTIONS) * len(self.x)

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best that the windows find, best first, ties to the smaller id."""
        n, self.verified = len(self.x), 0
        scale = self.largest / np.linalg.norm(q)
        at = (q * scale) @ self.lines[:-1]
        counts = np.zeros(n, np.int64)
        place = lambda v, side: np.clip(np.searchsorted(self.all, np.clip(v, -2 * bound, 2 * bound) + self.shift, side), self.first, self.first + n)
        bound = (self.shift[1] - 1) / 4
        low = high = place(at, "left")
        seen = np.zeros(n, bool)
        near, score = np.zeros(0, np.int64), np.zeros(0)
        radius, need = FIRST_RADIUS * self.largest, int(np.ceil(THRESHOLD * PROJECTIONS))
        size = np.diff(self.start)
        while True:
            reach = HALF_WIDTH * radius
            lo, hi = place(at - reach, "left"), place(at + reach, "right")
            lo, hi = np.minimum(lo, low), np.maximum(hi, high)
            if (hi - lo).sum() + (hi - lo - high + low).sum() > len(self.flat):  # less is outside than new: count that
                outside = np.concatenate([wh.ranges(self.first, lo - self.first), wh.ranges(hi, self.first + n - hi)])
                counts = PROJECTIONS - np.bincount(self.flat[outside], minlength=n)
            else:
                fresh = np.concatenate([wh.ranges(lo, low - lo), wh.ranges(high, hi - high)])
                counts += np.bincount(self.flat[fresh], minlength=n)
            low, high = lo, hi
            found = np.flatnonzero((counts >= need) & ~seen)
            if len(found):
                seen[found] = True
                near = np.concatenate([near, found])
                score = np.concatenate([score, (self.x @ q)[found] if 8 * len(found) > n else self.x[found] @ q])  # a copy of most rows costs more than all products
            if len(near) == n:
                break
            if size[near].sum() > k:  # one of them may be the query itself
                best = np.argpartition(-score, k)[: k + 1] if len(score) > k + 1 else np.arange(len(score))
                best = best[np.argsort(-score[best], kind="stable")]
                kth = score[best[min(int(np.searchsorted(np.cumsum(size[near[best]]), k + 1)), len(best) - 1)]]
                if 2 * self.largest**2 - 2 * scale * kth <= radius**2:
                    break
            radius *= STEP
        self.verified = len(near)
        if len(near) > 4 * k:
            keep = score >= np.partition(score, -(k + 1))[-(k + 1)] - 1e-9 * self.largest**2
            near = near[keep]
        score = (self.x[near] * q).sum(1)  # the same order of additions in every block, so that equal vectors tie
        take = np.minimum(size[near], k + 1)
        ids, scores = self.members[wh.ranges(self.start[near], take)], np.repeat(score, take)
        other = ids != own
        ids, scores = ids[other], scores[other]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    vectors(vec_id, embedding). Null, empty and zero vectors, those with null or non-finite components, and rows
    without an id take no part; vectors meet only those of their own length. A query's own id is no candidate. Fewer
    than k candidates are all returned; ties go to the smaller vec_id; an empty table gives no rows. Rows that repeat
    an id are candidates each, and as queries they are one (the first by components).
    """
    rows = usable(vectors)
    plan = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).first()
    blocks, largest = max(1, -(-plan["n"] // block)), float(plan["m"] or 1.0)
    # few blocks would leave most of a cluster idle, so their queries are shared out further
    idle = min(-(-vectors.sparkSession.sparkContext.defaultParallelism // blocks), -(-plan["q"] // 1024))
    parts = max(1, -(-plan["q"] // queries), idle)
    spread = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    keys = ["dim", "block", "part"]
    data = rows.withColumn("block", spread(blocks, 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asked.withColumn("part", spread(parts, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = data.withColumn("asks", F.lit(False)).unionByName(asked.withColumn("asks", F.lit(True))).withColumn("dim", F.size("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, held, index = None, [], [], None
        for b in batches:
            of = np.stack([b.column(c).to_numpy() for c in range(3)] + [b.column(3).to_numpy(zero_copy_only=False).astype(np.int32)])
            cuts = np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)], strict=True):
                if i == j:
                    continue
                if group != of[:3, i].tolist():
                    group, ids, held, index = of[:3, i].tolist(), [], [], None
                numbers, x = b.column(4).slice(i, j - i).to_numpy(), _matrix(b.column(5).slice(i, j - i))
                if not of[3, i]:
                    ids.append(numbers)
                    held.append(x)
                    continue
                if index is None and ids:
                    index = Index(np.concatenate(ids), np.concatenate(held), largest)
                    ids, held = [], []
                if index is not None:
                    found = [index.search(q, own, k) for own, q in zip(numbers.tolist(), x, strict=True)]
                    lengths = [len(v) for v, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, lengths)), pa.array(np.concatenate([v for v, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "vec_id", "score"])

    # a group's vectors come before its queries; equal groups of another length may share a task
    tasks = min(blocks * parts, MOST_TASKS)
    dealt = both.select(*keys, "asks", "vec_id", "v").repartitionById(tasks, F.pmod(F.col("block").cast("long") * parts + F.col("part"), F.lit(tasks)).cast("int"))
    found = dealt.sortWithinPartitions(*keys, "asks", "vec_id").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
