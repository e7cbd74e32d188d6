"""Exact top-k search by inner product: a KD-tree per shard.

A shard is a run of rows within one task. Its tree splits at the median of the widest side of the tight box around its
rows. A query walks a tree best-first, by the highest inner product that a box allows, and stops where that can't
reach its kth best so far. The kth best among some of the rows is found first, and bounds the search in all shards; within
a task the kth best goes on from each shard to the next."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.llm._common import stored


class KDTree:
    """rows: n x d of exact numbers. Nodes are numbered from the root, 0; a leaf has no children."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = 64):
        self.ids, self.rows = ids, rows
        self.lo, self.hi, self.least, self.kids, self.members = [], [], [], [], []
        stack = [(np.arange(len(ids)), -1)]
        while stack:
            own, parent = stack.pop()
            part = rows[own]
            if parent >= 0:
                self.kids[parent].append(len(self.lo))
            self.lo.append(part.min(0))
            self.hi.append(part.max(0))
            self.least.append(int(ids[own].min()))
            self.kids.append([])
            side = self.hi[-1] - self.lo[-1]
            if len(own) <= leaf or not side.any():
                self.members.append(own)
                continue
            self.members.append(None)
            half = len(own) // 2
            order = np.argsort(part[:, int(np.argmax(side))], kind="stable")
            stack += [(own[order[:half]], len(self.lo) - 1), (own[order[half:]], len(self.lo) - 1)]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query (row) and node (column): the highest inner product within the node's box."""
        zero = queries * 0
        return np.maximum(queries, zero) @ self.hi.T + np.minimum(queries, zero) @ self.lo.T

    def search(self, query: np.ndarray, own: int, bound: np.ndarray, best: list[tuple], k: int, least: float = float("-inf")) -> None:
        """Improve best, a heap of at most k (score, -id); rows of the id `own`, and scores below `least`, don't count."""
        ahead = [(-bound[0], 0)]
        while ahead:
            b, node = heapq.heappop(ahead)
            if -b < least or len(best) == k and -b < best[0][0]:
                return
            if len(best) == k and -b == best[0][0] and self.least[node] >= -best[0][1]:
                continue
            if self.kids[node]:
                for x in self.kids[node]:
                    heapq.heappush(ahead, (-bound[x], x))
                continue
            members = self.members[node]
            scores, ids = self.rows[members] @ query, self.ids[members]
            go = (ids != own) & (scores >= least)
            if len(best) == k:
                go &= scores >= best[0][0]
            scores, ids = scores[go], ids[go]
            if len(ids) > k:  # the k best of the leaf, smaller ids first
                at = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[at], ids[at]
            for s, i in zip(scores.tolist(), ids.tolist(), strict=True):
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    """Doubles where inner products of such numbers are exact, Python's integers else."""
    m = np.array(vectors, object)
    top = max((abs(x) for v in vectors for x in v), default=0)
    return m.astype(np.float64) if top * top * max(1, m.shape[1]) < 1 << 52 else m


def _vectors(column: pa.Array) -> list[list[int]]:
    return [[int(x) for x in v] for v in column.to_pylist()]


def _usable(v: Column) -> Column:
    """Not null, and neither null nor non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def exact_top_k(items: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 8192, seed_rows: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each query the k highest inner products with items of another id,
    all if there are fewer; ties to the smaller vec_id.

    Both tables have vec_id and embedding; components are turned into floor(256 * x), x as a double. Rows with a null id,
    a null vector or a null or non-finite component (256 * x beyond a double, too) take no part, and items of another length than the query's don't
    for it. A query id that repeats counts once, with its smallest vector; an item that repeats counts as often as it is
    there. Empty tables give an empty one; other columns are not read.

    Queries are read in blocks of block_rows, each broadcast by itself, searched for in one pass over all items without a
    shuffle of them, and written before the next block is read: one block lives at a time, on the driver too. About
    seed_rows items, chosen by a hash, are searched first where there are more: their kth best score is a lower bound of
    the kth best of all, so that tasks pass on only what may be among the best. Scores beyond a long are cut to its range."""
    spark = items.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
        return own.withColumn("v", F.transform("v", lambda x: 256 * x)).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))

    def floors(v: list[float]) -> list[int]:
        return [int(np.floor(x)) for x in v]

    found = None
    block: list = []
    asked = usable(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = usable(items)
    share = rows.count() // seed_rows
    for row in _then_none(asked.toLocalIterator()):
        if row is not None:
            block.append((row[0], floors(row[1])))
        if block and (row is None or len(block) == block_rows):
            least = {}
            if share > 1:
                seeds = _pass(spark, rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0), block, k, shard_rows, {})
                kth = F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)
                best = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("rank") <= k)
                least = {r[0]: r[1] for r in best.groupBy("query_id").agg(F.count("*").alias("n"), kth.alias("kth")).where((F.col("n") == k) & (F.col("kth") > F.lit(-(1 << 63)))).select("query_id", "kth").collect()}
            part = _pass(spark, rows, block, k, shard_rows, least)
            found = part if found is None else found.unionByName(part)
            block = []
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _then_none(rows: Iterator) -> Iterator:
    yield from rows
    yield None


def _pass(spark, items: DataFrame, block: list[tuple[int, list[int]]], k: int, shard_rows: int, least: dict[int, int]) -> DataFrame:
    """(query_id, vec_id, score), written: of each query of the block up to k of each task's items, at `least` or more."""
    shared = spark.sparkContext.broadcast((block, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = defaultdict(list)
        for q, v in shared.value[0]:
            by_length[len(v)].append((q, v))
        asked = {d: ([q for q, _ in x], _matrix([v for _, v in x])) for d, x in by_length.items()}
        best, least = {q: [] for q, _ in shared.value[0]}, shared.value[1]
        waiting = defaultdict(list)

        def search(d: int) -> None:
            own = waiting.pop(d)
            names, queries = asked[d]
            rows = _matrix([v for _, v in own])
            if object in (rows.dtype, queries.dtype) or abs(rows).max(initial=0) * abs(queries).max(initial=0) * max(d, 1) >= 1 << 52:
                rows, queries = (np.array([[int(x) for x in v] for v in m], object).reshape(len(m), d) for m in (rows, queries))
            tree = KDTree(np.array([i for i, _ in own], np.int64), rows)
            bounds = tree.bounds(queries)
            for j, q in enumerate(names):
                tree.search(queries[j], q, bounds[j].tolist(), best[q], k, least.get(q, float("-inf")))

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if (d := len(v)) in asked:
                    waiting[d].append((i, [int(np.floor(x)) for x in v]))
                    if len(waiting[d]) == shard_rows:
                        search(d)
        for d in list(waiting):
            search(d)
        out = [(q, -i, max(-(1 << 63), min((1 << 63) - 1, int(s)))) for q, found in best.items() for s, i in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    out = stored(items.mapInArrow(run, "query_id long, vec_id long, score long"), "topk-block")
    shared.destroy()
    return out
