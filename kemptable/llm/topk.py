"""Exact top-k inner products by reading sorted lists only (no random access).

A task holds its vectors in blocks. A block keeps, for each component, the list
of its vectors sorted by that component. A query reads all lists side by side,
from the top where its own component is positive and from the bottom where it
is negative. What has been read of a vector gives its partial score; the next
unread value of each list bounds what it may still get. A vector whose upper
bound falls below the k-th best lower bound is out. Reading stops when few are
left; those get their final scores, from the rest of their components. The k-th
best score found in earlier blocks is where a query starts. All queries of a
block share its readings: the bounds of many are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

# Vectors in a block, and query vectors sent to the tasks at once (at 64
# components, 2 MB of them).
BLOCK_ROWS = 16384
QUERY_ROWS = 4096
# A query reads this share of each list at first and this one in each further
# round. It stops reading a block when no unread vector can qualify and at most
# this share of the block is left.
FIRST = 1 / 2
# Queries whose bounds are worked out together.
TOGETHER = 64
STEP = 1 / 8
LEFT = 1 / 8


class SortedLists:
    """One block of vectors of the same length, with a sorted list per component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        order = np.argsort(vectors, axis=0, kind="stable").T
        values = np.take_along_axis(vectors.T, order, axis=1).astype(np.float64)
        # By direction: each list from its smallest and from its largest value.
        self.order = np.stack([order, order[:, ::-1]])
        self.sorted = np.stack([values, values[:, ::-1]])

    def _read(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is read of all lists to a depth, from the top and from the bottom, side by side.

        Values by vector and list (0 where unread), 1 where read, and the last
        value read of each list. Queries differ in weights and directions only,
        so one reading serves all of them.
        """
        n, width = len(self.ids), len(self.order[0])
        values, seen = np.zeros((n, 2 * width)), np.zeros((n, 2 * width))
        for way in (0, 1):
            column = np.arange(width)[:, None] + (way * width)
            values[self.order[way][:, :depth], column] = self.sorted[way][:, :depth]
            seen[self.order[way][:, :depth], column] = 1
        return values, seen, np.concatenate([self.sorted[way][:, depth - 1] for way in (0, 1)])

    def top(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query's place, ids, scores): the block's share of each query's k best.

        ``floors`` are scores that k vectors reach elsewhere, minus infinity if
        none are known.
        """
        n, left = len(self.ids), np.arange(len(query_ids))
        # Weights by list: negative ones read from the smallest value, positive ones from the largest.
        weights = np.concatenate([np.minimum(queries, 0), np.maximum(queries, 0)], axis=1).T.astype(np.float64)
        last = np.concatenate([self.sorted[way][:, -1] for way in (0, 1)])
        first = np.concatenate([self.sorted[way][:, 0] for way in (0, 1)])
        slack = 1e-12 * np.maximum(np.abs(first), np.abs(last)) @ np.abs(weights)
        depth = max(int(n * FIRST), 1)
        while len(left):
            values, seen, frontier = self._read(depth)
            unsure = []
            for start in range(0, len(left), TOGETHER):
                some = left[start : start + TOGETHER]
                w, room = weights[:, some], slack[some]
                worst, best = last[:, None] * w, frontier[:, None] * w
                got, known = values @ w, seen @ np.hstack([worst, best])
                lower = got + (worst.sum(axis=0) - known[:, : len(some)])
                upper = got + (best.sum(axis=0) - known[:, len(some) :])
                own = self.ids[:, None] == query_ids[some][None, :]
                lower[own] = -np.inf
                reach = floors[some].copy()
                if n > k:
                    reach = np.maximum(reach, np.partition(lower, n - k, axis=0)[n - k] - room)
                alive = (upper + room >= reach) & ~own
                sure = (best.sum(axis=0) + room < reach) & (alive.sum(axis=0) <= max(n * LEFT, k)) | (depth == n)
                for i in np.flatnonzero(sure):
                    yield (int(some[i]), *self._final(np.flatnonzero(alive[:, i]), queries[some[i]], k, floors[some[i]]))
                unsure.append(some[~sure])
            left, depth = np.concatenate(unsure), min(depth + max(int(n * STEP), 1), n)

    def _final(self, left: np.ndarray, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of what sequential reading could not rule out."""
        scores = self.vectors[left] @ query
        left, scores = left[scores >= floor], scores[scores >= floor]
        best = np.lexsort((self.ids[left], -scores))[:k]
        return self.ids[left][best], scores[best]


def _search(queries, k: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for ids, rows in _blocks(batches, block_rows):
            for size in np.unique([len(r) for r in rows]):
                member = np.array([len(r) == size for r in rows])
                vectors = np.array([r for r in rows if len(r) == size], np.int64).reshape(member.sum(), size)
                lists = SortedLists(ids[member], vectors)
                numbers = [i for i, (_, query) in enumerate(asked) if len(query) == size]
                if not numbers:
                    continue
                floors = np.array([
                    best[i][1][k - 1] if i in best and len(best[i][1]) >= k else -np.inf for i in numbers
                ])
                query_ids = np.array([asked[i][0] for i in numbers], np.int64)
                matrix = np.array([asked[i][1] for i in numbers], np.int64).reshape(len(numbers), size)
                for place, new_ids, new in lists.top(query_ids, matrix, k, floors):
                    number = numbers[place]
                    old_ids, old = best.get(number, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    all_ids, scores = np.concatenate([old_ids, new_ids]), np.concatenate([old, new])
                    order = np.lexsort((all_ids, -scores))[:k]
                    best[number] = all_ids[order], scores[order]
        for number, (ids, scores) in best.items():
            query_id = np.full(len(ids), asked[number][0], np.int64)
            number_ = np.full(len(ids), number, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_id), pa.array(number_), pa.array(ids), pa.array(scores)],
                ["query_id", "number", "vec_id", "score"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list]]:
    ids, rows = [], []
    for batch in batches:
        ids += batch.column("vec_id").to_pylist()
        offsets = batch.column("ints").offsets.to_numpy()
        values = batch.column("ints").values.to_numpy()
        rows += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        while len(ids) >= most:
            yield np.array(ids[:most], np.int64), rows[:most]
            ids, rows = ids[most:], rows[most:]
    if ids:
        yield np.array(ids, np.int64), rows


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and ``ints``, the floor of ``scale`` times each component, of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("ints"),
    )


def top_matches(
    vectors: DataFrame, is_query: Column, k: int = 10, query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows by integer inner product.

    ``vectors`` has vec_id and embedding; rows for which ``is_query`` (on
    vec_id) holds are the queries, all rows but the query's own are candidates.
    Ties go to the smaller vec_id. Rows without id, without vector or with a
    null or non-finite component take no part; vectors of another length than
    the query's are no candidates. Rows that share the query's vec_id are its
    own; other repeated rows are candidates each. Equal queries that occur twice
    are asked once. Empty tables give no rows; other columns are not read.

    Queries go to the tasks in blocks of about ``query_rows``, one pass over the
    candidates each, so neither the driver nor a task ever holds them all.
    """
    rows = whole_vectors(vectors)
    queries = rows.filter(is_query).distinct()
    blocks = max(1, -(-queries.count() // query_rows))
    spark, found = vectors.sparkSession, []
    for block in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        asked = [(r["vec_id"], np.array(r["ints"], np.int64)) for r in sorted(part)]
        sent = spark.sparkContext.broadcast(asked)
        best = rows.mapInArrow(_search(sent, k, block_rows), "query_id long, number long, vec_id long, score long")
        order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), "vec_id")
        ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found.append(cut_lineage(ranked.select("query_id", "rank", "vec_id", "score")))
        sent.unpersist()
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
