"""Exact top-k inner products by the threshold algorithm.

Vectors are turned to integers, floor(256 * x). Rows and queries are dealt into blocks of bounded size; each pair of a
row block and a query block is one group, so a group holds at most about ``ROWS`` rows and ``QUERIES`` queries whatever
the size of the table, and all queries meet all rows once. In a group each dimension has its list of rows by value. For a
query the lists are read from the end that its sign favours, to doubling depths; rows that turn up are scored in full; no
row that has not turned up can exceed the sum over the lists of query value times the value reached. Reading stops when
that bound is below the k-th score so far (strictly, so that ties with smaller ids cannot be missed), or when all rows
have turned up. The groups' best are merged to the best of all.

Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows with a null id. Vectors of
different lengths do not meet. Rows that repeat id and vector count once; one id with several vectors is
several candidates and several queries, which give the rows of their union. A query's own id is never its candidate. Scores
are exact as long as they fit 53 bits; beyond that they are computed in 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

ROWS, QUERIES = 8_192, 512
FIRST_DEPTH = 8


class SortedLists:
    """The rows of a block, and for each dimension the rows by value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.by_value = np.argsort(self.values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(self.values, self.by_value.T, axis=0).T

    def best(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best rows but those with the query's own id, and the ties of the last of them."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        weight = q[dims]
        seen = np.zeros(n, bool)
        scores = np.full(n, -np.inf) if self.values.dtype == float else np.full(n, np.iinfo(np.int64).min)
        start, depth = 0, FIRST_DEPTH
        bar = None
        while True:
            depth = min(depth, n)
            upward = weight > 0
            fresh = np.zeros(n, bool)
            if len(dims) == 0 or depth == n:
                fresh[:] = True
            else:
                fresh[self.by_value[dims[upward], n - depth : n - start].ravel()] = True
                fresh[self.by_value[dims[~upward], start:depth].ravel()] = True
            rows = np.flatnonzero(fresh & ~seen)
            scores[rows] = self.values[rows] @ q
            seen[rows] = True
            seen_other = np.flatnonzero(seen & (self.ids != own))
            if len(seen_other) >= k:
                bar = np.partition(scores[seen_other], len(seen_other) - k)[len(seen_other) - k]
            if depth == n or seen.all():
                break
            bound = (weight * np.where(upward, self.sorted[dims, n - depth], self.sorted[dims, depth - 1])).sum()
            if bar is not None and bar > bound:
                break
            start, depth = depth, depth * 2
        keep = seen_other if bar is None else seen_other[scores[seen_other] >= bar]
        top = keep[np.lexsort((self.ids[keep], -scores[keep]))][:k]
        return self.ids[top], scores[top]


def _values(table: pa.Table) -> np.ndarray:
    column = table["v"].combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            v, q = _values(rows), _values(queries)
            if float(np.abs(v).max()) * float(np.abs(q).max()) * v.shape[1] < 2**53:
                v, q = v.astype(float), q.astype(float)
            lists = SortedLists(rows["id"].to_numpy(), v)
            for own, one in zip(queries["id"].to_numpy(), q, strict=True):
                ids, scores = lists.best(own, one, k)
                out[0] += [own] * len(ids)
                out[1] += ids.tolist()
                out[2] += scores.astype(np.int64).tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v, size): distinct usable rows with integer components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    ok = vectors.where("vec_id IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).where(F.forall("x", lambda c: c.isNotNull())) \
        .where(F.forall("x", lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return ok.select("id", F.transform("x", lambda c: F.floor(c * 256).cast("long")).alias("v")).distinct().withColumn("size", F.size("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rows_per_block: int = ROWS, queries_per_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query among all rows."""
    rows, asked = usable(vectors), usable(queries)
    blocks = max(1, -(-rows.count() // rows_per_block))
    sets = max(1, -(-asked.count() // queries_per_block))
    place = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("rb")
    part = F.pmod(F.xxhash64(F.lit(7), "id", "v"), F.lit(sets)).cast("int").alias("qb")
    left = rows.select("id", "v", "size", place, F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("qb"))
    right = asked.select("id", "v", "size", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("rb"), part)
    found = left.groupBy("size", "rb", "qb").cogroup(right.groupBy("size", "rb", "qb")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
