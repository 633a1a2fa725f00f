"""Exact top-k search by inner product: the threshold algorithm over sorted lists, block by block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, table

TOP = 5
BLOCK, QUERY_BLOCK = 8192, 4096
FIRST_DEPTH = 16


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v (doubles floor(scale * x), as bytes): vectors without null ids, null or non-finite components."""

    def pack(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(off[0], off[-1] - off[0])
            x = np.floor(scale * flat.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
            bad = np.r_[0, np.cumsum(~np.isfinite(x))]  # nulls are NaN here
            off = off - off[0]
            keep = (bad[off[1:]] == bad[off[:-1]]) & np.array(ids.is_valid()) & np.array(lists.is_valid())
            at = np.flatnonzero(keep)
            out = pa.array([x[off[k] : off[k + 1]].tobytes() for k in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), out], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(pack, "vec_id long, v binary")


class SortedLists:
    """A block of candidates and, for each dimension, their order by that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, x: np.ndarray):
        self.ids, self.rows, self.x = ids, rows, x
        self.scored = 0
        self.order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32)  # ascending
        self.sorted = np.take_along_axis(x, self.order.T.astype(np.int64), axis=0).T

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best candidates but the row `own`, ties to smaller ids.

        Each list is walked from the end where the query's component gives the most.  All that is met is scored at once;
        what isn't met by depth d scores at most the sum of the lists' values at d, and when that is below the kth best
        score the walk stops.  At an equal bound it goes on: a smaller id may lie there.
        """
        n, live = len(self.ids), np.flatnonzero(q)
        up = q[live] > 0
        seen = np.zeros(n, bool)
        best_i, best_s = np.zeros(0, np.int64), np.zeros(0)
        depth, last = 0, 0
        while True:
            depth = min(n, max(FIRST_DEPTH, depth * 4))
            fresh = np.zeros(n, bool)
            fresh[self.order[live[up], n - depth : n - last].ravel()] = True
            fresh[self.order[live[~up], last:depth].ravel()] = True
            fresh &= ~seen
            if depth == n:
                fresh = ~seen
            seen |= fresh
            at = np.flatnonzero(fresh)
            s = self.x[at] @ q
            if s.dtype == object:
                s = np.maximum(np.minimum(s, 2**63 - 1), -(2**63))
            self.scored += len(at)
            keep = self.rows[at] != own
            i, s = np.r_[best_i, self.ids[at][keep]], np.r_[best_s, s[keep]]
            if len(i) > 8 * k:
                near = s >= np.partition(s, len(s) - k)[len(s) - k]
                i, s = i[near], s[near]
            top = np.lexsort((i, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda t: (-s[t], i[t]))[:k], np.int64)
            best_i, best_s = i[top], s[top]
            if depth == n:
                return best_i, best_s
            bound = q[live] @ np.where(up, self.sorted[live, n - depth], self.sorted[live, depth - 1])
            if len(best_s) == k and best_s[-1] > bound:
                return best_i, best_s
            last = depth


def _exact(x: np.ndarray, q: np.ndarray):
    """x and q in the narrowest form in which every partial sum of their products is exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 1 << 24:
        return x.astype(np.float32), q.astype(np.float32)
    if most < 1 << 53:
        return x, q
    whole = np.frompyfunc(int, 1, 1)
    return whole(x).astype(object), whole(q).astype(object)


def _vectors(rows: pa.Table, queries: bool = False) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, rows and components by dimension."""
    names = ("q_id", "q_row", "q_v") if queries else ("vec_id", "row", "v")
    ids, own, raw = (rows[n] for n in names)
    ids, own, raw = ids.to_numpy(), own.to_numpy(), raw.to_pylist()
    sizes = np.array([len(r) // 8 for r in raw], np.int64)
    return {int(d): (ids[sizes == d], own[sizes == d], np.frombuffer(b"".join(r for r, n in zip(raw, sizes, strict=True) if n == d), np.float64).reshape(int((sizes == d).sum()), d)) for d in np.unique(sizes)}


def numbered(vectors: DataFrame) -> DataFrame:
    """vectors in the shared folder with row, which tells rows with one vec_id apart."""
    return store(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")


def found(candidates: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, query_row, vec_id, score, scored: the k best candidates of each block for each query, and how many of the
    block's candidates the walk scored for the query."""
    n, m = candidates.count(), queries.count()
    parts, groups = max(1, -(-n // block)), max(1, -(-m // query_block))
    left = candidates.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(parts))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.selectExpr("vec_id as q_id", "v as q_v", "row as q_row").withColumn("g", F.pmod(F.hash("q_row"), F.lit(groups))).withColumn("c", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))

    def meet(cands: pa.Table, qs: pa.Table) -> pa.Table:
        out = [], [], [], [], []
        have = _vectors(cands) if cands.num_rows and qs.num_rows else {}
        for d, (qi, qr, q) in _vectors(qs, True).items() if have else ():
            if d not in have:
                continue
            ids, rows, x = have[d]
            x, q = _exact(x, q)
            lists = SortedLists(ids, rows, x)
            for i, own, row in zip(qi.tolist(), qr.tolist(), q, strict=True):
                before = lists.scored
                got, scores = lists.search(row, own, k)
                out[0].extend([i] * len(got))
                out[1].extend([own] * len(got))
                out[2].extend(got.tolist())
                out[3].extend(map(int, scores))
                out[4].extend([lists.scored - before] * len(got))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "query_row", "vec_id", "score", "scored"])

    return left.groupBy("c", "g").cogroup(right.groupBy("c", "g")).applyInArrow(meet, "query_id long, query_row long, vec_id long, score long, scored long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest inner products with each query (all, if fewer).

    candidates and queries: vec_id, v, row as numbered gives them.  The candidates are dealt into blocks of about `block`,
    whatever their ids; each block meets each block of queries in a task of its own, which makes the sorted lists and
    runs the threshold algorithm; the blocks' winners, k at most for each query and block, are ranked at the end.
    Vectors meet only those of their own dimension; a vector without components is a vector.  Each row of queries is a query,
    also where vec_ids repeat, and meets every row but itself; repeated candidates each count.  Ties go to the smaller
    vec_id.  Scores are exact, and end at the long range.  No rows, no results.  Other columns are not read.
    """
    ranked = found(candidates, queries, k, block, query_block)
    ranked = ranked.selectExpr("query_id", "cast(row_number() over (partition by query_row order by score desc, vec_id) as int) as rank", "vec_id", "score")
    return ranked.filter(F.col("rank") <= k)


def op1_topk(spark, sf_dir) -> DataFrame:
    vectors = numbered(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
