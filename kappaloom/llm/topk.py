"""Exact top-k search by aggregating sorted lists without random access.

Every component of the vectors is one list, sorted by its share of the score:
a query reads it from the end that its sign prefers, step by step. What a step adds is
taken for the candidates that are left alone: a candidate's score is bounded from below by what was read of it and the last entry of
each list that has not shown it, and from above by the lists' present fronts.
A candidate whose upper bound is below the k-th best lower bound is dropped; a query stops when few are
left, and only the scores of those are resolved.

Candidates are divided into blocks, each with its own lists, and queries too; every
pair of blocks is one task's work of bounded size, and a query's best of all blocks
are ranked in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Vectors in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 1024
#: Shares of the lists that are read, step by step.
STEPS = (0.25, 0.5, 0.75, 0.9)
#: Queries whose bounds are held at once.
AT_ONCE = 256


class Lists:
    """The sorted lists of a block of integer vectors.

    What is read of a list depends on the query's sign alone. So a step's entries, from
    either end, are kept as matrices, and the bounds of many queries are their products. `entries` counts
    what was read of all lists by all queries.
    """

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.largest, self.entries = vectors, _largest(vectors), 0
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rank = np.empty(vectors.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(vectors), dtype=np.int32)[:, None], axis=0)
        self.sorted = np.take_along_axis(vectors, order, axis=0)

    def top(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows, without those in own (rows x queries), among which the k best are, and their exact scores."""
        kind = exact_type(self.largest * _largest(queries) * max(1, queries.shape[1]))
        vectors, ends = self.vectors.astype(kind), self.sorted.astype(kind)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(queries), AT_ONCE):
            some = queries[at : at + AT_ONCE].astype(kind)
            left = self._left(vectors, ends, some.T, k, ~own[:, at : at + AT_ONCE])
            out += [(rows := np.flatnonzero(left[:, i]), self._scores(vectors, rows, query)) for i, query in enumerate(some)]
        return out

    def _left(self, vectors: np.ndarray, ends: np.ndarray, q: np.ndarray, k: int, left: np.ndarray) -> np.ndarray:
        """Which rows may be among a query's k best (rows x queries), by reading the lists down."""
        (n, dim), read = vectors.shape, 0
        going = left.sum(axis=0) > 4 * k
        signs = np.concatenate([q > 0, q <= 0])
        weights = signs * np.concatenate([q, q])
        bottom = weights * np.concatenate([ends[0], ends[-1]])[:, None] if n else weights
        # of every row and query: what was read, and what the rest adds at least
        known, rest = np.zeros(left.shape, vectors.dtype), np.broadcast_to(bottom.sum(axis=0), left.shape).copy()
        for share in STEPS if n > k and q.size else ():
            some = np.flatnonzero(going)
            if not len(some):
                break
            rows = np.flatnonzero(left[:, some].any(axis=1))
            depth, at = max(read + 1, int(n * share)), np.ix_(rows, some)
            rank, here = self.rank[rows], vectors[rows]
            seen = np.concatenate([rank >= n - depth, rank < depth], axis=1)
            fresh = seen & ~np.concatenate([rank >= n - read, rank < read], axis=1)
            known[at] += np.where(fresh, np.concatenate([here, here], axis=1), 0) @ weights[:, some]
            rest[at] -= fresh.astype(vectors.dtype) @ bottom[:, some]
            front = weights[:, some] * np.concatenate([ends[n - depth], ends[depth - 1]])[:, None]
            ahead = front.sum(axis=0) - seen.astype(vectors.dtype) @ front
            open_ = left[at]
            # a row outside had an upper bound below a k-th best lower bound, which only rises
            lower = np.where(open_, known[at] + rest[at], vectors.dtype.type(-(1 << 62)))
            least = np.partition(lower, len(rows) - k, axis=0)[len(rows) - k]
            left[at] = open_ & (known[at] + ahead >= least)
            self.entries += (depth - read) * dim * len(some)
            going[some] = left[:, some].sum(axis=0) > 4 * k
            read = depth
        return left

    def _scores(self, vectors: np.ndarray, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return vectors[rows] @ query


def _largest(vectors: np.ndarray) -> int:
    return max(abs(int(vectors.min())), abs(int(vectors.max()))) if vectors.size else 0


def exact_type(most: int) -> type:
    """A type in which sums of whole numbers of up to `most` in all have no rounding; all types give the same scores.

    >>> exact_type(1 << 40), exact_type(1 << 53)
    (<class 'numpy.float64'>, <class 'numpy.int64'>)
    """
    if most < 1 << 52:
        return np.float64
    if most < 1 << 61:
        return np.int64
    raise OverflowError("inner products of these vectors do not fit in 64 bits")


def best(scores: np.ndarray, ids: list, k: int) -> list[int]:
    """Places of the k highest scores, ties to smaller ids, null ids last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return sorted(places.tolist(), key=lambda i: (-scores[i], ids[i] is None, ids[i] or 0))[:k]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1).astype(np.int64)


def whole_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v, dim) with v = floor(1024 * component) of the rows whose vector is whole and finite."""
    sound = f"{vector_column} IS NOT NULL AND forall({vector_column}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return rows.where(sound).selectExpr(f"{id_column} AS vec_id", f"transform({vector_column}, x -> CAST(floor(1024D * CAST(x AS double)) AS bigint)) AS v").withColumn("dim", F.size("v"))


def top_k(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query, the k rows of highest inner product.

    Vectors that are null, or hold null or non-finite components, take no part. A
    row is compared with rows of as many components and of another id; repeated ids are
    repeated candidates, and a repeated query id is one query for each of its distinct
    vectors, of which the best rows count once. A null id is no query; as a candidate it
    comes last among ties; ties of a score go to smaller ids. Empty vectors are compared with each other, with a score of 0. Vectors whose
    products might not fit in 64 bits are an error. Other columns, whatever their names, are left out; an empty table gives an empty result.
    """
    # the block is fixed by writing it: a retried task would number its rows anew
    valid = staged(whole_vectors(rows.where(f"{vector_column} IS NOT NULL"), id_column, vector_column).withColumn("at", F.monotonically_increasing_id()).withColumn("is_query", F.lit(False)), "vectors")
    valid = valid.withColumn("is_query", F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull())
    n, nq = valid.agg(F.count("*"), F.count_if("is_query")).first()
    blocks, query_blocks = -(-n // block) or 1, -(-nq // query_block) or 1
    number = lambda m, seed: F.pmod(F.xxhash64("at", F.lit(seed)), F.lit(m))
    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    candidates = valid.select("vec_id", "v", "dim", number(blocks, 1).alias("b"), spread(query_blocks).alias("qb"))
    queries = valid.where("is_query").select("vec_id", "v", "dim").distinct().withColumn("at", F.xxhash64("vec_id", "v")).select("vec_id", "v", "dim", number(query_blocks, 2).alias("qb"), spread(blocks).alias("b"))
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, asked = left.column("vec_id").to_pylist(), right.column("vec_id").to_pylist()
            lists, vectors = Lists(_matrix(left.column("v"), len(ids))), _matrix(right.column("v"), len(asked))
            known = np.array([-1 if i is None else i for i in ids], np.int64)
            absent = np.array([i is None for i in ids], bool)
            own = (known[:, None] == np.array(asked, np.int64)) & ~absent[:, None]
            for query_id, (rows, scores) in zip(asked, lists.top(vectors, k, own), strict=True):
                mine = [ids[i] for i in rows]
                out += [(query_id, mine[i], int(scores[i])) for i in best(scores, mine, k)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, schema.types, strict=True)], schema=schema)

    found = candidates.groupBy("b", "qb", "dim").cogroup(queries.groupBy("b", "qb", "dim")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
