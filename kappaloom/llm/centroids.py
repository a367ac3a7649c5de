"""Lloyd's clustering with centroids screened by the norms of vectors' segments.

A vector is kept with a compressed form, made once: of each of its segments the sum and the norm of
what is left when the mean is taken off. By the inequality of Cauchy and Schwarz two segments are at least as far apart as
their means are, plus the difference of these norms. The sum over segments bounds a squared distance
from below, in a quarter of the numbers. The centroid of the least bound is measured exactly, and then only those whose bound
does not exceed that distance; distances are integers, so ties are ties.

A round is one pass over the written vectors. Every task gives a sum for each centroid, which Spark adds up; only the
centroids come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged
from .vectors import floored, is_whole, lists, matrix, squared

#: Segments that a vector's compressed form has at most.
SEGMENTS = 8
#: What rounding may add to a bound, in units of a distance.
SLACK = 1e-6


def segments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compressed form of integer vectors: each segment's sum by the root of its length, and the norm of what its mean leaves.

    >>> [x.round(6).tolist() for x in segments(np.array([[5] * 16 + [0] * 15 + [8]]))]
    [[[10.0, 10.0, 10.0, 10.0, 0.0, 0.0, 0.0, 4.0]], [[0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 6.928203]]]
    """
    dim = vectors.shape[1]
    if not dim:
        return np.zeros((len(vectors), 0)), np.zeros((len(vectors), 0))
    starts = np.unique(np.linspace(0, dim, min(SEGMENTS, dim) + 1).astype(int))[:-1]
    sizes = np.diff([*starts, dim])
    sums = np.add.reduceat(vectors, starts, axis=1)
    apart = vectors - np.repeat(sums / sizes, sizes, axis=1)
    return sums / np.sqrt(sizes), np.sqrt(np.add.reduceat(apart * apart, starts, axis=1))


def least_distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Lower bounds of the squared distances between all vectors of a and of b, from their compressed forms."""
    out = np.zeros((len(a[0]), len(b[0])))
    for x, y in zip(a, b, strict=True):
        for i in range(x.shape[1]):
            out += np.square(x[:, i, None] - y[None, :, i])
    return out


def nearest(vectors: np.ndarray, compressed: tuple[np.ndarray, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the smaller number on ties, the exact squared distance, and how many were measured."""
    bounds = least_distances(compressed, segments(centroids))
    rows = np.arange(len(vectors))
    guess = bounds.argmin(axis=1)
    upper = squared(vectors, centroids[guess])
    open_ = bounds - SLACK * (1 + np.sqrt(bounds)) <= upper[:, None]
    open_[rows, guess] = False
    distances = np.full(bounds.shape, np.iinfo(np.int64).max)
    distances[rows, guess] = upper
    at, which = np.nonzero(open_)
    distances[at, which] = squared(vectors[at], centroids[which])
    best = distances.argmin(axis=1)
    return best, distances[rows, best], open_.sum(axis=1) + 1


def clusters(rows: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact): the clustering of floor(scale * x) of the vectors with dim components.

    Centroids start as the k vectors with the smallest SHA-256 of `salt:id`, in that order. In each round every vector goes to its nearest centroid, and every
    centroid that has any becomes the componentwise floor of their mean; then vectors are assigned once more.
    n_exact is how many centroids were measured for a vector in the end.

    Vectors that are null, of another length, or hold null or non-finite components take no part. Repeated rows are vectors of their own, which can start equal
    centroids: the smaller number has all. Of equal ids the smaller vector starts first; null ids start last. Fewer vectors than k give
    fewer centroids, an empty table an empty result. Vectors whose squared distances might not fit in 64 bits are an error. Other columns are left out, whatever their names.
    """
    spark = rows.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    id_type = dict(rows.dtypes)[id_column]
    some = rows.select(F.col(id_column).alias("vec_id"), vector.alias("x")).where((F.size("x") == dim) & is_whole(F.col("x")))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = floored(matrix(batch.column("x"), dim), scale)
            means, rest = segments(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(v, pa.int64()), lists(means, pa.float64()), lists(rest, pa.float64())], ["vec_id", "v", "means", "rest"])

    kept = staged(some.mapInArrow(compress, f"vec_id {id_type}, v array<long>, means array<double>, rest array<double>"), "compressed")
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("v", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([r.v for r in first], np.int64).reshape(len(first), dim)

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        v = matrix(batch.column("v"), dim)
        return v, tuple(matrix(batch.column(x), min(SEGMENTS, dim)) for x in ("means", "rest"))

    for _ in range(rounds if first else 0):
        now = centroids

        def add(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            n, sums = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for batch in batches:
                if batch.num_rows:
                    v, compressed = read(batch)
                    best = nearest(v, compressed, now)[0]
                    n += np.bincount(best, minlength=len(now))
                    np.add.at(sums, best, v)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n[used]), lists(sums[used], pa.int64())], ["cluster", "n", "s"])

        parts = kept.mapInArrow(add, "cluster int, n long, s array<long>")
        # k rows come back: whole numbers of any size
        exact = lambda c: F.sum(c.cast("decimal(38,0)"))
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[exact(F.col("s")[i]) for i in range(dim)]).alias("s")).collect()
        centroids = now.copy()
        for r in found:
            centroids[r.cluster] = [int(x) // r.n for x in r.s]

    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, distance, exact = nearest(*read(batch), final)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance), pa.array(exact, pa.int32())], ["vec_id", "cluster", "distance", "n_exact"])

    assigned = staged(kept.mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long, n_exact int"), "assigned")
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    told = spark.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), p) for i, p in enumerate(prints)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows
    return assigned.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact")


def oracle(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1") -> str:
    """The same in DuckDB's SQL, a step for each round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0))""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, x) - 1)::INTEGER AS c, x, xx FROM kept QUALIFY c < {k})",
    ]
    # floor(sum / n) of whole numbers
    mean = f"[{', '.join(f'(sum(a.x[{i}])::HUGEINT - ((sum(a.x[{i}])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)' for i in range(1, dim + 1))}]::DOUBLE[]"
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, any_value(x) AS x, min({{'d': d, 'c': c}}) AS m FROM (SELECT k.r, k.vec_id, k.x, c.c, (k.xx - 2 * list_inner_product(k.x, c.x) + c.xx)::BIGINT AS d FROM kept k, c{i} c) GROUP BY r, vec_id)")
        if i < rounds:
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, x, list_inner_product(x, x) AS xx FROM (SELECT b.c, coalesce(n.x, b.x) AS x FROM c{i} b LEFT JOIN (SELECT a.m.c AS c, {mean} AS x FROM a{i} a GROUP BY a.m.c) n USING (c)))")
    return f"""WITH {', '.join(parts)}
SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m.c"""


ORACLE = oracle()
