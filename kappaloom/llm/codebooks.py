"""Vectors compressed to codes by Lloyd's codebooks with Yinyang bounds.

A vector is cut into parts, each of which has a codebook. The entries of a codebook are clustered
into groups once. With every part go its entry, an upper bound of the distance to it, and for each group a lower bound
of the distance to the group's other entries. When entries move, the upper bound grows by the drift of the own entry and a group's lower bound
falls by the largest drift in the group; a group is scanned only if its bound does not exceed the upper one, which is first made
exact. Distances are compared as squares in integers, the lower index on ties; bounds are integers rounded away from
each other, so that they never decide a tie.

A round is one pass over the written vectors and bounds. Every task also gives what its moved parts add to the sums of entries,
in a folder of its own; Spark adds these up, and the driver holds the codebooks and their sums alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh_path, remove, staged
from .vectors import floored, is_whole, lists, matrix, squared

#: Groups of a codebook's entries.
GROUPS = 4
#: How far a root may be off, as a share.
ROUNDING = 1e-12


def below(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not above the roots of squares.

    >>> below(np.array([0, 3, 4, 1 << 62])).tolist(), above(np.array([0, 3, 4])).tolist()
    ([0, 1, 1, 2147483647], [0, 2, 3])
    """
    return np.floor(np.sqrt(squares.astype(np.float64)) * (1 - ROUNDING)).astype(np.int64)


def above(squares: np.ndarray) -> np.ndarray:
    """Whole numbers not below the roots of squares."""
    return np.ceil(np.sqrt(squares.astype(np.float64)) * (1 + ROUNDING)).astype(np.int64)


def grouped(entries: np.ndarray, groups: int = GROUPS, rounds: int = 5) -> np.ndarray:
    """The group of each entry, by a few rounds of Lloyd's over the entries themselves; this changes the work and no result."""
    centres = entries[:: max(1, -(-len(entries) // groups))][:groups].astype(np.float64)
    of = np.zeros(len(entries), np.int64)
    for _ in range(rounds if len(entries) else 0):
        of = np.square(entries[:, None].astype(np.float64) - centres[None]).sum(axis=2).argmin(axis=1)
        for g in range(len(centres)):
            if (of == g).any():
                centres[g] = entries[of == g].mean(axis=0)
    return of


class Book:
    """One part's codebook, its groups, and how far its entries have moved."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.group = entries, grouped(entries)
        self.members = [np.flatnonzero(self.group == g) for g in range(GROUPS)]
        self.counts, self.sums = np.zeros(len(entries), np.int64).astype(object), np.zeros(entries.shape, object)
        self.drift, self.far = np.zeros(len(entries), np.int64), np.zeros(GROUPS, np.int64)

    def move(self) -> None:
        """Entries that are used become the floor of the mean of their parts."""
        old = self.entries
        self.entries = np.array([[int(s) // int(n) for s in sums] if n else row.tolist() for n, sums, row in zip(self.counts, self.sums, old, strict=True)], np.int64).reshape(old.shape)
        self.drift = above(squared(self.entries, old))
        self.far = np.array([self.drift[m].max(initial=0) for m in self.members])

    def scanned(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distances of some rows to some entries."""
        return np.stack([squared(x, self.entries[e]) for e in which], axis=1)

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Entries, upper bounds, lower bounds and the number of distances, for rows without bounds."""
        d = self.scanned(x, np.arange(len(self.entries)))
        code = d.argmin(axis=1)
        rows = np.arange(len(x))
        upper = above(d[rows, code])
        d[rows, code] = np.iinfo(np.int64).max
        lower = np.stack([below(d[:, m].min(axis=1)) if len(m) else np.full(len(x), NONE) for m in self.members], axis=1)
        return code, upper, np.minimum(lower, NONE), d.size

    def next(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same for rows with bounds, after the entries have moved."""
        code, upper, lower, exact = code.copy(), upper + self.drift[code], lower - np.where(lower == NONE, 0, self.far), 0
        open_ = np.flatnonzero(lower.min(axis=1) <= upper)
        if not len(open_):
            return code, upper, lower, 0
        old, some = code[open_], x[open_]
        own = squared(some, self.entries[old])
        upper[open_] = above(own)
        exact += len(open_)
        best, entry, bounds = own.copy(), old.copy(), lower[open_]
        asked = bounds <= upper[open_][:, None]
        far = np.iinfo(np.int64).max
        seen = np.full((len(open_), GROUPS, 2), far)  # the two least squares of every scanned group, without the old entry
        for g, members in enumerate(self.members):
            at = np.flatnonzero(asked[:, g])
            if not len(at) or not len(members):
                continue
            d = self.scanned(some[at], members)
            exact += d.size
            d[members[None] == old[at][:, None]] = far
            least = d.argmin(axis=1)
            found = d[np.arange(len(at)), least]
            seen[at, g] = np.sort(np.concatenate([d, np.full((len(at), 2), far)], axis=1), axis=1)[:, :2]
            won = (found < best[at]) | ((found == best[at]) & (members[least] < entry[at]))
            best[at[won]], entry[at[won]] = found[won], members[least[won]]
        # a scanned group's bound is its least square without the row's new entry
        rows, moved = np.arange(len(open_)), entry != old
        least, home = seen[:, :, 0].copy(), self.group[entry]
        least[rows[moved], home[moved]] = seen[rows[moved], home[moved], 1]
        bounds = np.where(asked, np.minimum(below(np.minimum(least, far - 1)), NONE), bounds)
        bounds = np.where(asked & (least == far), NONE, bounds)
        # the old entry is now one of its group's others
        left = self.group[old[moved]]
        bounds[rows[moved], left] = np.minimum(bounds[rows[moved], left], below(own[moved]))
        code[open_], upper[open_], lower[open_] = entry, above(best), bounds
        return code, upper, lower, exact


#: The lower bound of a group without any other entry.
NONE = np.iinfo(np.int32).max


def _pass(books: list[Book], cut: np.ndarray, held: np.ndarray | None) -> np.ndarray:
    """For the parts of vectors (rows, parts, width): entry, upper bound and lower bounds (rows, parts, 2 + GROUPS)."""
    out = np.empty((*cut.shape[:2], 2 + GROUPS), np.int32)
    for p, book in enumerate(books):
        x = np.ascontiguousarray(cut[:, p])
        if held is None:
            code, upper, lower, _ = book.first(x)
        else:
            now = held[:, p].astype(np.int64)
            code, upper, lower, _ = book.next(x, now[:, 0], now[:, 1], now[:, 2:])
        out[:, p] = np.concatenate([code[:, None], np.minimum(upper, NONE)[:, None], np.maximum(lower, -1)], axis=1)
    return out


def _compressed(spark: SparkSession, whole: DataFrame, dim: int, parts: int, k: int, rounds: int, scale: int) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of the vectors (vec_id, label, x) with dim components."""
    width, kinds = dim // parts, dict((f.name, f.dataType) for f in whole.schema)
    first = whole.where(F.size("x") == dim).orderBy(F.asc_nulls_last("vec_id"), "x").limit(k).collect()
    seeds = floored(np.array([r.x for r in first], np.float64).reshape(len(first), dim), scale).reshape(-1, parts, width)
    books = [Book(seeds[:, p]) for p in range(parts)]
    schema = T.StructType(
        [T.StructField("kind", T.IntegerType()), T.StructField("vec_id", kinds["vec_id"]), T.StructField("label", kinds["label"])]
        + [T.StructField("v", T.ArrayType(T.LongType())), T.StructField("held", T.ArrayType(T.IntegerType()))]
        + [T.StructField(x, T.IntegerType()) for x in ("part", "entry")]
        + [T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))]
    )

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray | None]:
        if "held" in batch.schema.names:
            return matrix(batch.column("v"), dim).reshape(-1, parts, width), matrix(batch.column("held"), parts * (2 + GROUPS)).reshape(-1, parts, 2 + GROUPS)
        return floored(matrix(batch.column("x"), dim), scale).reshape(-1, parts, width), None

    now, path = whole.where(F.size("x") == dim), None
    for _ in range(rounds if first else 0):
        def step(batches: Iterator[pa.RecordBatch], books: list[Book] = books) -> Iterator[pa.RecordBatch]:
            k, kinds_of = len(books[0].entries), None
            counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                kinds_of = [batch.schema.field(x).type for x in ("vec_id", "label")]
                cut, held = read(batch)
                after = _pass(books, cut, held)
                for p in range(parts):
                    new = after[:, p, 0]
                    old = None if held is None else held[:, p, 0]
                    at = np.arange(n) if old is None else np.flatnonzero(new != old)
                    counts[p] += np.bincount(new[at], minlength=k)
                    np.add.at(sums[p], new[at], cut[at, p])
                    if old is not None:
                        counts[p] -= np.bincount(old[at], minlength=k)
                        np.subtract.at(sums[p], old[at], cut[at, p])
                nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("vec_id"), batch.column("label"), lists(cut.reshape(n, -1), pa.int64()), lists(after.reshape(n, -1), pa.int32()), *nothing], schema.names)
            if kinds_of:
                p, e = np.nonzero(counts.astype(bool) | sums.any(axis=2))
                blank = [pa.nulls(len(p), t) for t in (*kinds_of, pa.list_(pa.int64()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(p), np.int32)), *blank, pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), lists(sums[p, e], pa.int64())], schema.names)

        at = fresh_path(spark, "yinyang")
        now.mapInArrow(step, schema).write.partitionBy("kind").option("compression", "zstd").parquet(at)
        if path:
            remove(spark, path)
        path = at
        written = spark.read.schema(schema).parquet(at)
        deltas = written.where("kind = 1").select("part", "entry", "n", "s")
        exact = lambda c: F.sum(c.cast("decimal(38,0)"))
        # a row for each entry comes back
        for r in deltas.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[exact(F.col("s")[i]) for i in range(width)]).alias("s")).collect():
            books[r.part].counts[r.entry] += r.n
            books[r.part].sums[r.entry] += np.array([int(x) for x in r.s], object)
        for book in books:
            book.move()
        now = written.where("kind = 0").select("vec_id", "label", "v", "held")
    done = books

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                cut, held = read(batch)
                after = _pass(done, cut, held)
                codes = np.ascontiguousarray(after[:, :, 0].astype(np.uint8))
                error = sum(squared(cut[:, p], book.entries[after[:, p, 0]]) for p, book in enumerate(done))
                told = pa.array([bytes(c) for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), told, pa.array(error)], ["vec_id", "label", "code", "error"])

    result = T.StructType([schema["vec_id"], schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    values = ",".join(str(x) for book in done for x in book.entries.ravel().tolist())
    out = staged(now.mapInArrow(assign, result), "codes")
    if path:
        remove(spark, path)
    return out.withColumn("codebooks_sha256", F.lit(hashlib.sha256(values.encode()).hexdigest()))


def codes(rows: DataFrame, parts: int = 8, k: int = 16, rounds: int = 6, scale: int = 4096, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of floor(scale * x) of every vector.

    Each part's codebook starts as that part of the k vectors of smallest id. In each round every part goes to its nearest entry, and every used entry becomes the
    componentwise floor of its parts' mean; then parts are assigned once more. code has two hexadecimal digits a part (k is 256 at most); error is the sum of squared distances,
    label_error its sum over rows of the same label, nulls being one.

    Vectors that are null, or hold null or non-finite components, are dropped, and so are those whose length is no positive multiple of `parts`. Vectors of
    different lengths have codebooks of their own. Of rows with equal ids the smaller vector starts first, null ids start last; repeated rows are vectors of their
    own, which can start equal entries: the smaller index has all. Fewer vectors than k give fewer entries, an empty table an empty result.
    Vectors whose squared distances might not fit in 64 bits are an error. Other columns are left out, whatever their names.
    """
    if not 0 < k <= 256:
        raise ValueError("a code has two digits: k must lie between 1 and 256")
    spark = rows.sparkSession
    chosen = rows.select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("x"))
    whole = chosen.where((F.size("x") > 0) & (F.size("x") % parts == 0) & is_whole(F.col("x")))
    # a value for each length that the table has, which is one as a rule
    lengths = sorted(r.n for r in whole.select(F.size("x").alias("n")).distinct().collect())
    out = None
    for dim in lengths or [parts]:
        found = _compressed(spark, whole, dim, parts, k, rounds, scale)
        out = found if out is None else out.unionByName(found)
    sums = staged(out.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors")
    return out.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", "codebooks_sha256")


def oracle(parts: int = 8, k: int = 16, rounds: int = 6, scale: int = 4096, dim: int = 64) -> str:
    """The same in DuckDB's SQL for vectors of dim components, a step for each round."""
    width = dim // parts
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"cut AS MATERIALIZED (SELECT r, p, x[p * {width} + 1 : p * {width} + {width}] AS x FROM kept, (SELECT unnest(range({parts})) AS p))",
        f"b0 AS MATERIALIZED (SELECT p, e, x FROM cut JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept QUALIFY e < {k}) USING (r))",
    ]
    mean = f"[{', '.join(f'(sum(a.x[{i}])::HUGEINT - ((sum(a.x[{i}])::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)' for i in range(1, width + 1))}]::DOUBLE[]"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m FROM (SELECT c.r, c.p, c.x, b.e, (list_inner_product(c.x, c.x) - 2 * list_inner_product(c.x, b.x) + list_inner_product(b.x, b.x))::BIGINT AS d FROM cut c JOIN b{i} b USING (p)) GROUP BY r, p)")
        if i < rounds:
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT a.p, a.m.e AS e, {mean} AS x FROM a{i} a GROUP BY a.p, a.m.e) n USING (p, e))")
    return f"""WITH {', '.join(steps)}, coded AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), book"""


ORACLE = oracle()
