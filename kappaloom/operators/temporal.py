"""Joins of intervals that overlap, joins with the last earlier row, and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: int, hot: int = 100_000, parts: int = 64) -> DataFrame:
    """All pairs of rows of equal keys whose intervals of whole numbers, bounds included, share a number: the columns of left and those of right without the keys.

    Line is cut into bins of `width`; a row stands in each bin that its interval touches and meets the rows of the other side there. The larger of
    both starts lies in both intervals, and a pair is kept in its bin alone. A bin of one key with more than `hot` rows is cut into `parts` finer ones, and
    the rows there once more. Rows with a null key or bound meet none; one that ends before it starts does neither. The sides' other columns must have different names.
    """
    fine = max(1, -(-width // parts))

    def binned(df: DataFrame, bounds: tuple[str, str], side: str) -> DataFrame:
        a, b = (F.col(x).cast("long") for x in bounds)
        bins = F.sequence(F.floor(a / width), F.floor(b / width))
        return df.withColumns({f"_{side}0": a, f"_{side}1": b}).where(a <= b).withColumn("_bin", F.explode(bins))

    sides = [binned(left, left_bounds, "l"), binned(right, right_bounds, "r")]
    counts = [s.groupBy(*keys, "_bin").agg(F.count("*").alias("_n")) for s in sides]
    crowded = staged(counts[0].unionByName(counts[1]).groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n")).where(F.col("_n") > hot).select(*keys, "_bin", F.lit(True).alias("_hot")), "hot-bins")

    def cut(df: DataFrame, side: str) -> DataFrame:
        marked = df.join(crowded, [*keys, "_bin"], "left")
        low = F.floor(F.greatest(F.col(f"_{side}0"), F.col("_bin") * width) / fine)
        high = F.floor(F.least(F.col(f"_{side}1"), F.col("_bin") * width + width - 1) / fine)
        # a bin that is not crowded is one part, whose number no finer one has
        finer = F.when(F.col("_hot"), F.sequence(low, high)).otherwise(F.array(F.lit(None).cast("long")))
        return marked.withColumn("_part", F.explode(finer)).withColumn("_part", F.coalesce("_part", F.lit(-(1 << 62))))

    at = F.greatest("_l0", "_r0")
    first = F.when(F.col("_hot_"), F.col("_part") == F.floor(at / fine)).otherwise(F.lit(True)) & (F.col("_bin") == F.floor(at / width))
    met = cut(sides[0], "l").withColumnRenamed("_hot", "_hot_").join(cut(sides[1], "r").drop("_hot"), [*keys, "_bin", "_part"])
    kept = met.where((F.col("_l0") <= F.col("_r1")) & (F.col("_r0") <= F.col("_l1")) & first)
    return kept.select(*left.columns, *[c for c in right.columns if c not in keys])


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, tie: str, bucket: Column, time: str = "_time") -> DataFrame:
    """left with the columns of right's last row of the same keys whose time is not after left's, null where there is none.

    bucket, an expression of the column `time`, must not fall along time. Both sides are put in one order of time inside each key's buckets, where the last row of right is carried on;
    from bucket to bucket the last one of each is, so that a key with very many rows is many tasks' work. Of right's rows of one key and time the largest `tie` counts. Rows of
    left whose time is null have none. Right's columns other than the keys must have names of their own.
    """
    names = [c for c in right.columns if c not in keys]
    before = right.where(F.col(right_time).isNotNull())
    rows = left.select(*keys, F.col(left_time).alias(time), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[tie]).alias("_tie"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(before.select(F.struct(*names)).schema[0].dataType).alias("_right"))
    others = before.select(*keys, F.col(right_time).alias(time), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), F.struct(*names).alias("_right"))
    both = rows.unionByName(others).withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time, "_side", "_tie")
    last = F.last("_right", ignorenulls=True)
    near = both.withColumn("_near", last.over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_side = 1")
    # a row for each key and bucket
    ends = others.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(F.max_by("_right", F.struct(time, "_tie")).alias("_right"))
    asked = rows.where(F.col(time).isNotNull()).withColumn("_bucket", bucket).select(*keys, "_bucket").distinct()
    whole = asked.join(ends, [*keys, "_bucket"], "full_outer")
    carried = whole.select(*keys, "_bucket", last.over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    found = near.where(F.col(time).isNotNull()).join(carried, [*keys, "_bucket"], "left").select("_left", F.coalesce("_near", "_far").alias("_right"))
    found = found.unionByName(near.where(F.col(time).isNull()).select("_left", F.lit(None).cast(near.schema["_right"].dataType).alias("_right")))
    return found.select("_left.*", "_right.*")


def sessions(df: DataFrame, keys: list[str], time: str, gap: str, *measures: Column) -> DataFrame:
    """(keys, first, last, n, measures): runs of a key's rows in which each is at most `gap` after the one before. On a stream, set a watermark before."""
    grouped = df.groupBy(*keys, F.session_window(F.col(time), gap).alias("_w"))
    return grouped.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"), *measures).drop("_w")
