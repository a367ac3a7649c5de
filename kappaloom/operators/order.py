"""Positions, gaps between rows of a key, displacement, choices in hash order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..sources.shared import staged


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list[str], to: str) -> DataFrame:
    """Adds `to`: the rows' numbers from 0 in each key's order.

    bucket must not fall along the order. Rows are numbered inside a key's buckets, and buckets by running totals of
    their sizes, so that a key that has very many rows is no task's work.
    """
    df = df.withColumn("_part", bucket)
    sizes = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")  # one row a bucket
    starts = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), ahead.alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    same = F.col("_part").eqNullSafe(F.col("_p"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    placed = df.withColumn("_inside", inside).join(starts, same)
    return placed.withColumn(to, F.col("_ahead") + F.col("_inside")).drop("_part", "_p", "_ahead", "_inside", *[f"_k{i}" for i in range(len(keys))])


def hash_numbered(df: DataFrame, keys: list[str], hash_: Column, tie: str, to: str) -> DataFrame:
    """numbered() in the order of a hexadecimal hash, whose first digits are the buckets."""
    out = df.withColumn("_hash", hash_)
    return numbered(out, keys, F.substring("_hash", 1, 3), ["_hash", tie], to).drop("_hash")


def indexed(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """Adds `to`: every row's number from 0 in the whole order, without a task that sorts all rows.

    The ranges of a sorted table are written with their own numbers; the sizes of ranges put before each other make the whole ones.
    """
    at = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    at = at.withColumn("_range", F.shiftright("_at", 33))
    sizes = at.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))  # one row a range
    return at.join(starts, "_range").withColumn(to, F.col("_start") + F.col("_at") - F.shiftleft("_range", 33)).drop("_range", "_at", "_start")


def gaps(df: DataFrame, key: str, position: str) -> DataFrame:
    """Adds before and after: the distances to the key's previous and next row."""
    w = Window.partitionBy(key).orderBy(position)
    at = F.col(position)
    return df.withColumns({"before": at - F.lag(at).over(w), "after": F.lead(at).over(w) - at})


def nearest(df: DataFrame, key: str, position: str) -> DataFrame:
    """Adds nearest: the smaller of both distances, null for a key's only row."""
    return gaps(df, key, position).withColumn("nearest", F.least("before", "after"))


def shares_beyond(df: DataFrame, value: str, thresholds: list[int]) -> DataFrame:
    """(threshold, n, share): how many values reach each threshold, in one pass."""
    counts = df.agg(F.count("*").alias("all"), *[F.count_if(F.col(value) >= t).alias(f"t{t}") for t in thresholds])
    rows = F.explode(F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"t{t}").alias("n")) for t in thresholds]))
    return counts.select("all", rows.alias("r")).select("r.threshold", "r.n", F.coalesce(F.try_divide(F.col("r.n").cast("double"), F.col("all")), F.lit(0.0)).alias("share"))


def balanced_choice(df: DataFrame, label: str, id_column: str, target: int, seed: int | str) -> DataFrame:
    """As many rows of each label, first in hash order: the target, or what the rarest label has."""
    few = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.least(F.min("_n"), F.lit(target)).alias("_few"))
    ranked = hash_numbered(df, [label], order_key(seed, F.col(id_column)), id_column, "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.join(F.broadcast(few)).where("rank <= _few").drop("_few")


def replacements(items: DataFrame, pool: DataFrame, category: str, name: str, id_column: str, n: int, seed: int | str) -> DataFrame:
    """For each item n names of its category other than its own, first in hash order: (id, name, replacement, rank).

    pool: distinct (category, name).
    """
    met = items.join(pool.withColumnRenamed(name, "replacement"), category).where(F.col("replacement") != F.col(name))
    rank = F.row_number().over(Window.partitionBy(id_column).orderBy(order_key(seed, F.col(id_column), F.col("replacement")), "replacement"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= n).select(id_column, name, "replacement", "rank")


def best_span(starts: Column, ends: Column, most: int | None = None) -> Column:
    """struct(first, last, score), from 0: the span of highest start + end score, first <= last, at most so many tokens; earliest on ties.

    A fold keeps the best start so far, or with a limit looks at the last `most` starts.
    """
    if most is None:
        zero = F.expr("named_struct('s', CAST(NULL AS double), 'si', 0, 'best', CAST(NULL AS double), 'first', 0, 'last', 0, 'i', 0)")

        def step(a: Column, x: Column) -> Column:
            fresh = a["s"].isNull() | (x["s"] > a["s"])
            s, si = F.when(fresh, x["s"]).otherwise(a["s"]), F.when(fresh, a["i"]).otherwise(a["si"])
            won = a["best"].isNull() | (s + x["e"] > a["best"])
            pick = lambda new, old: F.when(won, new).otherwise(old)
            return F.struct(s.alias("s"), si.alias("si"), pick(s + x["e"], a["best"]).alias("best"), pick(si, a["first"]).alias("first"), pick(a["i"], a["last"]).alias("last"), (a["i"] + 1).alias("i"))

        pairs = F.zip_with(starts, ends, lambda s, e: F.struct(s.cast("double").alias("s"), e.cast("double").alias("e")))
        done = F.aggregate(pairs, zero, step)
        return F.struct(done["first"].alias("first"), done["last"].alias("last"), done["best"].alias("score"))
    spans = F.flatten(
        F.transform(
            starts,
            lambda s, i: F.transform(F.slice(ends, i + 1, F.lit(most)), lambda e, k: F.struct((-(s + e)).cast("double").alias("score"), i.alias("first"), (i + k).alias("last"))),
        )
    )
    least = F.array_min(spans)
    return F.struct(least["first"].alias("first"), least["last"].alias("last"), (-least["score"]).alias("score"))


def lots(df: DataFrame, key: str, id_column: str, size: int, seed: int | str, strict: bool = False) -> DataFrame:
    """Adds lot: no key twice in a lot, and lots of `size` rows, or one less where the rows do not fill all.

    Keys are laid out one after the other, largest first, and dealt round robin. A key of more rows than there are
    lots would have to repeat: then there are as many lots as it has rows, and lots are smaller; if strict, that is an error.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.max("_n").alias("_most"))
    count = F.greatest(F.lit(1), F.ceil(F.col("_all") / size))
    if strict:
        count = F.when(F.col("_most") <= count, count).otherwise(F.raise_error(F.lit("a key has more rows than there are lots")))
    whole = whole.select(F.greatest(count, F.col("_most")).alias("_lots"))
    starts = sizes.select(key, (F.sum("_n").over(Window.orderBy(F.desc("_n"), key)) - F.col("_n")).alias("_first"))  # one row a key
    inside = hash_numbered(df, [key], order_key(seed, F.col(id_column)), id_column, "_in")
    return inside.join(starts, key).join(F.broadcast(whole)).withColumn("lot", F.pmod(F.col("_first") + F.col("_in"), F.col("_lots")).cast("long")).drop("_in", "_first", "_lots")


def positions(df: DataFrame, bucket: str, order: list[str], key: str | None = None) -> DataFrame:
    """Adds pos, the row's number from 1 in the whole order, and pos_in_<part> with a key.

    bucket must not fall along the order: rows are numbered inside buckets and
    buckets by running totals, so that no task orders all rows.
    """
    totals = df.groupBy(bucket).agg(F.count("*").alias("_n"))
    starts = totals.select(bucket, (F.sum("_n").over(Window.orderBy(bucket)) - F.col("_n")).alias("_start"))  # one row a bucket
    out = df.withColumn("_i", F.row_number().over(Window.partitionBy(bucket).orderBy(*order))).join(starts, bucket)
    out = out.withColumn("pos", F.col("_start") + F.col("_i"))
    if key is None:
        return out.drop("_start", "_i")
    # a key's rows fall into the same buckets, which its own numbers go by
    to = f"pos_in_{key.split('_')[-1]}"
    return numbered(out.drop("_start", "_i"), [key], F.col(bucket), ["pos"], to).withColumn(to, F.col(to) + 1)


def hash_positions(df: DataFrame, id_column: str, seed: int | str) -> DataFrame:
    """Adds pos in the order of the hash of seed and id; the hash's first digits are the buckets."""
    hashed = df.drop("pos").withColumn("_h", order_key(seed, F.col(id_column))).withColumn("_b", F.substring("_h", 1, 2))
    return positions(hashed, "_b", ["_h", id_column]).drop("_h", "_b")


def spread(df: DataFrame, key: str, id_column: str, seed: int | str, buckets: int = 1024) -> DataFrame:
    """Adds pos, an order in which a key's rows are about evenly apart: the i-th of n stands near (i + u) / n of the whole, u by the key's hash."""
    inside = hash_numbered(df, [key], order_key(seed, F.col(id_column)), id_column, "_in")
    sizes = df.groupBy(key).agg(F.count("*").alias("_of"))
    shift = F.conv(F.substring(order_key(seed, F.col(key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    placed = inside.join(sizes, key).withColumn("_f", (F.col("_in") + shift) / F.col("_of")).withColumn("_b", F.floor(F.col("_f") * buckets))
    return positions(placed, "_b", ["_f", key, id_column]).drop("_in", "_of", "_f", "_b")


def widest_gap(counts: dict[str, int]) -> int:
    """The largest distance that every key's rows can keep in a sequence of all: with the m most frequent keys of n rows each, (all - m) // (n - 1); all if no key repeats."""
    total, most = sum(counts.values()), max(counts.values(), default=0)
    return total if most < 2 else (total - sum(n == most for n in counts.values())) // (most - 1)


def gap_schedule(df: DataFrame, key: str, id_column: str, seed: int | str) -> DataFrame:
    """Adds pos from 1: an order in which every two rows of a key are at least widest_gap() apart, as far as any order can keep all of them.

    The m most frequent keys, of n rows each, begin n frames, all in the same order. The other rows fill the columns behind them, down the n - 1
    frames before the last, one key after the other and the more frequent first. A key of n - 1 rows fills a column, and one of fewer that goes on in the next column has a whole
    frame between its ends, so that no frame is too short for a gap. Places are sums over the sizes of keys and over the keys of a size, in hash order; a key's rows
    take its places in hash order. Rows whose key is null are a key. Without a repeated key all orders do, and it is that of hashes.
    """
    counts = staged(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")), "gap-counts")
    sizes = counts.groupBy("_rows").agg(F.count("*").alias("_keys"))
    ahead = F.sum(F.col("_rows") * F.col("_keys")).over(Window.orderBy(F.desc("_rows"))) - F.col("_rows") * F.col("_keys")  # one row a size
    whole = sizes.agg(F.sum(F.col("_rows") * F.col("_keys")).alias("_all"), F.max("_rows").alias("_most"), F.max_by("_keys", "_rows").alias("_firsts"))
    ranked = hash_numbered(counts, ["_rows"], order_key(seed, F.col("_key")), "_key", "_rank").join(sizes.select("_rows", ahead.alias("_ahead")), "_rows")
    inside = hash_numbered(df, [key], order_key(seed, F.col(id_column)), id_column, "_i")
    rows = inside.join(ranked, F.col(key).eqNullSafe(F.col("_key"))).join(F.broadcast(whole))
    rows = rows.withColumn("_frames", F.greatest(F.col("_most") - 1, F.lit(1))).withColumn("_t", F.expr("_ahead + _rank * _rows + _i - _firsts * _most"))
    rows = rows.withColumn("_left", F.expr("_all - _firsts * _most"))
    rows = rows.withColumns({"_frame": F.expr("if(_rows = _most, _i, pmod(_t, _frames))"), "_column": F.expr("if(_rows = _most, _rank, _firsts + _t DIV _frames)")})
    begin = "if(_frame = _most - 1, _all - _firsts, _frame * (_firsts + _left DIV _frames) + least(_frame, _left % _frames))"
    at = rows.withColumn("pos", F.expr(f"{begin} + _column + 1"))
    return at.select(*df.columns, "pos")


def distinct_demos(df: DataFrame, label: str, reference: str, id_column: str, n: int, seed: int | str) -> DataFrame:
    """n rows of each label, first in hash order, no reference twice in a label."""
    h = order_key(seed, F.col(id_column))
    first = df.withColumn("_h", h).groupBy(label, reference).agg(F.min_by(F.struct(*df.columns, "_h"), F.struct("_h", id_column)).alias("r")).select("r.*")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", id_column))).where(F.col("_r") <= n).drop("_h", "_r")


def demo_round(df: DataFrame, label: str, reference: str, id_column: str, words: Column, n: int, seed: int | str, targets: DataFrame | None = None, most_words: int = 160) -> DataFrame:
    """(id, label, reference, rank): n rows of each label taken in turns, label by label, no reference twice at all.

    Rows of more than most_words words, and those whose id or reference targets (id, reference) has, are left out. In its turn a label takes its first row
    in hash order whose reference is free. A reference can be taken by one row of each label at most before it is gone, so a label's
    n-th row is among its first n * labels references: only these come to one task.
    """
    few = df.where(words <= most_words)
    if targets is not None:
        few = few.join(targets.select(id_column), id_column, "left_anti").join(targets.select(reference), reference, "left_anti")
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    ranked = distinct_demos(few.select(id_column, label, reference), label, reference, id_column, n * max(1, len(labels)), seed)
    ranked = ranked.select(id_column, label, reference, order_key(seed, F.col(id_column)).alias("h"))

    def take(part: pd.DataFrame) -> pd.DataFrame:
        queues = {x: rows.sort_values(["h", id_column]).to_dict("records") for x, rows in part.groupby(label)}
        used, out = set(), []
        for turn in range(n):
            for x in labels:
                row = next((r for r in queues.get(x, ()) if r[reference] not in used), None)
                if row is not None:
                    used.add(row[reference])
                    out.append((row[id_column], x, row[reference], turn + 1))
        return pd.DataFrame(out, columns=[id_column, label, reference, "rank"])

    kinds = dict(df.select(id_column, label, reference).dtypes)
    return ranked.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(take, f"{id_column} {kinds[id_column]}, {label} {kinds[label]}, {reference} {kinds[reference]}, rank long")
