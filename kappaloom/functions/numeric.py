"""Exact binomial tests, draws by inverse distribution functions, percentiles, largest remainders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: twice the lower tail of a fair binomial, at most 1; 1 if there is none.

    The terms' logarithms are carried, so that 2**-n does not vanish for many pairs.
    """
    n, k = (b + c).cast("double"), F.least(b, c)
    state = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i) / (i + 1))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long")), state, step, lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


#: Deviations, and steps beside, on both sides of the mode that are looked at: what lies beyond is less than a double can tell from 0.
_DEVIATIONS, _BESIDE = 9.0, 12


def _with(body: Callable[[Column], Column], **values: Column) -> Column:
    """body of a struct of values, each of which is computed once however often it is used."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def _inverse(u: Column, mode: Column, deviation: Column, least: Column, most: Column, up: Callable[[Column], Column]) -> Column:
    """How many outcomes have a distribution function of at most u, as the outcome itself; up(k) is the mass of k + 1 by that of k.

    The masses are carried from the mode, whose own is 1, down and up to where they vanish, and then added from below until they exceed u of them all.
    So the work grows with the deviation, not with the number of trials.
    """
    none = F.array().cast("array<long>")
    state = lambda f, s: F.struct(f.alias("f"), s.alias("s"))
    fall = lambda a, k: _with(lambda x: state(x["f"], a["s"] + x["f"]), f=a["f"] / up(k - 1))
    rise = lambda a, k: _with(lambda x: state(x["f"], a["s"] + x["f"]), f=a["f"] * up(k))
    begin = state(F.lit(1.0), F.lit(0.0))

    def step(a: Column, k: Column) -> Column:
        upto = a["c"] + a["f"]
        return F.struct((a["f"] * up(k)).alias("f"), upto.alias("c"), (a["n"] + F.when(upto <= a["b"], F.lit(1)).otherwise(F.lit(0))).cast("long").alias("n"), a["b"].alias("b"))

    def walk(r: Column) -> Column:
        low, high = r["low"], r["high"]
        below = F.aggregate(F.when(mode > low, F.sequence(mode, low + 1, F.lit(-1).cast("long"))).otherwise(none), begin, fall)
        above = F.aggregate(F.when(mode < high, F.sequence(mode, high - 1)).otherwise(none), begin, rise)
        first = lambda x: F.struct(x["below"]["f"].alias("f"), F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("n"), (u * (1 + x["below"]["s"] + x["above"])).alias("b"))
        return _with(lambda x: F.least(high, low + F.aggregate(F.sequence(low, high), first(x), step, lambda a: a["n"])), below=below, above=above["s"])

    reach = F.ceil(deviation * _DEVIATIONS + _BESIDE)
    return _with(walk, low=F.greatest(least, mode - reach).cast("long"), high=F.least(most, mode + reach).cast("long"))


def binomial(n: Column, part: Column, whole: Column, u: Column) -> Column:
    """The successes of n trials, each of which has part chances in whole, at u of the distribution function; all long but u."""
    share, rest = part.cast("double") / whole, (whole - part).cast("double") / whole
    drawn = _with(
        lambda x: _inverse(x["u"], x["mode"], x["deviation"], F.lit(0).cast("long"), x["n"], lambda k: (x["n"] - k) / (k + 1).cast("double") * x["odds"]),
        n=n,
        u=u,
        odds=part.cast("double") / (whole - part),
        mode=F.least(n, F.floor((n + 1) * share).cast("long")),
        deviation=F.sqrt(n * share * rest),
    )
    return F.when(part == 0, F.lit(0).cast("long")).when(part == whole, n).otherwise(drawn)


def hypergeometric(whole: Column, part: Column, n: Column, u: Column) -> Column:
    """How many of n things, drawn without replacement from whole, are among part of them, at u of the distribution function; all long but u."""
    least, most = F.greatest(F.lit(0).cast("long"), n + part - whole), F.least(n, part)
    share = part.cast("double") / whole
    drawn = _with(
        lambda x: _inverse(x["u"], x["mode"], x["deviation"], x["least"], x["most"], lambda k: (x["part"] - k).cast("double") * (x["n"] - k) / ((k + 1).cast("double") * (x["others"] - x["n"] + k + 1))),
        n=n,
        part=part,
        others=whole - part,
        u=u,
        least=least,
        most=most,
        mode=F.least(most, F.greatest(least, F.floor((n + 1).cast("double") * (part + 1) / (whole + 2)).cast("long"))),
        deviation=F.sqrt(n * share * (1 - share) * (whole - n) / F.greatest(F.lit(1).cast("long"), whole - 1)),
    )
    return F.when(least == most, least).otherwise(drawn)


def nearest_ranks(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """(keys, one column for each share): the value at round((n - 1) * p), halves to even, of each group.

    Values are counted first, so that a group is as large as its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_c").over(group.orderBy(value))).withColumn("_n", F.sum("_c").over(group))
    # the first value that more rows than the wanted index reach
    pick = lambda p: F.min(F.when(F.col("_upto") > F.bround((F.col("_n") - 1) * F.lit(p), 0), F.col(value)))
    return ranked.groupBy(*keys).agg(*[pick(p).alias(name) for name, p in shares.items()])


def largest_remainder(df: DataFrame, keys: list[str], total: str, part: str, ratio: tuple[str, str], order: str) -> DataFrame:
    """Adds `share`: total divided by the parts' ratios (numerator, denominator) in each group of keys.

    Everything is whole numbers: floors first, what is left to the largest
    remainders, ties by `order`. A part is one row of the group.
    """
    num, den = F.col(ratio[0]), F.col(ratio[1])
    group = Window.partitionBy(*keys)
    df = df.withColumn("_floor", F.expr(f"({total} * {ratio[0]}) DIV {ratio[1]}")).withColumn("_rest", (F.col(total) * num) % den)
    df = df.withColumn("_left", F.col(total) - F.sum("_floor").over(group))
    rank = F.row_number().over(group.orderBy(F.desc("_rest"), F.col(order)))
    return df.withColumn("share", F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).drop("_floor", "_rest", "_left")
