"""Resampling: percentile intervals of bootstraps and permutation tests, without the draws.

Rows are reduced to the kinds that a measure can tell apart, once, and a replicate is a count for each kind. How often
n draws hit each kind is drawn itself: the kinds in their order are halved, a binomial number says how many draws go to the first half, and
so on down a tree whose leaves are the kinds. A shuffled table is found in the same way from its margins, with hypergeometric numbers. All of
them are exact inverses at hashes of seed, replicate and place in the tree, so that replicates are independent rows that run in parallel
and repeat exactly, and no row of the data is multiplied. For a generator's own sequence, see `sequential_bootstrap`.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..functions.numeric import binomial, hypergeometric
from ..operators import agreement
from ..sources.shared import settled


def _replicated(rows: DataFrame, reps: int) -> DataFrame:
    """rows for every replicate rep, dealt to as many tasks as there are, since each is much work."""
    tasks = min(reps, max(1, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).repartition(tasks, "rep")


def drawn(df: DataFrame, cells: list[str], reps: int, seed: int | str, strata: list[str] | None = None) -> DataFrame:
    """(rep, strata, cells, c): how often each replicate draws the rows of each kind, as many draws as there are rows, within strata if given.

    Kinds are ranked in the order of their cells in each stratum; the node of a level are the ranks that agree but for their last bits. A kind that is not drawn has no row.
    """
    strata = strata or []
    order = Window.partitionBy(*strata).orderBy(*cells)  # a row a kind
    counts = df.groupBy(*dict.fromkeys([*strata, *cells])).agg(F.count("*").alias("_c"))
    ranked = counts.select(F.to_json(F.struct(*strata) if strata else F.struct(F.lit(0).alias("_"))).alias("_s"), F.struct(*dict.fromkeys([*strata, *cells])).alias("_kind"), "_c", (F.row_number().over(order) - 1).cast("long").alias("_rank"))
    kinds, small = settled(ranked, "kinds")
    most = kinds.agg(F.max("_rank")).first()[0]
    tables = kinds.groupBy("_s").agg(F.sum("_c").alias("_n"), F.first("_kind").alias("_kind"))
    rows = _replicated(tables.select("_s", "_n", F.lit(0).cast("long").alias("_node"), *[F.col(f"_kind.{x}").cast("string").alias(f"_s{i}") for i, x in enumerate(strata)]), reps)
    for bit in range((most or 0).bit_length() - 1, -1, -1):
        # a node's weight, and that of its first half
        halves = kinds.groupBy("_s", F.shiftright("_rank", bit + 1).alias("_node")).agg(F.sum("_c").alias("_w"), F.sum(F.when(F.shiftright("_rank", bit) % 2 == 0, F.col("_c")).otherwise(F.lit(0).cast("long"))).alias("_l"))
        u = uniform(seed, *[F.col(f"_s{i}") for i in range(len(strata))], F.col("rep"), bit, F.col("_node"))
        # a replicate's rows stay where they are if the tree is small; else they go to its nodes
        split = rows.join(F.broadcast(halves) if small else halves, ["_s", "_node"]).withColumn("_first", binomial(F.col("_n"), F.col("_l"), F.col("_w"), u))
        sides = F.explode(F.array(*[F.struct((F.col("_node") * 2 + i).alias("node"), n.alias("n")) for i, n in enumerate((F.col("_first"), F.col("_n") - F.col("_first")))]))
        kept = [c for c in rows.columns if c not in ("_node", "_n")]
        rows = split.select(*kept, sides.alias("_side")).select(*kept, F.col("_side.node").alias("_node"), F.col("_side.n").alias("_n")).where("_n > 0")
    leaves = kinds.select("_s", F.col("_rank").alias("_node"), "_kind")
    met = rows.join(F.broadcast(leaves) if small else leaves, ["_s", "_node"])
    return met.select("rep", *[F.col(f"_kind.{x}").alias(x) for x in dict.fromkeys([*strata, *cells])], F.col("_n").alias("c"))


def interval(replicates: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: the linear percentiles of a value over replicates; NaN and null are left out."""
    sound = F.when(~F.isnan(value), F.col(value))
    return replicates.agg(F.percentile(sound, F.lit(low)).alias("low"), F.percentile(sound, F.lit(high)).alias("high"))


def bootstrap_kappa(df: DataFrame, reps: int, seed: int | str, strata: list[str] | None = None) -> DataFrame:
    """(low, high) of kappa; rows are reduced to the cells of the table of labels."""
    replicates = drawn(df, ["gold", "pred"], reps, seed, strata)
    return interval(replicates.groupBy("rep").agg(agreement.kappa(weight=F.col("c")).alias("_v")), "_v")


def bootstrap_mean(df: DataFrame, value: str, reps: int, seed: int | str) -> DataFrame:
    """(low, high) of the mean of a column; rows are reduced to its values."""
    return interval(drawn(df, [value], reps, seed).groupBy("rep").agg((F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("_v")), "_v")


def _signs(replicates: DataFrame, names: list[str]) -> DataFrame:
    """(measure, low, high, above, below) of differences, one column a measure: linear percentiles, and the shares of replicates on each side of 0."""
    rows = replicates.select(F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).alias("d")) for x in names])).alias("r")).select("r.*")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.groupBy("measure").agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"), share(F.col("d") > 0).alias("above"), share(F.col("d") < 0).alias("below"))


def paired_deltas(df: DataFrame, reps: int, seed: int | str) -> DataFrame:
    """(measure, low, high, above, below): accuracy, macro F1 and joint success of the second system less the first's, over shared draws.

    df: gold, pred, pred2, and joint and joint2, which tell by 0 and 1 whether a system is right in label and span.
    """
    c = F.col("c")
    cells = drawn(df, ["gold", "pred", "pred2", "joint", "joint2"], reps, seed)
    mean = lambda x: F.sum(F.col(x) * c) / F.sum(c)
    accuracy = agreement.weighted_accuracy("pred2", c) - agreement.weighted_accuracy("pred", c)
    f1 = agreement.weighted_macro_f1("pred2", c) - agreement.weighted_macro_f1("pred", c)
    replicates = cells.groupBy("rep").agg(accuracy.alias("accuracy"), f1.alias("macro_f1"), (mean("joint2") - mean("joint")).alias("joint"))
    return _signs(replicates, ["accuracy", "macro_f1", "joint"])


def cluster_bootstrap(df: DataFrame, clusters: list[str], value: Column, reps: int, seed: int | str) -> DataFrame:
    """(low, high) of the ratio of sums over clusters drawn whole; clusters are summed first, and those of equal sums and sizes are one kind."""
    summed = df.groupBy(*clusters).agg(F.sum(value).alias("_s1"), F.count("*").alias("_s2"))
    return interval(_ratios(summed, reps, seed, "_v"), "_v")


def _ratios(summed: DataFrame, reps: int, seed: int | str, to: str) -> DataFrame:
    """For every replicate of the clusters (_s1, _s2) the ratio of both sums."""
    return drawn(summed, ["_s1", "_s2"], reps, seed).groupBy("rep").agg((F.sum(F.col("_s1") * F.col("c")) / F.sum(F.col("_s2") * F.col("c"))).alias(to))


def paired_cluster_deltas(df: DataFrame, clusters: list[str], reps: int, seed: int | str) -> DataFrame:
    """(measure, low, high, above, below) of the accuracy of pred2 less that of pred, over clusters drawn whole: the sum of their differences by that of their sizes."""
    right = lambda x: F.count_if(F.col(x) == F.col("gold"))
    summed = df.groupBy(*clusters).agg((right("pred2") - right("pred")).alias("_s1"), F.count("*").alias("_s2"))
    return _signs(_ratios(summed, reps, seed, "accuracy"), ["accuracy"])


def chi_square(df: DataFrame, group: str, label: str) -> DataFrame:
    """(n, groups, labels, chi2, cramers_v) of a contingency table; cells that expect nothing are left out."""
    return _chi_square(df.groupBy(group, label).agg(F.count("*").alias("o")), group, label)


def _chi_square(cells: DataFrame, group: str, label: str) -> DataFrame:
    rows, columns = cells.groupBy(group).agg(F.sum("o").alias("r")), cells.groupBy(label).agg(F.sum("o").alias("c"))
    # observed cells give sum(o**2 / e) - n; the cells that are not observed add nothing to it
    total = cells.agg(F.sum("o").alias("n"), F.count_distinct(group).alias("groups"), F.count_distinct(label).alias("labels"))
    joined = cells.join(rows, group).join(columns, label).agg(F.sum(F.col("o").cast("double") * F.col("o") / F.col("r") / F.col("c")).alias("s"))
    chi = total.join(joined).withColumn("chi2", F.col("n") * (F.col("s") - 1))
    return chi.select("n", "groups", "labels", "chi2", F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("groups", "labels") - 1))).alias("cramers_v"))


def shuffled_tables(cells: DataFrame, group: str, label: str, reps: int, seed: int | str) -> DataFrame:
    """(rep, group, label, o): the tables that shuffled labels make of cells (group, label, o), cells of 0 left out.

    Groups are halved as in drawn(). The first half has as many rows as its margins say; how many of each label is drawn label by label from those of the whole node,
    the rest is the second half's. A node is a row with a count for each label, of which there are few: they come to the driver.
    """
    names = [r[0] for r in cells.select(label).distinct().orderBy(label).collect()]
    ranked = cells.groupBy(group).agg(F.sum("o").alias("_r")).withColumn("_rank", (F.row_number().over(Window.orderBy(group)) - 1).cast("long"))
    sizes, small = settled(ranked, "groups")  # a row a group
    most = sizes.agg(F.max("_rank")).first()[0]
    of = [F.coalesce(F.sum(F.when(F.col(label).eqNullSafe(F.lit(x)), F.col("o"))), F.lit(0).cast("long")).alias(f"_v{j}") for j, x in enumerate(names)]
    rows = _replicated(cells.agg(F.lit(0).cast("long").alias("_node"), *of), reps)
    vector = [f"_v{j}" for j in range(len(names))]
    for bit in range((most or 0).bit_length() - 1, -1, -1):
        halves = sizes.groupBy(F.shiftright("_rank", bit + 1).alias("_node")).agg(F.sum(F.when(F.shiftright("_rank", bit) % 2 == 0, F.col("_r")).otherwise(F.lit(0).cast("long"))).alias("_left"))
        split = rows.join(F.broadcast(halves) if small else halves, "_node").withColumn("_whole", sum((F.col(v) for v in vector), F.lit(0).cast("long")))
        for j, v in enumerate(vector):
            # the last label has what is left
            drawn_ = hypergeometric(F.col("_whole"), F.col(v), F.col("_left"), uniform(seed, F.col("rep"), bit, F.col("_node"), j)) if j < len(vector) - 1 else F.col("_left")
            split = split.withColumn(f"_x{j}", drawn_).withColumn("_left", F.col("_left") - F.col(f"_x{j}")).withColumn("_whole", F.col("_whole") - F.col(v))
        first = F.struct((F.col("_node") * 2).alias("_node"), *[F.col(f"_x{j}").alias(v) for j, v in enumerate(vector)])
        second = F.struct((F.col("_node") * 2 + 1).alias("_node"), *[(F.col(v) - F.col(f"_x{j}")).alias(v) for j, v in enumerate(vector)])
        rows = split.select("rep", F.explode(F.array(first, second)).alias("_side")).select("rep", "_side.*")
        rows = rows.where(" + ".join(vector) + " > 0")
    leaves = sizes.select(F.col("_rank").alias("_node"), group)
    told = rows.join(F.broadcast(leaves) if small else leaves, "_node")
    cell = F.explode(F.array(*[F.struct(F.lit(x).alias(label), F.col(v).alias("o")) for x, v in zip(names, vector, strict=True)]))
    return told.select("rep", group, cell.alias("_cell")).select("rep", group, "_cell.*").where("o > 0")


def permutation_p(df: DataFrame, group: str, label: str, reps: int, seed: int | str) -> DataFrame:
    """(chi2, exceed, p): how often shuffled labels reach the table's chi-square; p counts the table itself."""
    cells, _ = settled(df.groupBy(group, label).agg(F.count("*").alias("o")), "cells")
    margin_r, margin_c = cells.groupBy(group).agg(F.sum("o").alias("r")), cells.groupBy(label).agg(F.sum("o").alias("c"))
    met = shuffled_tables(cells, group, label, reps, seed)
    sums = met.join(margin_r, group).join(margin_c, label).groupBy("rep").agg(F.sum(F.col("o").cast("double") * F.col("o") / F.col("r") / F.col("c")).alias("s"))
    seen = _chi_square(cells, group, label).select("n", "chi2")
    exceed = sums.join(F.broadcast(seen)).withColumn("x", F.col("n") * (F.col("s") - 1)).agg(F.max("chi2").alias("chi2"), F.count_if(F.round("x", 9) >= F.round("chi2", 9)).alias("exceed"))  # one row
    return exceed.select("chi2", "exceed", ((F.col("exceed") + 1) / (reps + 1)).alias("p"))


def sequential_bootstrap(df: DataFrame, value: str, order: str, reps: int, seed: int) -> DataFrame:
    """(low, high) of the mean with draws from one sequential generator, as a single-process script makes them: one task for a published, small table."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        values, rng = part.sort_values(order)[value].tolist(), random.Random(seed)
        n = len(values)
        means = sorted(sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(reps))

        def at(q: float) -> float:
            x = q * (reps - 1)
            i = int(x)
            return means[i] + (means[min(i + 1, reps - 1)] - means[i]) * (x - i)

        return pd.DataFrame({"low": [at(0.025)], "high": [at(0.975)]})

    return df.select(value, order, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "low double, high double")
