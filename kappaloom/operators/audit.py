"""Counterfactual audits and comparisons: flips by case, breakdowns, seeds, baselines, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flagged(df: DataFrame) -> DataFrame:
    """Adds the 0/1 columns flip, harmful and beneficial to rows with gold, base_pred and variant_pred."""
    one = lambda c: c.cast("int")
    base, after = F.col("base_pred") == F.col("gold"), F.col("variant_pred") == F.col("gold")
    return df.withColumns({"flip": one(F.col("base_pred") != F.col("variant_pred")), "harmful": one(base & ~after), "beneficial": one(~base & after)})


def case_rates(df: DataFrame, keys: tuple[str, ...] = (), case: str = "base_id") -> DataFrame:
    """Means over cases of each case's rates: a case counts once, however many variants it has."""
    cases = df.groupBy(case, *keys).agg(F.avg("flip").alias("f"), F.avg("harmful").alias("h"), F.avg("beneficial").alias("b"), (1 - F.max("flip")).alias("c"))
    return cases.groupBy(*keys).agg(F.count("*").alias("cases"), F.avg("f").alias("flip_rate"), F.avg("h").alias("harmful_rate"), F.avg("b").alias("beneficial_rate"), F.avg("c").alias("consistent"))


def breakdowns(df: DataFrame, *keys: str) -> DataFrame:
    """Rates overall and by each key alone: one pass of grouping sets; the keys that a row is not grouped by are null."""
    measures = (F.count("*").alias("pairs"), F.sum("flip").alias("flips"), *[F.avg(x).alias(f"{x}_rate") for x in ("flip", "harmful", "beneficial")])
    return df.groupingSets([[], *[[F.col(k)] for k in keys]], *[F.col(k) for k in keys]).agg(*measures)


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Means of the groups' rates."""
    groups = df.groupBy(key).agg(F.avg("flip").alias("f"), F.avg("harmful").alias("h"))
    return groups.agg(F.avg("f").alias("balanced_flip_rate"), F.avg("h").alias("balanced_harmful_rate"))


def stability(df: DataFrame, case: str) -> DataFrame:
    """Over all runs of a case: how many flip in any, are harmed in any, and the share that is stable in all."""
    cases = df.groupBy(case).agg(F.max("flip").alias("f"), F.max("harmful").alias("h"))
    return cases.agg(F.count("*").alias("pairs"), F.sum("f").alias("any_flip"), F.sum("h").alias("any_harmful"), F.avg(1 - F.col("f")).alias("stable_share"))


def over_seeds(df: DataFrame, seed: str, value: str, single_std: float | None = 0.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, sample deviation (single_std for one seed), least, most and the values in seed order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(seed, value))), lambda x: x[value])
    return df.groupBy(*keys).agg(F.count("*").alias("seeds"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(single_std)).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"), listed.alias("vals"))


def condition_delta(df: DataFrame, first: str, second: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy of the second system less that of the first, and whether both use the same labels."""
    right = lambda x: F.count_if(F.col(x) == F.col("gold")) / F.count("*")
    used = lambda x: F.array_sort(F.collect_set(x))
    return df.groupBy(*keys).agg((right(second) - right(first)).alias("accuracy_delta"), (used(first) == used(second)).alias("same_labels"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def over_baselines(df: DataFrame, key: str) -> DataFrame:
    """Accuracy by key against always guessing the most frequent label, and against a third."""
    counts = df.groupBy(key, "gold").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("r"))
    by_key = counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum("r").alias("right"), F.max("n").alias("most"))
    accuracy, majority = F.col("right") / F.col("total"), F.col("most") / F.col("total")
    return by_key.select(key, F.col("total").alias("n"), accuracy.alias("accuracy"), majority.alias("majority"), (accuracy - majority).alias("over_majority"), (accuracy - F.lit(1.0) / 3).alias("over_uniform"))


def over_windows(df: DataFrame, instance: str, window: str, probabilities: str, classes: int = 3) -> DataFrame:
    """(instance, label_index from 1, span_window): the class of the highest mean probability over an instance's windows, and the window where it is highest.

    Probabilities are compared at nine places; ties go to the first class and window.
    """
    p = [F.element_at(probabilities, i + 1) for i in range(classes)]
    group = Window.partitionBy(instance)
    means = F.array(*[F.round(F.avg(x).over(group), 9) for x in p])
    rows = df.withColumn("_m", means).withColumn("label_index", F.array_position("_m", F.array_max("_m")).cast("int"))
    best = F.struct((-F.round(F.element_at(probabilities, F.col("label_index")), 9)).alias("p"), F.col(window).alias("w"))
    return rows.groupBy(instance, "label_index").agg(F.min(best)["w"].cast("long").alias("span_window"))


def over_scored_windows(df: DataFrame, instance: str, window: str, probabilities: str, score: str, first: str, last: str, neutral: int, classes: int = 3) -> DataFrame:
    """(instance, label_index from 1, span_window, first, last): the class of the first window's highest probability, and the span of the window whose span scores highest.

    The label is an instance's, so each of its windows has the same probabilities. The index `neutral` has no span. Scores are compared at nine
    places; ties go to the first window.
    """
    p = F.array(*[F.round(F.element_at(probabilities, i + 1), 9) for i in range(classes)])
    label = F.array_position(p, F.array_max(p)).cast("int")
    best = F.min(F.struct((-F.round(score, 9)).alias("s"), F.col(window).alias("w"), F.col(first).alias("a"), F.col(last).alias("b")))
    rows = df.groupBy(instance).agg(F.min(F.struct(F.col(window).alias("w"), label.alias("l")))["l"].alias("label_index"), best.alias("best"))
    span = lambda c: F.when(F.col("label_index") != neutral, F.col(f"best.{c}")).cast("long")
    return rows.select(instance, "label_index", span("w").alias("span_window"), span("a").alias(first), span("b").alias(last))
