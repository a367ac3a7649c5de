"""Validation as columns: every rule yields a code, a row has the array of those it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import LABELS, NEUTRAL


def annotation_faults(label: Column, start: Column, end: Column, id_: Column, least_start: int = 0) -> Column:
    """Codes of an annotation's faults, in a fixed order: id, label, neutral_span, missing_span, start, order."""
    blank = id_.isNull() | (F.trim(id_) == "")
    unknown = label.isNull() | ~label.isin(*LABELS)
    neutral = label == NEUTRAL
    rules = {
        "id": blank,
        "label": unknown,
        "neutral_span": neutral & (start.isNotNull() | end.isNotNull()),
        "missing_span": ~unknown & ~neutral & (start.isNull() | end.isNull()),
        "start": start < least_start,
        "order": end < start,
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))


def with_repeats(df: DataFrame, id_column: str, faults: str = "faults") -> DataFrame:
    """Adds the code repeated to rows whose id another row has too. Ids are counted by partial sums and joined back, so that a very frequent one is no task's work."""
    many = df.groupBy(id_column).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(id_column).alias("_many"))
    return df.join(many, F.col(id_column) == F.col("_many"), "left").withColumn(faults, F.when(F.col("_many").isNotNull(), F.array_append(faults, F.lit("repeated"))).otherwise(F.col(faults))).drop("_many")


def strict_integer_object(raw: Column, key: str, most: int) -> Column:
    """The integer under the only key of a JSON object, null unless it is a plain integer from 1 to most.

    8.0, "8" and true are no integers: the reader gives null for each.
    """
    parsed = F.from_json(raw, f"{key} bigint", {"mode": "PERMISSIVE"})[key]
    return F.when(F.json_object_keys(raw) == F.array(F.lit(key)), F.when(parsed.between(1, most), parsed))


def lax_integer(raw: Column, mode: str = "whole") -> Column:
    """The integer that a JSON scalar in text form stands for, null if none.

    mode "json": a JSON integer alone. "whole": 8.0 and "8" as well, 8.5 not. "truncate": as int() of the value, so 8.5 is 8.
    Booleans and nulls are none in any mode.
    """
    text = F.trim(raw)
    quoted = F.regexp_extract(text, r'^"\s*([+-]?\d+)\s*"$', 1)
    integer = F.when(text.rlike(r"^-?(0|[1-9]\d*)$"), text.try_cast("long"))
    if mode == "json":
        return integer
    number = F.when(text.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), text.try_cast("double"))
    whole = F.when(F.lit(mode == "truncate") | (number == F.floor(number)), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).try_cast("long"))
    return F.coalesce(integer, whole, F.nullif(quoted, F.lit("")).try_cast("long"))


def prediction_faults(raw: Column, id_: Column, most: Column) -> Column:
    """Codes of what is wrong with a predicted JSON object of the keys id, label, start and end: json, keys, id, label, integers, bounds, neutral_span.

    The keys are these and no others; the id is echoed; the label is one of the fixed set after trimming and lower case; bounds are
    JSON integers with 1 <= start <= end <= most, or both null for a neutral.
    """
    keys = ("end", "id", "label", "start")
    names = F.json_object_keys(raw)
    known = F.when(names.isNotNull(), F.array_sort(names) == F.array(*map(F.lit, keys)))
    part = {k: F.get_json_object(raw, f"$.{k}") for k in keys}
    label = F.lower(F.trim(part["label"]))
    # a string's quotes are gone in its value, so the raw object is asked for them
    number = {k: F.when(~raw.rlike(rf'"{k}"\s*:\s*"'), lax_integer(part[k], "json")) for k in ("start", "end")}
    neutral, none = label == NEUTRAL, part["start"].isNull() & part["end"].isNull()
    whole = number["start"].isNotNull() & number["end"].isNotNull()
    sound = (number["start"] >= 1) & (number["start"] <= number["end"]) & (number["end"] <= most)
    rules = {
        "json": names.isNull(),
        "keys": ~known,
        "id": known & ~part["id"].eqNullSafe(id_.cast("string")),
        "label": known & ~F.coalesce(label.isin(*LABELS), F.lit(False)),
        "integers": known & ~neutral & ~whole,
        "bounds": known & ~neutral & whole & ~sound,
        "neutral_span": known & neutral & ~none,
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))


def forbidden_keys(raw: Column, forbidden: list[str]) -> Column:
    """Those keys of a JSON object that an input must not have."""
    return F.coalesce(F.array_intersect(F.json_object_keys(raw), F.array(*map(F.lit, forbidden))), F.array().cast("array<string>"))


def corpus_counts(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row: rows, distinct ids, blank texts."""
    return df.agg(F.count("*").alias("n"), F.count_distinct(id_column).alias("ids"), F.count_if(F.col(text_column).isNull() | (F.trim(text_column) == "")).alias("blank"))


def count_differences(df: DataFrame, label: str, expected: DataFrame, n: str = "n") -> DataFrame:
    """(label, n, expected, off): how many rows each label has against expected (label, n); the null label is the sum of all."""
    have = df.rollup(label).agg(F.count("*").alias("_have"), F.grouping(label).alias("_all")).where(F.col(label).isNotNull() | (F.col("_all") == 1))
    want = expected.rollup(label).agg(F.sum(n).alias("_want"), F.grouping(label).alias("_all")).where(F.col(label).isNotNull() | (F.col("_all") == 1))
    joined = have.alias("h").join(want.alias("w"), F.col(f"h.{label}").eqNullSafe(F.col(f"w.{label}")), "full_outer")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return joined.select(F.coalesce(f"h.{label}", f"w.{label}").alias(label), count("_have").alias("n"), count("_want").alias("expected"), (count("_have") - count("_want")).alias("off"))


def membership_faults(members: DataFrame, listed: DataFrame, id_column: str, split: str) -> DataFrame:
    """(fault, id, split): ids that are in a split and not listed for it, listed and not in it, or in several splits."""
    pair = lambda df: df.select(F.col(id_column).alias("id"), F.col(split).alias("split"))
    have, want = pair(members), pair(listed)
    several = have.distinct().groupBy("id").agg(F.count("*").alias("n"), F.min("split").alias("split")).where("n > 1")
    named = lambda name, df: df.select(F.lit(name).alias("fault"), "id", "split")
    return named("unlisted", have.exceptAll(want)).unionByName(named("absent", want.exceptAll(have))).unionByName(named("several", several))


def leaking(df: DataFrame, key: Column, split: str) -> DataFrame:
    """(key, splits, n): keys that stand in more than one split."""
    return df.groupBy(key.alias("key")).agg(F.count_distinct(split).alias("splits"), F.count("*").alias("n")).where("splits > 1")


def reference(root: Column, meta: Column) -> tuple[Column, Column]:
    """The first of two references that is not blank, and whether both are there and differ."""
    first, second = F.nullif(F.trim(root), F.lit("")), F.nullif(F.trim(meta), F.lit(""))
    return F.coalesce(first, second), F.coalesce(first != second, F.lit(False))


def manifest_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left, right, differs) of two manifests given as (key, value) rows, null-safe."""
    joined = left.withColumnRenamed("value", "left").join(right.withColumnRenamed("value", "right"), "key", "full_outer")
    return joined.select("key", "left", "right", (~F.col("left").eqNullSafe(F.col("right"))).alias("differs"))


def imbalance(df: DataFrame, group: str, label: str, least_rows: int = 20, least_ratio: float = 0.67) -> DataFrame:
    """(group, n, least, most, warned): groups of enough rows whose rarest label is too rare beside the commonest."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("c"))
    out = counts.groupBy(group).agg(F.sum("c").alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    return out.withColumn("warned", (F.col("n") >= least_rows) & (F.col("least") / F.col("most") < least_ratio))


def challenge_faults(official: DataFrame, bases: DataFrame, variants: DataFrame, key: str, variant: str, same: list[str], text: str, per_base: int = 4, decision: str | None = None) -> DataFrame:
    """(key, variant, fault): what is wrong with base cases and their counterfactuals, a row for each fault; variant is null for a base's.

    Columns are key, those in same, and text, in all frames; variants have `variant` too. A base must be a row of official, once, and agree with it in same and text: else unknown, repeated, or the name
    of the column. It must have per_base counterfactuals: else variants. A counterfactual must have a base, agree with it in same, and have a text, another one than the base:
    else unknown, the column's name, empty, or unchanged; with a column `decision`, that must be KEEP. Nulls agree with each other.
    """

    def beside(df: DataFrame, names: list[str]) -> DataFrame:
        # of a repeated case its least row counts
        return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*names)).alias("_of"))

    def told(df: DataFrame, rules: dict[str, Column], id_: Column) -> DataFrame:
        codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))
        return df.select(key, id_.alias(variant), F.explode(codes).alias("fault"))

    missing = F.col("_of").isNull()
    differs = lambda c: ~missing & ~F.col(c).eqNullSafe(F.col(f"_of.{c}"))
    none = F.lit(None).cast(dict(variants.dtypes)[variant])
    of_bases = told(bases.join(beside(official, [*same, text]), F.col(key) == F.col("_key"), "left"), {"unknown": missing} | {c: differs(c) for c in [*same, text]}, none)
    repeated = bases.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, none.alias(variant), F.lit("repeated").alias("fault"))
    counts = variants.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    number = bases.select(key).distinct().join(counts, F.col(key) == F.col("_key"), "left").where(F.coalesce("_n", F.lit(0)) != per_base).select(key, none.alias(variant), F.lit("variants").alias("fault"))
    empty = F.coalesce(F.trim(text) == "", F.lit(True))
    rules = {"unknown": missing} | {c: differs(c) for c in same} | {"empty": empty, "unchanged": ~missing & ~empty & F.col(text).eqNullSafe(F.col(f"_of.{text}"))}
    if decision is not None:
        rules["decision"] = ~F.col(decision).eqNullSafe(F.lit("KEEP"))
    of_variants = told(variants.join(beside(bases, [*same, text]), F.col(key) == F.col("_key"), "left"), rules, F.col(variant))
    return of_bases.unionByName(repeated).unionByName(number).unionByName(of_variants)
