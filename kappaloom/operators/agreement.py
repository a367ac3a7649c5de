"""Agreement of two label-and-span annotations of the same items.

Frames have the columns gold, pred, gold_start, gold_end, pred_start, pred_end: labels
and inclusive token bounds, null where there is no span. Every metric is a
conditional aggregate, so any number of them is one pass with partial sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.labels import LABELS, NEUTRAL


@dataclass(frozen=True)
class Policy:
    """Choices in which published scorers differ.

    eligible: "both" scores spans where both sides are not neutral, "same" where
    they also agree. chance_one: kappa where the expected agreement is 1: "one" gives 1, "zero" 0, "nan" NaN,
    "exact" 1 if the agreement is 1 and else NaN, "raise" 1 if the agreement is 1 and else an error.
    """

    eligible: str = "both"
    chance_one: str = "exact"


def scored(df: DataFrame) -> DataFrame:
    """Adds token_f1, iou and exact."""
    found = spans.scores(F.col("gold_start"), F.col("gold_end"), F.col("pred_start"), F.col("pred_end"))
    return df.withColumn("_s", found).select("*", "_s.token_f1", "_s.iou", "_s.exact").drop("_s")


def eligible(policy: Policy) -> Column:
    both = (F.col("gold") != NEUTRAL) & (F.col("pred") != NEUTRAL)
    return both if policy.eligible == "both" else both & (F.col("gold") == F.col("pred"))


def accuracy() -> Column:
    """Null for no rows."""
    return F.try_divide(F.count_if(F.col("gold") == F.col("pred")).cast("double"), F.count("*"))


def _counted(weight: Column | None) -> tuple[Column, Callable[[Column], Column]]:
    """The number of rows, and of those for which something holds; each row counts as often as its weight says."""
    if weight is None:
        return F.count("*"), F.count_if
    return F.sum(weight), lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0))


def kappa(policy: Policy = Policy(), weight: Column | None = None) -> Column:
    """Cohen's kappa over the fixed labels."""
    all_, number = _counted(weight)
    n = F.nullif(all_, F.lit(0)).cast("double")
    observed = number(F.col("gold") == F.col("pred")) / n
    chance = sum((number(F.col("gold") == x) / n * (number(F.col("pred") == x) / n) for x in LABELS), F.lit(0.0))
    nan, one = F.lit(float("nan")), F.lit(1.0)
    undefined = F.raise_error(F.lit("kappa is undefined: the expected agreement is 1")).cast("double")
    at_one = {"one": one, "zero": F.lit(0.0), "nan": nan, "exact": F.when(observed == 1.0, one).otherwise(nan), "raise": F.when(observed == 1.0, one).otherwise(undefined)}[policy.chance_one]
    return F.when(chance == 1.0, at_one).otherwise(F.try_divide(observed - chance, 1 - chance))


def weighted_accuracy(pred: str, weight: Column) -> Column:
    all_, number = _counted(weight)
    return number(F.col("gold") == F.col(pred)) / all_


def weighted_macro_f1(pred: str, weight: Column) -> Column:
    """The mean of the labels' F1, each 0 where it has no denominator, of rows with weights."""
    _, number = _counted(weight)
    f1 = []
    for x in LABELS:
        both, either = number((F.col("gold") == x) & (F.col(pred) == x)), number(F.col("gold") == x) + number(F.col(pred) == x)
        f1.append(F.coalesce(F.try_divide(2.0 * both, either), F.lit(0.0)))
    return sum(f1, F.lit(0.0)) / len(LABELS)


def rationale(policy: Policy, suffix: str = "") -> list[Column]:
    """Number of eligible spans, and the means of their scores (null without any)."""
    ok = eligible(policy)
    return [
        F.count_if(ok).alias(f"s_span{suffix}"),
        F.avg(F.when(ok, F.col("token_f1"))).alias(f"token_f1{suffix}"),
        F.avg(F.when(ok, F.col("iou"))).alias(f"iou{suffix}"),
        F.avg(F.when(ok, F.col("exact").cast("double"))).alias(f"exact{suffix}"),
    ]


def joint(least_iou: float = 0.5) -> list[Column]:
    """Shares of all items that are right in label and span: by overlap, and exactly. Two neutrals are right."""
    neutral = (F.col("gold") == NEUTRAL) & (F.col("pred") == NEUTRAL)
    same = (F.col("gold") == F.col("pred")) & (F.col("gold") != NEUTRAL)
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return [share(neutral | same & (F.col("iou") >= least_iou)).alias("joint_iou"), share(neutral | same & F.col("exact")).alias("joint_exact")]


def neutral_absence() -> Column:
    """Of gold neutrals, the share that is predicted neutral without a span; null without any."""
    gold = F.col("gold") == NEUTRAL
    right = gold & (F.col("pred") == NEUTRAL) & F.col("pred_start").isNull() & F.col("pred_end").isNull()
    return F.try_divide(F.count_if(right).cast("double"), F.count_if(gold))


def summary(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """All metrics in one aggregate, for the whole frame or by keys."""
    measures = [F.count("*").alias("n"), accuracy().alias("accuracy"), kappa().alias("kappa"), *rationale(Policy("both"), "_both"), *rationale(Policy("same"), "_same"), *joint(), neutral_absence().alias("neutral_absence")]
    return scored(df).groupBy(*keys).agg(*measures)


def confusion(df: DataFrame) -> DataFrame:
    """A row for every gold label of the fixed set, a column for every predicted one; zeros where nothing is."""
    counted = df.groupBy("gold").pivot("pred", list(LABELS)).agg(F.count(F.lit(1)))
    full = df.sparkSession.createDataFrame([(x,) for x in LABELS], "gold string")
    return full.join(counted, "gold", "left").na.fill(0, list(LABELS))


def per_class(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, label, support, tp, fp, fn, precision, recall, f1); a ratio without a denominator is 0."""
    counts = [F.count_if(c).alias(f"{x}_{name}") for x in LABELS for name, c in (("tp", (F.col("gold") == x) & (F.col("pred") == x)), ("fp", (F.col("gold") != x) & (F.col("pred") == x)), ("fn", (F.col("gold") == x) & (F.col("pred") != x)))]
    wide = df.groupBy(*keys).agg(*counts)
    rows = wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("label"), *[F.col(f"{x}_{n}").alias(n) for n in ("tp", "fp", "fn")]) for x in LABELS])).alias("r")).select(*keys, "r.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select("*", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def averaged(classes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Macro and support-weighted means of per_class(), and the balanced accuracy."""
    names = ("precision", "recall", "f1")
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(x) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(f"weighted_{x}") for x in names]
    return classes.groupBy(*keys).agg(*[F.avg(x).alias(f"macro_{x}") for x in names], *weighted, F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))


def eligible_ids(df: DataFrame, id_column: str = "id", policy: Policy = Policy()) -> DataFrame:
    """(id, token_f1, iou, exact) of the rows whose spans count."""
    return scored(df).where(eligible(policy)).select(id_column, "token_f1", "iou", "exact")


def neutral_disagreements(df: DataFrame) -> DataFrame:
    """One row: neutral on one side alone, by side, and neutral on both with a span on the predicted side."""
    gold, pred = F.col("gold") == NEUTRAL, F.col("pred") == NEUTRAL
    span = F.col("pred_start").isNotNull() | F.col("pred_end").isNotNull()
    return df.agg(F.count_if(gold & ~pred).alias("gold_neutral_only"), F.count_if(~gold & pred).alias("pred_neutral_only"), F.count_if(gold & pred & span).alias("neutral_with_span"))


def written_confusion(df: DataFrame, path: str) -> None:
    """confusion() as one CSV file in the labels' order, with a header whose first cell is empty of a label."""
    from ..sources.files import write_csv

    at = F.array_position(F.array(*map(F.lit, LABELS)), F.col("gold"))
    write_csv([confusion(df).orderBy(at).coalesce(1)], path)


def disagreements(df: DataFrame) -> DataFrame:
    """The rows whose label differs or whose span is not the same, with both verdicts."""
    return scored(df).withColumn("label_agreement", F.col("gold") == F.col("pred")).where(~F.col("label_agreement") | ~F.col("exact"))


def transitions(df: DataFrame, first: str, second: str) -> DataFrame:
    """(transition, changed, n): how two systems' predictions of the same items go from right to wrong and back."""
    right1, right2 = F.col(first) == F.col("gold"), F.col(second) == F.col("gold")
    name = F.when(right1 & right2, "both_right").when(right1, "right_then_wrong").when(right2, "wrong_then_right").otherwise("both_wrong")
    return df.groupBy(name.alias("transition"), (F.col(first) != F.col(second)).alias("changed")).agg(F.count("*").alias("n"))


def label_distribution(df: DataFrame, label: str = "gold") -> DataFrame:
    """(label, n, share), labels that do not occur included."""
    total = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    full = df.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    joined = full.join(total, "label", "left").na.fill(0, ["n"])
    return joined.join(joined.agg(F.sum("n").alias("all"))).select("label", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("all")), F.lit(0.0)).alias("share"))
