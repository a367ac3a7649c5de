"""Queries on paired annotations: labels, spans, joint success, seeds, systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import agreement as ag
from ..operators import audit
from .bindings import PAIRED_SQL, SCORED_SQL, VARIANTS_SQL, paired, table, variants
from .registry import registered

LABEL_ROWS = "(VALUES ('entailment'), ('contradiction'), ('neutral')) AS l(label)"


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({x: F.round(x, places) for x in names})


def _measures(*keys: str) -> str:
    by = "".join(f"{k}, " for k in keys)
    shares = " + ".join(f"(count(*) FILTER (gold = '{x}') / count(*)::DOUBLE) * (count(*) FILTER (pred = '{x}') / count(*)::DOUBLE)" for x in labels.LABELS)
    return f"""
SELECT {by}count(*) AS n, round(count(*) FILTER (gold = pred) / count(*)::DOUBLE, 6) AS accuracy,
  round((count(*) FILTER (gold = pred) / count(*)::DOUBLE - ({shares})) / (1 - ({shares})), 6) AS kappa,
  count(*) FILTER (both_spans) AS s_span_both, round(avg(token_f1) FILTER (both_spans), 6) AS token_f1_both, round(avg(iou) FILTER (both_spans), 6) AS iou_both, round(avg(exact::INT) FILTER (both_spans), 6) AS exact_both,
  count(*) FILTER (same_spans) AS s_span_same, round(avg(token_f1) FILTER (same_spans), 6) AS token_f1_same, round(avg(iou) FILTER (same_spans), 6) AS iou_same, round(avg(exact::INT) FILTER (same_spans), 6) AS exact_same,
  round(avg((gold = pred AND (gold = 'neutral' OR iou >= 0.5))::INT), 6) AS joint_iou, round(avg((gold = pred AND (gold = 'neutral' OR exact))::INT), 6) AS joint_exact,
  round(count(*) FILTER (gold = 'neutral' AND pred = 'neutral' AND pred_start IS NULL) / count(*) FILTER (gold = 'neutral')::DOUBLE, 6) AS neutral_absence
FROM scored {'GROUP BY ' + ', '.join(keys) if keys else ''}"""


MEASURES = ("accuracy", "kappa", "token_f1_both", "iou_both", "exact_both", "token_f1_same", "iou_same", "exact_same", "joint_iou", "joint_exact", "neutral_absence")


@registered("agreement_summary", SCORED_SQL + _measures())
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.summary(paired(spark, sf_dir)), *MEASURES)


@registered("agreement_by_seed", SCORED_SQL + _measures("seed"))
def agreement_by_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.summary(paired(spark, sf_dir), ("seed",)), *MEASURES)


def systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both systems' predictions below each other; the second has no spans of its own and keeps the first one's."""
    both = paired(spark, sf_dir)
    return both.drop("pred2").withColumn("system", F.lit("first")).unionByName(both.withColumn("pred", F.col("pred2")).drop("pred2").withColumn("system", F.lit("second")))


SYSTEMS_SQL = SCORED_SQL + ", systems AS (SELECT id, gold, pred, 'first' AS system FROM paired UNION ALL SELECT id, gold, pred2, 'second' FROM paired)"


@registered(
    "system_comparison",
    SYSTEMS_SQL + " SELECT system, count(*) AS n, count(*) FILTER (gold = pred) AS n_right, round(count(*) FILTER (gold = pred) / count(*)::DOUBLE, 6) AS accuracy FROM systems GROUP BY system",
)
def system_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(systems(spark, sf_dir).groupBy("system").agg(F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("n_right"), ag.accuracy().alias("accuracy")), "accuracy")


@registered("confusion_matrix", PAIRED_SQL + f" SELECT label AS gold, {', '.join(f'''count(pred) FILTER (pred = '{x}') AS {x}''' for x in labels.LABELS)} FROM {LABEL_ROWS} LEFT JOIN paired ON gold = label GROUP BY label")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.confusion(paired(spark, sf_dir))


CLASSES_SQL = (
    PAIRED_SQL
    + f""", counted AS (
  SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (gold <> label AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn
  FROM paired CROSS JOIN {LABEL_ROWS} GROUP BY label
), classes AS (
  SELECT *, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM counted
)"""
)


@registered("per_class_prf", CLASSES_SQL + " SELECT label, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM classes")
def per_class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.per_class(paired(spark, sf_dir)), "precision", "recall", "f1")


@registered(
    "weighted_prf",
    CLASSES_SQL
    + " SELECT "
    + ", ".join(f"round(avg({x}), 6) AS macro_{x}, round(sum({x} * support) / sum(support), 6) AS weighted_{x}" for x in ("precision", "recall", "f1"))
    + ", round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM classes",
)
def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = ag.averaged(ag.per_class(paired(spark, sf_dir)))
    return rounded(means, *means.columns)


@registered("span_pair_scores", SCORED_SQL + " SELECT id, gold, pred, round(token_f1, 6) AS token_f1, round(iou, 6) AS iou, exact FROM scored WHERE both_spans")
def span_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ag.scored(paired(spark, sf_dir)).where(ag.eligible(ag.Policy("both")))
    return rounded(rows.select("id", "gold", "pred", "token_f1", "iou", "exact"), "token_f1", "iou")


def _rationale(which: str) -> str:
    return SCORED_SQL + f" SELECT gold, count(*) FILTER ({which}_spans) AS s_span, round(avg(token_f1) FILTER ({which}_spans), 6) AS token_f1, round(avg(iou) FILTER ({which}_spans), 6) AS iou, round(avg(exact::INT) FILTER ({which}_spans), 6) AS exact FROM scored GROUP BY gold"


def _rationale_plan(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return rounded(ag.scored(paired(spark, sf_dir)).groupBy("gold").agg(*ag.rationale(ag.Policy(which))), "token_f1", "iou", "exact")


@registered("rationale_both_nonneutral", _rationale("both"))
def rationale_both_nonneutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rationale_plan(spark, sf_dir, "both")


@registered("rationale_same_label", _rationale("same"))
def rationale_same_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rationale_plan(spark, sf_dir, "same")


@registered("joint_iou50", SCORED_SQL + " SELECT seed, round(avg((gold = pred AND (gold = 'neutral' OR iou >= 0.5))::INT), 6) AS joint_iou, round(avg((gold = pred AND (gold = 'neutral' OR exact))::INT), 6) AS joint_exact FROM scored GROUP BY seed")
def joint_iou50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.scored(paired(spark, sf_dir)).groupBy("seed").agg(*ag.joint()), "joint_iou", "joint_exact")


@registered("neutral_absence", PAIRED_SQL + " SELECT seed, round(count(*) FILTER (gold = 'neutral' AND pred = 'neutral' AND pred_start IS NULL AND pred_end IS NULL) / count(*) FILTER (gold = 'neutral')::DOUBLE, 6) AS neutral_absence FROM paired GROUP BY seed")
def neutral_absence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paired(spark, sf_dir).groupBy("seed").agg(ag.neutral_absence().alias("neutral_absence")), "neutral_absence")


@registered("disagreements", SCORED_SQL + " SELECT id, gold, pred, gold_start, gold_end, pred_start, pred_end, gold = pred AS label_agreement, exact AS exact_span_match FROM scored WHERE gold <> pred OR NOT exact")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.disagreements(paired(spark, sf_dir)).select("id", "gold", "pred", "gold_start", "gold_end", "pred_start", "pred_end", "label_agreement", F.col("exact").alias("exact_span_match"))


@registered(
    "correctness_transitions",
    PAIRED_SQL + " SELECT CASE WHEN pred = gold AND pred2 = gold THEN 'both_right' WHEN pred = gold THEN 'right_then_wrong' WHEN pred2 = gold THEN 'wrong_then_right' ELSE 'both_wrong' END AS transition, pred <> pred2 AS changed, count(*) AS n FROM paired GROUP BY ALL",
)
def correctness_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.transitions(paired(spark, sf_dir), "pred", "pred2")


@registered(
    "condition_delta",
    PAIRED_SQL
    + """ SELECT seed, round(count(*) FILTER (pred2 = gold) / count(*)::DOUBLE - count(*) FILTER (pred = gold) / count(*)::DOUBLE, 6) AS accuracy_delta,
  list_sort(list(DISTINCT pred)) = list_sort(list(DISTINCT pred2)) AS same_labels, min(id) AS first_id, max(id) AS last_id FROM paired GROUP BY seed""",
)
def condition_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.condition_delta(paired(spark, sf_dir), "pred", "pred2", ("seed",)), "accuracy_delta")


@registered("label_distribution", PAIRED_SQL + f" SELECT label, count(gold) AS n, round(count(gold) / (SELECT count(*) FROM paired)::DOUBLE, 6) AS share FROM {LABEL_ROWS} LEFT JOIN paired ON gold = label GROUP BY label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.label_distribution(paired(spark, sf_dir)), "share")


@registered(
    "normalised_labels",
    """SELECT event_type, count(*) AS n, CASE lower(trim(raw)) WHEN 'entails' THEN 'entailment' WHEN 'implication' THEN 'entailment' WHEN 'contradict' THEN 'contradiction' WHEN 'neutre' THEN 'neutral' ELSE lower(trim(raw)) END AS label
FROM (SELECT event_type, CASE event_id % 6 WHEN 0 THEN ' Entails ' WHEN 1 THEN 'implication' WHEN 2 THEN 'CONTRADICT' WHEN 3 THEN 'neutre' WHEN 4 THEN 'Neutral' ELSE event_type END AS raw FROM events) GROUP BY ALL""",
)
def normalised_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN ' Entails ' WHEN 1 THEN 'implication' WHEN 2 THEN 'CONTRADICT' WHEN 3 THEN 'neutre' WHEN 4 THEN 'Neutral' ELSE event_type END")
    return table(spark, sf_dir, "events").groupBy("event_type", labels.normalised(raw).alias("label")).agg(F.count("*").alias("n"))


FLIPS_SQL = VARIANTS_SQL + ", flagged AS (SELECT *, (base_pred <> variant_pred)::INT AS flip, (base_pred = gold AND variant_pred <> gold)::INT AS harmful, (base_pred <> gold AND variant_pred = gold)::INT AS beneficial FROM variants)"


@registered(
    "flip_rates",
    FLIPS_SQL
    + """, cases AS (SELECT base_id, category, avg(flip) AS f, avg(harmful) AS h, avg(beneficial) AS b, 1 - max(flip) AS c FROM flagged GROUP BY ALL)
SELECT category, count(*) AS cases, round(avg(f), 6) AS flip_rate, round(avg(h), 6) AS harmful_rate, round(avg(b), 6) AS beneficial_rate, round(avg(c), 6) AS consistent FROM cases GROUP BY category""",
)
def flip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.case_rates(audit.flagged(variants(spark, sf_dir)), ("category",)), "flip_rate", "harmful_rate", "beneficial_rate", "consistent")


@registered(
    "pair_breakdowns",
    FLIPS_SQL + " SELECT direction, gold, count(*) AS pairs, sum(flip)::BIGINT AS flips, round(avg(flip), 6) AS flip_rate, round(avg(harmful), 6) AS harmful_rate, round(avg(beneficial), 6) AS beneficial_rate FROM flagged GROUP BY GROUPING SETS ((), (direction), (gold))",
)
def pair_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.breakdowns(audit.flagged(variants(spark, sf_dir)), "direction", "gold"), "flip_rate", "harmful_rate", "beneficial_rate")


@registered("direction_balanced_rate", FLIPS_SQL + " SELECT round(avg(r), 6) AS balanced_flip_rate, round(avg(h), 6) AS balanced_harmful_rate FROM (SELECT direction, avg(flip) AS r, avg(harmful) AS h FROM flagged GROUP BY direction)")
def direction_balanced_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.balanced(audit.flagged(variants(spark, sf_dir)), "direction"), "balanced_flip_rate", "balanced_harmful_rate")


PROBABILITIES_SQL = "WITH triples AS (SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, 50 * l_discount + 1 AS b, 50 * l_tax + 1 AS c FROM lineitem), probs AS (SELECT l_orderkey, l_linenumber, a / (a + b + c) AS p1, b / (a + b + c) AS p2, c / (a + b + c) AS p3 FROM triples)"


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5: l_orderkey, l_linenumber, p (three probabilities in the labels' order)."""
    raw = F.array(F.col("l_quantity") + 1, F.col("l_discount") * 50 + 1, F.col("l_tax") * 50 + 1)
    total = F.element_at("raw", 1) + F.element_at("raw", 2) + F.element_at("raw", 3)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return lines.select("l_orderkey", "l_linenumber", F.transform("raw", lambda x: x / total).alias("p"))


@registered(
    "tv_distance",
    PROBABILITIES_SQL
    + """ SELECT b.l_orderkey AS base_id, round(avg(0.5 * (abs(v.p1 - b.p1) + abs(v.p2 - b.p2) + abs(v.p3 - b.p3))), 6) AS tv, round(avg(v.p1 - b.p1), 6) AS shift, round(avg(abs(v.p1 - b.p1)), 6) AS abs_shift
FROM probs b JOIN probs v USING (l_orderkey) WHERE b.l_linenumber = 1 AND v.l_linenumber > 1 GROUP BY b.l_orderkey""",
)
def tv_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    probs = probabilities(spark, sf_dir)
    base = probs.where("l_linenumber = 1").select(F.col("l_orderkey").alias("base_id"), F.col("p").alias("base"))
    moved = probs.where("l_linenumber > 1").withColumnRenamed("l_orderkey", "base_id").join(base, "base_id")
    shift = F.element_at("p", 1) - F.element_at("base", 1)
    out = moved.groupBy("base_id").agg(F.avg(labels.total_variation(F.col("p"), F.col("base"))).alias("tv"), F.avg(shift).alias("shift"), F.avg(F.abs(shift)).alias("abs_shift"))
    return rounded(out, "tv", "shift", "abs_shift")


@registered("argmax_label", PROBABILITIES_SQL + " SELECT CASE WHEN p1 >= p2 AND p1 >= p3 THEN 'entailment' WHEN p2 >= p3 THEN 'contradiction' ELSE 'neutral' END AS label, count(*) AS n FROM probs GROUP BY ALL")
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).groupBy(labels.most_probable(F.col("p")).alias("label")).agg(F.count("*").alias("n"))


@registered(
    "softmax_rows",
    "SELECT l_orderkey, l_linenumber, round(exp(a - m) / z, 6) AS s1, round(exp(b - m) / z, 6) AS s2, round(exp(c - m) / z, 6) AS s3 FROM (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS z FROM (SELECT *, greatest(a, b, c) AS m FROM (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_discount * 20 AS b, l_tax * 20 AS c FROM lineitem)))",
)
def softmax_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft = labels.softmax(F.array(F.col("l_quantity") / 10, F.col("l_discount") * 20, F.col("l_tax") * 20))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", soft.alias("s"))
    return rounded(rows.select("l_orderkey", "l_linenumber", *[F.element_at("s", i).alias(f"s{i}") for i in (1, 2, 3)]), "s1", "s2", "s3")


@registered(
    "seed_aggregate",
    PAIRED_SQL
    + """, by_seed AS (SELECT seed, count(*) FILTER (gold = pred) / count(*)::DOUBLE AS accuracy FROM paired GROUP BY seed)
SELECT count(*) AS seeds, round(avg(accuracy), 6) AS mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS std, round(min(accuracy), 6) AS least, round(max(accuracy), 6) AS most, list_transform(list(accuracy ORDER BY seed), lambda x: round(x, 6))::VARCHAR AS vals FROM by_seed""",
)
def seed_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_seed = paired(spark, sf_dir).groupBy("seed").agg(ag.accuracy().alias("accuracy"))
    out = rounded(audit.over_seeds(by_seed, "seed", "accuracy"), "mean", "std", "least", "most")
    shown = F.concat(F.lit("["), F.array_join(F.transform("vals", lambda x: F.round(x, 6).cast("string")), ", "), F.lit("]"))
    return out.withColumn("vals", shown)


@registered(
    "cross_seed_stability",
    FLIPS_SQL + ", pairs AS (SELECT base_id, max(flip) AS any_flip, max(harmful) AS any_harmful FROM flagged GROUP BY base_id) SELECT count(*) AS pairs, sum(any_flip)::BIGINT AS any_flip, sum(any_harmful)::BIGINT AS any_harmful, round(avg(1 - any_flip), 6) AS stable_share FROM pairs",
)
def cross_seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.stability(audit.flagged(variants(spark, sf_dir)), "base_id"), "stable_share")


@registered(
    "variant_vs_majority",
    PAIRED_SQL
    + """, v AS (SELECT seed AS variant, gold, count(*) AS n, count(*) FILTER (gold = pred) AS r FROM paired GROUP BY ALL)
SELECT variant, sum(n)::BIGINT AS n, round(sum(r) / sum(n), 6) AS accuracy, round(max(n) / sum(n), 6) AS majority, round(sum(r) / sum(n) - max(n) / sum(n), 6) AS over_majority, round(sum(r) / sum(n) - 1.0::DOUBLE / 3, 6) AS over_uniform FROM v GROUP BY variant""",
)
def variant_vs_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.over_baselines(paired(spark, sf_dir).withColumnRenamed("seed", "variant"), "variant"), "accuracy", "majority", "over_majority", "over_uniform")


@registered(
    "window_aggregate",
    PROBABILITIES_SQL
    + """, means AS (SELECT l_orderkey, avg(p1) AS m1, avg(p2) AS m2, avg(p3) AS m3 FROM probs GROUP BY 1),
chosen AS (SELECT *, CASE WHEN round(m1, 9) >= round(m2, 9) AND round(m1, 9) >= round(m3, 9) THEN 1 WHEN round(m2, 9) >= round(m3, 9) THEN 2 ELSE 3 END AS k FROM means)
SELECT c.l_orderkey AS instance, k AS label_index, (list(l_linenumber ORDER BY round(CASE k WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, 9) DESC, l_linenumber))[1]::BIGINT AS span_window
FROM chosen c JOIN probs p USING (l_orderkey) GROUP BY ALL""",
)
def window_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.over_windows(probabilities(spark, sf_dir), "l_orderkey", "l_linenumber", "p").withColumnRenamed("l_orderkey", "instance")


@registered("probability_maps", PROBABILITIES_SQL + " SELECT l_orderkey, l_linenumber, label, round(CASE label WHEN 'entailment' THEN p1 WHEN 'contradiction' THEN p2 ELSE p3 END, 6) AS p FROM probs, " + LABEL_ROWS)
def probability_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every label of each line's map from labels to probabilities."""
    maps = probabilities(spark, sf_dir).select("l_orderkey", "l_linenumber", labels.probability_map(F.col("p")).alias("m"))
    return rounded(maps.select("l_orderkey", "l_linenumber", F.explode("m").alias("label", "p")), "p")


@registered("eligible_spans", SCORED_SQL + " SELECT id, round(token_f1, 6) AS token_f1, round(iou, 6) AS iou, exact FROM scored WHERE both_spans")
def eligible_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ag.eligible_ids(paired(spark, sf_dir)), "token_f1", "iou")


@registered("neutral_disagreements", PAIRED_SQL + " SELECT count(*) FILTER (gold = 'neutral' AND pred <> 'neutral') AS gold_neutral_only, count(*) FILTER (gold <> 'neutral' AND pred = 'neutral') AS pred_neutral_only, count(*) FILTER (gold = 'neutral' AND pred = 'neutral' AND pred_start IS NOT NULL) AS neutral_with_span FROM paired")
def neutral_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ag.neutral_disagreements(paired(spark, sf_dir))


@registered(
    "scored_window_aggregate",
    PROBABILITIES_SQL
    + """, w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p1, p2, p3, 1 + l_partkey % 40 AS first, 1 + l_partkey % 40 + l_suppkey % 9 AS last, round(-ln(1 + l_extendedprice), 9) AS score FROM probs JOIN lineitem USING (l_orderkey, l_linenumber)),
firsts AS (SELECT l_orderkey, (list(CASE WHEN round(p1, 9) >= round(p2, 9) AND round(p1, 9) >= round(p3, 9) THEN 1 WHEN round(p2, 9) >= round(p3, 9) THEN 2 ELSE 3 END ORDER BY l_linenumber, CASE WHEN round(p1, 9) >= round(p2, 9) AND round(p1, 9) >= round(p3, 9) THEN 1 WHEN round(p2, 9) >= round(p3, 9) THEN 2 ELSE 3 END))[1] AS k FROM w GROUP BY 1),
best AS (SELECT l_orderkey, (list({'w': l_linenumber, 'a': first, 'b': last} ORDER BY score DESC, l_linenumber, first, last))[1] AS b FROM w GROUP BY 1)
SELECT l_orderkey AS instance, k AS label_index, CASE WHEN k <> 3 THEN b.w END::BIGINT AS span_window, CASE WHEN k <> 3 THEN b.a END::BIGINT AS first, CASE WHEN k <> 3 THEN b.b END::BIGINT AS last FROM firsts JOIN best USING (l_orderkey)""",
)
def scored_window_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with a span and its score each: the label is the first window's, the span that of the highest score."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "1 + l_partkey % 40 AS first", "1 + l_partkey % 40 + l_suppkey % 9 AS last", "-ln(1 + l_extendedprice) AS score")
    rows = probabilities(spark, sf_dir).join(lines, ["l_orderkey", "l_linenumber"])
    return audit.over_scored_windows(rows, "l_orderkey", "l_linenumber", "p", "score", "first", "last", 3).withColumnRenamed("l_orderkey", "instance")
