"""The operators' inputs, made of the driver's tables, as frames and as the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _next(label: str) -> str:
    return f"CASE {label} WHEN 'entailment' THEN 'contradiction' WHEN 'contradiction' THEN 'neutral' ELSE 'entailment' END"


GOLD = "CASE l_returnflag WHEN 'A' THEN 'entailment' WHEN 'R' THEN 'contradiction' ELSE 'neutral' END"
_LABELLED = f"""SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linenumber AS seed, {GOLD} AS gold,
  (l_orderkey * 31 + l_linenumber * 17 + l_partkey) % 10 AS u, (l_orderkey * 7 + l_linenumber * 13 + l_suppkey) % 10 AS v,
  1 + l_partkey % 40 AS g, 1 + l_suppkey % 25 AS k FROM lineitem"""
_PREDICTED = f"""SELECT *, CASE WHEN u >= 8 THEN {_next('gold')} ELSE gold END AS pred, CASE WHEN v >= 9 THEN {_next('gold')} ELSE gold END AS pred2,
  greatest(1, g + l_orderkey % 5 - 2) AS p, 1 + (l_suppkey + l_linenumber - 1) % 25 AS m FROM labelled"""
_BOUNDED = """SELECT id, CAST(seed AS BIGINT) AS seed, l_orderkey, gold, pred, pred2,
  CASE WHEN gold <> 'neutral' THEN g END AS gold_start, CASE WHEN gold <> 'neutral' THEN g + k - 1 END AS gold_end,
  CASE WHEN pred <> 'neutral' THEN p END AS pred_start, CASE WHEN pred <> 'neutral' THEN p + m - 1 END AS pred_end FROM predicted"""

#: The beginning of an oracle over paired annotations, with and without their scores.
PAIRED_SQL = f"WITH labelled AS ({_LABELLED}), predicted AS ({_PREDICTED}), paired AS ({_BOUNDED})"
SCORED_SQL = (
    PAIRED_SQL
    + """, overlapped AS (
  SELECT *, gold_end - gold_start + 1 AS n1, pred_end - pred_start + 1 AS n2,
    CASE WHEN gold_start IS NOT NULL AND pred_start IS NOT NULL THEN greatest(0, least(gold_end, pred_end) - greatest(gold_start, pred_start) + 1) END AS shared FROM paired
), scored AS (
  SELECT *, CASE WHEN gold_start IS NULL AND pred_start IS NULL THEN 1.0 WHEN shared IS NULL THEN 0.0 ELSE 2 * shared::DOUBLE / (n1 + n2) END::DOUBLE AS token_f1,
    CASE WHEN gold_start IS NULL AND pred_start IS NULL THEN 1.0 WHEN shared IS NULL THEN 0.0 ELSE shared::DOUBLE / (n1 + n2 - shared) END::DOUBLE AS iou,
    CASE WHEN gold_start IS NULL AND pred_start IS NULL THEN true WHEN shared IS NULL THEN false ELSE gold_start = pred_start AND gold_end = pred_end END AS exact,
    gold <> 'neutral' AND pred <> 'neutral' AS both_spans, gold <> 'neutral' AND pred = gold AS same_spans FROM overlapped
)"""
)


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: id, seed, gold, pred, pred2 (of a second system), and the bounds."""
    lines = table(spark, sf_dir, "lineitem")
    labelled = spark.sql(_LABELLED.replace("FROM lineitem", "FROM {lines}"), lines=lines)
    predicted = spark.sql(_PREDICTED.replace("FROM labelled", "FROM {labelled}"), labelled=labelled)
    return spark.sql(_BOUNDED.replace("FROM predicted", "FROM {predicted}"), predicted=predicted)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: the places of benchmark passages in documents: doc_id, item_id, text, passage, start, end."""
    return containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Joins documents (text) to the items whose passage they contain, with its first place.

    The longest word inside a passage, which stands whole in any document that
    contains it, brings both together by equality; passages of fewer than three
    words have none inside and are looked for with their longest word.
    """
    parts = F.split("passage", r"\s+")
    inner = F.when(F.size(parts) > 2, F.slice(parts, F.lit(2), F.size(parts) - 2)).otherwise(parts)
    anchor = F.element_at(F.array_sort(inner, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), 1)
    keyed = items.withColumn("word", anchor)
    met = docs.withColumn("word", F.explode(F.array_distinct(F.split("text", r"\s+")))).join(keyed, "word").drop("word")
    start = F.expr("instr(text, passage) - 1")
    return met.withColumn("start", start).where("start >= 0").withColumn("end", F.col("start") + F.length("passage"))


PASSAGES_SQL = "WITH met AS (SELECT doc_id, item_id, d.text, b.text AS passage, instr(d.text, b.text) - 1 AS start, instr(d.text, b.text) - 1 + length(b.text) AS stop FROM documents d JOIN benchmark b ON contains(d.text, b.text))"


#: Passages with the ids of their first and last token.
TOKENS_SQL = PASSAGES_SQL + ", spanned AS (SELECT *, len(regexp_extract_all(substring(text, 1, start::INT), '\\S+')) + CASE WHEN start > 0 AND regexp_matches(substring(text, start::INT, 2), '^\\S\\S') THEN 0 ELSE 1 END AS first, len(regexp_extract_all(substring(text, 1, stop::INT), '\\S+')) AS last FROM met)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4: counterfactual variants (order lines) of base cases (orders), with the base's and the variant's prediction."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return spark.sql(_VARIANTS.replace("FROM orders", "FROM {orders}").replace("JOIN lineitem", "JOIN {lines}"), lines=lines, orders=orders)


def _hashed(x: str) -> str:
    return f"CASE {x} % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'contradiction' ELSE 'neutral' END"


_VARIANTS = f"""SELECT o_orderkey AS base_id, l_linenumber AS variant, o_orderpriority AS category, l_linestatus AS direction, {_hashed('o_orderkey')} AS gold,
  {_hashed("(o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END)")} AS base_pred,
  {_hashed("(o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN (l_partkey + l_linenumber) % 9 = 0 THEN 1 ELSE 0 END)")} AS variant_pred
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""
VARIANTS_SQL = f"WITH variants AS ({_VARIANTS})"
