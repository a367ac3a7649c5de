"""Queries of order, gaps, choices in hash order, spans by score, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import order_key
from ..operators import order
from ..sources import files
from .agreement import rounded
from .bindings import table
from .registry import registered

_PLACED = "placed AS (SELECT event_id, user_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS pos, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos_in_type FROM events)"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B8: events with their position in all and in their type."""
    return order.positions(table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts")), "hour", ["ts", "event_id"], "event_type")


@registered("positions", f"WITH {_PLACED} SELECT event_id, pos, pos_in_type FROM placed")
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("event_id", "pos", "pos_in_type")


@registered(
    "key_gaps",
    f"""WITH {_PLACED}, g AS (SELECT user_id, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM placed)
SELECT user_id, count(gap) AS gaps, min(gap) AS least, round(avg(gap), 6) AS mean, max(gap) AS most, quantile_cont(gap, 0.5)::DOUBLE AS median, round(quantile_cont(gap, 0.1), 6)::DOUBLE AS p10, count(*) FILTER (gap = 1) AS adjacent FROM g GROUP BY user_id""",
)
def key_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order.gaps(placed(spark, sf_dir), "user_id", "pos").withColumnRenamed("before", "gap")
    out = rows.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.min("gap").alias("least"), F.avg("gap").alias("mean"), F.max("gap").alias("most"), F.percentile("gap", F.lit(0.5)).alias("median"), F.percentile("gap", F.lit(0.1)).alias("p10"), F.count_if(F.col("gap") == 1).alias("adjacent"))
    return rounded(out, "mean", "p10")


@registered("nearest_gap", f"WITH {_PLACED} SELECT event_id, least(pos - lag(pos) OVER w, lead(pos) OVER w - pos) AS nearest FROM placed WINDOW w AS (PARTITION BY user_id ORDER BY pos)")
def nearest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.nearest(placed(spark, sf_dir), "user_id", "pos").select("event_id", "nearest")


_MOVED = _PLACED + ", hashed AS (SELECT event_id, sha256('2026|' || event_id) AS h FROM events), shuffled AS (SELECT event_id, row_number() OVER (ORDER BY h, event_id) AS new_pos FROM hashed)"


def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their position in all and in a hash order."""
    old = placed(spark, sf_dir).select("event_id", "user_id", "pos")
    return old.join(order.hash_positions(old, "event_id", "2026").select("event_id", F.col("pos").alias("new_pos")), "event_id")


@registered("displacement", f"WITH {_MOVED} SELECT event_id, pos, new_pos, new_pos - pos AS moved, abs(new_pos - pos) AS distance FROM placed JOIN shuffled USING (event_id)")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.col("new_pos") - F.col("pos")
    return shuffled(spark, sf_dir).select("event_id", "pos", "new_pos", moved.alias("moved"), F.abs(moved).alias("distance"))


@registered("threshold_histogram", f"WITH {_MOVED}, d AS (SELECT abs(new_pos - pos) AS x FROM placed JOIN shuffled USING (event_id)) SELECT t::BIGINT AS threshold, count(*) FILTER (x >= t) AS n, round(count(*) FILTER (x >= t) / count(*)::DOUBLE, 6) AS share FROM d, (VALUES (10), (20), (50), (100), (200)) AS v(t) GROUP BY t")
def threshold_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = shuffled(spark, sf_dir).withColumn("distance", F.abs(F.col("new_pos") - F.col("pos")))
    return rounded(order.shares_beyond(moved, "distance", [10, 20, 50, 100, 200]), "share")


@registered(
    "hash_topk_balanced",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|' || doc_id), doc_id) AS rank FROM documents), few AS (SELECT least(min(c), 200) AS k FROM (SELECT count(*) AS c FROM documents GROUP BY lang))
SELECT doc_id, lang, rank FROM r, few WHERE rank <= k""",
)
def hash_topk_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.balanced_choice(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 200, 7)


@registered(
    "replacement_pool",
    """WITH pool AS (SELECT DISTINCT n_regionkey AS category, n_name AS name FROM nation), items AS (SELECT c_custkey AS id, n_regionkey AS category, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT id, name, replacement, rank FROM (SELECT id, i.name, p.name AS replacement, row_number() OVER (PARTITION BY id ORDER BY sha256('11|' || id || '|' || p.name), p.name) AS rank FROM items i JOIN pool p USING (category) WHERE p.name <> i.name) WHERE rank <= 4""",
)
def replacement_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("category"), F.col("n_name").alias("name"))
    items = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), "category", "name")
    return order.replacements(items, nations.select("category", "name").distinct(), "category", "name", "id", 4, 11)


_SPANS = "halves AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS s, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS e FROM embeddings), spans AS (SELECT vec_id, i - 1 AS first, j - 1 AS last, s[i] + e[j] AS score FROM halves, (SELECT unnest(range(1, 33)) AS i), (SELECT unnest(range(1, 33)) AS j) WHERE i <= j{})"
_BEST = " SELECT vec_id, arg_max(first, score)::BIGINT AS first, arg_max(last, score)::BIGINT AS last, round(max(score), 6) AS score FROM spans GROUP BY vec_id"


def _best(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    half = lambda a: F.transform(F.slice("embedding", a, 32), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", order.best_span(half(1), half(33), most).alias("b"))
    return rounded(rows.select("vec_id", F.col("b.first").cast("long").alias("first"), F.col("b.last").cast("long").alias("last"), "b.score"), "score")


@registered("best_span", "WITH " + _SPANS.format("") + _BEST)
def best_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, None)


@registered("best_span_capped", "WITH " + _SPANS.format(" AND j - i < 8") + _BEST)
def best_span_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, 8)


_LOTS = "sizes AS (SELECT user_id, count(*) AS n, sum(count(*)) OVER (ORDER BY count(*) DESC, user_id) - count(*) AS first FROM events GROUP BY user_id), whole AS (SELECT greatest(1, ceil(sum(n) / 500.0), max(n))::BIGINT AS lots FROM sizes), lots AS (SELECT event_id, user_id, ((first + row_number() OVER (PARTITION BY user_id ORDER BY sha256('5|' || event_id), event_id) - 1) % lots)::BIGINT AS lot FROM events JOIN sizes USING (user_id), whole)"


@registered("lot_assignment", f"WITH {_LOTS} SELECT event_id, user_id, lot FROM lots")
def lot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to lots of 500 or fewer, no user twice in a lot."""
    return order.lots(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 500, 5)


@registered("master_rows", f"WITH {_LOTS}, placed AS (SELECT event_id, user_id, lot, row_number() OVER (PARTITION BY lot ORDER BY event_id) AS position_in_lot, row_number() OVER (ORDER BY lot, event_id) AS global_position FROM lots) SELECT event_id AS id, user_id, lot, position_in_lot, global_position FROM placed")
def master_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lots one after the other, with every row's place in its lot and in all."""
    rows = lot_assignment(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", "lot", F.col("event_id").alias("place"), F.lit("hidden").alias("_helper"))
    return files.master_view(rows, "lot", "place")


@registered("spread_schedule", "WITH placed AS (SELECT doc_id, source, (i + ('0x' || substr(sha256('3|' || source), 1, 8))::BIGINT / 4294967296::DOUBLE) / n AS f FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('3|' || doc_id), doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)), seq AS (SELECT doc_id, source, row_number() OVER (ORDER BY f, source, doc_id) AS pos FROM placed) SELECT doc_id, source, pos, pos - lag(pos) OVER (PARTITION BY source ORDER BY pos) AS gap FROM seq")
def spread_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in an order that keeps those of a source apart: position, and the gap to the source's previous one."""
    spread = order.spread(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3)
    return order.gaps(spread, "source", "pos").select("doc_id", "source", "pos", F.col("before").alias("gap"))


_FRAMES = """sizes AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), keys AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY sha256('3|' || user_id), user_id) - 1 AS rank, (SELECT max(n) FROM sizes) AS most FROM sizes),
whole AS (SELECT max(most) AS most, count(*) FILTER (n = most) AS firsts, sum(n)::BIGINT AS total FROM keys), others AS (SELECT user_id, (sum(n) OVER (ORDER BY n DESC, rank) - n)::BIGINT AS first FROM keys WHERE n < most),
cells AS (SELECT event_id, e.user_id, k.n, k.rank, row_number() OVER (PARTITION BY e.user_id ORDER BY sha256('3|' || event_id), event_id) - 1 AS i, first FROM events e JOIN keys k ON k.user_id = e.user_id LEFT JOIN others o ON o.user_id = e.user_id),
framed AS (SELECT event_id, user_id, CASE WHEN n = most THEN i ELSE (first + i) % (most - 1) END AS frame, CASE WHEN n = most THEN rank ELSE firsts + (first + i) // (most - 1) END AS col FROM cells, whole),
starts AS (SELECT frame, sum(count(*)) OVER (ORDER BY frame) - count(*) AS start FROM framed GROUP BY frame),
seq AS (SELECT event_id, user_id, (start + row_number() OVER (PARTITION BY frame ORDER BY col))::BIGINT AS pos FROM framed JOIN starts USING (frame))"""


@registered("gap_schedule", f"WITH {_FRAMES} SELECT event_id, user_id, pos, pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) AS gap FROM seq")
def gap_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in an order that keeps a user's apart as far as can be: place, and the gap to the user's one before."""
    placed = order.gap_schedule(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 3)
    return order.gaps(placed, "user_id", "pos").select("event_id", "user_id", "pos", F.col("before").alias("gap"))


@registered("least_gap", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), m AS (SELECT max(n) AS most, sum(n) AS total FROM c) SELECT total::BIGINT AS n, total::BIGINT AS places, ((total - (SELECT count(*) FROM c WHERE n = most)) // (most - 1))::BIGINT AS least_gap FROM m")
def least_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of that order is taken once, and its least gap is the widest that the counts allow."""
    placed = order.gap_schedule(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id", 3)
    return order.gaps(placed, "user_id", "pos").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("places"), F.min("before").alias("least_gap"))


@registered(
    "demo_choice",
    """WITH free AS (SELECT doc_id, lang, source, sha256('demo|' || doc_id) AS h FROM documents d WHERE len(regexp_extract_all(text, '\\S+')) <= 160 AND doc_id NOT IN (SELECT doc_id FROM labels) AND source NOT IN (SELECT source FROM documents WHERE doc_id % 97 = 1)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS r FROM free) WHERE r = 1)
SELECT lang, rank, doc_id, source FROM (SELECT lang, doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS rank FROM firsts) WHERE rank <= 2""",
)
def demo_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two short unlabelled documents of each language, of different sources, none of a target's source, first in hash order."""
    docs = table(spark, sf_dir, "documents")
    free = docs.where(F.size(text.words(F.col("text"))) <= 160).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").join(docs.where("doc_id % 97 = 1").select("source"), "source", "left_anti")
    chosen = order.distinct_demos(free.select("doc_id", "lang", "source"), "lang", "source", "doc_id", 2, "demo")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order_key("demo", F.col("doc_id")), "doc_id")).cast("long")  # two rows a language
    return chosen.withColumn("rank", rank)


@registered(
    "demo_round",
    """WITH RECURSIVE free AS (SELECT conv_id, turn, conv_id * 100 + turn AS id, role, (conv_id % 50)::BIGINT AS ref, sha256('demo|' || (conv_id * 100 + turn)) AS h FROM conversations WHERE len(regexp_extract_all(text, '\\S+')) <= 160 AND conv_id % 50 <> 7),
roles AS (SELECT role, row_number() OVER (ORDER BY role) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT role FROM conversations)),
firsts AS (SELECT role, ref, min({'h': h, 'id': id}) AS f FROM free GROUP BY ALL),
ranked AS MATERIALIZED (SELECT k, n, f.id AS id, f.h AS h, ref FROM firsts JOIN roles USING (role)),
steps(step, used, id, ref, k) AS (
  SELECT -1, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT step + 1, CASE WHEN c IS NULL THEN used ELSE list_append(used, c.ref) END, c.id, c.ref, (step + 1) % n
  FROM (SELECT s.step, s.used, (SELECT max(n) FROM ranked) AS n, (SELECT min({'h': r.h, 'id': r.id, 'ref': r.ref}) FROM ranked r WHERE r.k = (s.step + 1) % r.n AND NOT list_contains(s.used, r.ref)) AS c FROM steps s WHERE s.step + 1 < 3 * (SELECT max(n) FROM ranked)) x)
SELECT id, role, ref, (step // n + 1)::BIGINT AS rank FROM steps JOIN roles USING (k) WHERE id IS NOT NULL""",
)
def demo_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three short turns of each role in turns, no reference twice and none that a target has."""
    talks = table(spark, sf_dir, "conversations").selectExpr("conv_id * 100 + turn AS id", "role", "conv_id % 50 AS ref", "text")
    targets = talks.where("ref = 7").select(F.lit(-1).cast("long").alias("id"), "ref")
    return order.demo_round(talks, "role", "ref", "id", F.size(text.words(F.col("text"))), 3, "demo", targets)
