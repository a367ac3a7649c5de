"""Queries of joins by interval and by time, and of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lexical, temporal
from .agreement import rounded
from .bindings import TOKENS_SQL, passages, table
from .registry import registered

_WINDOWED = TOKENS_SQL + ", w AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents), bounds AS (SELECT doc_id, win, win * 48 + 1 AS w1, least(win * 48 + 64, n) AS w2 FROM (SELECT doc_id, n, unnest(range(greatest(1, ceil((n - 64) / 48.0) + 1)::BIGINT)) AS win FROM w))"


@registered("span_windows", f'{_WINDOWED} SELECT doc_id, item_id, win AS "window", least(last, w2) - greatest(first, w1) + 1 AS shared, first >= w1 AND last <= w2 AS whole FROM spanned JOIN bounds USING (doc_id) WHERE first <= w2 AND w1 <= last')
def span_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which windows of 64 tokens touch the spans of contained passages, and by how many tokens."""
    met = passages(spark, sf_dir).withColumn("s", text.token_span(F.col("text"), F.col("start"), F.col("end")))
    spans = met.select("doc_id", "item_id", F.col("s.first").alias("first_token"), F.col("s.last").alias("last_token"))
    windows = lexical.token_windows(table(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text")), 64, 48).select("doc_id", "window", "first", "last")
    pairs = temporal.overlapping(spans, windows, ["doc_id"], ("first_token", "last_token"), ("first", "last"), 256)
    shared = F.least("last_token", "last") - F.greatest("first_token", "first") + 1
    whole = (F.col("first_token") >= F.col("first")) & (F.col("last_token") <= F.col("last"))
    return pairs.select("doc_id", "item_id", F.col("window").cast("long").alias("window"), shared.cast("long").alias("shared"), whole.alias("whole"))


_LINES = "SELECT l_suppkey % 10 AS lane, l_orderkey, l_linenumber, l_partkey AS low, l_partkey + CAST(l_quantity AS BIGINT) AS high FROM lineitem"
_PARTS = "SELECT p_partkey % 10 AS lane, p_partkey, p_partkey AS low2, p_partkey + p_size AS high2 FROM part"


@registered("overlapping_parts", f"WITH l AS ({_LINES}), p AS ({_PARTS}) SELECT l_orderkey, l_linenumber, count(*) AS met, sum(least(high, high2) - greatest(low, low2) + 1)::BIGINT AS shared FROM l JOIN p ON l.lane = p.lane AND low <= high2 AND low2 <= high GROUP BY ALL")
def overlapping_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines and parts as intervals in ten lanes: how many parts overlap each line, and by how much. Few keys, and bins that are crowded."""
    lines = spark.sql(_LINES.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    parts = spark.sql(_PARTS.replace("FROM part", "FROM {parts}"), parts=table(spark, sf_dir, "part"))
    pairs = temporal.overlapping(lines, parts, ["lane"], ("low", "high"), ("low2", "high2"), 512, hot=10_000)
    return pairs.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("met"), F.sum(F.least("high", "high2") - F.greatest("low", "low2") + 1).alias("shared"))


_ORDERED = "SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, (o_orderkey * 7919) % 2592000) AS o_time, o_totalprice FROM orders"
_ORDERED_SQL = "SELECT o_orderkey, o_custkey % 150 AS user_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds((o_orderkey * 7919) % 2592000) AS o_time, o_totalprice FROM orders"


@registered("order_before_event", f"WITH o AS ({_ORDERED_SQL}), m AS (SELECT event_id, e.user_id, max({{'t': o_time, 'k': o_orderkey, 'p': o_totalprice}}) AS x FROM events e LEFT JOIN o ON o.user_id = e.user_id AND o_time <= ts GROUP BY ALL) SELECT event_id, user_id, x.k AS o_orderkey, x.p AS o_totalprice FROM m")
def order_before_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's latest earlier order of its user, the orders' dates dealt over the events' month."""
    orders = spark.sql(_ORDERED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    found = temporal.as_of(events, orders, ["user_id"], "ts", "o_time", "o_orderkey", F.date_trunc("day", F.col("_time")))
    return found.select("event_id", "user_id", "o_orderkey", "o_totalprice")


@registered("sessions", "WITH g AS (SELECT *, (ts > lag(ts) OVER w + INTERVAL 6 HOUR)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(coalesce(fresh, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS value FROM s GROUP BY user_id, k")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events with at most six hours between."""
    return rounded(temporal.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours", F.sum("value").alias("value")), "value", places=4)
