"""Queries that validate, align and deduplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spans, text
from ..functions.hashing import order_key, request_id
from ..operators import align, order, validate
from .bindings import PASSAGES_SQL, TOKENS_SQL, passages, table
from .registry import registered

_RAW = """SELECT CASE WHEN l_partkey % 101 = 0 THEN ' ' WHEN l_partkey % 103 = 0 THEN concat(l_suppkey, '-x') ELSE concat(l_orderkey, '-', l_linenumber) END AS id,
  CASE WHEN l_partkey % 50 = 0 THEN 'unknown' WHEN l_returnflag = 'A' THEN 'entailment' WHEN l_returnflag = 'R' THEN 'contradiction' ELSE 'neutral' END AS label,
  CASE WHEN l_returnflag = 'N' AND l_suppkey % 20 <> 0 THEN NULL WHEN l_partkey % 37 = 0 THEN -1 ELSE l_partkey % 40 END AS first,
  CASE WHEN l_returnflag = 'N' AND l_suppkey % 20 <> 0 OR l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN 0 ELSE l_partkey % 40 + 5 END AS last FROM lineitem"""


@registered(
    "violations",
    f"""WITH raw AS ({_RAW}), counted AS (SELECT *, count(*) OVER (PARTITION BY id) AS same FROM raw), coded AS (
  SELECT unnest(list_filter([
    CASE WHEN id IS NULL OR trim(id) = '' THEN 'id' END, CASE WHEN label NOT IN ('entailment', 'contradiction', 'neutral') THEN 'label' END,
    CASE WHEN label = 'neutral' AND (first IS NOT NULL OR last IS NOT NULL) THEN 'neutral_span' END,
    CASE WHEN label IN ('entailment', 'contradiction') AND (first IS NULL OR last IS NULL) THEN 'missing_span' END,
    CASE WHEN first < 0 THEN 'start' END, CASE WHEN last < first THEN 'order' END, CASE WHEN id IS NOT NULL AND same > 1 THEN 'repeated' END], lambda x: x IS NOT NULL)) AS code FROM counted)
SELECT code, count(*) AS n FROM coded GROUP BY code""",
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(_RAW.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem"))
    faulty = raw.withColumn("faults", validate.annotation_faults(F.col("label"), F.col("first"), F.col("last"), F.col("id")))
    return validate.with_repeats(faulty, "id").select(F.explode("faults").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@registered("corpus_check", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) FILTER (text IS NULL OR trim(text) = '') AS blank FROM documents")
def corpus_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.corpus_counts(table(spark, sf_dir, "documents"), "doc_id", "text")


_STRICT = "CASE event_id % 6 WHEN 0 THEN replace(props, '}', '.0}') WHEN 1 THEN regexp_replace(props, '([0-9]+)', '\"GROUP\"') WHEN 2 THEN replace(props, '}', ', \"x\": 1}') WHEN 3 THEN '{\"k\": true}' ELSE props END"


@registered("strict_json_predictions", "SELECT event_id, CASE WHEN regexp_full_match(raw, '\\{\"k\": ?[0-9]+\\}') AND regexp_extract(raw, '[0-9]+')::BIGINT BETWEEN 1 AND 90 THEN regexp_extract(raw, '[0-9]+')::BIGINT END AS k FROM (SELECT event_id, " + _STRICT.replace("GROUP", "\\1") + " AS raw FROM events)")
def strict_json_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_STRICT.replace("GROUP", "$1"))
    return table(spark, sf_dir, "events").select("event_id", validate.strict_integer_object(raw, "k", 90).alias("k"))


@registered("blind_input_check", "SELECT event_type, count(*) AS n, count(*) FILTER (contains(props, '\"k\"')) AS forbidden FROM events GROUP BY event_type")
def blind_input_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.size(validate.forbidden_keys(F.col("props"), ["k", "gold_label"])) > 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(found).alias("forbidden"))


SPLIT = "CASE WHEN doc_id % 20 < 14 THEN 'train' WHEN doc_id % 20 < 17 THEN 'validation' ELSE 'test' END"


@registered("split_leakage", f"SELECT sha256(lower(text)) AS key, count(DISTINCT {SPLIT}) AS splits, count(*) AS n FROM documents GROUP BY key HAVING count(DISTINCT {SPLIT}) > 1")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("split", F.expr(SPLIT))
    return validate.leaking(docs, F.sha2(F.lower("text"), 256), "split")


@registered("span_bounds_check", PASSAGES_SQL + " SELECT doc_id, item_id, start::BIGINT AS start, stop::BIGINT AS stop, start >= 0 AND stop <= length(text) AND substring(text, start::INT + 1, (stop - start)::INT) = passage AS sound FROM met")
def span_bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = passages(spark, sf_dir)
    sound = spans.is_sound(F.col("text"), F.col("start"), F.col("end"), F.col("passage"))
    return met.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), sound.alias("sound"))


@registered(
    "challenge_check",
    """SELECT variants, count(*) AS cases, count(*) FILTER (kept) AS kept FROM (
  SELECT o_orderkey, count(*) AS variants, count(*) = 4 AND bool_and(l_linenumber BETWEEN 1 AND 4) AND count(DISTINCT l_linestatus) = 1 AS kept FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey) GROUP BY variants""",
)
def challenge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    met = orders.select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    cases = met.groupBy("o_orderkey").agg(F.count("*").alias("variants"), ((F.count("*") == 4) & F.every(F.col("l_linenumber").between(1, 4)) & (F.count_distinct("l_linestatus") == 1)).alias("kept"))
    return cases.groupBy("variants").agg(F.count("*").alias("cases"), F.count_if("kept").alias("kept"))


_OFFICIAL = "SELECT o_orderkey AS base_id, o_orderstatus AS label, o_orderpriority AS premise, concat('L', CAST(o_custkey % 90 AS VARCHAR(9))) AS law_ref, concat('h', CAST(o_custkey AS VARCHAR(19))) AS hypothesis FROM orders"
_BASES = """SELECT CASE WHEN base_id % 53 = 0 THEN -base_id - 1 ELSE base_id END AS base_id, CASE WHEN base_id % 37 = 0 THEN 'X' ELSE label END AS label, CASE WHEN base_id % 41 = 0 THEN concat(premise, '!') ELSE premise END AS premise,
  CASE WHEN base_id % 47 = 0 THEN NULL ELSE law_ref END AS law_ref, CASE WHEN base_id % 43 = 0 THEN 'other' ELSE hypothesis END AS hypothesis FROM official WHERE base_id % 3 = 0 UNION ALL SELECT * FROM official WHERE base_id % 177 = 0"""
_VARIANTS = """SELECT l_orderkey AS base_id, l_orderkey * 8 + l_linenumber AS variant_id, CASE WHEN l_partkey % 61 = 0 THEN 'Y' ELSE label END AS label, premise, law_ref,
  CASE WHEN l_partkey % 67 = 0 THEN hypothesis WHEN l_partkey % 71 = 0 THEN ' ' ELSE concat('v', CAST(l_linenumber AS VARCHAR(9))) END AS hypothesis, CASE WHEN l_suppkey % 73 = 0 THEN 'DROP' ELSE 'KEEP' END AS decision
  FROM lineitem JOIN official ON l_orderkey = base_id WHERE l_orderkey % 3 = 0 OR l_partkey % 211 = 0"""

def _faults(rows: str, of: str, id_: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT x.base_id, {id_} AS variant_id, '{fault}' AS fault FROM {rows} x LEFT JOIN {of} o ON o.base_id = x.base_id WHERE {rule}" for fault, rule in rules.items())


_DIFFERS = {c: f"o.base_id IS NOT NULL AND x.{c} IS DISTINCT FROM o.{c}" for c in ("label", "premise", "law_ref", "hypothesis")}


@registered(
    "challenge_faults",
    f"""WITH official AS ({_OFFICIAL}), bases AS ({_BASES}), variants AS ({_VARIANTS}), one AS (SELECT * FROM bases QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY label NULLS FIRST, premise NULLS FIRST, law_ref NULLS FIRST, hypothesis NULLS FIRST) = 1),
counts AS (SELECT base_id, count(*) AS n FROM variants GROUP BY base_id)
{_faults('bases', 'official', 'NULL::BIGINT', {'unknown': 'o.base_id IS NULL'} | _DIFFERS)}
UNION ALL SELECT base_id, NULL, 'repeated' FROM bases GROUP BY base_id HAVING count(*) > 1
UNION ALL SELECT b.base_id, NULL, 'variants' FROM (SELECT DISTINCT base_id FROM bases) b LEFT JOIN counts c ON c.base_id = b.base_id WHERE coalesce(n, 0) <> 4
UNION ALL {_faults('variants', 'one', 'x.variant_id', {'unknown': 'o.base_id IS NULL'} | {c: _DIFFERS[c] for c in ('label', 'premise', 'law_ref')} | {'empty': "trim(x.hypothesis) = ''", 'unchanged': "o.base_id IS NOT NULL AND trim(x.hypothesis) <> '' AND x.hypothesis = o.hypothesis", 'decision': "x.decision <> 'KEEP'"})}""",
)
def challenge_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as official cases, copies of them with faults as base cases, and their lines as counterfactuals with faults of their own: every fault, with the case."""
    official = spark.sql(_OFFICIAL.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    bases = spark.sql(_BASES.replace("FROM official", "FROM {official}"), official=official)
    variants = spark.sql(_VARIANTS.replace("FROM lineitem", "FROM {lines}").replace("JOIN official", "JOIN {official}"), lines=table(spark, sf_dir, "lineitem"), official=official)
    return validate.challenge_faults(official, bases, variants, "base_id", "variant_id", ["label", "premise", "law_ref"], "hypothesis", decision="decision")


_STORED = "CASE WHEN (doc_id + item_id) % 4 = 0 THEN first + 1 ELSE first END"


@registered(
    "target_consistency",
    TOKENS_SQL + f" SELECT s.doc_id, s.item_id, {_STORED.replace('first', 's.first').replace('doc_id', 's.doc_id').replace('item_id', 's.item_id')} AS stored, s.first AS found, (s.doc_id + s.item_id) % 4 = 0 AS moved, l.doc_id IS NULL AS missing FROM spanned s LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
)
def target_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored token bounds of passages against those that the tokens of the text give, and whether gold lacks the document."""
    met = passages(spark, sf_dir).withColumn("t", text.tokens("text")).withColumn("s", spans.covering_tokens(F.col("t"), F.col("start"), F.col("end")))
    rows = met.select("doc_id", "item_id", F.col("s.first").cast("long").alias("first")).selectExpr("doc_id", "item_id", f"{_STORED} AS stored", "first AS found")
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "doc_id", "left").select("doc_id", "item_id", "stored", "found", (~F.col("stored").eqNullSafe(F.col("found"))).alias("moved"), F.col("known").isNull().alias("missing"))


@registered(
    "corpus_totals",
    "WITH have AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), want AS (SELECT lang, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY lang) SELECT lang, coalesce(h.n, 0)::BIGINT AS n, coalesce(w.n, 0)::BIGINT AS expected, (coalesce(h.n, 0) - coalesce(w.n, 0))::BIGINT AS off FROM have h FULL JOIN want w USING (lang) UNION ALL SELECT NULL, (SELECT sum(n) FROM have)::BIGINT, (SELECT sum(n) FROM want)::BIGINT, ((SELECT sum(n) FROM have) - (SELECT sum(n) FROM want))::BIGINT",
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language, and in all, against those that the labelled ones would have."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    expected = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))
    return validate.count_differences(docs, "lang", expected)


@registered(
    "split_membership",
    f"WITH have AS (SELECT doc_id AS id, {SPLIT} AS split FROM documents UNION ALL SELECT doc_id, 'test' FROM documents WHERE doc_id % 50 = 0), want AS (SELECT doc_id AS id, CASE WHEN doc_id % 33 = 0 THEN 'test' ELSE {SPLIT} END AS split FROM documents WHERE doc_id % 41 <> 0) SELECT 'unlisted' AS fault, * FROM (SELECT * FROM have EXCEPT ALL SELECT * FROM want) UNION ALL SELECT 'absent', * FROM (SELECT * FROM want EXCEPT ALL SELECT * FROM have) UNION ALL SELECT 'several', id, min(split) FROM (SELECT DISTINCT * FROM have) GROUP BY id HAVING count(*) > 1",
)
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits with some ids in two of them, against a list that has other splits for some ids and lacks some."""
    docs = table(spark, sf_dir, "documents")
    have = docs.selectExpr("doc_id", f"{SPLIT} AS split").unionByName(docs.where("doc_id % 50 = 0").selectExpr("doc_id", "'test' AS split"))
    want = docs.where("doc_id % 41 <> 0").selectExpr("doc_id", f"CASE WHEN doc_id % 33 = 0 THEN 'test' ELSE {SPLIT} END AS split")
    return validate.membership_faults(have, want, "doc_id", "split")


_PREDICTIONS = """CASE event_id % 9 WHEN 0 THEN concat('{"id": "', event_id, '", "label": " Neutral ", "start": null, "end": null}')
  WHEN 1 THEN concat('{"id": "', event_id + 1, '", "label": "entailment", "start": 1, "end": 2}')
  WHEN 2 THEN concat('{"id": "', event_id, '", "label": "maybe", "start": 1, "end": 2}')
  WHEN 3 THEN concat('{"id": "', event_id, '", "label": "entailment", "start": 1.0, "end": 2}')
  WHEN 4 THEN concat('{"id": "', event_id, '", "label": "entailment", "start": "1", "end": 2}')
  WHEN 5 THEN concat('{"id": "', event_id, '", "label": "contradiction", "start": ', 1 + user_id % 30, ', "end": 20}')
  WHEN 6 THEN concat('{"id": "', event_id, '", "label": "neutral", "start": 1, "end": 2}')
  WHEN 7 THEN concat('{"id": "', event_id, '", "label": "entailment", "start": 1, "end": 2, "why": 3}')
  ELSE 'no object' END"""


@registered(
    "prediction_faults",
    "SELECT event_id, CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'id' WHEN 2 THEN 'label' WHEN 3 THEN 'integers' WHEN 4 THEN 'integers' WHEN 5 THEN CASE WHEN 1 + user_id % 30 > 20 THEN 'bounds' ELSE '' END WHEN 6 THEN 'neutral_span' WHEN 7 THEN 'keys' ELSE 'json' END AS faults FROM events",
)
def prediction_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of every kind of fault, against what was put into them."""
    raw = F.expr(_PREDICTIONS)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(validate.prediction_faults(raw, F.col("event_id"), F.lit(25)), ",").alias("faults"))


_NUMBERS = "CASE event_id % 5 WHEN 0 THEN concat(user_id, '.0') WHEN 1 THEN concat('\"', user_id, '\"') WHEN 2 THEN concat(user_id, '.5') WHEN 3 THEN 'true' ELSE concat(user_id, '') END"


@registered("lax_integers", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN user_id END AS json, CASE WHEN event_id % 5 IN (0, 1, 4) THEN user_id END AS whole, CASE WHEN event_id % 5 <> 3 THEN user_id END AS truncated FROM events")
def lax_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_NUMBERS)
    modes = {"json": "json", "whole": "whole", "truncated": "truncate"}
    return table(spark, sf_dir, "events").select("event_id", *[validate.lax_integer(raw, m).alias(name) for name, m in modes.items()])


NAMES = ("the", "les", "der", "los")
_NAME = "(^|[^\\p{{L}}\\p{{N}}_]){}([^\\p{{L}}\\p{{N}}_]|$)"


@registered(
    "eligibility",
    "SELECT lang, class, count(*) AS n FROM (SELECT lang, CASE WHEN k = 0 THEN 'no_name' WHEN ambiguous THEN 'ambiguous' WHEN k > 1 THEN 'many_names' WHEN contains(lower(text), 'license') OR contains(lower(text), 'rights') THEN 'excluded' ELSE 'eligible' END AS class FROM (SELECT lang, text, "
    + " + ".join(f"regexp_matches(text, '{_NAME.format(x)}')::INT" for x in NAMES)
    + f" AS k, regexp_matches(text, '{_NAME.format(NAMES[0])}') AND lang <> 'en' AS ambiguous FROM documents)) GROUP BY ALL",
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first that holds: no name; one that stands in several inventories, as the first does outside English; several names; an excluded context; eligible."""
    found = F.size(F.array_compact(F.array(*[F.when(text.has_word(F.col("text"), x), 1) for x in NAMES])))
    ambiguous = text.has_word(F.col("text"), NAMES[0]) & (F.col("lang") != "en")
    kind = F.when(F.col("k") == 0, "no_name").when(ambiguous, "ambiguous").when(F.col("k") > 1, "many_names").when(text.mentions(F.col("text"), ["license", "rights"]), "excluded").otherwise("eligible")
    return table(spark, sf_dir, "documents").withColumn("k", found).groupBy("lang", kind.alias("class")).agg(F.count("*").alias("n"))


_MENTIONED = ", ".join(f"('{x}')" for x in (*NAMES, "of the", "in the", "de la"))


@registered(
    "name_mentions",
    f"SELECT name, lang, count(*) AS docs FROM documents, (VALUES {_MENTIONED}) AS v(name) WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])' || name || '([^\\p{{L}}\\p{{N}}_]|$)') GROUP BY ALL",
)
def name_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents of each language names of one word and of two stand."""
    names, docs = spark.createDataFrame([(x,) for x in (*NAMES, "of the", "in the", "de la")], "name string"), table(spark, sf_dir, "documents")
    return align.mentions(docs, names, "doc_id", "text", "name", ("lang",)).groupBy("name", "lang").agg(F.count("*").alias("docs"))


@registered("quality_warnings", "WITH c AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) SELECT source, sum(c)::BIGINT AS n, min(c) AS least, max(c) AS most, sum(c) >= 20 AND min(c) / max(c) < 0.67 AS warned FROM c GROUP BY source")
def quality_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.imbalance(table(spark, sf_dir, "documents"), "source", "lang")


_REFS = ("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN concat(' ', source) ELSE '  ' END AS root", "CASE WHEN doc_id % 5 = 0 THEN 'src0' WHEN doc_id % 5 = 1 THEN '' ELSE source END AS meta")


@registered("reference_keys", f"SELECT coalesce(a, b) AS ref, coalesce(a <> b, false) AS conflict, count(*) AS n FROM (SELECT nullif(trim(root), '') AS a, nullif(trim(meta), '') AS b FROM (SELECT {', '.join(_REFS)} FROM documents)) GROUP BY ALL")
def reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(*_REFS)
    ref, conflict = validate.reference(F.col("root"), F.col("meta"))
    return rows.groupBy(ref.alias("ref"), conflict.alias("conflict")).agg(F.count("*").alias("n"))


@registered(
    "manifest_difference",
    """WITH a AS (SELECT source || '/' || lang AS key, count(*)::VARCHAR AS value FROM documents GROUP BY 1), b AS (SELECT source || '/' || lang AS key, count(*)::VARCHAR AS value FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT key, a.value AS "left", b.value AS "right", a.value IS DISTINCT FROM b.value AS differs FROM a FULL JOIN b USING (key)""",
)
def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("key"))
    counted = lambda df: df.groupBy("key").agg(F.count("*").cast("string").alias("value"))
    return validate.manifest_difference(counted(docs), counted(docs.join(table(spark, sf_dir, "labels"), "doc_id")))


@registered(
    "align_report",
    "SELECT CASE WHEN r.doc_id IS NULL THEN 'left_only' WHEN l.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n, min(coalesce(l.doc_id, r.doc_id)) AS first_key FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) l FULL JOIN labels r ON l.doc_id = r.doc_id GROUP BY side",
)
def align_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return align.report(talks, table(spark, sf_dir, "labels"), "doc_id")


@registered("strict_alignment", "SELECT doc_id, lang, source AS lang_2 FROM documents")
def strict_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of the same ids, one row an id; other ids on a side would be an error that names them."""
    docs = table(spark, sf_dir, "documents")
    return align.strict(docs.select("doc_id", "lang"), docs.select("doc_id", F.col("source").alias("lang")), "doc_id")


@registered("ordered_alignment", "SELECT doc_id, row_number() OVER (ORDER BY sha256('gold|' || doc_id), doc_id) - 1 AS pos, lang AS lang_2 FROM documents")
def ordered_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold stands in an order of its own, which the aligned rows keep."""
    docs = table(spark, sf_dir, "documents")
    gold = order.indexed(docs.select("doc_id", order_key("gold", F.col("doc_id")).alias("h")), ["h", "doc_id"], "pos").drop("h")
    return align.in_order(gold, docs.select("doc_id", "lang"), "doc_id", "pos")


@registered("three_way_alignment", "SELECT lang, quality, toxic, count(*) AS n, sum(turns)::BIGINT AS turns FROM documents JOIN labels USING (doc_id) JOIN (SELECT conv_id AS doc_id, count(*) AS turns FROM conversations GROUP BY conv_id) USING (doc_id) GROUP BY ALL")
def three_way_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"))
    met = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").join(turns, "doc_id")
    return met.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("turns").alias("turns"))


@registered("pending_antijoin", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source")


@registered(
    "content_dedup",
    "SELECT sha256(lang || chr(10) || text) AS key, count(*) AS n, array_to_string(list_sort(list(doc_id)), ',') AS ids FROM documents GROUP BY key HAVING count(*) > 1",
)
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align.by_content(table(spark, sf_dir, "documents"), request_id(F.col("lang"), F.col("text")), "doc_id").where("n > 1")
    return found.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@registered("unlike_partners")
def unlike_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a partner of another group and of another text, where four in ten have one text, in all groups."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.expr("pmod(doc_id, 7)").alias("group"), F.sha2(F.when(F.expr("doc_id % 10 < 4"), F.lit("the same")).otherwise(F.lower("text")), 256).alias("content"))
    found = align.unlike_partners(rows, "doc_id", "group", "content")
    mine, other = rows.select("doc_id", "group", "content"), rows.select(F.col("doc_id").alias("partner"), F.col("group").alias("group2"), F.col("content").alias("content2"))
    return found.join(mine, "doc_id").join(other, "partner").select("doc_id", "partner", (F.col("group") == F.col("group2")).alias("same_group"), (F.col("content") == F.col("content2")).alias("same_content"))


@registered(
    "derangement",
    """WITH placed AS (SELECT doc_id, source, row_number() OVER (ORDER BY source, sha256('pairs|' || doc_id), doc_id) - 1 AS at FROM documents), whole AS (SELECT count(*) AS n, (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY source)) AS most FROM documents)
SELECT a.doc_id, a.source, b.doc_id AS partner, b.source AS partner_group FROM placed a CROSS JOIN whole JOIN placed b ON b.at = (a.at + most) % n""",
)
def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.shifted_partners(table(spark, sf_dir, "documents"), "doc_id", "source")


@registered(
    "paired_by_suffix",
    "SELECT a.id AS id, a.n AS original, b.n AS counterfactual FROM (SELECT user_id::VARCHAR AS id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a JOIN (SELECT user_id::VARCHAR AS id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1) b USING (id)",
)
def paired_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids end with __orig or __cf; pairs are joined on what stands before."""
    name = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_type") == "view", "__orig").otherwise("__cf"))
    counts = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").groupBy(name.alias("name")).agg(F.count("*").alias("n"))
    keyed = counts.withColumn("id", F.regexp_replace("name", "__(orig|cf)$", ""))
    side = lambda end, to: keyed.where(F.col("name").endswith(end)).select("id", F.col("n").alias(to))
    return side("__orig", "original").join(side("__cf", "counterfactual"), "id")
