"""Queries that write and read files again, and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement
from ..sources import files
from ..sources.shared import fresh_path
from ..streaming import logs
from .bindings import PAIRED_SQL, paired, table
from .registry import registered


@registered("jsonl_round_trip", "SELECT conv_id, turn, role, sha256(text) AS content FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks, path = table(spark, sf_dir, "conversations"), fresh_path(spark, "jsonl")
    files.write_jsonl(talks, path, ["conv_id", "turn"])
    return files.read_jsonl(spark, path, talks.schema).select("conv_id", "turn", "role", F.sha2("text", 256).alias("content"))


@registered("csv_round_trip", "SELECT p_partkey, p_name, p_retailprice, NULL::VARCHAR AS s_name FROM part UNION ALL SELECT s_suppkey, NULL, NULL, s_name FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of different columns in one table, with a byte order mark."""
    path = fresh_path(spark, "csv")
    files.write_csv([table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")], path)
    return files.read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double, s_name string")


@registered("confusion_file", PAIRED_SQL + " SELECT gold, count(*) FILTER (pred = 'entailment') AS entailment, count(*) FILTER (pred = 'contradiction') AS contradiction, count(*) FILTER (pred = 'neutral') AS neutral FROM paired GROUP BY gold")
def confusion_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "confusion")
    agreement.written_confusion(paired(spark, sf_dir), path)
    return files.read_csv(spark, path, "gold string, entailment long, contradiction long, neutral long")


@registered("readable_report", "SELECT line FROM (SELECT unnest(['source ' || source, '  documents  : ' || count(*), '  characters : ' || printf('%.4f', avg(n_chars)), '  labelled   : ' || coalesce(nullif(count(l.doc_id), 0)::VARCHAR, '-')]) AS line FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source)")
def readable_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a report on every source."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(1))
    rows = table(spark, sf_dir, "documents").join(known, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"), F.nullif(F.count("known"), F.lit(0)).alias("labelled"))
    path = fresh_path(spark, "report")
    files.write_report(rows.withColumn("title", F.concat(F.lit("source "), "source")), path, {"title": "", "n": "documents", "mean": "characters", "labelled": "labelled"}, ["title"])
    return spark.read.text(path).withColumnRenamed("value", "line")


@registered("json_report", "SELECT source, count(*) AS n, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested report as JSON and read again."""
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))
    whole = rows.agg(F.array_sort(F.collect_list(F.struct("source", "n", "mean"))).alias("sources"))
    text = spark.createDataFrame([(files.report(whole),)], "report string")
    return text.select(F.explode(F.from_json("report", "sources array<struct<source:string,n:bigint,mean:double>>")["sources"]).alias("s")).select("s.*")


@registered("json_or_lines", "SELECT doc_id, sha256(text) AS content FROM documents")
def json_or_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files, some with lines and some with one array of objects."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text"), fresh_path(spark, "mixed")
    row = F.to_json(F.struct("doc_id", "text"))
    lines = docs.where("doc_id % 2 = 0").select(row.alias("value"))
    arrays = docs.where("doc_id % 2 = 1").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(16))).agg(F.concat(F.lit("\n [ "), F.array_join(F.collect_list(row), ",\n"), F.lit(" ]")).alias("value")).select("value")
    lines.write.text(path)
    _one_file_each(arrays, path)
    return files.read_json(spark, path, docs.schema).select("doc_id", F.sha2("text", 256).alias("content"))


def _one_file_each(texts: DataFrame, path: str) -> None:
    """Every row as a file of its own."""
    texts.write.option("maxRecordsPerFile", 1).mode("append").text(path)


@registered("typed_instances", "SELECT doc_id AS id, sha256(trim(text)) AS hypothesis, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 2 + length(text) - length(regexp_replace(text, '^\\s+', '')) END::BIGINT AS first, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 2 + length(regexp_replace(text, '\\s+$', '')) END::BIGINT AS last FROM documents")
def typed_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances whose spans have white space at their ends, and neutral ones."""
    raw = table(spark, sf_dir, "documents").selectExpr("doc_id AS id", "concat('  ', text, ' ') AS premise", "concat(' ', text, ' ') AS hypothesis_facts", "IF(doc_id % 3 = 2, 'neutral', 'entailment') AS label", "0 AS rationale_start", "length(text) + 3 AS rationale_end")
    found = files.instances(raw, True)
    return found.select("id", F.sha2("hypothesis_facts", 256).alias("hypothesis"), F.col("rationale_start").cast("long").alias("first"), F.col("rationale_end").cast("long").alias("last"))


@registered("blind_and_gold", "SELECT doc_id AS id, sha256(text) AS shown, CASE WHEN quality = 1 THEN 'entailment' ELSE 'contradiction' END AS label, 5 AS columns FROM documents JOIN labels USING (doc_id)")
def blind_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What annotators see of the labelled documents, joined to gold by id again; neither view has the reference."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    raw = rows.selectExpr("doc_id AS id", "text AS premise", "lang AS hypothesis_facts", "source AS law_ref", "IF(quality = 1, 'entailment', 'contradiction') AS label", "toxic AS rationale_start")
    joined = files.annotator_view(raw, hide_reference=True).join(files.gold_view(raw), "id")
    return joined.select("id", F.sha2("premise", 256).alias("shown"), "label", F.lit(len(joined.columns)).alias("columns"))


@registered("rendered_values", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{' || chr(10) || '  \"k\": ' || regexp_extract(props, '[0-9]+') || chr(10) || '}' WHEN 1 THEN event_type ELSE 'plain ' || event_type END AS shown FROM events")
def rendered_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects are indented, JSON strings and plain texts trimmed."""
    raw = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('\" ', event_type, '\"') ELSE concat(' plain ', event_type, ' ') END")
    return table(spark, sf_dir, "events").select("event_id", files.rendered(raw).alias("shown"))


@registered("embedded_json", "SELECT event_id, regexp_extract(props, '[0-9]+')::BIGINT AS k FROM events")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects inside fenced answers."""
    raw = F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", files.embedded_object(raw, "k bigint")["k"].alias("k"))


@registered("append_log", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arrive in two overlapping deliveries; the log has each once."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, target, checkpoint = (fresh_path(spark, x) for x in ("arrivals", "log", "log-state"))
    for delivery in (events.where("event_type IN ('view', 'click')"), events):
        files.append_jsonl(delivery, source)
        logs.append_new(spark, source, "event_id long, event_type string, user_id long, ts timestamp", target, checkpoint, "event_id", "ts", "60 days")
    return spark.read.schema("event_id long, event_type string").json(target).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


_DELIVERED = "CASE WHEN event_id % 10 = 9 OR ts >= TIMESTAMP '2024-01-20 00:00:00' THEN 1 ELSE 0 END"


@registered("late_events", f"WITH d AS (SELECT *, {_DELIVERED} AS delivery FROM events), m AS (SELECT max(ts) - INTERVAL 2 DAY AS lim FROM d WHERE delivery = 0) SELECT event_type, count(*) FILTER (NOT (delivery = 1 AND ts < lim)) AS in_time, count(*) FILTER (delivery = 1 AND ts < lim) AS late FROM d, m GROUP BY event_type")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two deliveries, the second with one in ten of the first one's time: how many of each type come in time, two days being allowed, and how many do not."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    source, on_time, too_late, checkpoint = (fresh_path(spark, x) for x in ("deliveries", "in-time", "too-late", "late-state"))
    for k in (0, 1):
        events.where(f"{_DELIVERED} = {k}").write.mode("append").parquet(source)
        logs.divide_late(spark.readStream.schema(events.schema).parquet(source), "ts", "2 days", on_time, too_late, checkpoint)
    read = lambda path, n: spark.read.schema(events.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias(n))
    return read(on_time, "in_time").join(read(too_late, "late"), "event_type", "left").na.fill(0, ["late"])


@registered("daily_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = logs.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
    return counts.withColumn("total", F.round("total", 4))


@registered("pending_runs", "SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0")
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by their settings' hash: a third is finished, but half of that under another protocol, which does not count."""
    runs, settings = table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), F.struct("doc_id", "source", "lang")
    none = spark.createDataFrame([], "signature string, protocol string")
    done = [files.pending_runs(runs.where(f"doc_id % 3 = 0 AND doc_id % 2 = {k}"), none, settings, p).select("signature", F.lit(p).alias("protocol")) for k, p in ((1, "v2"), (0, "v1"))]
    return files.pending_runs(runs, done[0].unionByName(done[1]), settings, "v2").select("doc_id", "source")
