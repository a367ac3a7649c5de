import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from kappaloom.operators import temporal
from kappaloom.plans import catalogue
from kappaloom.sources import files
from kappaloom.streaming import logs

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_json_lines(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_bytes(b"\xef\xbb\xbf" + '{"id": "a", "n": 1, "more": 2}\n\n  \n{"id": "é", "n": null}\n'.encode())
    assert [tuple(r) for r in files.read_jsonl(spark, str(good), SCHEMA).collect()] == [("a", 1), ("é", None)]
    for line in ('{"id": "a"', "[1]", '"text"', '{"id": "a", "n": "x"}'):
        bad = tmp_path / "bad.jsonl"
        bad.write_text('{"id": "a", "n": 1}\n\n' + line + "\n")
        with pytest.raises(files.FaultyLine, match=r"bad\.jsonl:3:"):
            files.read_jsonl(spark, str(bad), SCHEMA)
    empty = tmp_path / "empty.jsonl"
    empty.write_text("\n")
    assert files.read_jsonl(spark, str(empty), SCHEMA).count() == 0
    with pytest.raises(files.FaultyLine):
        files.read_jsonl(spark, str(empty), SCHEMA, empty_ok=False)


def test_json_arrays_and_embedded(spark, tmp_path):
    path = tmp_path / "array.json"
    path.write_text('\n [ {"id": "a", "n": 1},\n {"id": "b", "n": 2} ]')
    assert files.read_json(spark, str(path), SCHEMA).count() == 2
    raw = spark.createDataFrame([("Here:\n```json\n{\"a\": [\"x\"]}\n```",), ("none",), ("{broken",)], "t string")
    assert [r.o for r in raw.select(files.embedded_object(F.col("t"), "map<string,array<string>>").alias("o")).collect()] == [{"a": ["x"]}, None, None]


def test_written_files(spark, tmp_path):
    frame = spark.createDataFrame([("b", 2), ("a", None)], SCHEMA)
    files.write_jsonl(frame, f"{tmp_path}/out", ["id"])
    assert [tuple(r) for r in files.read_jsonl(spark, f"{tmp_path}/out", SCHEMA).orderBy("id").collect()] == [("a", None), ("b", 2)]
    files.append_jsonl(frame, f"{tmp_path}/out")
    assert files.read_jsonl(spark, f"{tmp_path}/out", SCHEMA).count() == 4
    files.write_csv([frame, frame.select("id", F.lit(1).alias("z"))], f"{tmp_path}/csv")
    first = [p.read_bytes() for p in (tmp_path / "csv").glob("*.csv")]
    assert all(x.startswith(b"\xef\xbb\xbfid,n,z") for x in first if x)
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/csv", "id string, n long, z int").collect()), key=repr) == sorted([("b", 2, None), ("a", None, None), ("b", None, 1), ("a", None, 1)], key=repr)
    assert files.report(frame.where("id = 'b'")) == '{"id": "b", "n": 2}'
    with pytest.raises(ValueError):
        files.report(spark.range(1).select(F.lit(float("nan")).alias("x")))
    assert files.latest(spark, f"{tmp_path}/csv/*.csv").endswith(".csv")


def test_folders_of_lines_and_arrays(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": "a", "n": 1}\n')
    (tmp_path / "two.json").write_text('\ufeff\n\t[ {"id": "b", "n": 2},\n {"id": "c", "n": 3} ]')
    (tmp_path / "three.json").write_text("\n")
    assert sorted(map(tuple, files.read_json(spark, str(tmp_path), SCHEMA).collect())) == [("a", 1), ("b", 2), ("c", 3)]


def test_reports_views_and_values(spark, tmp_path):
    rows = spark.createDataFrame([("x", 2, 0.5), ("a", None, None)], "t string, n long, f double")
    files.write_report(rows, f"{tmp_path}/report", {"t": "", "n": "rows", "f": "share"}, ["t"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("*.txt")))
    assert text == "a\n  rows  : -\n  share : -\nx\n  rows  : 2\n  share : 0.5000\n"
    raw = spark.createDataFrame([(i, x) for i, x in enumerate(['" a "', '{"k":[1,"é"]}', " no json ", None])], "i int, r string")
    assert [r.s for r in raw.select("i", files.rendered("r").alias("s")).orderBy("i").collect()] == ["a", '{\n  "k": [\n    1,\n    "é"\n  ]\n}', "no json", None]
    master = files.master_view(spark.createDataFrame([(f"i{i}", i % 2, 10 - i, "h") for i in range(5)], "id string, l long, p long, _helper string"), "l", "p").orderBy("global_position").collect()
    assert [tuple(r) for r in master] == [("i4", 0, 1, 1), ("i2", 0, 2, 2), ("i0", 0, 3, 3), ("i3", 1, 1, 4), ("i1", 1, 2, 5)]


def test_folders_and_runs(spark, tmp_path):
    for name, inside in (("one", ["a"]), ("two", ["a", "b"]), ("three", ["a", "b"])):
        for x in inside:
            (tmp_path / name / x).mkdir(parents=True)
    folders = [f"{tmp_path}/{x}" for x in ("one", "two", "three")]
    assert files.folder_with(spark, folders, ["a", "b"]).endswith("two") and files.folder_with(spark, folders, ["c"]) is None
    assert files.folder_with(spark, folders, ["a", "b"], newest=True).endswith(("two", "three"))
    assert {"python", "spark"} <= set(files.environment(spark))
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "seed int, model string")
    none = spark.createDataFrame([], "signature string, protocol string")
    first = files.pending_runs(runs, none, F.struct("seed", "model"), "v1")
    done = first.where("seed = 1").select("signature", F.lit("v1").alias("protocol"))
    assert [r.seed for r in files.pending_runs(runs, done, F.struct("seed", "model"), "v1").collect()] == [2]
    assert files.pending_runs(runs, done, F.struct("seed", "model"), "v2").count() == 2


def test_manifests(spark, tmp_path):
    path = f"{tmp_path}/manifest"
    assert files.verify_or_create(spark, path, {"model": "m", "created": 1})
    assert not files.verify_or_create(spark, path, {"model": "m", "created": 2})
    with pytest.raises(ValueError, match="model"):
        files.verify_or_create(spark, path, {"model": "other", "created": 1})


def test_instances(spark):
    raw = spark.createDataFrame([("1", " a  bc d", " h ", "entailment", 1, 6), ("2", "x", "h", "neutral", None, None)], "id string, premise string, hypothesis_facts string, label string, rationale_start int, rationale_end int")
    found = files.instances(raw, True).orderBy("id").collect()
    assert (found[0].rationale_start, found[0].rationale_end, found[0].rationale_text) == (1, 6, "a  bc")
    assert (found[1].rationale_start, found[1].rationale_end, found[1].rationale_text) == (0, 0, "")
    assert files.instances(raw, False).columns == ["id", "premise", "hypothesis_facts"]


def test_log_goes_on_where_it_stopped(spark, tmp_path):
    args = (f"{tmp_path}/in", "id string, n long", f"{tmp_path}/log", f"{tmp_path}/state", "id")
    for rows in ([("a", 1)], [("a", 1), ("b", 2)]):
        files.append_jsonl(spark.createDataFrame(rows, SCHEMA), args[0])
        logs.append_new(spark, *args)
    assert sorted(r.id for r in spark.read.schema("id string").json(args[2]).collect()) == ["a", "b"]


def test_log_forgets_old_keys(spark, tmp_path):
    schema = "id long, t timestamp"
    source, target, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "log", "state"))
    day = lambda d, ids: spark.createDataFrame([(i, f"2024-01-{d:02d} 12:00:00") for i in ids], "id long, t string").withColumn("t", F.to_timestamp("t"))
    held = []
    # the third delivery repeats keys of the day before, which are still known, and one of the first day, which is too late
    for rows in (day(1, range(50)), day(10, range(50, 60)), day(11, range(60, 65)).unionByName(day(10, range(50, 60))).unionByName(day(1, [3]))):
        files.append_jsonl(rows, source)
        held.append(logs.append_new(spark, source, schema, target, checkpoint, "id", "t", "2 days"))
    assert sorted(r.id for r in spark.read.schema(schema).json(target).collect()) == list(range(65))
    assert held[0] == 50 and max(held[1:]) <= 25


def test_late_rows_are_counted_and_sessions_closed(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame([(u, f"2024-01-01 {t}") for u, t in x], "u string, t string").withColumn("t", F.to_timestamp("t"))
    deliveries = [rows(("a", "10:00:00"), ("a", "10:20:00"), ("b", "10:05:00")), rows(("a", "09:59:00"), ("a", "10:35:00"), ("a", "08:00:00"), ("b", "12:00:00")), rows(("a", "10:40:00"), ("b", "12:10:00"), ("b", "15:00:00"), ("a", "11:59:00")), rows(("c", "19:00:00"), ("b", "13:59:00"))]
    source, on_time, too_late, done = (f"{tmp_path}/{x}" for x in ("in", "on", "late", "sessions"))
    for one in deliveries:
        one.coalesce(1).write.mode("append").parquet(source)
        logs.divide_late(spark.readStream.schema(one.schema).parquet(source), "t", "1 hour", on_time, too_late, f"{tmp_path}/divide")
        logs.closed_sessions(spark.readStream.schema(one.schema).parquet(on_time), ["u"], "t", "30 minutes", "1 hour", done, f"{tmp_path}/close")
    clock = lambda x: x.strftime("%H:%M")
    late = sorted((r.u, clock(r.t)) for r in spark.read.schema(deliveries[0].schema).parquet(too_late).collect())
    assert late == [("a", "08:00"), ("a", "10:40"), ("b", "13:59")]
    closed = sorted((r.u, clock(r.first), clock(r.last), r.n) for r in spark.read.parquet(done).collect())
    assert closed[:3] == [("a", "09:59", "10:35", 4), ("a", "11:59", "11:59", 1), ("b", "10:05", "10:05", 1)] and ("b", "12:00", "12:10", 2) in closed
    kept = spark.read.schema(deliveries[0].schema).parquet(on_time)
    whole = sorted((r.u, clock(r["first"]), clock(r["last"]), r.n) for r in temporal.sessions(kept, ["u"], "t", "30 minutes").collect())
    assert set(closed) <= set(whole) and sum(r[3] for r in whole) == 13 - 3


def test_windowed_counts_on_a_stream(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 05:00:00", "v", 1.0), ("2024-01-01 06:00:00", "v", 2.0), ("2024-01-05 00:00:00", "v", 1.0)], "t string, k string, value double").withColumn("t", F.to_timestamp("t"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = logs.windowed_counts(stream, "t", "k").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("counted").collect()) == [(1, 1.0), (2, 3.0)]
    assert sorted((r.n, r.total) for r in logs.windowed_counts(events, "t", "k").collect()) == [(1, 1.0), (2, 3.0)]


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["agreement_summary", "confusion_matrix", "violations", "span_token_map", "derangement", "chi_square", "key_gaps", "hash_topk_balanced", "set_overlap", "stratified_targets", "token_windows", "embedded_json", "demo_round", "selection_by_flow", "group_folds", "window_batches", "prediction_faults", "bootstrap_paired", "strict_alignment", "gram_features", "scored_window_aggregate", "json_or_lines"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    expected = con.execute(catalogue.ORACLES[name]).df()
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    clean = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    rows = lambda df: sorted((tuple(map(clean, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)
    assert rows(found) == rows(expected)


#: Blank, null and repeated texts, ids and kinds.
ODD = [
    (1, "Ann of the hill", "en", "s1", 15), (2, "Ann of the hill", "en", "s2", 15), (3, "Ann of the hill", "de", "s2", 15), (3, "Ann of the hill", "de", "s1", 15), (4, "Ann of the hill", None, "s1", 15),
    (5, None, "en", "s1", None), (6, None, "en", "s2", None), (7, " \n ", "en", "s1", 3), (8, "", "fr", "s2", 0), (9, "", "fr", "s3", 0), (10, " in the  of the ", "en", None, 16), (None, "in the", "fr", "s3", 6),
]


@pytest.mark.parametrize("name", ["set_overlap", "token_arrays", "name_mentions"])
def test_odd_documents_equal_their_sql(spark, tmp_path, name):
    spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.execute(catalogue.ORACLES[name])
    columns, rows = [c[0] for c in expected.description], expected.fetchall()
    found = catalogue.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr) and rows
