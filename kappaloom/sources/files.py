"""Reading and writing JSON lines, JSON arrays, CSV and reports; manifests."""

from __future__ import annotations

import json
import platform

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class FaultyLine(ValueError):
    """A line that is no JSON object: names file and line."""


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, empty_ok: bool = True) -> DataFrame:
    """Rows of JSON lines in UTF-8. A byte order mark and blank lines are skipped, unknown fields dropped.

    A line that is no object, or does not fit the schema, is an error with file and
    line number; so is an input without rows unless empty_ok.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    checked = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.withColumn("row", F.from_json("value", checked, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    object_like = F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$")
    bad = parsed.where(~object_like | F.col("row._bad").isNotNull()).select("file", "value").first()
    if bad:
        raise FaultyLine(f"{bad.file}:{_line_number(spark, bad.file, bad.value)}: not an object that fits: {bad.value[:80]}")
    out = parsed.select("row.*").drop("_bad")
    if not empty_ok and out.isEmpty():
        raise FaultyLine(f"{path}: no rows")
    return out


def _line_number(spark: SparkSession, file: str, value: str) -> int:
    """Of the first line of a file that reads so; only the file of a fault is read again, line by line."""
    lines = spark.read.option("maxPartitionBytes", 1 << 40).text(file).select("value", F.monotonically_increasing_id().alias("at"))
    found = lines.where(F.regexp_replace("value", "^\ufeff", "") == value).agg(F.min("at")).first()[0]
    # lines are numbered by part and place in it: what stands before counts
    return 0 if found is None else lines.where(F.col("at") <= found).count()


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, or arrays of objects in files whose first character that is not blank is a bracket: each file is told by itself."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    first = lines.where(F.trim("value") != "").groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("value"))
    arrays = [r.file for r in first.where(F.trim(F.translate("value", "\t\r", "  ")).startswith("[")).select("file").collect()]  # names of files
    if not arrays:
        return read_jsonl(spark, path, schema)
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(arrays)
    others = [r.file for r in first.where(~F.col("file").isin(arrays)).select("file").collect()]
    return whole if not others else whole.unionByName(read_jsonl(spark, others, schema))


def embedded_object(raw: Column, schema: str) -> Column:
    """The object between the first and the last brace of a text, such as a fenced answer; null if it does not parse."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Committed as a whole. With an order, files hold consecutive ranges of it."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_csv(frames: list[DataFrame], path: str, mark: bool = True) -> None:
    """With a header; frames of different columns get the union of them, in first-seen order. mark: every file begins with a byte order mark, as its header does then."""
    whole = frames[0]
    for df in frames[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    if mark:
        whole = whole.withColumnRenamed(whole.columns[0], "\ufeff" + whole.columns[0])
    whole.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a header, and a byte order mark or none: columns go by their place."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(schema).csv(path)


def write_report(df: DataFrame, path: str, lines: dict[str, str], order: list[str] | None = None) -> None:
    """A readable text for every row: a title and lines of a name and a value, aligned. lines: names with the column that they show, the first is the title.

    Numbers that are no whole ones have four places; a null is a dash. With an order, files hold consecutive ranges of it.
    """
    kinds, width = dict(df.dtypes), max(map(len, lines.values()), default=0)

    def shown(c: str) -> Column:
        value = F.format_string("%.4f", F.col(c).cast("double")) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), "-").otherwise(value)

    (title, _), *rest = lines.items()
    text = F.concat_ws("\n", shown(title), *[F.concat(F.lit(f"  {name.ljust(width)} : "), shown(c)) for c, name in rest])
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.select(text.alias("value")).write.mode("overwrite").text(path)


@F.pandas_udf(T.StringType())
def rendered(raw: pd.Series) -> pd.Series:
    """A JSON value as a person reads it: a string trimmed, anything else indented by two; text that is no JSON is trimmed as it is."""

    def show(x: str | None) -> str | None:
        if x is None:
            return None
        try:
            value = json.loads(x)
        except ValueError:
            return x.strip()
        return value.strip() if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=2)

    return raw.map(show)


def report(df: DataFrame, allow_nan: bool = False) -> str:
    """A one-row frame as a JSON text; NaN is an error unless allowed."""
    return json.dumps(df.first().asDict(recursive=True), ensure_ascii=False, allow_nan=allow_nan, default=str)


def manifest(values: dict[str, object], spark: SparkSession) -> DataFrame:
    """(key, value) of a run's settings; values as JSON."""
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, default=str)) for k, v in sorted(values.items())], "key string, value string")


def verify_or_create(spark: SparkSession, path: str, values: dict[str, object], unstable: tuple[str, ...] = ("created",)) -> bool:
    """Write the manifest if there is none (True), else compare it, but for unstable keys: a difference is an error."""
    from ..operators.validate import manifest_difference

    new, at = manifest(values, spark), spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        new.write.parquet(path)
        return True
    differs = manifest_difference(spark.read.parquet(path), new).where("differs").where(~F.col("key").isin(*unstable)).collect()
    if differs:
        raise ValueError("the run differs from its manifest in " + ", ".join(sorted(r.key for r in differs)))
    return False


def signature(row: Column) -> Column:
    """The SHA-256 of a struct's JSON, to recognise a finished run by."""
    return F.sha2(F.to_json(row), 256)


def environment(spark: SparkSession) -> dict[str, object]:
    """What a run's results may depend on beside its settings."""
    return {"python": platform.python_version(), "spark": spark.version, "java": spark._jvm.System.getProperty("java.version"), "time_zone": spark.conf.get("spark.sql.session.timeZone"), "ansi": spark.conf.get("spark.sql.ansi.enabled")}


def pending_runs(runs: DataFrame, finished: DataFrame, settings: Column, protocol: str) -> DataFrame:
    """Runs that are still to do, with their signature: those of which finished (signature, protocol) has none of this protocol.

    A finished run of another protocol does not count, so that a change of protocol does all runs again.
    """
    done = finished.where(F.col("protocol") == protocol).select("signature").distinct()
    return runs.withColumn("signature", signature(F.struct(settings.alias("settings"), F.lit(protocol).alias("protocol")))).join(done, "signature", "left_anti")


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The newest file that a pattern matches."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return found.p if found else None


def folder_with(spark: SparkSession, candidates: list[str], required: list[str], newest: bool = False) -> str | None:
    """The first of the folders, or the one changed last, that holds all required files or folders."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = []
    for folder in candidates:
        system = path(folder).getFileSystem(conf)
        if all(system.exists(path(f"{folder}/{name}")) for name in required):
            found.append((system.getFileStatus(path(folder)).getModificationTime(), folder))
    if not found:
        return None
    return max(found, key=lambda x: x[0])[1] if newest else found[0][1]


def instances(raw: DataFrame, labelled: bool) -> DataFrame:
    """Typed instances: text columns trimmed, spans trimmed of white space, neutral as (0, 0, ''); without labels the gold columns are not there."""
    from ..functions.spans import trimmed

    base = raw.select("id", F.col("premise"), F.trim("hypothesis_facts").alias("hypothesis_facts"), *(["label", "rationale_start", "rationale_end"] if labelled else []))
    if not labelled:
        return base
    neutral = F.col("label") == "neutral"
    span = trimmed(F.col("premise"), F.coalesce("rationale_start", F.lit(0)), F.coalesce("rationale_end", F.lit(0)))
    out = base.withColumn("_s", span)
    pick = lambda c: F.when(neutral, 0).otherwise(F.col(f"_s.{c}"))
    out = out.withColumns({"rationale_start": pick("start"), "rationale_end": pick("end")}).drop("_s")
    return out.withColumn("rationale_text", F.when(neutral, "").otherwise(F.substring("premise", F.col("rationale_start") + 1, F.col("rationale_end") - F.col("rationale_start"))))


#: What annotators may see, and what gold adds to it.
BLIND = ("id", "premise", "hypothesis_facts", "law_ref")
GOLD = ("label", "rationale_start", "rationale_end", "rationale_text")


def annotator_view(df: DataFrame, hide_reference: bool = False) -> DataFrame:
    return df.select([c for c in BLIND if not (hide_reference and c == "law_ref")])


def gold_view(df: DataFrame) -> DataFrame:
    return df.select("id", *[c for c in GOLD if c in df.columns])


def master_view(df: DataFrame, lot: str, position: str) -> DataFrame:
    """All columns but helpers (that begin with _), with lot, position_in_lot and global_position: rows of a lot in the order of position, lots one after the other."""
    from ..operators.order import numbered

    plain = [c for c in df.columns if not c.startswith("_") and c not in (lot, position)]
    rows = df.select(*plain, F.col(lot).alias("lot"), F.col(position).alias("_position"))
    inside = numbered(rows, ["lot"], F.floor(F.col("_position") / 4096), ["_position"], "position_in_lot")
    whole = numbered(inside.withColumn("_one", F.lit(0)), ["_one"], F.col("lot"), ["position_in_lot"], "global_position")
    return whole.select(*plain, "lot", *[(F.col(c) + 1).cast("long").alias(c) for c in ("position_in_lot", "global_position")])
