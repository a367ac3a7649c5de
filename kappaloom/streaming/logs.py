"""Append-only logs, rows that come too late, sessions and event counts as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.temporal import sessions


def _finished(query: StreamingQuery) -> StreamingQuery:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def append_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, time: str | None = None, late: str = "1 day") -> int:
    """Take all lines that have arrived under source into the log at target, each key once; a restart goes on where it stopped. Returns how many keys are still remembered.

    With a column `time`, a key is remembered until the stream's latest time is `late` after it, and lines that come later than that are left out: what is held is bounded by the lines of
    that time. Without one every key is remembered, which suits a log of bounded length alone.
    """
    lines = spark.readStream.schema(schema).json(source)
    single = lines.dropDuplicates([key]) if time is None else lines.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    query = _finished(single.writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    told = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return told[-1] if told else 0


def divide_late(stream: DataFrame, time: str, late: str, on_time: str, too_late: str, checkpoint: str) -> None:
    """Write what has arrived to two tables: rows older than the latest time of all deliveries before, less `late`, go to too_late, the others and those without a time to on_time.

    A delivery's rows stand in a folder of its number, and so does its latest time, beside the checkpoint: one that is done again after a fault replaces them. A sum over too_late counts
    what windows and sessions with the same watermark would leave out.
    """
    spark, seen = stream.sparkSession, f"{checkpoint}-times"

    def put(rows: DataFrame, number: int) -> None:
        before = spark.createDataFrame([], "latest timestamp")
        if number:
            # a row for each delivery
            before = spark.read.schema("latest timestamp, delivery long").parquet(seen).where(F.col("delivery") < number).select("latest")
        limit = before.agg((F.max("latest") - F.expr(f"INTERVAL {late}")).alias("_limit"))
        marked = rows.join(F.broadcast(limit)).withColumn("_late", F.coalesce(F.col(time).cast("timestamp") < F.col("_limit"), F.lit(False))).drop("_limit")
        marked = marked.persist()
        for path, those in ((on_time, ~F.col("_late")), (too_late, F.col("_late"))):
            marked.where(those).drop("_late").write.mode("overwrite").parquet(f"{path}/delivery={number}")
        rows.agg(F.max(F.col(time).cast("timestamp")).alias("latest")).write.mode("overwrite").parquet(f"{seen}/delivery={number}")
        marked.unpersist()

    _finished(stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def closed_sessions(stream: DataFrame, keys: list[str], time: str, gap: str, late: str, target: str, checkpoint: str, *measures: Column) -> None:
    """Write the sessions of a stream's rows that no row in time can change any more to a table; a restart goes on with the open ones."""
    found = sessions(stream.withWatermark(time, late), keys, time, gap, *measures)
    _finished(found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, n, total): counts in windows; on a stream, those older than the watermark are dropped and closed."""
    watched = events.withWatermark(time, late) if events.isStreaming else events
    return watched.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
