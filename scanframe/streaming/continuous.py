"""Continuous scan of newly arriving file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanframe.operators import patterns


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def scan_stream(texts: DataFrame, text_col: str, name_col: str, category: str | None = None) -> DataFrame:
    """Stateless rule scan; the batch operator applied to a stream."""
    return patterns.scan_text(texts, text_col, name_col, category)


def severity_windows(findings: DataFrame, ts: str = "ts", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Findings per severity and event-time window."""
    return (
        findings.withWatermark(ts, late).groupBy(F.window(ts, width), "severity")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "severity", "n"))


def without_redelivery(files: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Drop files delivered again with the same path and content."""
    keyed = files.withColumn("content_sha", F.sha2(F.col("content"), 256))
    return keyed.withWatermark(ts, late).dropDuplicatesWithinWatermark(["path", "content_sha"])


def run_updates(stream: DataFrame, folder: str, checkpoint: str) -> int:
    """Process what is there and append every changed row with its batch; returns the rows that came too late.

    The windows that are still open at the end are in it too: ``current`` gives the last state of each.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
    late = {}  # by batch, as Spark itself remembers the last ones only
    ended = False
    while not ended:
        ended = query.awaitTermination(0.2)
        for p in query.recentProgress:
            late[p["batchId"], p["timestamp"]] = sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])
    return sum(late.values())


def current(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last written state of every key."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def run_available(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what is there, append it to a Parquet folder and stop."""
    query = (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
