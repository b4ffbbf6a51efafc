"""Streams of audit entries and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.files import AUDIT


def audit_stream(spark, path: str) -> DataFrame:
    """Audit entries appended to a folder as JSON lines; malformed lines, which have no entry_id, are left out."""
    return spark.readStream.schema(AUDIT).json(path).filter("entry_id IS NOT NULL").withColumn("ts", F.try_to_timestamp("timestamp"))


def audit_sink(entries: DataFrame, path: str, checkpoint: str):
    """Appends a stream of audit entries to a log of JSON lines, each entry once; both folders must be shared by all executors."""
    return entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rate_limited(requests: DataFrame, user: str = "user_id", ts: str = "ts", limit: int = 60, late: str = "5 minutes") -> DataFrame:
    """Requests per user and minute with those above ``limit``; works on streams (state older than ``late`` is dropped) and on tables."""
    src = requests.withWatermark(ts, late) if requests.isStreaming else requests
    c = src.groupBy(F.col(user).alias("user_id"), F.window(ts, "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("user_id", F.col("w.start").alias("minute"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("n_rejected"))


def audit_totals(entries: DataFrame) -> DataFrame:
    """Running totals per retrieval method; error entries count apart."""
    ok = F.col("type").isNull() | (F.col("type") != "error")
    return entries.groupBy("retrieval_method").agg(F.count_if(ok).alias("n_queries"), F.count_if(~ok).alias("n_errors"), F.count_if(ok & F.col("abstained")).alias("n_abstained"), F.count_if(ok & F.col("flagged_for_review")).alias("n_flagged"))


def first_entries(entries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Entries without those received again within ``late`` of their time."""
    return entries.withWatermark("ts", late).dropDuplicatesWithinWatermark(["entry_id"])
