"""Structured Streaming: idempotent intake, windows, sessions, and an outbox applied by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicates import claimable
from ..functions.scores import backoff_seconds
from ..operators.upkeep import prune_outbox as prune  # noqa: F401

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files below a folder as a stream, with ``event_time`` for watermarks."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("event_time", F.col("ts").cast("timestamp"))


def once_only(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark; the state is bounded by it."""
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    w = F.window("event_time", width)
    return stream.withWatermark("event_time", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sliding(stream: DataFrame, width: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    w = F.window("event_time", width, step)
    return stream.withWatermark("event_time", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def user_sessions(stream: DataFrame, gap: str, key: str = "user_id", late: str = "1 hour") -> DataFrame:
    w = F.session_window("event_time", gap)
    return stream.withWatermark("event_time", late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run everything that is there through ``foreachBatch`` and stop."""
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append results to Parquet with Spark's exactly-once file sink and read them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


# ------------------------------------------------------------------ outbox


def enqueue(outbox: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that are new by (tenant, idempotency_key), pending."""
    fresh = rows.dropDuplicates(["tenant", "idempotency_key"]).join(outbox.select("tenant", "idempotency_key"), ["tenant", "idempotency_key"], "left_anti")
    return fresh.withColumns({"status": F.lit("pending"), "attempt_count": F.lit(0)})


def claim(outbox: DataFrame, now: Column, limit: int, timeout_s: int = 300, max_attempts: int = 5) -> DataFrame:
    """The oldest claimable rows, first in first out, as processing with one more attempt."""
    due = outbox.where(claimable(now, timeout_s, max_attempts)).orderBy("received_at", "outbox_id").limit(limit)
    return due.withColumns({"status": F.lit("processing"), "attempt_count": F.col("attempt_count") + 1, "claimed_at": now})


def settle(claimed: DataFrame, outcome: DataFrame, now: Column, max_attempts: int = 5, base: float = 30.0, cap: float = 3600.0) -> DataFrame:
    """Claimed rows after work: completed, failed with a due time, or dead after ``max_attempts``. outcome: (outbox_id, ok)."""
    d = claimed.join(outcome.select("outbox_id", "ok"), "outbox_id", "left")
    ok, dead = F.coalesce("ok", F.lit(False)), F.col("attempt_count") >= max_attempts
    wait = backoff_seconds(F.col("attempt_count"), base, cap)
    return d.withColumns({"status": F.when(ok, "completed").when(dead, "dead_letter").otherwise("failed"), "next_retry_at": F.when(~ok & ~dead, F.timestamp_micros((F.unix_micros(now) + wait * 1_000_000).cast("long")))}).drop("ok")


def outbox_stats(outbox: DataFrame) -> DataFrame:
    s = F.col("status")
    return outbox.agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("pending", "processing", "completed", "failed", "dead_letter")], F.min(F.when(s == "pending", F.col("received_at"))).alias("oldest_pending"))
