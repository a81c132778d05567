"""Streaming forms: call-log statistics, silent jobs, incremental evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from naskah.constants import ERROR_PREVIEW, STALE_SECONDS, SUCCESS_PREVIEW
from naskah.operators.calls import outcome_of

_HEADERS = ["content-type", "content-length", "retry-after"]


def classify_calls(raw: DataFrame) -> DataFrame:
    """Log rows from raw calls: outcome, kept headers, cut preview, inherited job id.

    Raw calls have ``created_at, status, error_name, headers, body, track_job_id, context_job_id``.
    """
    cap = F.when(F.col("status").between(200, 299), SUCCESS_PREVIEW).otherwise(ERROR_PREVIEW)
    lower = F.transform_keys("headers", lambda k, _: F.lower(k))
    return raw.select(
        "*",
        outcome_of(F.col("status"), F.col("error_name")).alias("outcome"),
        F.map_filter(
            lower, lambda k, _: k.isin(_HEADERS) | F.startswith(k, F.lit("x-ratelimit-"))
        ).alias("response_headers"),
        F.left("body", cap).alias("body_preview"),
        (F.length("body") > cap).alias("body_truncated"),
        F.coalesce("track_job_id", "context_job_id").alias("job_id"),
    )


def call_windows(calls: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window; rows later than ``late`` are dropped on a stream."""
    bad = F.col("outcome").isin("http_error", "network_error", "timeout")
    return (
        calls.withWatermark("created_at", late)
        .groupBy(F.window("created_at", width).alias("w"))
        .agg(F.count("*").alias("total"), F.count_if(bad).alias("errors"), F.sum("duration_ms").alias("duration_ms"))
        .select(F.col("w.start").alias("window_start"), "total", "errors", "duration_ms")
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains a stream into a Parquet table and stops."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


ALARM = "job_id string, last_seen timestamp, alarm_at timestamp"


def _watch(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Keeps the newest heartbeat of a job; a timeout raises the alarm."""
    if state.hasTimedOut:
        (seen,) = state.get
        last = pd.Timestamp(seen, unit="us")
        state.remove()
        yield pd.DataFrame(
            {"job_id": [key[0]], "last_seen": [last], "alarm_at": [last + pd.Timedelta(seconds=STALE_SECONDS)]}
        )
        return
    newest = max((b["seen_at"].max() for b in batches), default=None)
    seen = int(pd.Timestamp(newest).value // 1000) if newest is not None else 0
    if state.exists:
        seen = max(seen, state.get[0])
    state.update((seen,))
    due = seen // 1000 + STALE_SECONDS * 1000
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def heartbeat_alarms(beats: DataFrame, late: str = "0 seconds") -> DataFrame:
    """An alarm per job silent for 120 s of event time (``job_id, seen_at``)."""
    return (
        beats.withWatermark("seen_at", late)
        .groupBy("job_id")
        .applyInPandasWithState(_watch, ALARM, "seen_us bigint", "append", "EventTimeTimeout")
    )


def _append_batch(df: DataFrame, path: str, number: int, bucket: Column) -> None:
    """Adds a batch as partitions of its own; a replay overwrites them."""
    rows = df.withColumn("job_bucket", bucket).withColumn("batch", F.lit(number))
    rows.write.mode("overwrite").partitionBy("job_bucket", "batch").option(
        "partitionOverwriteMode", "dynamic"
    ).parquet(path)


def _has_files(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)


def current_pages(spark: SparkSession, path: str) -> DataFrame:
    """The newest arrival of every page of ``evaluate_arrivals``."""
    pages = spark.read.parquet(f"{path}/pages")
    rest = [c for c in pages.columns if c not in ("job_bucket", "batch", "job_id", "page_number")]
    return (
        pages.groupBy("job_bucket", "job_id", "page_number")
        .agg(F.max_by(F.struct(*rest), "batch").alias("r")).select("job_bucket", "job_id", "page_number", "r.*")
    )


def current_findings(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Findings of the newest evaluation of every job; a job that became clean has none."""
    if not _has_files(spark, f"{path}/findings"):
        return spark.createDataFrame([], schema)
    latest = spark.read.parquet(f"{path}/evaluated").groupBy("job_bucket", "job_id").agg(F.max("batch").alias("batch"))
    found = spark.read.schema(
        StructType([*schema.fields, StructField("job_bucket", IntegerType()), StructField("batch", LongType())])
    ).parquet(f"{path}/findings")
    return found.join(latest, ["job_bucket", "job_id", "batch"], "left_semi").select(*schema.names)


def evaluate_arrivals(pages: DataFrame, evaluate, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Evaluates all stored pages of the jobs that an arriving batch touches.

    ``pages`` has ``job_id, page_number`` and whatever ``evaluate`` needs. A batch only adds: its
    pages, the findings of its jobs, and the fact that these were evaluated, as partitions named by
    job bucket and batch. Nothing is rewritten; readers take the newest (``current_findings``).
    Replays overwrite their own partitions. Batch numbers of a later stream with another
    checkpoint follow those already stored.
    """
    spark = pages.sparkSession
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    mark = f"{path}/evaluated"
    # A checkpoint that has begun keeps its offset; a new one continues after the stored batches.
    offset_file = f"{checkpoint}-offset"
    if _has_files(spark, offset_file):
        first = spark.read.parquet(offset_file).first()["first"]
    else:
        last = spark.read.parquet(mark).agg(F.max("batch")).first()[0] if _has_files(spark, mark) else None
        first = 0 if last is None else int(last) + 1
        spark.createDataFrame([(first,)], "first long").write.parquet(offset_file)

    def write(batch: DataFrame, number: int) -> None:
        number += first
        session = batch.sparkSession
        _append_batch(batch, f"{path}/pages", number, bucket)
        jobs = batch.select("job_id").distinct()
        touched = jobs.select(bucket.alias("job_bucket"), "job_id")
        stored = current_pages(session, path).join(touched, ["job_bucket", "job_id"], "left_semi").drop("job_bucket")
        _append_batch(evaluate(stored), f"{path}/findings", number, bucket)
        _append_batch(jobs, mark, number, bucket)

    query = (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
