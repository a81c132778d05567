"""Call-log analytics, job status, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from naskah.constants import (
    DEFAULT_PAUSE_SECONDS, ERROR_OUTCOMES, IN_FLIGHT, MAX_ATTEMPTS, MAX_PAUSE_SECONDS, OUTCOMES,
    STALE_SECONDS,
)
from naskah.functions import text as T

HOUR = 3600


def filter_calls(
    calls: DataFrame, provider=None, outcome: str = "all", url: str | None = None,
    status: int | None = None, track_job_id=None, eval_job_id=None, start=None, end=None,
) -> DataFrame:
    """Conjunction of the given conditions; time bounds are inclusive."""
    wanted = {"errors": ERROR_OUTCOMES, "success": ["success"], "aborted": ["aborted"]}
    tests = []
    if provider:
        tests.append(F.col("provider").isin(list(provider)))
    if outcome != "all":
        tests.append(F.col("outcome").isin(wanted[outcome]))
    if url:
        tests.append(T.icontains(F.col("url"), url))
    for name, value in (("status", status), ("track_job_id", track_job_id), ("eval_job_id", eval_job_id)):
        if value is not None:
            tests.append(F.col(name) == value)
    if start is not None:
        tests.append(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("created_at") <= F.lit(end).cast("timestamp"))
    for t in tests:
        calls = calls.filter(t)
    return calls


def outcome_of(status: Column, error: Column) -> Column:
    """Outcome class of a call from its status or the name of its error."""
    return (
        F.when(status.between(200, 299), "success")
        .when(status.isNotNull(), "http_error")
        .when(error == "LookupTimeoutError", "aborted")
        .when(error.isin("TimeoutError", "AbortError"), "timeout")
        .otherwise("network_error")
    )


def call_stats(calls: DataFrame, *by: str) -> DataFrame:
    """Counts per outcome (zero-filled), errors without self-stopped calls, error rate."""
    per = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    errors = sum((F.col(o) for o in ERROR_OUTCOMES[1:]), F.col(ERROR_OUTCOMES[0]))
    total = sum((F.col(o) for o in OUTCOMES[1:]), F.col(OUTCOMES[0]))
    return (
        calls.groupBy(*by).agg(*per)
        .withColumn("total", total)
        .withColumn("errors", errors)
        .withColumn("error_rate", F.when(F.col("total") == 0, 0.0).otherwise(F.col("errors") / F.col("total")))
    )


def call_latency(calls: DataFrame) -> DataFrame:
    """Mean and exact continuous 95th percentile, rounded, 0 for no calls.

    Durations are counted per value first, so the percentile sees one row per value.
    """
    values = calls.groupBy("duration_ms").agg(F.count("*").alias("n")).filter("duration_ms IS NOT NULL")
    return values.agg(
        F.coalesce(
            F.round((F.sum(F.col("duration_ms") * F.col("n")) / F.sum("n")).cast("decimal(38,6)")), F.lit(0)
        ).cast("int").alias("avg_ms"),
        F.coalesce(F.rint(F.percentile("duration_ms", F.lit(0.95), F.col("n"))), F.lit(0.0))
        .cast("int").alias("p95_ms"),
    )


def paged(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of an ordered table, with total rows and number of pages (at least 1)."""
    total = df.agg(F.count("*")).scalar()
    return (
        df.orderBy(*order).offset((page - 1) * size).limit(size)
        .withColumn("total", total)
        .withColumn("total_pages", F.greatest(F.lit(1), F.ceil(total / size).cast("int")))
    )


def cooldown_flags(calls: DataFrame) -> DataFrame:
    """Flags calls made while their host is paused after a 429 or 503.

    The pause end is a running maximum per host. Hours are windowed apart and joined with
    the maximum of earlier hours (one row per host and hour), so a busy host is split.
    """
    wait = F.least(
        F.coalesce(F.col("retry_after").try_cast("double"), F.lit(float(DEFAULT_PAUSE_SECONDS))),
        F.lit(float(MAX_PAUSE_SECONDS)),
    )
    at = F.unix_micros("created_at")
    until = F.when(F.col("status").isin(429, 503), at + (wait * 1_000_000).cast("bigint"))
    rows = calls.withColumn("_until", until).withColumn("_hour", F.floor(at / (HOUR * 1_000_000)))
    hours = rows.groupBy("host", "_hour").agg(F.max("_until").alias("_max"))
    earlier = Window.partitionBy("host").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = hours.select("host", "_hour", F.max("_max").over(earlier).alias("_before"))
    inside = Window.partitionBy("host", "_hour").orderBy("created_at", "id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    paused = F.greatest(F.max("_until").over(inside), F.col("_before"))
    return (
        rows.join(before, ["host", "_hour"])
        .withColumn("in_cooldown", F.coalesce(paused > at, F.lit(False)))
        .drop("_until", "_hour", "_before")
    )


def fetch_status(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """References, and their sources found, failed and in flight, per job."""
    status = F.col("status")
    per = sources.join(refs.select("job_id", "reference_id"), ["job_id", "reference_id"], "left_semi").groupBy("job_id").agg(
        F.count_if(status == "done").alias("found"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status.isin(IN_FLIGHT)).alias("pending"),
    )
    total = refs.groupBy("job_id").agg(F.count("*").alias("total"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("found", "failed", "pending")]
    return total.join(per, "job_id", "left").select("job_id", "total", *zero)


def first_source(attempts: DataFrame) -> DataFrame:
    """First success per reference in provider order, each address tried once.

    Failures become one text, ordered by rank. The addresses of a reference are as many
    as there are providers.
    """
    tries = attempts.groupBy("reference_id", "url").agg(
        F.min(F.struct("rank", "provider", "ok", "error")).alias("t")
    ).select("reference_id", "url", "t.*")
    return tries.groupBy("reference_id").agg(
        F.min_by("provider", F.when(F.col("ok"), F.col("rank"))).alias("provider"),
        F.min_by("url", F.when(F.col("ok"), F.col("rank"))).alias("url"),
        F.bool_or("ok").alias("found"),
        F.array_sort(F.collect_set(F.when(~F.col("ok"), F.struct("rank", "provider", "error")))).alias("errors"),
    ).select(
        "reference_id", "found",
        F.when(F.col("found"), F.col("provider")).alias("provider"),
        F.when(F.col("found"), F.col("url")).alias("url"),
        F.when(
            ~F.col("found"),
            F.array_join(
                F.transform("errors", lambda e: F.concat_ws(": ", e["provider"], e["error"])), "; "
            ),
        ).alias("error"),
    )


def stranded_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Unfinished jobs silent for too long, and what to do with them."""
    seen = F.coalesce("heartbeat_at", "updated_at")
    return jobs.filter(
        F.col("status").isin("pending", "extracting", "analyzing")
        & (F.unix_micros(seen) < F.unix_micros(now) - STALE_SECONDS * 1_000_000)
    ).withColumn("action", F.when(F.col("attempts") >= MAX_ATTEMPTS, "fail").otherwise("requeue"))


def stalled(df: DataFrame, statuses: list[str], now: Column, seconds: int) -> DataFrame:
    """Rows in one of ``statuses`` not updated within the window."""
    return df.filter(
        F.col("status").isin(statuses)
        & (F.unix_micros("updated_at") < F.unix_micros(now) - seconds * 1_000_000)
    )


def expired_by_age(jobs: DataFrame, days: int, now: Column) -> DataFrame:
    """Jobs created before the cutoff, whatever their status."""
    return jobs.filter(F.unix_micros("created_at") < F.unix_micros(now) - days * 86_400_000_000)


def expired_terminal(jobs: DataFrame, days: int, now: Column) -> DataFrame:
    """Finished jobs not updated since the cutoff."""
    return jobs.filter(
        F.col("status").isin("done", "failed")
        & (F.unix_micros("updated_at") < F.unix_micros(now) - days * 86_400_000_000)
    )


def expired_calls(calls: DataFrame, days: int, now: Column) -> DataFrame:
    """Old calls that belong to no job."""
    return calls.filter(
        F.col("track_job_id").isNull() & F.col("eval_job_id").isNull()
        & (F.unix_micros("created_at") < F.unix_micros(now) - days * 86_400_000_000)
    )


def with_children(expired: DataFrame, **children: DataFrame) -> DataFrame:
    """Expired jobs with the number of rows each child table loses."""
    out = expired
    for name, child in children.items():
        n = child.join(expired.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(
            F.count("*").alias(name)
        )
        out = out.join(n, "job_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def keep_rows(table: DataFrame, expired: DataFrame) -> DataFrame:
    """The rows of a child table that survive."""
    return table.join(expired.select("job_id"), "job_id", "left_anti")


def orphan_files(listing: DataFrame, live: DataFrame, pattern: str, cutoff: Column) -> DataFrame:
    """Stored files whose id (group 1 of ``pattern``) is not live and that are past the grace period."""
    name = F.substring_index("path", "/", -1)
    ident = F.lower(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")))
    return (
        listing.withColumn("file_id", ident)
        .join(live.select(F.lower("id").alias("file_id")).distinct().withColumn("live", F.lit(True)), "file_id", "left")
        .filter(F.col("live").isNull() & (F.col("modified_at") <= cutoff))
        .drop("live")
    )
