"""Call log, job status and retention over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.functions import labels as LB
from naskah.functions import text as T
from naskah.operators import calls as C
from naskah.plans.fixtures import table, view
from naskah.plans.registry import query

def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def cut():
    return F.lit("1998-06-01 00:00:00").cast("timestamp")


NOWS = "TIMESTAMP '2024-01-20 00:00:00'"


def calls(spark, sf):
    return view(spark, sf, "call_log")


@query(
    "pf3_filter_calls",
    """SELECT id, provider, outcome, url, status FROM {call_log} WHERE provider IN ('crossref', 'openalex')
       AND outcome IN ('http_error', 'network_error', 'timeout') AND lower(url) LIKE '%/a$_b/%' ESCAPE '$'
       AND created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-01-25 00:00:00'""",
)
def filter_calls(spark, sf):
    return C.filter_calls(
        calls(spark, sf), provider=["crossref", "openalex"], outcome="errors", url="/A_b/",
        start="2024-01-05 00:00:00", end="2024-01-25 00:00:00",
    ).select("id", "provider", "outcome", "url", "status")


@query("pf4_icontains", "SELECT p_partkey, p_name FROM {part} WHERE position('Red w' IN p_name) > 0 OR lower(p_name) LIKE '%red w%'")
def icontains(spark, sf):
    return table(spark, sf, "part").filter(T.icontains(F.col("p_name"), "ReD W")).select("p_partkey", "p_name")


_STATS = ", ".join(f"CAST(count(*) FILTER (WHERE outcome = '{o}') AS BIGINT) AS {o}" for o in C.OUTCOMES)
_TOT = """CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE outcome IN ('http_error', 'network_error', 'timeout')) AS BIGINT) AS errors,
  round(count(*) FILTER (WHERE outcome IN ('http_error', 'network_error', 'timeout')) / count(*), 6) AS error_rate"""


@query("ag9_call_stats", f"SELECT {_STATS}, {_TOT} FROM {{call_log}}")
def call_stats(spark, sf):
    return C.call_stats(calls(spark, sf)).withColumn("error_rate", F.round("error_rate", 6))


@query("ag10_call_stats_by_provider", f"SELECT provider, {_STATS}, {_TOT} FROM {{call_log}} GROUP BY 1")
def call_stats_by_provider(spark, sf):
    return C.call_stats(calls(spark, sf), "provider").withColumn("error_rate", F.round("error_rate", 6)).orderBy(
        F.desc("errors"), F.desc("total"), "provider"
    )


@query("ag11_call_latency", "SELECT CAST(round(avg(duration_ms)) AS INTEGER) AS avg_ms, CAST(round_even(quantile_cont(duration_ms, 0.95), 0) AS INTEGER) AS p95_ms FROM {call_log}")
def call_latency(spark, sf):
    return C.call_latency(calls(spark, sf))


@query(
    "tk4_paged",
    """SELECT id, created_at, n.t AS total, CAST(greatest(1, ceil(n.t / 50)) AS INTEGER) AS total_pages
       FROM (SELECT id, created_at FROM {call_log} ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100) x, (SELECT count(*) AS t FROM {call_log}) n""",
)
def paged(spark, sf):
    return C.paged(calls(spark, sf).select("id", "created_at"), [F.desc("created_at"), F.desc("id")], 3, 50)


@query(
    "wn10_cooldown_flags",
    """WITH u AS (SELECT *, CASE WHEN status IN (429, 503) THEN epoch_us(created_at) + CAST(least(coalesce(TRY_CAST(retry_after AS DOUBLE), 60), 86400) * 1000000 AS BIGINT) END AS until FROM {call_log})
       SELECT id, host, coalesce(max(until) OVER (PARTITION BY host ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > epoch_us(created_at), false) AS in_cooldown FROM u""",
)
def cooldown_flags(spark, sf):
    return C.cooldown_flags(calls(spark, sf)).select("id", "host", "in_cooldown")


@query(
    "ag12_fetch_status",
    """SELECT job_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'done') AS BIGINT) AS found,
       CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (WHERE status IN ('pending', 'found', 'downloading', 'extracting')) AS BIGINT) AS pending
       FROM {plant_refs} LEFT JOIN {plant_sources} USING (job_id, reference_id) GROUP BY 1""",
)
def fetch_status(spark, sf):
    return C.fetch_status(view(spark, sf, "plant_refs"), view(spark, sf, "plant_sources"))


@query(
    "wn12_first_source",
    """WITH d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reference_id, url ORDER BY rank, provider) AS k FROM {plant_attempts}) WHERE k = 1)
       SELECT reference_id, bool_or(ok) AS found, arg_min(provider, rank) FILTER (WHERE ok) AS provider, arg_min(url, rank) FILTER (WHERE ok) AS url,
         CASE WHEN NOT bool_or(ok) THEN string_agg(provider || ': ' || error, '; ' ORDER BY rank, provider) END AS error FROM d GROUP BY 1""",
)
def first_source(spark, sf):
    return C.first_source(view(spark, sf, "plant_attempts"))


@query(
    "st3_stranded_jobs",
    f"""SELECT job_id, status, attempts, CASE WHEN attempts >= 3 THEN 'fail' ELSE 'requeue' END AS action FROM {{plant_jobs}}
       WHERE status IN ('pending', 'extracting', 'analyzing') AND coalesce(heartbeat_at, updated_at) < {NOWS} - INTERVAL 120 SECOND""",
)
def stranded_jobs(spark, sf):
    return C.stranded_jobs(view(spark, sf, "plant_jobs"), now()).select("job_id", "status", "attempts", "action")


@query(
    "st4_stalled",
    f"""SELECT source_id, status FROM {{plant_sources}} WHERE status IN ('pending', 'found', 'downloading', 'extracting') AND updated_at < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 600 SECOND""",
)
def stalled(spark, sf):
    from naskah.constants import IN_FLIGHT

    return C.stalled(
        view(spark, sf, "plant_sources"), IN_FLIGHT, F.lit("1998-01-01").cast("timestamp"), 600
    ).select("source_id", "status")


def _child_counts(cond: str) -> str:
    return f"""WITH x AS (SELECT job_id FROM {{plant_orders}} WHERE {cond})
      SELECT job_id, CAST(count(l_orderkey) AS BIGINT) AS citations FROM x LEFT JOIN {{lineitem}} ON CAST(l_orderkey AS VARCHAR) = job_id GROUP BY 1"""




def _citations(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"))


@query("rt1_expired_by_age", _child_counts("created_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 90 DAY"))
def expired_by_age(spark, sf):
    gone = C.expired_by_age(view(spark, sf, "plant_orders"), 90, cut()).select("job_id")
    return C.with_children(gone, citations=_citations(spark, sf))


@query("rt2_expired_terminal", _child_counts("status IN ('done', 'failed') AND updated_at < TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 90 DAY"))
def expired_terminal(spark, sf):
    gone = C.expired_terminal(view(spark, sf, "plant_orders"), 90, cut()).select("job_id")
    return C.with_children(gone, citations=_citations(spark, sf))


@query("rt2_expired_calls", f"SELECT id FROM {{call_log}} WHERE track_job_id IS NULL AND eval_job_id IS NULL AND created_at < {NOWS} - INTERVAL 7 DAY")
def expired_calls(spark, sf):
    return C.expired_calls(calls(spark, sf), 7, now()).select("id")


@query(
    "jn18_orphan_files",
    """WITH f AS (SELECT *, regexp_extract(path, '([0-9]+)(?:_original|_preview)?\\.pdf$', 1) AS i FROM {plant_listing})
       SELECT path, length FROM f WHERE modified_at <= TIMESTAMP '1998-01-01 00:00:00'
         AND (i = '' OR i NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM {orders} WHERE o_orderstatus = 'F') OR NOT regexp_matches(path, '/[0-9]+(_original|_preview)?\\.pdf$'))""",
)
def orphan_files(spark, sf):
    live = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("id"))
    return C.orphan_files(
        view(spark, sf, "plant_listing"), live, r"^([0-9]+)(?:_original|_preview)?\.pdf$",
        F.lit("1998-01-01").cast("timestamp"),
    ).select("path", "length")


@query(
    "tx34_labels",
    f"""WITH d AS (SELECT id, duration_ms * 700 AS ms, created_at, epoch_us({NOWS}) - epoch_us(created_at) AS us FROM {{call_log}}),
      a AS (SELECT *, CAST(floor(ms / 1000 + 0.5) AS BIGINT) AS s, floor(us / 1000000 + 0.5) AS ds FROM d),
      b AS (SELECT *, s // 60 AS m, floor(ds / 60 + 0.5) AS dm, floor(floor(ds / 60 + 0.5) / 60 + 0.5) AS dh, floor(floor(floor(ds / 60 + 0.5) / 60 + 0.5) / 24 + 0.5) AS dd FROM a)
      SELECT id, CASE WHEN ms < 0 THEN '—' WHEN ms < 1000 THEN '<1 dtk' WHEN s < 60 THEN s || ' dtk' WHEN m < 60 AND s % 60 = 0 THEN m || ' mnt'
          WHEN m < 60 THEN m || ' mnt ' || (s % 60) || ' dtk' WHEN m % 60 = 0 THEN (m // 60) || ' jam' ELSE (m // 60) || ' jam ' || (m % 60) || ' mnt' END AS duration,
        CASE WHEN us < 0 OR ds < 30 THEN 'baru saja' WHEN ds < 60 THEN CAST(ds AS BIGINT) || ' detik yang lalu' WHEN dm < 60 THEN CAST(dm AS BIGINT) || ' menit yang lalu'
          WHEN dh < 24 THEN CAST(dh AS BIGINT) || ' jam yang lalu' WHEN dd = 1 THEN 'kemarin' WHEN dd < 7 THEN CAST(dd AS BIGINT) || ' hari yang lalu'
          ELSE day(created_at) || ' ' || ['Jan','Feb','Mar','Apr','Mei','Jun','Jul','Agu','Sep','Okt','Nov','Des'][month(created_at)] END AS age FROM b""",
)
def labels(spark, sf):
    return calls(spark, sf).select(
        "id", LB.format_duration(F.col("duration_ms") * 700).alias("duration"),
        LB.relative_time(F.col("created_at"), now()).alias("age"),
    )


@query(
    "ag8_tier_percentages",
    """WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS l, count(*) FILTER (WHERE event_type = 'purchase') AS d,
         count(*) FILTER (WHERE event_type IN ('signup', 'error')) AS u, count(*) AS t FROM {events} GROUP BY 1),
      s AS (SELECT user_id, t, k, o, n, floor(n / t * 100) AS f, n / t * 100 - floor(n / t * 100) AS r FROM c, LATERAL (VALUES ('local', 1, l), ('daring', 2, d), ('unverified', 3, u)) v(k, o, n)),
      x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC, o) AS rk, 100 - sum(f) OVER (PARTITION BY user_id) AS rest FROM s)
      SELECT user_id, k AS tier, CAST(n AS BIGINT) AS n, CAST(f + CASE WHEN rk <= rest THEN 1 ELSE 0 END AS INTEGER) AS percent FROM x WHERE n > 0""",
)
def tier_percentages(spark, sf):
    from naskah.operators.findings import tier_percentages as op

    e = F.col("event_type")
    counts = table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(e.isin("view", "click")).alias("local"),
        F.count_if(e == "purchase").alias("daring"),
        F.count_if(e.isin("signup", "error")).alias("unverified"),
    )
    return op(counts, "user_id")
