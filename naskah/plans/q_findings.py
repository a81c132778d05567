"""Findings and revision comparison over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.functions import labels as LB
from naskah.operators import compare as CP
from naskah.operators import findings as FD
from naskah.plans.fixtures import table, view
from naskah.plans.registry import query


def found(spark, sf):
    return view(spark, sf, "plant_findings")


TOKEN_SQL = """CASE WHEN rule_id LIKE 'kbbi.unknown-word%' THEN lower(nullif(regexp_extract(message, '^Kata "([^"]+)"', 1), '')) END"""


@query(
    "pf1_filter_findings",
    f"""SELECT id, page_number FROM {{plant_findings}} WHERE category IN ('kbbi') AND severity IN ('error', 'warning') AND resolved_at IS NULL
       AND page_number NOT IN (2, 3, 4, 9) AND (contains(lower(message), 'kata') OR contains(lower(coalesce(excerpt, '')), 'kata') OR contains(lower(coalesce(rule_id, '')), 'kata'))
       AND coalesce({TOKEN_SQL}, '') NOT IN ('sistim', 'resiko')""",
)
def filter_findings(spark, sf):
    vocab = spark.createDataFrame([("sistim", "brand"), ("resiko", "ignore")], "word string, classification string")
    return FD.filter_findings(
        found(spark, sf), categories=["kbbi"], severities=["error", "warning"], query="kata",
        excluded_pages="4-2, 9, 0, x", vocabulary=vocab,
    ).select("id", "page_number")


@query(
    "pf2_excluded_pages",
    """WITH t AS (SELECT event_id, event_id % 7 AS a, event_id % 11 AS b FROM {events}),
       p AS (SELECT event_id, unnest(range(least(a, b), greatest(a, b) + 1)) AS page FROM t UNION SELECT event_id, a FROM t WHERE a > 0)
       SELECT DISTINCT event_id, CAST(page AS INTEGER) AS page FROM p""",
)
def excluded_pages(spark, sf):
    a, b = (F.col("event_id") % 7).cast("string"), (F.col("event_id") % 11).cast("string")
    text = F.concat(a, F.lit(" - "), b, F.lit(", x, ,"), a, F.lit(",1-"))
    return table(spark, sf, "events").select(
        "event_id", F.explode(FD.parse_excluded_pages(text)).alias("page")
    )


@query(
    "pf6_classify_fixes",
    """SELECT id, coalesce(rule_id = 'eyd.foreign-not-italic', false) AND coalesce(trim(token) <> '', false) AS is_italic,
       ((coalesce(trim(suggestion) <> '', false) AND coalesce(trim(token) <> '', false)) OR (coalesce(rule_id = 'eyd.foreign-not-italic', false) AND coalesce(trim(token) <> '', false))) AND resolved_at IS NULL AS eligible,
       coalesce(trim(suggestion) <> '', false) AND coalesce(trim(token) <> '', false) AND resolved_at IS NULL AND category = 'eyd' AND coalesce(rule_id, '') <> 'eyd.foreign-not-italic' AS default_checked
       FROM {plant_findings}""",
)
def classify_fixes(spark, sf):
    return FD.classify_fixes(found(spark, sf)).select("id", "is_italic", "eligible", "default_checked")


@query(
    "ag16_group_findings",
    """SELECT job_id, rule_id, severity, message, suggestion, CAST(count(*) AS BIGINT) AS n, CAST(count(resolved_at) AS BIGINT) AS resolved,
       min(page_number) AS first_page, max(page_number) AS last_page, CAST(count(DISTINCT page_number) AS BIGINT) AS pages FROM {plant_findings} GROUP BY 1, 2, 3, 4, 5""",
)
def group_findings(spark, sf):
    return FD.group_findings(found(spark, sf))


SCORE = """CASE WHEN {k} + {e} = 0 THEN 100 WHEN {p} IS NULL OR {p} <= 0 THEN greatest(0, least(100, floor(100 - ({k} + {e}) * 0.5::DOUBLE + 0.5)))
  ELSE greatest(0, least(100, floor(100 - (({k} + {e}) / {p}) * 14 + 0.5))) END"""


def score_sql(k: str, e: str, p: str) -> str:
    return f"CAST({SCORE.replace('{k}', k).replace('{e}', e).replace('{p}', p)} AS INTEGER)"


@query(
    "ag5_summarise_findings",
    f"""WITH c AS (SELECT job_id, count(*) FILTER (WHERE category = 'kbbi' AND severity <> 'info') AS kbbi, count(*) FILTER (WHERE category = 'eyd' AND severity <> 'info') AS eyd
         FROM {{plant_findings}} GROUP BY 1)
       SELECT job_id, total_pages, CAST(coalesce(kbbi, 0) AS BIGINT) AS kbbi, CAST(coalesce(eyd, 0) AS BIGINT) AS eyd, {score_sql('coalesce(kbbi, 0)', 'coalesce(eyd, 0)', 'total_pages')} AS score
       FROM {{plant_evals}} LEFT JOIN c USING (job_id)""",
)
def summarise_findings(spark, sf):
    return FD.summarise_findings(found(spark, sf), view(spark, sf, "plant_evals"))


@query(
    "ag6_score",
    f"""SELECT job_id, {score_sql('k', 'e', 'total_pages')} AS score FROM (SELECT job_id, total_pages, length(job_id) * 3 AS k, length(filename) AS e FROM {{plant_orders}})""",
)
def score(spark, sf):
    return view(spark, sf, "plant_orders").select(
        "job_id", LB.score(F.length("job_id") * 3, F.length("filename"), F.col("total_pages")).alias("score")
    )


KEY = """category || '|' || coalesce(rule_id, '_') || '|' || regexp_replace(trim(lower(coalesce(token, ''))), '[^\\p{L}\\p{N}-]', '', 'g') || '|'
  || left(trim(regexp_replace(lower(coalesce(excerpt, '')), '\\s+', ' ', 'g')), 40)"""
BUCKETS = f"""
  f AS (SELECT *, {KEY} AS key FROM {{plant_findings}}),
  a AS (SELECT pair, key, count(*) AS n, arg_min(id, (coalesce(page_number, 2147483647), coalesce("offset", 0), id)) AS sample FROM f WHERE side = 'before' GROUP BY 1, 2),
  b AS (SELECT pair, key, count(*) AS n, arg_min(id, (coalesce(page_number, 2147483647), coalesce("offset", 0), id)) AS sample FROM f WHERE side = 'after' GROUP BY 1, 2),
  buckets AS (SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.key, b.key) AS key, split_part(coalesce(a.key, b.key), '|', 1) AS category,
    nullif(split_part(coalesce(a.key, b.key), '|', 2), '_') AS rule_id, CAST(coalesce(a.n, 0) AS BIGINT) AS before_count, CAST(coalesce(b.n, 0) AS BIGINT) AS after_count,
    CAST(coalesce(b.n, 0) - coalesce(a.n, 0) AS BIGINT) AS delta, a.sample AS sample_before, b.sample AS sample_after,
    CASE WHEN b.n IS NULL THEN 'resolved' WHEN a.n IS NULL THEN 'introduced' ELSE 'still-present' END AS bucket
    FROM a FULL JOIN b ON a.pair = b.pair AND a.key = b.key)"""


@query("jn16_compare_findings", f"WITH {BUCKETS} SELECT * FROM buckets")
def compare_findings(spark, sf):
    return CP.compare_findings(found(spark, sf))


DELTAS = """deltas AS (SELECT pair, rule_id, min(category) AS category, CAST(count(*) FILTER (WHERE side = 'before') AS BIGINT) AS before, CAST(count(*) FILTER (WHERE side = 'after') AS BIGINT) AS after,
   CAST(count(*) FILTER (WHERE side = 'after') - count(*) FILTER (WHERE side = 'before') AS BIGINT) AS delta FROM {plant_findings} WHERE rule_id IS NOT NULL GROUP BY 1, 2)"""


@query("ag14_rule_deltas", f"WITH {DELTAS} SELECT * FROM deltas")
def rule_deltas(spark, sf):
    return CP.rule_deltas(found(spark, sf))


@query(
    "tk3_top_rule_changes",
    f"""WITH {DELTAS} SELECT pair, change, rule_id, delta, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY pair, change ORDER BY abs(delta) DESC, rule_id) AS rn
        FROM (SELECT *, CASE WHEN delta < 0 THEN 'reduction' ELSE 'regression' END AS change FROM deltas WHERE delta <> 0)) WHERE rn <= 5""",
)
def top_rule_changes(spark, sf):
    return CP.top_rule_changes(rule_deltas(spark, sf), 5).select("pair", "change", "rule_id", "delta", "rank")


@query(
    "ag15_group_by_rule",
    f"""WITH {BUCKETS} SELECT pair, bucket, category, rule_id, CAST(count(*) AS BIGINT) AS buckets, CAST(sum(before_count) AS BIGINT) AS before_total,
        CAST(sum(after_count) AS BIGINT) AS after_total, CAST(greatest(sum(before_count), sum(after_count)) AS BIGINT) AS weight FROM buckets GROUP BY 1, 2, 3, 4""",
)
def group_by_rule(spark, sf):
    return CP.group_by_rule(compare_findings(spark, sf))


@query(
    "ag15_rule_members",
    f"""WITH {BUCKETS} SELECT pair, bucket, category, rule_id, key, CAST(before_count AS BIGINT) AS before_count, CAST(after_count AS BIGINT) AS after_count,
        CAST(greatest(sum(before_count) OVER g, sum(after_count) OVER g) AS BIGINT) AS weight FROM buckets WINDOW g AS (PARTITION BY pair, bucket, category, rule_id)""",
)
def rule_members(spark, sf):
    return CP.rule_members(compare_findings(spark, sf)).select(
        "pair", "bucket", "category", "rule_id", "key", "before_count", "after_count", "weight"
    )


_METRICS = {
    "total": "true", "kbbi": "category = 'kbbi'", "eyd": "category = 'eyd'",
    "error": "severity = 'error'", "warning": "severity = 'warning'", "info": "severity = 'info'",
}
_PAIRS = "pairs AS (SELECT DISTINCT pair, CAST(10 + length(pair) AS INTEGER) AS pb, CAST(CASE WHEN pair = 'P1' THEN 0 ELSE 9 END AS INTEGER) AS pa FROM {plant_findings})"
_PCT = "CASE WHEN before <> 0 THEN floor((after - before) / before * 1000 + 0.5) / 10 END"


@query(
    "ag13_scoreboard",
    f"WITH {_PAIRS}, m AS ("
    + " UNION ALL ".join(
        f"SELECT pair, '{m}' AS metric, count(*) FILTER (WHERE side = 'before') AS before, count(*) FILTER (WHERE side = 'after') AS after FROM {{plant_findings}} WHERE {c} GROUP BY 1"
        for m, c in _METRICS.items()
    )
    + f"""), s AS (SELECT pair, {score_sql('tb', '0', 'pb')} AS before, {score_sql('ta', '0', 'pa')} AS after FROM pairs JOIN (SELECT pair, before AS tb, after AS ta FROM m WHERE metric = 'total') USING (pair))
      SELECT pair, metric, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after, CAST(after - before AS BIGINT) AS delta, CAST({_PCT} AS DOUBLE) AS pct_change FROM m
      UNION ALL SELECT pair, 'score', before, after, after - before, NULL FROM s""",
)
def scoreboard(spark, sf):
    jobs = found(spark, sf).select("pair").distinct().select(
        "pair", (F.lit(10) + F.length("pair")).alias("pages_before"),
        F.when(F.col("pair") == "P1", 0).otherwise(9).alias("pages_after"),
    )
    return CP.scoreboard(found(spark, sf), jobs)


_STRIP = "trim(regexp_replace(regexp_replace(lower({x}), '\\.[a-z0-9]+$', ''), '[-_ ]?(v|rev|revisi|final|fix)[-_ ]?[0-9]*$', ''))"


@query(
    "ag21_name_similarity",
    f"""WITH n AS (SELECT p_partkey, {_STRIP.replace('{x}', "p_name || '_Final 2.PDF'")} AS a, {_STRIP.replace('{x}', "p_type || '-v3.docx'")} AS b FROM {{part}})
       SELECT p_partkey, CAST(floor((CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END) * 100 + 0.5) / 100 AS DOUBLE) AS similarity FROM n""",
)
def name_similarity(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        LB.name_similarity(
            F.concat("p_name", F.lit("_Final 2.PDF")), F.concat("p_type", F.lit("-v3.docx"))
        ).alias("similarity"),
    )


@query(
    "rt3_orient",
    """SELECT event_id, CASE WHEN (ts <= ts + INTERVAL 1 DAY * (event_id % 3 - 1)) <> (event_id % 2 = 0) THEN 'a' ELSE 'b' END AS before_id,
       CASE WHEN (ts <= ts + INTERVAL 1 DAY * (event_id % 3 - 1)) <> (event_id % 2 = 0) THEN 'b' ELSE 'a' END AS after_id FROM {events}""",
)
def orient(spark, sf):
    days = (F.col("event_id") % 3 - 1) * 86400
    pairs = table(spark, sf, "events").select(
        "event_id", F.lit("a").alias("a_id"), F.col("ts").alias("a_created"), F.lit("b").alias("b_id"),
        (F.col("ts") + F.make_dt_interval(secs=days)).alias("b_created"), (F.col("event_id") % 2 == 0).alias("swap"),
    )
    return CP.orient(pairs).select("event_id", "before_id", "after_id")


@query(
    "tx31_finding_needle",
    """SELECT id, coalesce(nullif(trim(token), ''), nullif(trim(regexp_extract(message, '"([^"]+)"', 1)), ''),
       list_filter(list_transform(regexp_split_to_array(excerpt, '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+$', '')), lambda w: length(w) >= 5)[1]) AS needle FROM {plant_findings}""",
)
def finding_needle(spark, sf):
    return found(spark, sf).select(
        "id", LB.finding_needle(F.col("token"), F.col("message"), F.col("excerpt")).alias("needle")
    )


_SLUG = "trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    "tx32_derive_filename",
    f"""WITH s AS (SELECT reference_id, {_SLUG.replace('{x}', "trim(regexp_split_to_array(author, '(?i),|&|\\bet al\\.?\\b|\\band\\b')[1])")} AS a, lower(left(regexp_replace(year, '[^0-9a-zA-Z]', '', 'g'), 6)) AS y FROM {{plant_refs}})
       SELECT reference_id, CASE WHEN a <> '' AND y <> '' THEN a || '-' || y || '.pdf' WHEN a <> '' THEN a || '.pdf' ELSE 'sumber.pdf' END AS filename FROM s""",
)
def derive_filename(spark, sf):
    return view(spark, sf, "plant_refs").select(
        "reference_id", LB.derive_filename(F.col("title"), F.col("author"), F.col("year")).alias("filename")
    )


@query(
    "sc10_export_findings",
    """SELECT CASE category WHEN 'kbbi' THEN 'KBBI' ELSE 'EYD' END AS "Category", CASE severity WHEN 'error' THEN 'Error' WHEN 'warning' THEN 'Warning' ELSE 'Info' END AS "Severity",
       coalesce(CAST(page_number AS VARCHAR), '') AS "Page", coalesce(rule_id, '') AS "Rule ID", message AS "Message", coalesce(excerpt, '') AS "Excerpt", coalesce(suggestion, '') AS "Suggestion" FROM {plant_findings}""",
)
def export_findings(spark, sf):
    from naskah.sources.exports import findings_export

    return findings_export(found(spark, sf))


@query(
    "ed4_set_resolved",
    """SELECT id, CASE WHEN id % 17 = 3 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE resolved_at END AS resolved_at FROM {plant_findings}""",
)
def set_resolved(spark, sf):
    from naskah.operators.edits import set_resolved as op

    ids = found(spark, sf).filter("id % 17 = 3").select("id")
    return op(found(spark, sf), ids, F.lit("2024-03-01").cast("timestamp")).select("id", "resolved_at")
