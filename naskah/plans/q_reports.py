"""Trace reports, history, exports, edits and keyed writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.functions import text as T
from naskah.operators import calls as CL
from naskah.operators import edits as E
from naskah.operators import fonts as FN
from naskah.operators import passages as P
from naskah.operators import reports as R
from naskah.plans.fixtures import table, view
from naskah.plans.q_findings import score_sql
from naskah.plans.registry import query
from naskah.session import materialize
from naskah.sources import exports as X
from naskah.sources import tables as TB


def _v(spark, sf, *names):
    return [view(spark, sf, n) for n in names]


# The stored results of a track job, by rule from plant_refs (see fixtures).
STATUS = """CASE WHEN match_type IS NULL OR match_type = 'unmatched' THEN 'not-found' WHEN coalesce(source_status, '') <> 'done' THEN 'no-source'
  WHEN passage_confidence >= 0.8 THEN 'verified' WHEN passage_confidence > 0 THEN 'needs-review' ELSE 'not-found' END"""
TRACE = f"""
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, citation_key ORDER BY thesis_page, citation_id) AS rn FROM {{t_citations}}) WHERE rn = 1),
  sc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, reference_id ORDER BY source_id) AS rn FROM {{plant_sources}}) WHERE rn = 1),
  ps AS (SELECT * FROM (SELECT p.*, c.citation_key, row_number() OVER (PARTITION BY p.job_id, c.citation_key ORDER BY passage_id) AS rn
         FROM {{t_passages}} p JOIN {{t_citations}} c USING (citation_id)) WHERE rn = 1),
  traces AS (SELECT *, {STATUS} AS status FROM (SELECT u.job_id, u.citation_key, u.thesis_page, u.thesis_context, r.title AS reference_title, r.author AS reference_author,
      m.match_type, m.confidence AS match_confidence, ps.source_page, ps.matched_passage, ps.confidence AS passage_confidence, ps.reasoning, sc.status AS source_status
    FROM u LEFT JOIN {{t_matches}} m ON m.job_id = u.job_id AND m.citation_key = u.citation_key LEFT JOIN {{plant_refs}} r ON r.reference_id = m.reference_id
    LEFT JOIN sc ON sc.job_id = u.job_id AND sc.reference_id = m.reference_id LEFT JOIN ps ON ps.job_id = u.job_id AND ps.citation_key = u.citation_key))"""
_COLS = ["job_id", "citation_key", "thesis_page", "thesis_context", "reference_title", "reference_author", "match_type",
         "match_confidence", "source_page", "matched_passage", "passage_confidence", "reasoning", "source_status", "status"]


def traces(spark, sf):
    cites, matches, refs, sources, passages = _v(spark, sf, "t_citations", "t_matches", "plant_refs", "plant_sources", "t_passages")
    unique = cites.groupBy("job_id", "citation_key").agg(
        F.min(F.struct("thesis_page", "citation_id", "thesis_context")).alias("f")
    ).select("job_id", "citation_key", "f.thesis_page", "f.thesis_context")
    return R.trace_report(unique, cites, matches, refs, sources, passages).select(*_COLS)


@query("jn13_trace_report", f"WITH {TRACE} SELECT {', '.join(_COLS)} FROM traces")
def trace_report(spark, sf):
    return traces(spark, sf)


@query("st1_trace_status", f"WITH {TRACE} SELECT status, match_type, source_status, CAST(count(*) AS BIGINT) AS n FROM traces GROUP BY 1, 2, 3")
def trace_status(spark, sf):
    return traces(spark, sf).groupBy("status", "match_type", "source_status").agg(F.count("*").alias("n"))


@query(
    "ag3_trace_summary",
    f"""WITH {TRACE} SELECT job_id, CAST(count(*) AS BIGINT) AS unique_citations, CAST(count(*) FILTER (WHERE status IN ('verified', 'needs-review')) AS BIGINT) AS matched,
      CAST(count(source_page) AS BIGINT) AS passages_found, CAST(coalesce(floor(avg(CAST(round(passage_confidence * 100) AS BIGINT)) + 0.5) / 100, 0) AS DOUBLE) AS avg_confidence,
      CAST(count(*) FILTER (WHERE status = 'verified') AS BIGINT) AS verified, CAST(count(*) FILTER (WHERE status = 'needs-review') AS BIGINT) AS needs_review,
      CAST(count(*) FILTER (WHERE status = 'no-source') AS BIGINT) AS no_source, CAST(count(*) FILTER (WHERE status = 'not-found') AS BIGINT) AS not_found,
      any_value(t) AS total_citations FROM traces JOIN (SELECT job_id, count(*) AS t FROM {{t_citations}} GROUP BY 1) USING (job_id) GROUP BY 1""",
)
def trace_summary(spark, sf):
    return R.trace_summary(traces(spark, sf), view(spark, sf, "t_citations"))


@query(
    "pf5_filter_traces",
    f"""WITH {TRACE} SELECT job_id, citation_key FROM traces WHERE status = 'needs-review'
        AND (contains(lower(citation_key), 'jar') OR contains(lower(thesis_context), 'jar') OR contains(lower(coalesce(reference_title, '')), 'jar') OR contains(lower(coalesce(matched_passage, '')), 'jar'))""",
)
def filter_traces(spark, sf):
    return R.filter_traces(traces(spark, sf), "needs-review", "JAR").select("job_id", "citation_key")


@query(
    "tk5_sort_report",
    f"""WITH {TRACE} SELECT job_id, citation_key, CAST(CASE status WHEN 'verified' THEN 0 WHEN 'needs-review' THEN 1 WHEN 'no-source' THEN 2 ELSE 3 END AS INTEGER) AS status_rank,
        coalesce(passage_confidence, -1) AS sort_confidence FROM traces""",
)
def sort_report(spark, sf):
    return R.sort_traces(traces(spark, sf), "status").select(
        "job_id", "citation_key", R.rank_of(F.col("status"), R.STATUS_ORDER).alias("status_rank"),
        F.coalesce("passage_confidence", F.lit(-1.0)).alias("sort_confidence"),
    )


@query(
    "sc8_export_trace_csv",
    f"""WITH {TRACE} SELECT citation_key AS "Citation", CAST(thesis_page AS VARCHAR) AS "Thesis Page", thesis_context AS "Thesis Context", coalesce(reference_author, '') AS "Reference Author",
      coalesce(reference_title, '') AS "Reference Title", coalesce(match_type, '') AS "Match Type", coalesce(CAST(source_page AS VARCHAR), '') AS "Source Page",
      coalesce(matched_passage, '') AS "Matched Passage", coalesce(CAST(CAST(floor(passage_confidence * 100 + 0.5) AS BIGINT) AS VARCHAR), '') AS "Confidence (%)",
      coalesce(reasoning, '') AS "Reasoning", status AS "Status" FROM traces""",
)
def export_trace_csv(spark, sf):
    from naskah.session import scratch_dir

    out = X.trace_export(traces(spark, sf))
    path = scratch_dir(spark, "trace-csv")
    X.write_csv(out, path)
    back = spark.read.csv(path, header=True, schema=out.schema, quote='"', escape='"', multiLine=True)
    return back.fillna("")


@query("sc9_export_trace_json")
def export_trace_json(spark, sf):
    t = traces(spark, sf)
    jobs = t.select("job_id").distinct().withColumn("filename", F.concat("job_id", F.lit(".pdf")))
    return X.trace_json(t, jobs, R.trace_summary(t, view(spark, sf, "t_citations")), F.lit("2024-01-01T00:00:00Z"))


@query(
    "ag4_history_counts",
    """SELECT job_id, CAST(coalesce(c, 0) AS BIGINT) AS total_citations, CAST(coalesce(m, 0) AS BIGINT) AS matched_citations, CAST(coalesce(p, 0) AS BIGINT) AS passages_found
       FROM {plant_orders} LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS job_id, count(*) AS c, nullif(count(*) FILTER (WHERE l_returnflag <> 'N'), 0) AS m, nullif(count(*) FILTER (WHERE l_linenumber = 1), 0) AS p FROM {lineitem} GROUP BY 1) USING (job_id)""",
)
def history_counts(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("job_id"), "l_linenumber",
        F.when(F.col("l_returnflag") == "N", "unmatched").otherwise("exact").alias("match_type"),
    )
    jobs = view(spark, sf, "plant_orders").select("job_id")
    return R.history_counts(jobs, li, li, li.filter("l_linenumber = 1"))


@query(
    "st6_history_state",
    """SELECT job_id, CASE WHEN status IN ('done', 'failed') THEN CAST(greatest(0, epoch_ms(updated_at) - epoch_ms(created_at)) AS BIGINT) END AS duration_ms, phase = 'review-passages' AS complete FROM {plant_orders}""",
)
def history_state(spark, sf):
    return R.history_state(view(spark, sf, "plant_orders")).select("job_id", "duration_ms", "complete")


def _stage(stage: str, total: str, done: str, st: str, sd: str, state: str) -> str:
    pct = f"floor({done} / {total} * 100 + 0.5)"
    pct = f"least(100, {pct})" if stage == "kbbi" else pct
    return f"""SELECT job_id, '{stage}' AS stage, {state} AS state, CAST(CASE WHEN {total} > 0 THEN {sd} END AS BIGINT) AS processed,
      CAST(CASE WHEN {total} > 0 THEN {st} END AS BIGINT) AS total, CAST(CASE WHEN {total} > 0 THEN {pct} END AS BIGINT) AS pct FROM {{plant_evals}}"""


def _state(s: str) -> str:
    return f"CASE WHEN {s}_total > 0 AND {s}_progress >= {s}_total THEN 'done' WHEN status = 'done' THEN 'done' WHEN status = 'analyzing' THEN 'running' ELSE 'waiting' END"


@query(
    "st2_stage_progress",
    " UNION ALL ".join([
        _stage("extract", "total_pages", "extracted_pages", "total_pages", "extracted_pages", "CASE status WHEN 'pending' THEN 'waiting' WHEN 'extracting' THEN 'running' ELSE 'done' END"),
        _stage("kbbi", "kbbi_total", "kbbi_progress", "greatest(1, floor(kbbi_total / 100 + 0.5))", "least(greatest(1, floor(kbbi_total / 100 + 0.5)), ceil(kbbi_progress / 100))", _state("kbbi")),
        _stage("eyd", "eyd_total", "eyd_progress", "eyd_total", "eyd_progress", _state("eyd")),
    ]),
)
def stage_progress(spark, sf):
    return R.stage_progress(view(spark, sf, "plant_evals"))


@query(
    "jn14_list_batches",
    """WITH b AS (SELECT m.job_id, s.source_id, count(DISTINCT citation_key) AS n FROM {t_matches} m JOIN {plant_sources} s ON s.job_id = m.job_id AND s.reference_id = m.reference_id AND s.status = 'done'
         WHERE match_type <> 'unmatched' GROUP BY 1, 2)
       SELECT b.job_id, b.source_id, CAST(n AS BIGINT) AS citation_count, CAST(row_number() OVER (PARTITION BY b.job_id ORDER BY b.source_id) AS INTEGER) AS batch_index, filename,
         author || ' (' || year || ')' AS reference_label FROM b JOIN {plant_sources} s USING (source_id) JOIN {plant_refs} r ON r.reference_id = s.reference_id""",
)
def list_batches(spark, sf):
    matches, sources, refs = _v(spark, sf, "t_matches", "plant_sources", "plant_refs")
    batches = P.passage_batches(matches, sources)
    return R.list_batches(batches, sources.drop("job_id", "status", "updated_at"), refs.drop("job_id")).select(
        "job_id", "source_id", "citation_count", "batch_index", "filename", "reference_label"
    )


@query(
    "jn14_list_matches",
    "SELECT m.job_id, citation_key, m.reference_id, match_type, title AS reference_title FROM {t_matches} m LEFT JOIN {plant_refs} r ON r.reference_id = m.reference_id",
)
def list_matches(spark, sf):
    matches, refs = _v(spark, sf, "t_matches", "plant_refs")
    return R.list_matches(matches, refs).select("job_id", "citation_key", "reference_id", "match_type", "reference_title")


@query(
    "jn14_list_passages",
    """SELECT p.job_id, p.passage_id, c.citation_key, c.thesis_context, c.thesis_page, p.source_page, p.matched_passage, p.confidence, p.reasoning,
         s.filename, r.author || ' (' || r.year || ')' AS reference_label
       FROM {t_passages} p JOIN {t_citations} c USING (citation_id) JOIN {plant_sources} s ON s.source_id = (p.citation_id // 2) * 10
       LEFT JOIN (SELECT reference_id, author, CASE WHEN reference_id % 4 <> 0 THEN year END AS year FROM {plant_refs}) r ON r.reference_id = s.reference_id""",
)
def list_passages(spark, sf):
    passages, cites, sources, refs = _v(spark, sf, "t_passages", "t_citations", "plant_sources", "plant_refs")
    found_in = passages.withColumn("source_id", F.floor(F.col("citation_id") / 2) * 10)
    dated = refs.withColumn("year", F.when(F.col("reference_id") % 4 != 0, F.col("year")))
    return R.list_passages(found_in, cites, sources, dated)


@query(
    "tk5_sort_findings",
    """SELECT category, page_number, "offset", rule_id, CAST(row_number() OVER (ORDER BY CASE category WHEN 'kbbi' THEN 0 ELSE 1 END, page_number NULLS FIRST, "offset" NULLS FIRST, rule_id NULLS FIRST, id) AS BIGINT) AS place
       FROM {plant_findings} QUALIFY place <= 200""",
)
def sort_findings(spark, sf):
    """The first 200 of the report; the order is the operator's, the limit that of one screen."""
    top = R.sort_findings(view(spark, sf, "plant_findings")).limit(200)
    return top.select("category", "page_number", "offset", "rule_id", (F.monotonically_increasing_id() + 1).alias("place"))


@query(
    "bt1_passage_batches",
    """SELECT job_id, source_id, CAST(n AS BIGINT) AS citation_count, CAST(row_number() OVER (PARTITION BY job_id ORDER BY source_id) AS INTEGER) AS batch_index FROM (
         SELECT m.job_id, s.source_id, count(DISTINCT citation_key) AS n FROM {t_matches} m JOIN {plant_sources} s ON s.job_id = m.job_id AND s.reference_id = m.reference_id AND s.status = 'done'
         WHERE match_type <> 'unmatched' GROUP BY 1, 2)""",
)
def passage_batches(spark, sf):
    return P.passage_batches(*_v(spark, sf, "t_matches", "plant_sources"))


@query(
    "jn17_no_source",
    """SELECT job_id, citation_key, reference_id FROM {t_matches} m WHERE match_type <> 'unmatched' AND reference_id IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM {plant_sources} s WHERE s.job_id = m.job_id AND s.reference_id = m.reference_id AND s.status = 'done')""",
)
def no_source(spark, sf):
    return R.no_source(*_v(spark, sf, "t_matches", "plant_sources")).select("job_id", "citation_key", "reference_id")


@query(
    "jn15_eval_history",
    f"""SELECT job_id, CASE WHEN kbbi IS NOT NULL THEN {score_sql('kbbi', 'eyd', 'total_pages')} END AS overall_score, kbbi + eyd AS error_count
        FROM {{plant_evals}} LEFT JOIN (SELECT job_id, count(*) FILTER (WHERE category = 'kbbi') AS kbbi, count(*) FILTER (WHERE category = 'eyd') AS eyd FROM {{plant_findings}} GROUP BY 1) USING (job_id)
        WHERE status = 'done' AND job_id <> 'E8'""",
)
def eval_history(spark, sf):
    c = F.col("category")
    summaries = view(spark, sf, "plant_findings").groupBy("job_id").agg(
        F.count_if(c == "kbbi").alias("kbbi"), F.count_if(c == "eyd").alias("eyd")
    )
    return R.eval_history(view(spark, sf, "plant_evals"), summaries, current="E8").select(
        "job_id", "overall_score", "error_count"
    )


@query(
    "sc5_upsert",
    """SELECT c_custkey, coalesce(v, c_acctbal) AS balance, CAST(coalesce(o, 0) AS BIGINT) AS version FROM {customer}
       LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS v, max(o_orderkey) AS o FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""",
)
def upsert(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.lit(0).cast("bigint").alias("version"))
    delta = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("version")
    )
    return TB.upsert(base, delta, ["c_custkey"], "version")


@query(
    "sc6_insert_missing",
    """SELECT l_orderkey, l_linenumber, 'old' AS origin FROM {lineitem} WHERE l_quantity < 30 UNION ALL
       SELECT DISTINCT l_orderkey, l_linenumber, 'new' FROM {lineitem} n WHERE NOT EXISTS (SELECT 1 FROM {lineitem} o WHERE o.l_quantity < 30 AND o.l_orderkey = n.l_orderkey AND o.l_linenumber = n.l_linenumber)""",
)
def insert_missing(spark, sf):
    keys = ["l_orderkey", "l_linenumber"]
    li = table(spark, sf, "lineitem")
    base = li.filter("l_quantity < 30").select(*keys, F.lit("old").alias("origin"))
    return TB.insert_missing(base, li.select(*keys).distinct().withColumn("origin", F.lit("new")), keys)


@query(
    "sc7_replace_partition",
    """SELECT o_custkey % 16 AS job_bucket, o_orderkey, CASE WHEN o_custkey % 16 < 4 THEN 'second' ELSE 'first' END AS written FROM {orders}
       WHERE o_custkey % 16 <> 7""",
)
def replace_partition(spark, sf):
    from naskah.session import scratch_dir

    path = scratch_dir(spark, "by-job")
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 16).alias("job_bucket"), "o_orderkey")
    TB.replace_partition(rows.withColumn("written", F.lit("first")), path)
    again = rows.filter("job_bucket < 4").withColumn("written", F.lit("second"))
    # Bucket 7 is replaced as well, by nothing.
    replaced = rows.filter("job_bucket < 4 OR job_bucket = 7").select("job_bucket")
    TB.replace_partition(again, path, replaced=replaced)
    TB.replace_partition(again, path, replaced=replaced)
    return spark.read.schema("o_orderkey bigint, written string, job_bucket bigint").parquet(path)


# Fixes: rule hits of planted pages, some stale, some without a suggestion, some italic.
def fixes(spark, sf):
    from naskah.operators import rules as RU

    pages = view(spark, sf, "plant_pages")
    hits = RU.scan_rules(pages, RU.RULES, T.parse_ranges(F.col("code_json")), links=True)
    n = F.col("offset") + F.col("page_number") * 1000
    return hits.select(
        "job_id", "page_number", "rule_id",
        (F.pmod(F.xxhash64("job_id"), F.lit(1 << 30)) * (1 << 20) + n * 20 + F.length("rule_id") % 20).alias("finding_id"),
        "offset", "length",
        F.when(n % 11 == 0, F.concat("token", F.lit("?"))).otherwise(F.col("token")).alias("token"),
        F.when(n % 7 == 0, F.lit("")).otherwise(F.col("suggestion")).alias("suggestion"),
        (n % 5 == 0).alias("is_italic"),
        F.lit("eyd").alias("category"), "excerpt",
    )


@query("ed1_apply_fixes")
def apply_fixes(spark, sf):
    out = E.apply_fixes(view(spark, sf, "plant_pages").select("job_id", "page_number", "content"), fixes(spark, sf))
    return out.select(
        "job_id", "page_number", "new_content",
        F.to_json("italic_ranges").alias("italic_ranges"),
        F.size(F.filter("log", lambda x: x["reason"].isNull())).alias("applied"),
    )


def _log(spark, sf):
    f = materialize(fixes(spark, sf), "fixes")
    pages = view(spark, sf, "plant_pages").select("job_id", "page_number", "content")
    return E.change_log(f, E.apply_fixes(pages, f))


@query("ed3_change_log")
def change_log(spark, sf):
    return _log(spark, sf).groupBy("applied", "kind", "reason").agg(F.count("*").alias("n"))


@query("sc11_change_log_report")
def change_log_report(spark, sf):
    return X.change_log_lines(_log(spark, sf))


@query("ed2_reanchor")
def reanchor(spark, sf):
    # The revised text of a page is the page behind a new sentence.
    texts = view(spark, sf, "plant_pages").select(
        F.concat_ws("/", "job_id", "page_number").alias("job_id"),
        F.concat(F.lit("Kalimat baru di depan. "), "content").alias("text"),
    )
    f = fixes(spark, sf).withColumn("job_id", F.concat_ws("/", "job_id", "page_number"))
    return E.reanchor(f, texts)


# The whole excerpt is there, or all of it but the first word, or only its longest words, or nothing.
@query(
    "tx30_locate_excerpt",
    """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM {documents}),
       q AS (SELECT doc_id, t, CASE doc_id % 3 WHEN 0 THEN trim(substr(t, 30, 60)) WHEN 1 THEN trim('zzqx ' || trim(substr(t, 40, 50))) ELSE 'zzqx zzqy 12' END AS q,
         CASE WHEN doc_id % 3 = 1 THEN trim(substr(t, 40, 50)) END AS rest FROM d),
       w AS (SELECT *, list_filter(regexp_split_to_array(q, '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3 AND strpos(t, x) > 0) AS words FROM q),
       l AS (SELECT *, list_filter(words, lambda x: length(x) = list_max(list_transform(words, lambda y: length(y))))[1] AS longest FROM w)
       SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN strpos(t, q) - 1 WHEN doc_id % 3 = 2 THEN NULL WHEN length(rest) >= 8 THEN strpos(t, rest) - 1
         WHEN longest IS NOT NULL THEN strpos(t, longest) - 1 END AS INTEGER) AS start FROM l WHERE q <> ''""",
)
def locate_excerpt(spark, sf):
    from naskah.functions.passages import normalize

    t = normalize(F.col("text"))
    q = F.when(F.col("doc_id") % 3 == 0, F.substring(t, 30, 60)).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("zzqx "), F.trim(F.substring(t, 40, 50)))
    ).otherwise("zzqx zzqy 12")
    return table(spark, sf, "documents").withColumn("q", q).filter("trim(q) <> ''").select(
        "doc_id", E.locate_excerpt(F.col("text"), F.col("q"))["start"].alias("start")
    )


_RUNS = """
  r AS (SELECT * FROM {plant_runs}),
  pf AS (SELECT job_id, page_number, font_name, size, sum("end" - start) FILTER (WHERE NOT is_mono) AS chars, min(start) FILTER (WHERE NOT is_mono) AS first, sum("end" - start) AS allc FROM r GROUP BY 1, 2, 3, 4),
  lp AS (SELECT job_id, page_number FROM pf GROUP BY 1, 2 HAVING sum(allc) >= 200),
  us AS (SELECT pf.* FROM pf JOIN lp USING (job_id, page_number) WHERE chars > 0),
  bs AS (SELECT job_id, page_number, size AS body_size FROM (SELECT job_id, page_number, size, row_number() OVER (PARTITION BY job_id, page_number ORDER BY sum(chars) DESC, min(first)) AS rn FROM us GROUP BY 1, 2, 3) WHERE rn = 1),
  nr AS (SELECT us.* FROM us JOIN bs USING (job_id, page_number) WHERE abs(size - body_size) / body_size <= 0.05),
  bf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, page_number ORDER BY chars DESC, first) AS rn FROM nr) WHERE rn = 1),
  it AS (SELECT DISTINCT n.job_id, n.page_number, n.font_name FROM nr n JOIN bf b ON b.job_id = n.job_id AND b.page_number = n.page_number WHERE n.font_name <> b.font_name AND n.chars / b.chars <= 0.5)"""


@query("ag20_italic_fonts", f"WITH {_RUNS} SELECT job_id, page_number, font_name FROM it")
def italic_fonts(spark, sf):
    return FN.italic_fonts(view(spark, sf, "plant_runs"))


@query(
    "wn9_merge_runs",
    """WITH f AS (SELECT *, name_is_italic AND NOT is_mono AS flag FROM {plant_runs}),
       l AS (SELECT *, lag(flag) OVER w AS pf, lag("end") OVER w AS pe FROM f WINDOW w AS (PARTITION BY job_id, page_number ORDER BY start)),
       i AS (SELECT *, sum(CASE WHEN flag AND NOT (coalesce(pf, false) AND start <= pe + 2) THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, page_number ORDER BY start) AS isl FROM l),
       m AS (SELECT job_id, page_number, isl, min(start) AS s, max("end") AS e FROM i WHERE flag GROUP BY 1, 2, 3)
       SELECT job_id, page_number, CAST(least(s, 250) AS BIGINT) AS start, CAST(least(e, 250) AS BIGINT) AS "end" FROM m WHERE least(e, 250) > least(s, 250)""",
)
def merge_runs(spark, sf):
    merged = FN.merge_runs(view(spark, sf, "plant_runs"), F.col("name_is_italic") & ~F.col("is_mono"))
    return FN.clamp(merged, F.lit(250).cast("bigint"))
