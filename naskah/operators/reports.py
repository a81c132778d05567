"""Report joins, counts, status logic, sorts and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from naskah.functions import text as T


def best_per(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score per key, the lowest ``tie`` on equal scores."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(tie))).alias("b"))
        .select(*keys, "b.*")
    )


def track_diagnostics(cites: DataFrame, refs: DataFrame, matches: DataFrame) -> DataFrame:
    """Totals, match rate, orphans and unused references per job."""
    c = cites.groupBy("job_id", "citation_key").agg(F.count("*").alias("n")).groupBy("job_id").agg(
        F.sum("n").alias("citations"), F.count("*").alias("unique_keys")
    )
    matched = F.col("match_type") != "unmatched"
    m = matches.groupBy("job_id").agg(
        F.count_if(matched).alias("matched"),
        F.count_if(~matched).alias("orphans"),
        F.countDistinct("reference_id").alias("used"),
    )
    r = refs.groupBy("job_id").agg(F.count("*").alias("refs"))
    zero = lambda name: F.coalesce(name, F.lit(0))
    return (
        r.join(c, "job_id", "left").join(m, "job_id", "left")
        .select(
            "job_id",
            zero("citations").alias("citations"),
            zero("unique_keys").alias("unique_keys"),
            "refs",
            zero("matched").alias("matched"),
            zero("orphans").alias("orphans"),
            (F.col("refs") - zero("used")).alias("unused"),
            F.when(F.coalesce("unique_keys", F.lit(0)) == 0, 0.0)
            .otherwise(F.col("matched") / F.col("unique_keys"))
            .alias("match_rate"),
        )
    )


def trace_status(match_type: Column, confidence: Column, source_status: Column) -> Column:
    """Status of a citation from its match, its source and its passage."""
    return (
        F.when(match_type.isNull() | (match_type == "unmatched"), "not-found")
        .when(source_status.isNull() | (source_status != "done"), "no-source")
        .when(confidence >= 0.8, "verified")
        .when(confidence > 0, "needs-review")
        .otherwise("not-found")
    )


def trace_report(
    unique: DataFrame, cites: DataFrame, matches: DataFrame, refs: DataFrame,
    sources: DataFrame, passages: DataFrame,
) -> DataFrame:
    """One row per citation key with its match, reference, source and passage.

    Every side is reduced to one row per key before it is joined (lowest id wins), so no
    join multiplies rows. ``passages`` refer to ``citation_id`` of ``cites``.
    """
    source = sources.groupBy("job_id", "reference_id").agg(
        F.min_by("status", "source_id").alias("source_status")
    )
    passage = (
        passages.join(cites.select("citation_id", "citation_key"), "citation_id")
        .groupBy("job_id", "citation_key")
        .agg(
            F.min_by(
                F.struct("source_page", "matched_passage", F.col("confidence").alias("passage_confidence"), "reasoning"),
                "passage_id",
            ).alias("p")
        )
        .select("job_id", "citation_key", "p.*")
    )
    keys = ["job_id", "citation_key"]
    return (
        unique.join(
            matches.select(*keys, "reference_id", "match_type", F.col("confidence").alias("match_confidence")),
            keys, "left",
        )
        .join(
            refs.select("reference_id", F.col("title").alias("reference_title"), F.col("author").alias("reference_author")),
            "reference_id", "left",
        )
        .join(source, ["job_id", "reference_id"], "left")
        .join(passage, keys, "left")
        .withColumn("status", trace_status(F.col("match_type"), F.col("passage_confidence"), F.col("source_status")))
    )


def trace_summary(traces: DataFrame, cites: DataFrame) -> DataFrame:
    """Totals, found passages, mean confidence and counts per status of each job."""
    status = F.col("status")
    per = traces.groupBy("job_id").agg(
        F.count("*").alias("unique_citations"),
        F.count_if(status.isin("verified", "needs-review")).alias("matched"),
        F.count("source_page").alias("passages_found"),
        F.coalesce(T.mean2(F.col("passage_confidence")), F.lit(0.0)).alias("avg_confidence"),
        *[F.count_if(status == s).alias(s.replace("-", "_")) for s in STATUS_ORDER],
    )
    return per.join(cites.groupBy("job_id").agg(F.count("*").alias("total_citations")), "job_id")


# Order of statuses in reports.
STATUS_ORDER = ["verified", "needs-review", "no-source", "not-found"]
PASSAGE_ORDER = ["matched", "no-match", "no-source"]
CATEGORY_ORDER = ["kbbi", "eyd"]


def filter_traces(traces: DataFrame, status: str = "all", search: str = "") -> DataFrame:
    """By status, and by text in key, context, title or passage."""
    if status != "all":
        traces = traces.filter(F.col("status") == status)
    if search:
        hit = F.lit(False)
        for c in ("citation_key", "thesis_context", "reference_title", "matched_passage"):
            hit = hit | F.coalesce(T.icontains(F.col(c), search), F.lit(False))
        traces = traces.filter(hit)
    return traces


def rank_of(col: Column, order: list[str]) -> Column:
    out = F.when(col == order[0], 0)
    for i, v in enumerate(order[1:], 1):
        out = out.when(col == v, i)
    return out.otherwise(9)


def sort_traces(traces: DataFrame, key: str = "page") -> DataFrame:
    """By page, by confidence (none counts as -1) or by status."""
    orders = {
        "page": F.col("thesis_page"),
        "confidence": F.desc(F.coalesce("passage_confidence", F.lit(-1.0))),
        "status": rank_of(F.col("status"), STATUS_ORDER),
    }
    return traces.orderBy(orders[key], "thesis_page", "citation_key")


def sort_passages(results: DataFrame) -> DataFrame:
    """Matched passages by falling confidence, then those without match, then without source."""
    rank = rank_of(F.col("status"), PASSAGE_ORDER)
    return results.orderBy(rank, F.when(F.col("status") == "matched", -F.col("confidence")), "query_id")


def sort_findings(findings: DataFrame) -> DataFrame:
    """By category (words before spelling rules), page and place."""
    return findings.orderBy(rank_of(F.col("category"), CATEGORY_ORDER), "page_number", "offset", "rule_id")


def history_counts(jobs: DataFrame, cites: DataFrame, matches: DataFrame, passages: DataFrame) -> DataFrame:
    """Citations, matched keys and passages per job, 0 where there are none."""
    out = jobs
    for name, df in (
        ("total_citations", cites),
        ("matched_citations", matches.filter("match_type <> 'unmatched'")),
        ("passages_found", passages),
    ):
        out = out.join(df.groupBy("job_id").agg(F.count("*").alias(name)), "job_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def history_state(jobs: DataFrame) -> DataFrame:
    """Duration of finished jobs and whether a job is complete or can be resumed."""
    done = F.col("status").isin("done", "failed")
    ms = (F.unix_micros("updated_at") - F.unix_micros("created_at")) / 1000
    return jobs.withColumn(
        "duration_ms", F.when(done, F.greatest(F.lit(0), F.floor(ms)).cast("bigint"))
    ).withColumn("complete", F.col("phase") == "review-passages")


PROGRESS_SCALE = 100


def stage_progress(jobs: DataFrame) -> DataFrame:
    """``job_id, stage, state, processed, total, pct`` for the three stages."""
    status = F.col("status")
    half = T.round_half_up

    def state(stage: str) -> Column:
        if stage == "extract":
            return F.when(status == "pending", "waiting").when(status == "extracting", "running").otherwise("done")
        total, now = F.col(f"{stage}_total"), F.col(f"{stage}_progress")
        return (
            F.when((total > 0) & (now >= total), "done").when(status == "done", "done")
            .when(status == "analyzing", "running").otherwise("waiting")
        )

    def row(stage: str, total: Column, done: Column, shown_total: Column, shown_done: Column, cap: bool) -> Column:
        pct = half(done / total * 100)
        ok = total > 0
        return F.struct(
            F.lit(stage).alias("stage"), state(stage).alias("state"),
            F.when(ok, shown_done.cast("bigint")).alias("processed"),
            F.when(ok, shown_total.cast("bigint")).alias("total"),
            F.when(ok, F.least(F.lit(100), pct) if cap else pct).cast("bigint").alias("pct"),
        )

    pages, got = F.col("total_pages"), F.col("extracted_pages")
    kt, kp, et, ep = (F.col(c) for c in ("kbbi_total", "kbbi_progress", "eyd_total", "eyd_progress"))
    k_total = F.greatest(F.lit(1), half(kt / PROGRESS_SCALE))
    rows = F.array(
        row("extract", pages, got, pages, got, False),
        row("kbbi", kt, kp, k_total, F.least(k_total, F.ceil(kp / PROGRESS_SCALE)), True),
        row("eyd", et, ep, et, ep, False),
    )
    return jobs.select("job_id", F.explode(rows).alias("r")).select("job_id", "r.*")


def ref_label(author: Column, year: Column) -> Column:
    return F.concat(author, F.lit(" ("), year, F.lit(")"))


def list_matches(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """Matches with the title of their reference."""
    return matches.join(
        refs.select("reference_id", F.col("title").alias("reference_title")), "reference_id", "left"
    )


def list_batches(batches: DataFrame, sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Batches with file name (or a derived one) and reference label."""
    from naskah.functions.labels import derive_filename

    joined = batches.join(sources.select("source_id", "reference_id", "filename"), "source_id").join(
        refs.select("reference_id", "author", "year"), "reference_id", "left"
    )
    named = F.coalesce(
        "filename",
        F.when(
            F.col("author").isNotNull() | F.col("year").isNotNull(),
            derive_filename(F.lit(None).cast("string"), F.col("author"), F.col("year")),
        ),
    )
    return joined.withColumn("filename", named).withColumn(
        "reference_label", ref_label(F.col("author"), F.col("year"))
    )


def list_passages(passages: DataFrame, cites: DataFrame, sources: DataFrame, refs: DataFrame) -> DataFrame:
    """Passages with citation, source file and reference label, to be read by page.

    Passages of a citation or source that is gone are left out; the label needs author and year.
    """
    return (
        passages.join(cites.select("citation_id", "citation_key", "thesis_page", "thesis_context"), "citation_id")
        .join(sources.select("source_id", "reference_id", "filename"), "source_id")
        .join(refs.select("reference_id", "author", "year"), "reference_id", "left")
        .select(
            "job_id", "passage_id", "citation_key", "thesis_context", "thesis_page", "source_page", "matched_passage",
            "confidence", "reasoning", "filename", ref_label(F.col("author"), F.col("year")).alias("reference_label"),
        )
    )


def no_source(matches: DataFrame, sources: DataFrame) -> DataFrame:
    """Matched citations whose reference has no finished source."""
    done = sources.filter("status = 'done'").select("job_id", "reference_id").distinct()
    return matches.filter("match_type <> 'unmatched' AND reference_id IS NOT NULL").join(
        done, ["job_id", "reference_id"], "left_anti"
    )


def eval_history(jobs: DataFrame, summaries: DataFrame, current: str | None = None) -> DataFrame:
    """Evaluations with score and error count; optionally only finished ones but ``current``."""
    from naskah.functions.labels import score

    if current is not None:
        jobs = jobs.filter((F.col("status") == "done") & (F.col("job_id") != current))
    both = F.col("kbbi").isNotNull() & F.col("eyd").isNotNull()
    return jobs.join(summaries.select("job_id", "kbbi", "eyd"), "job_id", "left").withColumn(
        "overall_score", F.when(both, score(F.col("kbbi"), F.col("eyd"), F.col("total_pages")))
    ).withColumn("error_count", F.when(both, F.col("kbbi") + F.col("eyd")))
