"""Report exports: projections, and writers over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from naskah.functions import text as T


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def trace_export(traces: DataFrame) -> DataFrame:
    """The eleven columns of a trace report; confidence as a whole percent."""
    percent = T.round_half_up(F.col("passage_confidence") * 100).cast("string")
    return traces.select(
        F.col("citation_key").alias("Citation"),
        F.col("thesis_page").cast("string").alias("Thesis Page"),
        _blank("thesis_context").alias("Thesis Context"),
        _blank("reference_author").alias("Reference Author"),
        _blank("reference_title").alias("Reference Title"),
        _blank("match_type").alias("Match Type"),
        _blank("source_page").alias("Source Page"),
        _blank("matched_passage").alias("Matched Passage"),
        F.coalesce(percent, F.lit("")).alias("Confidence (%)"),
        _blank("reasoning").alias("Reasoning"),
        _blank("status").alias("Status"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes only where a value needs them; quotes are doubled inside."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def trace_json(traces: DataFrame, jobs: DataFrame, totals: DataFrame, exported_at: Column) -> DataFrame:
    """``job_id, kind, json``: one meta line per job and one line per trace.

    Traces stay rows, so a job of any size is written by many tasks.
    """
    meta = jobs.join(totals, "job_id").select(
        "job_id", F.lit("meta").alias("kind"),
        F.to_json(
            F.struct(
                "filename", exported_at.alias("exportedAt"),
                F.col("total_citations").alias("totalCitations"),
                F.col("unique_citations").alias("uniqueCitations"),
                F.col("passages_found").alias("passagesFound"),
                F.col("avg_confidence").alias("avgConfidence"),
            )
        ).alias("json"),
    )
    rows = traces.select(
        "job_id", F.lit("trace").alias("kind"),
        F.to_json(
            F.struct(
                F.col("citation_key").alias("citationKey"),
                F.col("thesis_page").alias("thesisPage"),
                F.col("thesis_context").alias("thesisContext"),
                F.struct(
                    F.col("reference_author").alias("author"),
                    F.col("reference_title").alias("title"),
                    F.col("match_type").alias("matchType"),
                ).alias("reference"),
                F.struct(
                    F.col("source_page").alias("sourcePage"),
                    F.col("matched_passage").alias("matchedPassage"),
                    F.col("passage_confidence").alias("confidence"),
                    "reasoning",
                ).alias("passage"),
                "status",
            ),
            {"ignoreNullFields": "false"},
        ).alias("json"),
    )
    return meta.unionByName(rows)


# Labels of categories and severities.
_CATEGORY = {"kbbi": "KBBI", "eyd": "EYD"}
_SEVERITY = {"error": "Error", "warning": "Warning", "info": "Info"}


def _label(name: str, labels: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(table[F.col(name)], F.col(name))


def findings_export(findings: DataFrame) -> DataFrame:
    """Seven labelled columns of a findings report."""
    return findings.select(
        _label("category", _CATEGORY).alias("Category"),
        _label("severity", _SEVERITY).alias("Severity"),
        _blank("page_number").alias("Page"),
        _blank("rule_id").alias("Rule ID"),
        _blank("message").alias("Message"),
        _blank("excerpt").alias("Excerpt"),
        _blank("suggestion").alias("Suggestion"),
    )


def change_log_lines(log: DataFrame) -> DataFrame:
    """``section, line_no keys, line`` of a change report; one row per line.

    Rows sort by ``section, page_number, finding_id``; counts are their own lines.
    """
    page = F.when(F.col("page_number").isNull(), "Halaman tidak diketahui").otherwise(
        F.concat(F.lit("Halaman "), F.col("page_number").cast("string"))
    )
    rule = F.when(F.col("rule_id").isNull(), "").otherwise(F.concat(F.lit(" · "), "rule_id"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    change = F.when(
        F.col("kind") == "italic", F.concat(quoted(F.col("before")), F.lit(" dijadikan miring"))
    ).otherwise(F.concat(quoted(F.col("before")), F.lit(" → "), quoted(F.col("after"))))
    applied = F.concat(
        F.lit("- "), page, F.lit(" ("), _label("category", _CATEGORY), rule, F.lit("): "), change
    )
    unlocated = F.concat(
        F.lit("- "), page, rule, F.lit(": "), quoted(F.col("before")), F.lit(" → "),
        quoted(F.col("after")), F.lit(" ("), F.col("reason"), F.lit(")"),
    )
    is_applied = F.col("applied")
    lines = log.select(
        "job_id", F.when(is_applied, 1).otherwise(2).alias("section"),
        "page_number", "finding_id", F.when(is_applied, applied).otherwise(unlocated).alias("line"),
    )
    counts = log.groupBy("job_id").agg(
        F.count_if(is_applied).alias("a"), F.count_if(~is_applied).alias("u")
    )
    head = lambda n, title, c: counts.select(
        "job_id", F.lit(n).alias("section"), F.lit(None).cast("int").alias("page_number"),
        F.lit(None).cast("bigint").alias("finding_id"),
        F.concat(F.lit(f"{title}: "), F.col(c).cast("string")).alias("line"),
    )
    return head(0, "Perubahan diterapkan", "a").unionByName(
        head(0, "Tidak dapat diterapkan", "u")
    ).unionByName(lines)
