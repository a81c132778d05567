"""Bibliography tables: section pages, repeated lines, running headers, entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.functions import references as R
from naskah.functions import text as T


def reference_section(pages: DataFrame) -> DataFrame:
    """Pages from the last one with a bibliography heading on, with ``start_page``."""
    starts = (
        pages.filter(F.col("content").rlike(T.js(R.HEADING, True)))
        .groupBy("job_id")
        .agg(F.max("page_number").alias("start_page"))
    )
    return pages.join(starts, "job_id").filter(F.col("page_number") >= F.col("start_page"))


def repeating_lines(pages: DataFrame) -> DataFrame:
    """Trimmed lines on more than one page and on at least half of the job's pages."""
    lines = pages.select(
        "job_id",
        F.explode(
            F.array_distinct(
                F.transform(F.split("content", "\n", -1), lambda l: T.strip(l))
            )
        ).alias("line"),
    ).filter("line <> ''")
    totals = pages.groupBy("job_id").agg(F.count("*").alias("pages"))
    return (
        lines.groupBy("job_id", "line")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .join(totals, "job_id")
        .filter(F.col("n") >= F.ceil(F.col("pages") * 0.5))
        .select("job_id", "line", "n")
    )


def strip_repeating_lines(pages: DataFrame) -> DataFrame:
    """Pages without repeated lines and without lines that are a bare page number.

    Only the few repeated lines meet the pages: each page looks up its own distinct lines.
    """
    on_page = (
        pages.select(
            "job_id", "page_number",
            F.explode(
                F.array_distinct(F.transform(F.split("content", "\n", -1), lambda l: T.strip(l)))
            ).alias("line"),
        )
        .join(repeating_lines(pages).select("job_id", "line"), ["job_id", "line"])
        .groupBy("job_id", "page_number")
        .agg(F.collect_set("line").alias("drop"))
    )
    keep = lambda drop: lambda l: T.let(
        T.strip(l), lambda t: (t == "") | ~(t.rlike(r"^[0-9]{1,3}\z") | F.array_contains(drop, t))
    )
    drop = F.coalesce(F.col("drop"), F.array().cast("array<string>"))
    return (
        pages.join(on_page, ["job_id", "page_number"], "left")
        .withColumn(
            "content",
            F.array_join(F.filter(F.split("content", "\n", -1), keep(drop)), "\n"),
        )
        .drop("drop")
    )


def running_header(pages: DataFrame) -> DataFrame:
    """``job_id, words``: words of the header that opens every page of the job."""
    leaders = pages.select(
        "job_id", "page_number", R.leader(F.col("content")).alias("leader")
    ).filter(F.length("leader") > 20)
    first = leaders.groupBy("job_id").agg(
        F.min_by("leader", "page_number").alias("first"), F.count("*").alias("n")
    ).filter("n > 1")
    return (
        leaders.join(first, "job_id")
        .groupBy("job_id")
        .agg(
            F.min(R.common_length(F.col("first"), F.col("leader"))).alias("len"),
            F.first("first").alias("first"),
        )
        .select("job_id", R.header_words(F.left("first", F.col("len"))).alias("words"))
    )


def section_text(pages: DataFrame) -> DataFrame:
    """One cleaned bibliography text per job.

    A bibliography is one section of one document, so its pages meet in one row.
    """
    section = reference_section(pages)
    words = F.coalesce(F.col("words"), F.array().cast("array<string>"))
    cleaned = (
        strip_repeating_lines(section)
        .join(running_header(section), "job_id", "left")
        .select(
            "job_id", "start_page", "page_number",
            R.strip_header(R.strip_page_number(F.col("content")), words).alias("content"),
        )
    )
    return cleaned.groupBy("job_id", "start_page").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("page_number", "content"))),
                lambda p: p["content"],
            ),
            "\n",
        ).alias("text")
    )


def reference_entries(pages: DataFrame) -> DataFrame:
    """``job_id, start_page, entry_no, raw_text`` of every bibliography entry."""
    return section_text(pages).select(
        "job_id", "start_page", F.posexplode(R.split_entries(F.col("text"))).alias("entry_no", "raw_text")
    )


def parse_references(pages: DataFrame) -> DataFrame:
    """Entries with their fields."""
    return reference_entries(pages).select(
        "job_id", "start_page", "entry_no", "raw_text", R.parse_entry(F.col("raw_text")).alias("f")
    ).select("job_id", "start_page", "entry_no", "raw_text", "f.*")


def bad_references(refs: DataFrame) -> DataFrame:
    """References whose author, year or title has a wrong shape."""
    return refs.filter(
        (F.col("author") == "Unknown")
        | (F.length("author") <= 1)
        | ~F.col("year").rlike(r"^(19|20)[0-9]{2}\z")
        | (F.length("title") < 10)
        | (F.length("title") > 300)
    )


def duplicate_references(refs: DataFrame) -> DataFrame:
    """Keys (first 200 characters, squeezed) that occur more than once in a job."""
    key = T.squeeze(F.lower(F.left("raw_text", F.lit(200))))
    return (
        refs.groupBy("job_id", key.alias("ref_key"))
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
