"""Citation tables over pages: extraction, grouping, first occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.functions import citations as C


def citations(pages: DataFrame, kind: str | None = None) -> DataFrame:
    """One row per citation of a page, with its sentence context."""
    hit = F.col("hit")
    found = pages.select(
        "job_id", "page_number", "content", F.explode(C.page_citations(F.col("content"), kind)).alias("hit")
    )
    return found.select(
        "job_id",
        F.col("page_number").alias("thesis_page"),
        hit["citation_key"].alias("citation_key"),
        hit["start"].alias("start"),
        hit["kind"].alias("kind"),
        hit["author"].alias("author"),
        hit["year"].alias("year"),
        hit["raw_match"].alias("raw_match"),
        C.context(F.col("content"), hit["start"], hit["end"]).alias("thesis_context"),
    )


def group_citations(cites: DataFrame) -> DataFrame:
    """Occurrences per key; the occurrences themselves stay rows of ``cites``."""
    return cites.groupBy("job_id", "citation_key").agg(
        F.count("*").alias("occurrences"),
        F.min("thesis_page").alias("first_page"),
        F.max("thesis_page").alias("last_page"),
    )


def citation_members(cites: DataFrame) -> DataFrame:
    """Every occurrence with the size of its group, in rows: a group may be of any size."""
    return cites.join(group_citations(cites).select("job_id", "citation_key", "occurrences"), ["job_id", "citation_key"])


def unique_citations(cites: DataFrame) -> DataFrame:
    """One row per key with its first page and the context found there."""
    return cites.groupBy("job_id", "citation_key").agg(
        F.min(F.struct("thesis_page", "start", "thesis_context")).alias("first")
    ).select(
        "job_id",
        "citation_key",
        F.col("first.thesis_page").alias("thesis_page"),
        F.col("first.thesis_context").alias("thesis_context"),
    )
