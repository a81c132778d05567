"""Italic fonts and ranges from text runs ``job_id, page_number, start, end, font_name, size, is_mono, name_is_italic``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE_TOLERANCE, MIN_CHARS, MAX_RATIO = 0.05, 200, 0.5
PAGE = ["job_id", "page_number"]


def italic_fonts(runs: DataFrame) -> DataFrame:
    """Minority fonts in the body size of a page, taken to be italics.

    Ties of body size or body font go to the one that starts first on the page.
    """
    per = runs.groupBy(*PAGE, "font_name", "size").agg(
        F.sum(F.col("end") - F.col("start")).alias("all_chars"),
        F.sum(F.when(~F.col("is_mono") & (F.col("end") > F.col("start")), F.col("end") - F.col("start"))).alias("chars"),
        F.min(F.when(~F.col("is_mono") & (F.col("end") > F.col("start")), F.col("start"))).alias("first"),
    )
    long_pages = per.groupBy(*PAGE).agg(F.sum("all_chars").alias("n")).filter(F.col("n") >= MIN_CHARS)
    usable = (
        per.filter("chars > 0 AND font_name <> '' AND size > 0").join(long_pages.select(*PAGE), PAGE, "left_semi")
    )
    body_size = (
        usable.groupBy(*PAGE, "size").agg(F.sum("chars").alias("c"), F.min("first").alias("f"))
        .groupBy(*PAGE).agg(F.max_by("size", F.struct("c", (-F.col("f")).alias("o"))).alias("body_size"))
    )
    near = usable.join(body_size, PAGE).filter(
        F.abs(F.col("size") - F.col("body_size")) / F.col("body_size") <= SIZE_TOLERANCE
    )
    body = near.groupBy(*PAGE).agg(
        F.max(F.struct("chars", (-F.col("first")).alias("o"), "font_name")).alias("b")
    )
    return (
        near.join(body, PAGE)
        .filter((F.col("font_name") != F.col("b.font_name")) & (F.col("chars") / F.col("b.chars") <= MAX_RATIO))
        .select(*PAGE, "font_name").distinct()
    )


def merge_runs(runs: DataFrame, flag: Column, gap: int = 2) -> DataFrame:
    """Flagged runs of a page merged over small gaps; an unflagged run breaks a range."""
    order = Window.partitionBy(*PAGE).orderBy("start", "end")
    rows = runs.filter("end > start").withColumn("flag", flag)
    breaks = (
        F.col("flag")
        & ~(
            F.coalesce(F.lag("flag").over(order), F.lit(False))
            & (F.col("start") <= F.lag("end").over(order) + gap)
        )
    )
    return (
        rows.withColumn("new", breaks.cast("int"))
        .withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("flag")
        .groupBy(*PAGE, "island")
        .agg(F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"))
        .select(*PAGE, "start", "end")
    )


def clamp(ranges: DataFrame, length: Column) -> DataFrame:
    """Ranges cut to the content; empty ones go."""
    inside = lambda c: F.greatest(F.lit(0), F.least(F.col(c), length))
    return ranges.withColumn("start", inside("start")).withColumn("end", inside("end")).filter("end > start")
