"""Comparison of two revisions of a document.

Findings carry ``side`` (``before`` or ``after``); a comparison is keyed by ``pair``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from naskah.functions import labels as LB


def _sides(alias_before: str, alias_after: str):
    side = F.col("side")
    return (
        F.count_if(side == "before").alias(alias_before),
        F.count_if(side == "after").alias(alias_after),
    )


def compare_findings(findings: DataFrame) -> DataFrame:
    """Buckets per finding key: counts per side, first sample per side, what became of it.

    Both sides are one input, so one aggregation gives what a full outer join of two would.
    """
    key = LB.finding_key(F.col("category"), F.col("rule_id"), F.col("token"), F.col("excerpt"))
    place = F.struct(F.coalesce("page_number", F.lit(2**31 - 1)), F.coalesce("offset", F.lit(0)), "id")
    side = F.col("side")
    out = findings.groupBy("pair", key.alias("key")).agg(
        F.first("category").alias("category"),
        F.first("rule_id").alias("rule_id"),
        *_sides("before_count", "after_count"),
        F.min_by("id", F.when(side == "before", place)).alias("sample_before"),
        F.min_by("id", F.when(side == "after", place)).alias("sample_after"),
    )
    b, a = F.col("before_count"), F.col("after_count")
    return out.select(
        "pair", "key", "category", "rule_id", "before_count", "after_count",
        (a - b).alias("delta"),
        F.when(b > 0, F.col("sample_before")).alias("sample_before"),
        F.when(a > 0, F.col("sample_after")).alias("sample_after"),
        F.when(a == 0, "resolved").when(b == 0, "introduced").otherwise("still-present").alias("bucket"),
    )


def rule_deltas(findings: DataFrame) -> DataFrame:
    """Findings per rule and side; findings without a rule are left out."""
    return (
        findings.filter(F.col("rule_id").isNotNull())
        .groupBy("pair", "rule_id")
        .agg(F.min("category").alias("category"), *_sides("before", "after"))
        .withColumn("delta", F.col("after") - F.col("before"))
    )


def top_rule_changes(deltas: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest reductions and regressions per comparison, ties by rule id."""
    change = F.when(F.col("delta") < 0, "reduction").when(F.col("delta") > 0, "regression")
    order = Window.partitionBy("pair", "change").orderBy(F.desc(F.abs("delta")), "rule_id")
    return (
        deltas.withColumn("change", change)
        .filter(F.col("change").isNotNull())
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def group_by_rule(buckets: DataFrame) -> DataFrame:
    """Bucket totals per category and rule."""
    return buckets.groupBy("pair", "bucket", "category", "rule_id").agg(
        F.count("*").alias("buckets"),
        F.sum("before_count").alias("before_total"),
        F.sum("after_count").alias("after_total"),
    ).withColumn("weight", F.greatest("before_total", "after_total"))


def rule_members(buckets: DataFrame) -> DataFrame:
    """Every bucket with the weight of its rule group, in rows."""
    keys = ["pair", "bucket", "category", "rule_id"]
    groups = group_by_rule(buckets).select(*keys, "weight")
    named = [F.col(f"g.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    on = named[0] & named[1] & named[2] & named[3]
    return buckets.alias("b").join(groups.alias("g"), on).select("b.*", "g.weight")


def scoreboard(findings: DataFrame, jobs: DataFrame) -> DataFrame:
    """``pair, metric, before, after, delta, pct_change`` for totals and the score.

    ``jobs`` has ``pair, pages_before, pages_after``. The score here counts every finding.
    """
    c, s, side = F.col("category"), F.col("severity"), F.col("side")
    tests = {
        "total": F.lit(True), "kbbi": c == "kbbi", "eyd": c == "eyd",
        "error": s == "error", "warning": s == "warning", "info": s == "info",
    }
    counts = findings.groupBy("pair").agg(
        *[F.count_if(t & (side == w)).alias(f"{n}_{w}") for n, t in tests.items() for w in ("before", "after")]
    )
    for w in ("before", "after"):
        counts_score = LB.score(F.col(f"kbbi_{w}"), F.col(f"eyd_{w}"), F.col(f"pages_{w}"))
        jobs = jobs if w == "after" else jobs.join(counts, "pair", "left").fillna(0, subset=counts.columns[1:])
        jobs = jobs.withColumn(f"score_{w}", counts_score.cast("bigint"))
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_before").alias("before"), F.col(f"{m}_after").alias("after"))
        for m in [*tests, "score"]
    ])
    return jobs.select("pair", F.explode(rows).alias("r")).select(
        "pair", "r.metric", "r.before", "r.after",
        (F.col("r.after") - F.col("r.before")).alias("delta"),
        F.when(F.col("r.metric") != "score", LB.percent_change(F.col("r.before"), F.col("r.after"))).alias("pct_change"),
    )


def orient(pairs: DataFrame) -> DataFrame:
    """Older revision first unless swapped (``a_id, a_created, b_id, b_created, swap``)."""
    a_first = (F.col("a_created") <= F.col("b_created")) != F.col("swap")
    return pairs.withColumn("before_id", F.when(a_first, F.col("a_id")).otherwise(F.col("b_id"))).withColumn(
        "after_id", F.when(a_first, F.col("b_id")).otherwise(F.col("a_id"))
    )
