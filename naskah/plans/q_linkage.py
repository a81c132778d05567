"""Citation linkage and file pairing over planted citations and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.operators import citations as C
from naskah.operators import linkage as L
from naskah.plans.fixtures import table, view
from naskah.plans.q_citations import CITES
from naskah.plans.registry import query
from naskah.session import materialize

_FOLD = "trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[–—]', '-', 'g'), '\\s*-\\s*', '-', 'g'))"


def fold(x: str) -> str:
    return _FOLD.replace("{x}", x)


# All pairs of a job: slow but independent of the join keys.
MATCH = CITES + f""",
  ck AS (SELECT DISTINCT job_id, citation_key,
      {fold("regexp_split_to_array(trim(regexp_replace(citation_key, ',\\s*\\d{4}.*$', '')), '\\s*(?:&|et\\s+al\\.?|,)\\s*')[1]")} AS sn,
      coalesce(TRY_CAST(regexp_extract(citation_key, '\\d{{4}}') AS INT), 0) AS cy,
      regexp_matches(citation_key, '(?i)et\\s+al\\.') AS et FROM cites),
  rf AS (SELECT *, CASE WHEN coalesce(trim(year), '') = '' THEN 0 ELSE TRY_CAST(year AS INT) END AS ry,
      list_filter(list_transform(regexp_split_to_array(author, '\\s*(?:,\\s*&|&|\\band\\b|\\bdan\\b)\\s*'),
        lambda p: {fold("trim(split_part(p, ',', 1))")}), lambda n: length(n) > 1) AS names FROM {{plant_refs}}),
  pr AS (SELECT ck.*, rf.reference_id, rf.title, rf.ry, rf.names,
      CASE WHEN len(list_filter(names, lambda n: starts_with(n, sn) OR starts_with(sn, n)
                OR (strpos(n, ' ') > 0 AND list_contains(string_split(n, ' '), sn)))) > 0 THEN 0
           ELSE list_min(list_transform(list_concat(names, flatten(list_transform(list_filter(names, lambda n: strpos(n, ' ') > 0),
                lambda n: string_split(n, ' ')))), lambda n: levenshtein(n, sn))) END AS d
    FROM ck JOIN rf USING (job_id) WHERE ry IS NULL OR abs(ry - cy) <= 2),
  sc AS (SELECT *, 1.0::DOUBLE - coalesce(abs(ry - cy), 0) * 0.15::DOUBLE - d * 0.15::DOUBLE AS raw FROM pr
    WHERE d <= greatest(1, CAST(floor(length(sn) * 0.3) AS INT))),
  sd AS (SELECT *, greatest(0, least(1, CASE WHEN et AND len(names) >= 3 THEN least(1.0, raw + 0.05::DOUBLE)
      WHEN et AND len(names) = 1 THEN raw - 0.2::DOUBLE ELSE raw END)) AS conf,
      CASE WHEN d = 0 AND ry = cy THEN 'exact' ELSE 'fuzzy' END AS mt FROM sc),
  bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, citation_key ORDER BY conf DESC, reference_id) AS rn FROM sd) WHERE rn = 1),
  matches AS (SELECT ck.job_id, ck.citation_key, bs.reference_id, bs.title AS reference_title,
      coalesce(floor(conf * 100 + 0.5) / 100, 0) AS confidence, coalesce(mt, 'unmatched') AS match_type
    FROM ck LEFT JOIN bs ON bs.job_id = ck.job_id AND bs.citation_key = ck.citation_key)"""


def matches(spark, sf):
    keys = C.citations(view(spark, sf, "plant_pages")).select("job_id", "citation_key")
    return L.match_citations(keys, view(spark, sf, "plant_refs"))


@query("jn1_match_citations", f"WITH {MATCH} SELECT * FROM matches WHERE match_type <> 'unmatched'")
def match_citations(spark, sf):
    return matches(spark, sf).filter("match_type <> 'unmatched'")


@query("jn2_unmatched_kept", f"WITH {MATCH} SELECT job_id, match_type, CAST(count(*) AS BIGINT) AS n, round(sum(confidence), 4) AS conf FROM matches GROUP BY 1, 2")
def unmatched_kept(spark, sf):
    return matches(spark, sf).groupBy("job_id", "match_type").agg(
        F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("conf")
    )


@query(
    "tk1_best_reference",
    f"WITH {MATCH} SELECT job_id, citation_key, reference_id, round(conf, 6) AS confidence FROM bs",
)
def best_reference(spark, sf):
    keys = C.citations(view(spark, sf, "plant_pages")).select("job_id", "citation_key").distinct()
    keys = materialize(keys, "citation-keys")
    from naskah.operators.reports import best_per

    return best_per(
        L.match_candidates(keys, view(spark, sf, "plant_refs")),
        ["job_id", "citation_key"], "raw_confidence", "reference_id",
    ).select("job_id", "citation_key", "reference_id", F.round("raw_confidence", 6).alias("confidence"))


@query("so2_orphan_citations", f"WITH {MATCH} SELECT job_id, citation_key FROM matches WHERE match_type = 'unmatched'")
def orphan_citations(spark, sf):
    return L.orphan_citations(matches(spark, sf))


@query(
    "so3_unused_references",
    f"""WITH {MATCH} SELECT job_id, reference_id, author, year, title FROM {{plant_refs}}
        WHERE reference_id NOT IN (SELECT reference_id FROM matches WHERE reference_id IS NOT NULL)""",
)
def unused_references(spark, sf):
    return L.unused_references(view(spark, sf, "plant_refs"), matches(spark, sf)).select(
        "job_id", "reference_id", "author", "year", "title"
    )


@query(
    "ag23_track_diagnostics",
    f"""WITH {MATCH},
      c AS (SELECT job_id, count(*) AS citations, count(DISTINCT citation_key) AS keys FROM cites GROUP BY 1),
      m AS (SELECT job_id, count(*) FILTER (WHERE match_type <> 'unmatched') AS matched,
                   count(*) FILTER (WHERE match_type = 'unmatched') AS orphans, count(DISTINCT reference_id) AS used FROM matches GROUP BY 1),
      r AS (SELECT job_id, count(*) AS refs FROM {{plant_refs}} GROUP BY 1)
    SELECT job_id, CAST(coalesce(citations, 0) AS BIGINT) AS citations, CAST(coalesce(keys, 0) AS BIGINT) AS unique_keys, CAST(refs AS BIGINT) AS refs,
      CAST(coalesce(matched, 0) AS BIGINT) AS matched, CAST(coalesce(orphans, 0) AS BIGINT) AS orphans,
      CAST(refs - coalesce(used, 0) AS BIGINT) AS unused,
      round(CASE WHEN coalesce(keys, 0) = 0 THEN 0 ELSE matched / keys END, 6) AS match_rate
    FROM r LEFT JOIN c USING (job_id) LEFT JOIN m USING (job_id)""",
)
def track_diagnostics(spark, sf):
    from naskah.operators.reports import track_diagnostics as op

    cites = materialize(C.citations(view(spark, sf, "plant_pages")).select("job_id", "citation_key"), "citations")
    refs = view(spark, sf, "plant_refs")
    return op(cites, refs, L.match_citations(cites, refs)).withColumn("match_rate", F.round("match_rate", 6))


_TOK = "list_filter(string_split({x}, ' '), lambda t: length(t) >= 3)"
_T = "trim(regexp_replace(regexp_replace(strip_accents(lower({x})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _title(x: str) -> str:
    return _T.replace("{x}", x)


def _tokens(x: str) -> str:
    return _TOK.replace("{x}", x)


def _shingles(x: str) -> str:
    return (
        f"CASE WHEN len({x}) >= 2 THEN list_distinct(list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"
        f" WHEN len({x}) = 1 THEN {x} ELSE [] END"
    )


@query(
    "jn3_pair_files",
    f"""WITH q AS (SELECT *, {_tokens('norm')} AS qt FROM (
        SELECT job_id, file_id, {_title("trim(concat_ws(' ', nullif(title, ''), nullif(substr(first_page, 1, 500), '')))")} AS norm FROM {{plant_files}})),
      c AS (SELECT job_id, reference_id, year, {_title('title')} AS tn, {_tokens(_title("author || ' ' || year || ' ' || title"))} AS ct,
              string_split({_title('author')}, ' ')[-1] AS ln FROM {{plant_refs}}),
      p AS (SELECT q.job_id, file_id, reference_id, CASE WHEN tn <> '' AND contains(norm, tn) THEN 0.95 ELSE least(1.0,
          0.5 * CASE WHEN len(ct) = 0 THEN 0 ELSE len(list_filter(ct, lambda t: list_contains(qt, t))) / len(ct) END
          + 0.3 * CASE WHEN len(s1) = 0 OR len(s2) = 0 THEN 0 ELSE len(list_intersect(s1, s2)) / (len(s1) + len(s2) - len(list_intersect(s1, s2))) END
          + 0.25 * (CAST(ln <> '' AND list_contains(qt, ln) AS INT) + CAST(year <> '' AND list_contains(qt, year) AS INT))) END AS score
        FROM (SELECT *, {_shingles('qt')} AS s1 FROM q) q JOIN (SELECT *, {_shingles('ct')} AS s2 FROM c) c USING (job_id) WHERE len(qt) > 0),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, file_id ORDER BY round(score, 9) DESC, reference_id) AS rn FROM p WHERE score > 0) WHERE rn = 1)
    SELECT q.job_id, q.file_id, CASE WHEN score >= 0.35 THEN reference_id END AS reference_id, round(coalesce(score, 0), 6)::DOUBLE AS confidence
    FROM q LEFT JOIN b ON b.job_id = q.job_id AND b.file_id = q.file_id""",
)
def pair_files(spark, sf):
    return L.pair_files(view(spark, sf, "plant_files"), view(spark, sf, "plant_refs")).withColumn(
        "confidence", F.round("confidence", 6)
    )


@query(
    "so4_missing_sources",
    """SELECT reference_id, job_id FROM {plant_refs} WHERE reference_id NOT IN (SELECT l_orderkey FROM {lineitem} WHERE l_linenumber = 3)""",
)
def missing_sources(spark, sf):
    covered = table(spark, sf, "lineitem").filter("l_linenumber = 3").select(
        F.col("l_orderkey").alias("reference_id")
    )
    return L.missing(view(spark, sf, "plant_refs"), covered, ["reference_id"]).select("reference_id", "job_id")
