"""Citation extraction over planted pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.functions import citations as C
from naskah.operators import citations as ops
from naskah.plans.fixtures import view
from naskah.plans.registry import query, spans_sql
from naskah.session import materialize

# RE2 has no Unicode word boundaries to translate, so the plain patterns run as they are.
_NAME = r"\p{Lu}[\p{L}''\-]+"
_BLACK = ", ".join(f"'{w}'" for w in C.AUTHOR_BLACKLIST)


def _q(text: str) -> str:
    return text.replace("'", "''")


def _key(author: str, year: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace({author}, '(?i)\s+(?:et\s+al\.?|dkk\.?)', ' et al.'),"
        rf" '\s*(?:&|and|dan)\s*', ' & ', 'g'), '\s+', ' ', 'g')) || ', ' || trim(regexp_replace({year}, '[,\s].*', '', 'g'))"
    )


_KEEP = rf"""split_part(regexp_replace(trim(author), '\s+', ' ', 'g'), ' ', 1) NOT IN ({_BLACK})
   AND (regexp_matches(author, '(?i){_q(C.CONNECTOR)}') OR len(regexp_split_to_array(trim(author), '\s+')) <= 4)"""

_PAREN_RAW = f"""
  paren_spans AS ({spans_sql("{plant_pages}", "job_id, page_number", "content", C.PAREN)}),
  paren_parts AS (
    SELECT job_id, page_number, src, txt, s, e,
           unnest(regexp_split_to_array(regexp_extract(txt, '{_q(C.PAREN)}', 1), '\\s*;\\s*')) AS part
    FROM paren_spans),
  paren AS (
    SELECT DISTINCT job_id, page_number, src, txt, s, e, 'parenthetical' AS kind,
           regexp_extract(part, '{_q(C.PART)}', 1) AS author, regexp_extract(part, '{_q(C.PART)}', 2) AS yr
    FROM paren_parts)"""
_NARR_RAW = f"""
  narr_spans AS ({spans_sql("{plant_pages}", "job_id, page_number", "content", C.NARRATIVE)}),
  narr AS (
    SELECT job_id, page_number, src, txt, s, e, 'narrative' AS kind,
           regexp_extract(txt, '{_q(C.NARRATIVE)}', 1) AS author,
           regexp_replace(regexp_extract(txt, '{_q(C.NARRATIVE)}', 2), '[,\\s].*', '', 'g') AS yr
    FROM narr_spans)"""
_CONTEXT = """
  trim(substr(src,
    CASE WHEN s > 150 AND strpos(reverse(substr(src, s - 149, 152)), ' .') > 0
              AND 152 - strpos(reverse(substr(src, s - 149, 152)), ' .') - 1 > 0
         THEN s - 150 + (152 - strpos(reverse(substr(src, s - 149, 152)), ' .') - 1) + 2
         ELSE greatest(s - 150, 0) END + 1,
    CASE WHEN strpos(substr(src, e + 1, least(e + 150, length(src)) - e + 1), '. ') > 0
         THEN e + strpos(substr(src, e + 1, least(e + 150, length(src)) - e + 1), '. ')
         ELSE least(e + 150, length(src)) END
    - CASE WHEN s > 150 AND strpos(reverse(substr(src, s - 149, 152)), ' .') > 0
              AND 152 - strpos(reverse(substr(src, s - 149, 152)), ' .') - 1 > 0
         THEN s - 150 + (152 - strpos(reverse(substr(src, s - 149, 152)), ' .') - 1) + 2
         ELSE greatest(s - 150, 0) END), chr(32) || chr(10))"""

CITES = f"""{_PAREN_RAW},{_NARR_RAW},
  raw_cites AS (SELECT * FROM paren WHERE author <> '' UNION ALL SELECT * FROM narr WHERE strpos(author, chr(10)) = 0),
  cites AS (
    SELECT DISTINCT job_id, page_number AS thesis_page, s AS start, kind, txt AS raw_match,
           {_key("author", "yr")} AS citation_key, {_CONTEXT} AS thesis_context
    FROM raw_cites WHERE {_KEEP})"""


@query(
    "tx3_citations_paren",
    f"WITH {CITES} SELECT job_id, thesis_page, start, citation_key, raw_match FROM cites WHERE kind = 'parenthetical'",
)
def citations_paren(spark, sf):
    return ops.citations(view(spark, sf, "plant_pages"), "parenthetical").select(
        "job_id", "thesis_page", "start", "citation_key", "raw_match"
    )


@query(
    "tx4_citations_narrative",
    f"WITH {CITES} SELECT job_id, thesis_page, start, citation_key, raw_match FROM cites WHERE kind = 'narrative'",
)
def citations_narrative(spark, sf):
    return ops.citations(view(spark, sf, "plant_pages"), "narrative").select(
        "job_id", "thesis_page", "start", "citation_key", "raw_match"
    )


@query(
    "tx5_split_multi",
    f"WITH {_PAREN_RAW} SELECT DISTINCT job_id, page_number, s AS start, author, yr AS year FROM paren WHERE author <> ''",
)
def split_multi(spark, sf):
    from naskah.functions import text as T

    pattern = T.js(C.PAREN)
    return (
        view(spark, sf, "plant_pages")
        .select("job_id", "page_number", F.explode(T.spans(F.col("content"), pattern)).alias("m"))
        .select(
            "job_id", "page_number", F.col("m.start").alias("start"),
            F.explode(
                F.array_distinct(C.split_multi(F.regexp_extract(F.col("m.text"), pattern, 1)))
            ).alias("p"),
        )
        .select("job_id", "page_number", "start", "p.author", "p.year")
    )


@query(
    "tx6_citation_key",
    f"""WITH {_PAREN_RAW},{_NARR_RAW},
      b AS (SELECT author, yr FROM paren WHERE author <> '' UNION ALL SELECT author, yr FROM narr)
      SELECT author, {_key("author", "yr")} AS citation_key, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL""",
)
def citation_key(spark, sf):
    from naskah.functions import text as T

    pages = view(spark, sf, "plant_pages")
    paren, narr = T.js(C.PAREN), T.js(C.NARRATIVE)
    both = pages.select(
        F.explode(
            F.concat(
                F.flatten(
                    F.transform(
                        T.spans(F.col("content"), paren),
                        lambda s: F.array_distinct(
                            C.split_multi(F.regexp_extract(s["text"], paren, 1))
                        ),
                    )
                ),
                F.transform(
                    C.narrative_spans(F.col("content")),
                    lambda s: F.struct(
                        F.regexp_extract(s["text"], narr, 1).alias("author"),
                        F.regexp_extract(s["text"], narr, 2).alias("year"),
                    ),
                ),
            )
        ).alias("c")
    )
    return both.groupBy(
        F.col("c.author").alias("author"),
        C.citation_key(F.col("c.author"), F.col("c.year")).alias("citation_key"),
    ).agg(F.count("*").alias("n"))


@query(
    "tx7_citation_context",
    f"WITH {CITES} SELECT job_id, thesis_page, start, citation_key, thesis_context FROM cites",
)
def citation_context(spark, sf):
    return ops.citations(view(spark, sf, "plant_pages")).select(
        "job_id", "thesis_page", "start", "citation_key", "thesis_context"
    )


@query(
    "pf7_author_guards",
    f"""WITH {_PAREN_RAW},{_NARR_RAW},
      b AS (SELECT author FROM paren WHERE author <> '' UNION ALL SELECT author FROM narr)
      SELECT author, ({_KEEP}) AS keep, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY ALL""",
)
def author_guards(spark, sf):
    return (
        citation_key(spark, sf)
        .groupBy("author", C.keep_citation(F.col("author")).alias("keep"))
        .agg(F.sum("n").alias("n"))
    )


@query(
    "ag1_group_citations",
    f"""WITH {CITES} SELECT job_id, citation_key, CAST(count(*) AS BIGINT) AS occurrences,
        min(thesis_page) AS first_page, max(thesis_page) AS last_page FROM cites GROUP BY 1, 2""",
)
def group_citations(spark, sf):
    return ops.group_citations(ops.citations(view(spark, sf, "plant_pages")))


@query(
    "ag1_citation_members",
    f"""WITH {CITES} SELECT job_id, citation_key, thesis_page, CAST(start AS INTEGER) AS start, thesis_context,
        CAST(count(*) OVER (PARTITION BY job_id, citation_key) AS BIGINT) AS occurrences FROM cites""",
)
def citation_members(spark, sf):
    cites = materialize(ops.citations(view(spark, sf, "plant_pages")), "citations")
    return ops.citation_members(cites).select("job_id", "citation_key", "thesis_page", "start", "thesis_context", "occurrences")


@query(
    "ag2_unique_citations",
    f"""WITH {CITES} SELECT job_id, citation_key, thesis_page, thesis_context FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id, citation_key ORDER BY thesis_page, start, thesis_context) rn
        FROM cites) WHERE rn = 1""",
)
def unique_citations(spark, sf):
    return ops.unique_citations(ops.citations(view(spark, sf, "plant_pages")))
