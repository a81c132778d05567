"""Bibliographies over planted pages and single entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.functions import references as R
from naskah.functions import text as T
from naskah.operators import references as ops
from naskah.plans.fixtures import table, view
from naskah.plans.registry import query

_HEAD = "(?i)" + R.HEADING
_SECTION = f"""
  starts AS (SELECT job_id, max(page_number) AS start_page FROM {{plant_pages}}
             WHERE regexp_matches(content, '{_HEAD}') GROUP BY 1),
  section AS (SELECT p.*, start_page FROM {{plant_pages}} p JOIN starts USING (job_id) WHERE page_number >= start_page)"""


@query("tx9_reference_section", f"WITH {_SECTION} SELECT job_id, page_number, start_page, content FROM section")
def reference_section(spark, sf):
    return ops.reference_section(view(spark, sf, "plant_pages")).select(
        "job_id", "page_number", "start_page", "content"
    )


_LINES = """
  lines AS (SELECT job_id, page_number, i, l[i] AS raw, trim(l[i]) AS line FROM (
     SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT source AS job_id, doc_id AS page_number, string_split(text, chr(10)) AS l FROM {documents}))),
  totals AS (SELECT job_id, count(DISTINCT page_number) AS pages FROM lines GROUP BY 1),
  rep AS (SELECT job_id, line, CAST(count(DISTINCT page_number) AS BIGINT) AS n FROM lines WHERE line <> '' GROUP BY 1, 2)"""


@query(
    "tx10_strip_repeating_lines",
    f"""WITH {_LINES},
      gone AS (SELECT job_id, line FROM rep JOIN totals USING (job_id) WHERE n > 1 AND n >= ceil(pages * 0.5))
    SELECT l.job_id, l.page_number, md5(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (
      WHERE line = '' OR NOT (regexp_matches(line, '^[0-9]{{1,3}}$') OR g.line IS NOT NULL)), '')) AS digest
    FROM lines l LEFT JOIN gone g USING (job_id, line) GROUP BY 1, 2""",
)
def strip_repeating_lines(spark, sf):
    pages = table(spark, sf, "documents").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("content")
    )
    return ops.strip_repeating_lines(pages).select(
        "job_id", "page_number", F.md5(F.col("content").cast("binary")).alias("digest")
    )


@query("tx11_running_header")
def running_header(spark, sf):
    section = ops.reference_section(view(spark, sf, "plant_pages"))
    return ops.running_header(section).select("job_id", F.array_join("words", " ").alias("header"))


@query("tx12_join_url_lines")
def join_url_lines(spark, sf):
    return view(spark, sf, "plant_entries").select(
        "entry_id", R.join_url_lines(F.col("raw_text")).alias("joined")
    )


@query("tx13_split_entries")
def split_entries(spark, sf):
    return ops.reference_entries(view(spark, sf, "plant_pages"))


def _entries(spark, sf):
    return view(spark, sf, "plant_entries")


YEAR = r"""coalesce(nullif(regexp_extract(raw_text, '\((\d{4})[a-z]?[,)]', 1), ''),
  nullif(regexp_extract(raw_text, '^[A-Z][a-zA-Zà-öø-ÿÀ-ÖØ-Ý'',\-\s]+?[.,]\s*((?:19|20)\d{2})[a-z]?\s*[.,]', 1), ''),
  nullif(regexp_extract(raw_text, '\b(19\d{2}|20[0-2]\d)\b', 1), ''), 'n.d.')"""


@query("tx14_ref_year", f"SELECT entry_id, {YEAR} AS year FROM {{plant_entries}}")
def ref_year(spark, sf):
    return _entries(spark, sf).select("entry_id", R.ref_year(F.col("raw_text")).alias("year"))


DOI = r"nullif(regexp_extract(raw_text, '(?i)\b(?:doi:\s*|https?://doi\.org/)(10\.\d{4,9}/[^\s,)]+[^\s,).:])', 1), '')"
URL = r"""coalesce(list_filter(regexp_extract_all(raw_text, 'https?://[^\s,)>\]]+'), lambda u: strpos(u, 'doi.org') = 0)[1],
  regexp_extract_all(raw_text, 'https?://[^\s,)>\]]+')[1])"""


@query("tx15_ref_doi_url", f"SELECT entry_id, {DOI} AS doi, {URL} AS url FROM {{plant_entries}}")
def ref_doi_url(spark, sf):
    raw = F.col("raw_text")
    return _entries(spark, sf).select("entry_id", R.ref_doi(raw).alias("doi"), R.ref_url(raw).alias("url"))


_TIDY = r"trim(regexp_replace({a}, '[.,\s]+$', ''))"
_S1 = r"(?s)^(.+?)\s*\((\d{4})[a-z]?(?:,\s*\w+)?\)\.\s*(.*)$"
_S2 = r"""(?s)^(.+?)\s*\((\d{4})[a-z]?\)\s*[''"]?\s*(.*)$"""
_S3 = r"(?s)^(.+?),\s*((?:19|20)\d{2})[a-z]?\.\s+(.*)$"
_S4 = r"(?s)^(.+?)[.,]\s*((?:19|20)\d{2})[a-z]?\s*[.,]\s*(.*)$"


def _author(group: int) -> str:
    def part(p: str) -> str:
        got = f"regexp_extract(raw_text, '{p}', {group})"
        return _TIDY.replace("{a}", got) if group == 1 else got

    whens = " ".join(f"WHEN regexp_matches(raw_text, '{p}') THEN {part(p)}" for p in (_S1, _S2, _S3, _S4))
    last = (
        r"CASE WHEN length(regexp_extract(raw_text, '(?s)^(.*?)\(?\d{4}', 1)) > 3 THEN "
        + (
            _TIDY.replace("{a}", r"regexp_extract(raw_text, '(?s)^(.*?)\(?\d{4}\)?', 1)")
            if group == 1
            else r"regexp_replace(raw_text, '(?s)^.*?\(?\d{4}\)?[.,\s]*', '')"
        )
        + " END"
    )
    return f"CASE {whens} ELSE {last} END"


@query(
    "tx16_ref_author",
    f"SELECT entry_id, coalesce({_author(1)}, 'Unknown') AS author, {_author(3)} AS rest FROM {{plant_entries}}",
)
def ref_author(spark, sf):
    parts = R.author_and_rest(F.col("raw_text"))
    return (
        _entries(spark, sf)
        .select("entry_id", parts.alias("p"))
        .select("entry_id", F.coalesce("p.author", F.lit("Unknown")).alias("author"), "p.rest")
    )


@query("tx17_ref_title_venue")
def ref_title_venue(spark, sf):
    return (
        _entries(spark, sf)
        .select("entry_id", R.parse_entry(F.col("raw_text")).alias("f"))
        .select("entry_id", "f.title", "f.publisher", "f.journal")
    )


@query(
    "pf12_bad_references",
    """SELECT job_id, reference_id, author, year, title FROM {plant_refs}
       WHERE author = 'Unknown' OR length(author) <= 1 OR NOT regexp_matches(year, '^(19|20)[0-9]{2}$')
          OR length(title) < 10 OR length(title) > 300""",
)
def bad_references(spark, sf):
    return ops.bad_references(view(spark, sf, "plant_refs"))


@query(
    "ag22_duplicate_references",
    """SELECT job_id, ref_key, CAST(count(*) AS BIGINT) AS n FROM (
         SELECT source AS job_id, trim(regexp_replace(lower(substr(text, 1, 200)), '\\s+', ' ', 'g')) AS ref_key FROM {documents})
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_references(spark, sf):
    refs = table(spark, sf, "documents").select(F.col("source").alias("job_id"), F.col("text").alias("raw_text"))
    return ops.duplicate_references(refs)
