"""Orthography rules over planted pages and over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.constants import LOCATIVES, PASSIVE_VERBS, PUN_FIXED
from naskah.functions import text as T
from naskah.operators import rules as R
from naskah.plans.fixtures import table, view
from naskah.plans.registry import query, spans_sql

PAGES = "{plant_pages}"
# JSON text to [start, end) lists; malformed text gives an empty list.
RANGES = """coalesce(TRY_CAST(CASE WHEN json_valid({c}) AND json_type({c}) = 'ARRAY' THEN {c} END AS INTEGER[][]), [])"""


def ranges_sql(col: str) -> str:
    return RANGES.replace("{c}", col)


_URL_RE = r"(?i)\bhttps?:\/\/\S+|\bwww\.\S+|\b\S+\.(?:com|org|net|ac\.id|co\.id|io|ly|gov)(?:\/\S*)?"

# Link and code ranges of every page.
SKIPS = f"""
  url_spans AS ({spans_sql(PAGES, "job_id, page_number", "content", _URL_RE)}),
  skips AS (
    SELECT job_id, page_number, s, e FROM url_spans
    UNION ALL
    SELECT job_id, page_number, r[1] AS s, r[2] AS e FROM (
      SELECT job_id, page_number, unnest({ranges_sql("code_json")}) AS r FROM {PAGES}))"""


def rule_sql(pattern: str, message: str, suggestion: str, where: str = "true", flags: str = "") -> str:
    """Oracle of one rule: matches outside the skips, with message and suggestion."""
    return f"""
    WITH {SKIPS},
      hits AS ({spans_sql(PAGES, "job_id, page_number", "content", pattern, flags)})
    SELECT job_id, page_number, s AS "offset", CAST(e - s AS INTEGER) AS length, txt AS token,
           {message} AS message, {suggestion} AS suggestion,
           trim(regexp_replace(substr(src, greatest(s - 30, 0) + 1, e + 30 - greatest(s - 30, 0)), '\\s+', ' ', 'g')) AS excerpt
    FROM hits h
    WHERE ({where}) AND NOT EXISTS (
      SELECT 1 FROM skips k WHERE k.job_id = h.job_id AND k.page_number = h.page_number AND h.s < k.e AND h.e > k.s)"""


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_L = "[A-Za-zÀ-ÿ]"
_DI2 = "lower(regexp_extract(txt, '(?:di|Di)\\s+(.*)', 1))"
_NEXT = "substr(src, e + 1, 2)"
ORACLE = {
    "eyd.double-space": rule_sql(
        f"{_L}  +{_L}", "'Dua spasi atau lebih berturut-turut antara kata.'",
        "regexp_replace(txt, '\\s+', ' ')"),
    "eyd.space-before-punct": rule_sql(
        f"{_L}\\s{{2,}}[,.;:!?]", "'Tidak boleh ada spasi sebelum tanda baca.'",
        "regexp_replace(txt, '\\s+', '')",
        f"NOT (right(txt, 1) = '.' AND (left({_NEXT}, 1) = '.' OR {_NEXT} = ' .'))"),
    "eyd.missing-space-after-punct": rule_sql(
        f"{_L}{{2,}}[,.;:!?]{_L}{{2,}}",
        "'Tidak ada spasi setelah tanda \"' || regexp_extract(txt, '[,.;:!?]') || '\".'",
        "regexp_replace(txt, '([,.;:!?])', '\\1 ')"),
    "eyd.repeated-punct": rule_sql(
        ",{2,}|;{2,}|:{2,}|!{2,}|\\?{2,}", "'Tanda \"' || left(txt, 1) || '\" berulang.'", "left(txt, 1)"),
    "eyd.repeated-period": rule_sql(
        "\\.{2,}", "'Tanda titik berulang. Gunakan satu titik (.) atau elipsis tiga titik (...).'",
        "CASE length(txt) WHEN 2 THEN '.' ELSE '...' END", "length(txt) IN (2, 4, 5)"),
    "eyd.english-number-format": rule_sql(
        R._NUMBER,
        "'Format angka tampak gaya Inggris. Indonesia: titik untuk ribuan (1.000), koma untuk desimal (12,5).'",
        "replace(split_part(txt, '.', 1), ',', '.') || CASE WHEN strpos(txt, '.') > 0 THEN ',' || split_part(txt, '.', 2) ELSE '' END"),
    "eyd.di-locative-one-word": rule_sql(
        R._DI,
        "'\"' || lower(txt) || '\" ditulis terpisah sebagai \"di ' || substr(lower(txt), 3) || '\" (kata depan + kata benda/lokasi).'",
        "'di ' || substr(lower(txt), 3)", flags="i"),
    "eyd.kemana-one-word": rule_sql(
        "\\bkemana\\b", "'\"kemana\" ditulis terpisah sebagai \"ke mana\".'", "'ke mana'", flags="i"),
    "eyd.daripada-two-words": rule_sql(
        "\\bdari\\s+pada\\b", "'\"dari pada\" ditulis serangkai sebagai \"daripada\".'", "'daripada'", flags="i"),
    "eyd.kepada-two-words": rule_sql(
        "\\bke\\s+pada\\b", "'\"ke pada\" ditulis serangkai sebagai \"kepada\".'", "'kepada'", flags="i"),
    "eyd.bagaimana-two-words": rule_sql(
        "\\bbagai\\s+mana\\b", "'\"bagai mana\" ditulis serangkai sebagai \"bagaimana\".'", "'bagaimana'", flags="i"),
    "eyd.ketika-two-words": rule_sql(
        "\\bke\\s+tika\\b", "'\"ke tika\" ditulis serangkai sebagai \"ketika\".'", "'ketika'", flags="i"),
    "eyd.particle-lah-separated": rule_sql(
        R._LAH,
        "'Partikel \"-' || right(txt, 3) || '\" ditulis serangkai dengan kata sebelumnya, contoh \"' || regexp_replace(txt, '\\s+', '') || '\".'",
        "regexp_replace(txt, '\\s+', '')"),
    "eyd.particle-pun-attached": rule_sql(
        R._PUN,
        "'Partikel \"pun\" ditulis terpisah (\"' || left(txt, length(txt) - 3) || ' pun\"), kecuali pada bentuk tetap seperti walaupun, meskipun, adapun, maupun.'",
        "left(txt, length(txt) - 3) || ' pun'", f"lower(txt) NOT IN {_in(PUN_FIXED)}"),
    "eyd.di-passive-split": rule_sql(
        R._SPLIT_DI,
        f"'Prefiks pasif \"di-\" ditulis serangkai dengan kata kerja, contoh \"di' || {_DI2} || '\".'",
        "regexp_replace(txt, '\\s+', '')",
        f"{_DI2} NOT IN {_in(LOCATIVES)} AND ({_DI2} IN {_in(PASSIVE_VERBS)} OR (length({_DI2}) >= 5 AND {_DI2} LIKE '%kan'))"),
}
NAMES = {
    "eyd.double-space": "ey1_double_space",
    "eyd.space-before-punct": "ey2_space_before_punct",
    "eyd.missing-space-after-punct": "ey3_missing_space",
    "eyd.repeated-punct": "ey4_repeated_punct",
    "eyd.repeated-period": "ey5_repeated_period",
    "eyd.english-number-format": "ey6_english_number",
    "eyd.di-locative-one-word": "ey7_di_locative",
    "eyd.kemana-one-word": "ey8_kemana",
    "eyd.daripada-two-words": "ey9_daripada",
    "eyd.kepada-two-words": "ey10_kepada",
    "eyd.bagaimana-two-words": "ey11_bagaimana",
    "eyd.ketika-two-words": "ey12_ketika",
    "eyd.particle-lah-separated": "ey13_particle_lah",
    "eyd.particle-pun-attached": "ey14_particle_pun",
    "eyd.di-passive-split": "ey15_di_passive",
}


def _one_rule(rule: R.Rule):
    def run(spark, sf):
        pages = view(spark, sf, "plant_pages")
        return R.scan_rules(pages, [rule], T.parse_ranges(F.col("code_json")), links=True).drop("rule_id", "severity")

    return run


for _rule in R.RULES:
    query(NAMES[_rule.id], ORACLE[_rule.id])(_one_rule(_rule))


@query(
    "so1_all_rules",
    "SELECT rule_id, severity, CAST(count(*) AS BIGINT) AS n, CAST(sum(length) AS BIGINT) AS chars FROM ("
    + " UNION ALL ".join(
        f"SELECT '{r.id}' AS rule_id, '{r.severity}' AS severity, length FROM ({ORACLE[r.id].strip()})"
        for r in R.RULES
    )
    + ") GROUP BY 1, 2",
)
def all_rules(spark, sf):
    pages = view(spark, sf, "plant_pages")
    hits = R.scan_rules(pages, R.RULES, T.parse_ranges(F.col("code_json")), links=True)
    return hits.groupBy("rule_id", "severity").agg(
        F.count("*").alias("n"), F.sum("length").alias("chars")
    )


@query(
    "ud2_registered_rule",
    f"""SELECT doc_id, s AS "offset", txt AS token, lower(txt) AS suggestion
        FROM ({spans_sql("{documents}", "doc_id", "text", "[A-Z]{9,}")})""",
)
def registered_rule(spark, sf):
    registry = R.RuleRegistry().register(
        R.Rule(
            "custom.shouting", "info", "[A-Z]{9,}",
            lambda m: F.concat(F.lit("Huruf besar: "), m), lambda m: F.lower(m),
        )
    )
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("content")
    )
    return R.scan_rules(docs, registry.select("custom.shouting")).select(
        F.col("page_number").alias("doc_id"), "offset", "token", "suggestion"
    )


@query(
    "wn5_dedupe_findings",
    f"""SELECT doc_id, s AS "offset", rule_id FROM (
        SELECT DISTINCT doc_id, s, 'eyd.repeated-punct' AS rule_id
        FROM ({spans_sql("{documents}", "doc_id", "text", ",{2,}|;{2,}|:{2,}|!{2,}|[?]{2,}")})
        UNION ALL SELECT DISTINCT doc_id, s, 'eyd.missing-space-after-punct'
        FROM ({spans_sql("{documents}", "doc_id", "text", "[A-Za-zÀ-ÿ]{2,}[,.;:!?][A-Za-zÀ-ÿ]{2,}")}))""",
)
def dedupe(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("job_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("content")
    )
    rules = R.RuleRegistry().select("eyd.repeated-punct", "eyd.missing-space-after-punct")
    # The union of two scans holds every finding twice.
    scan = R.scan_rules(docs, rules)
    return R.dedupe_findings(scan.unionByName(scan)).select(
        F.col("page_number").alias("doc_id"), "offset", "rule_id"
    )


@query(
    "tx1_regex_spans",
    f"""SELECT doc_id, s AS start, e AS "end", txt AS token
        FROM ({spans_sql("{documents}", "doc_id", "text", ",{2,}|;{2,}|:{2,}|!{2,}|[?]{2,}")})""",
)
def regex_spans(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", F.explode(T.spans(F.col("text"), r"([,;:!?])\1+")).alias("m"))
        .select("doc_id", "m.start", "m.end", F.col("m.text").alias("token"))
    )


@query(
    "tx8_excerpt",
    f"""SELECT doc_id, s AS start,
        trim(regexp_replace(substr(src, greatest(s - 30, 0) + 1, e + 30 - greatest(s - 30, 0)), '\\s+', ' ', 'g')) AS excerpt
        FROM ({spans_sql("{documents}", "doc_id", "text", ",{2,}|;{2,}|:{2,}|!{2,}|[?]{2,}")})""",
)
def excerpts(spark, sf):
    return (
        table(spark, sf, "documents")
        .select("doc_id", "text", F.explode(T.spans(F.col("text"), r"([,;:!?])\1+")).alias("m"))
        .select(
            "doc_id", "m.start",
            T.excerpt(F.col("text"), F.col("m.start"), F.col("m.end")).alias("excerpt"),
        )
    )


@query(
    "sc2_parse_ranges",
    f"""SELECT job_id, page_number, CAST(r[1] AS INTEGER) AS start, CAST(r[2] AS INTEGER) AS "end"
        FROM (SELECT job_id, page_number, unnest({ranges_sql("italic_json")}) AS r FROM {PAGES})""",
)
def parse_ranges(spark, sf):
    return (
        view(spark, sf, "plant_pages")
        .select("job_id", "page_number", F.explode(T.parse_ranges(F.col("italic_json"))).alias("r"))
        .select("job_id", "page_number", "r.start", "r.end")
    )


@query(
    "pf9_span_overlap",
    f"""WITH {SKIPS}, hits AS ({spans_sql(PAGES, "job_id, page_number", "content", "[A-Z][a-z]+")}),
        rng AS (SELECT job_id, page_number, unnest({ranges_sql("italic_json")}) AS r FROM {PAGES})
        SELECT h.job_id, h.page_number, h.s AS start, h.txt AS token,
               coalesce(bool_or(h.s < r[2] AND h.e > r[1]), false) AS overlap,
               coalesce(bool_or(h.s >= r[1] AND h.s < r[2]), false) AS inside
        FROM hits h LEFT JOIN rng ON rng.job_id = h.job_id AND rng.page_number = h.page_number
        GROUP BY 1, 2, 3, 4""",
)
def span_overlap(spark, sf):
    return (
        view(spark, sf, "plant_pages")
        .select(
            "job_id", "page_number",
            T.parse_ranges(F.col("italic_json")).alias("ranges"),
            F.explode(T.spans(F.col("content"), "[A-Z][a-z]+")).alias("m"),
        )
        .select(
            "job_id", "page_number", "m.start", F.col("m.text").alias("token"),
            T.overlaps(F.col("m.start"), F.col("m.end"), F.col("ranges")).alias("overlap"),
            T.in_ranges(F.col("m.start"), F.col("ranges")).alias("inside"),
        )
    )
