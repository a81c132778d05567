"""Text operators over documents, benchmark texts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from naskah.constants import ABBREVIATIONS, STOPWORDS
from naskah.functions import passages as P
from naskah.functions import text as T
from naskah.operators import bm25 as BM
from naskah.plans.fixtures import table, view
from naskah.plans.registry import query, spans_sql

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS = (
    "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'),"
    f" lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"
)
_ABB = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
SENTENCES = f"""list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'),
      '([.!?]) ([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'),
      '(?i)((?:^| |' || chr(1) || ')(?:[a-z]|{_ABB})\\.)' || chr(1), '\\1 ', 'g'),
      '(?i)((?:^| |' || chr(1) || ')(?:[a-z]|{_ABB})\\.)' || chr(1), '\\1 ', 'g'),
    chr(1)), lambda s: trim(s)), lambda s: s <> '')"""


def docs(spark, sf):
    return table(spark, sf, "documents")


@query(
    "sc1_page_scan",
    """SELECT source AS job_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page_number,
       doc_id, length(text) AS chars FROM {documents} WHERE source IN ('src0', 'src1', 'src2')""",
)
def page_scan(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("doc_id")
    return (
        table(spark, sf, "documents")
        .filter(F.col("source").isin("src0", "src1", "src2"))
        .select(
            F.col("source").alias("job_id"), F.row_number().over(order).alias("page_number"),
            "doc_id", F.length("text").cast("bigint").alias("chars"),
        )
    )


@query(
    "pf13_page_density",
    """SELECT source AS job_id, CAST(count(*) AS BIGINT) AS pages,
       CAST(count(*) FILTER (WHERE length(text) < 50) AS BIGINT) AS low_pages,
       count(*) FILTER (WHERE length(text) < 50) > 0.5 * count(*) AS scanned FROM {documents} GROUP BY 1""",
)
def page_density(spark, sf):
    from naskah.operators.pages import page_density as op

    return op(
        table(spark, sf, "documents").select(F.col("source").alias("job_id"), F.col("text").alias("content"))
    )


@query(
    "tx2_tokens",
    f"""SELECT doc_id, s AS "offset", e AS "end", txt AS token
        FROM ({spans_sql("{conversations_text}", "doc_id", "text", "[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ''-]*").replace("''''", "''")})""",
)
def tokens(spark, sf):
    from naskah.operators.words import tokens as op

    pages = view(spark, sf, "conversations_text").select(
        F.lit("x").alias("job_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("content")
    )
    return op(pages).select(F.col("page_number").alias("doc_id"), "offset", "end", "token")


@query("tx18_sentences", f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, s[i] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {SENTENCES} AS s FROM {{documents}}))")
def sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.posexplode(P.sentences(F.col("text"))).alias("pos", "sentence"))


@query(
    "wn1_sentence_windows",
    f"""WITH d AS (SELECT doc_id, {SENTENCES} AS s FROM {{documents}})
    SELECT doc_id, CAST(i AS INTEGER) AS window_idx, array_to_string(s[i + 1 : i + 3], ' ') AS window_text
    FROM (SELECT *, unnest(range(0, greatest(len(s) - 3, 0) + 1)) AS i FROM d WHERE len(s) > 0)""",
)
def sentence_windows(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.posexplode(P.windows(P.sentences(F.col("text")))).alias("window_idx", "window_text")
    )


@query("tx21_bm25_tokens", f"SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM {{documents}}) GROUP BY 1, 2")
def bm25_tokens(spark, sf):
    return BM.postings(docs(spark, sf)).select("doc_id", "term", "tf")


@query(
    "tx22_ngrams",
    """WITH w AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM {benchmark})
    SELECT item_id, CAST(i AS INTEGER) AS pos, array_to_string(w[i + 1 : i + 8], ' ') AS gram
    FROM (SELECT *, unnest(range(0, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)""",
)
def ngrams(spark, sf):
    return table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(P.text_ngrams(F.col("text"), 8)).alias("pos", "gram")
    )


KEYWORDS = """
  kw AS (
    SELECT DISTINCT {key}, CASE WHEN o = 1 THEN lower(c) ELSE c END AS keyword
    FROM (SELECT {key}, regexp_replace(unnest(regexp_split_to_array({text}, '\\s+')), '[.,;:!?()"'']', '', 'g') AS c
          FROM {src}) x, (VALUES (1), (2)) v(o)
    WHERE (o = 1 AND ((regexp_matches(c, '^[A-Z][a-z]+') AND length(c) > 2) OR regexp_matches(c, '^[A-Z]{2,}$')))
       OR (o = 2 AND regexp_matches(c, '[0-9]{2,}')))"""


def keywords_sql(key: str, text: str, src: str) -> str:
    return KEYWORDS.replace("{key}", key).replace("{text}", text).replace("{src}", src)


@query("tx23_keywords", f"WITH {keywords_sql('doc_id', 'text', '{documents}')} SELECT doc_id, keyword FROM kw")
def keywords(spark, sf):
    return docs(spark, sf).select("doc_id", F.explode(P.keywords(F.col("text"))).alias("keyword"))


def anchors_sql(key: str, text: str, src: str) -> str:
    """Proper nouns and numbers without look-behind: words after exactly one blank."""
    return f"""
  parts AS (SELECT {key}, regexp_split_to_array({text}, '\\s') AS p FROM {src}),
  mids AS (SELECT {key}, regexp_extract(p[i], '^([A-Z][a-zA-Z]{{2,}}|[A-Z]{{2,}})') AS a
           FROM (SELECT *, unnest(range(2, len(p) + 1)) AS i FROM parts) WHERE p[i - 1] <> '' AND p[i] <> ''),
  bare AS (SELECT {key}, regexp_replace(unnest(p), '[^A-Za-z]', '', 'g') AS a FROM parts),
  anchors AS (
    SELECT DISTINCT {key}, 'noun' AS kind, lower(a) AS anchor FROM (
      SELECT * FROM mids WHERE a <> '' UNION ALL
      SELECT * FROM bare WHERE regexp_matches(a, '^[A-Z]{{2,}}$') OR (length(a) >= 4 AND regexp_matches(a, '^[A-Z][a-z]+[A-Z]')))
    UNION ALL SELECT DISTINCT {key}, 'number', unnest(regexp_extract_all({text}, '\\b\\d{{2,}}\\b')) FROM {src})"""


@query("tx24_anchors", f"WITH {anchors_sql('doc_id', 'text', '{documents}')} SELECT doc_id, kind, anchor FROM anchors")
def anchors(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id",
        F.explode(
            F.concat(
                F.transform(P.proper_nouns(t), lambda a: F.struct(F.lit("noun").alias("kind"), a.alias("anchor"))),
                F.transform(P.numbers(t), lambda a: F.struct(F.lit("number").alias("kind"), a.alias("anchor"))),
            )
        ).alias("x"),
    ).select("doc_id", "x.kind", "x.anchor")


@query(
    "tx29_search_pages",
    """WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM {documents}),
    c AS (SELECT doc_id, len(string_split(t, 'the re')) - 1 AS n FROM d)
    SELECT doc_id, CAST(unnest(range(0, n)) AS INTEGER) AS occurrence FROM c WHERE n > 0""",
)
def search_pages(spark, sf):
    from naskah.operators.pages import search_pages as op

    return op(
        docs(spark, sf).select("doc_id", F.col("text").alias("content")), "  The\nRE "
    ).select("doc_id", "occurrence")


@query(
    "tx33_fold",
    """SELECT doc_id, strip_accents(lower(text)) AS folded,
       trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_form
       FROM {documents}""",
)
def fold(spark, sf):
    return docs(spark, sf).select(
        "doc_id", T.fold_accents(F.col("text")).alias("folded"), T.fold_title(F.col("text")).alias("title_form")
    )


_BM = f"""
  d AS (SELECT doc_id, {TOKENS} AS t FROM {{documents}}),
  size AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM d),
  tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS f FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""


@query(
    "ag18_bm25_index",
    f"""WITH {_BM} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, size""",
)
def bm25_index(spark, sf):
    return BM.bm25_index(docs(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(
    "ag19_bm25_rank",
    f"""WITH {_BM},
    q AS (SELECT item_id, unnest({TOKENS}) AS term FROM {{benchmark}})
    SELECT item_id, doc_id, round(score, 6) AS score FROM (
      SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len)))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term), size GROUP BY 1, 2) WHERE score > 0""",
)
def bm25_rank(spark, sf):
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return BM.bm25_rank(docs(spark, sf), queries).select(
        F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score")
    )


@query(
    "so5_overlap_jaccard",
    f"""WITH t AS (SELECT item_id, list_distinct({TOKENS}) AS t FROM {{benchmark}}),
    n AS (SELECT a.item_id, a.t AS a, b.t AS b, len(list_intersect(a.t, b.t)) AS i
          FROM t a JOIN t b ON b.item_id = a.item_id + 1)
    SELECT item_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE i / len(a) END, 6) AS overlap,
           round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE i / (len(a) + len(b) - i) END, 6) AS jaccard FROM n""",
)
def overlap_jaccard(spark, sf):
    t = table(spark, sf, "benchmark").select(
        "item_id", F.array_distinct(P.bm25_tokens(F.col("text"))).alias("t")
    )
    nxt = t.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    return t.join(nxt, "item_id").select(
        "item_id",
        F.round(P.overlap_rate(F.col("t"), F.col("u")), 6).alias("overlap"),
        F.round(P.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"),
    )


@query(
    "tx19_front_matter",
    """WITH f AS (SELECT page_id, content,
      CAST(regexp_matches(content, '(?i)\\bE[\\s-]?ISSN\\b') AS INT) + CAST(regexp_matches(content, '(?i)\\bISSN\\b') AS INT)
      + CAST(regexp_matches(content, '(?i)\\bDOI\\s*:?\\s*10\\.') AS INT) + CAST(regexp_matches(content, '(?i)\\bVol(ume)?\\.?\\s*\\d+') AS INT)
      + CAST(regexp_matches(content, '(?i)\\bNo(mor)?\\.?\\s*\\d+') AS INT)
      + CAST(regexp_matches(content, '\\b[\\w.-]+@[\\w.-]+\\.[A-Za-z]{2,}\\b') AS INT) + CAST(regexp_matches(content, '\\bA\\s*B\\s*S\\s*T\\s*R\\s*A\\s*K\\b') AS INT)
      + CAST(regexp_matches(content, '\\bA\\s*B\\s*S\\s*T\\s*R\\s*A\\s*C\\s*T\\b') AS INT) + CAST(regexp_matches(content, '(?i)\\bISBN\\b') AS INT) AS hits FROM {plant_front}),
    c AS (SELECT *, CASE
        WHEN regexp_matches(content, '(?i)P\\s*E\\s*N\\s*D\\s*A\\s*H\\s*U\\s*L\\s*U\\s*A\\s*N') THEN '(?i)P\\s*E\\s*N\\s*D\\s*A\\s*H\\s*U\\s*L\\s*U\\s*A\\s*N'
        WHEN regexp_matches(content, '(?i)INTRODUCTION') THEN '(?i)INTRODUCTION'
        WHEN regexp_matches(content, '(?i)latar\\s+belakang') THEN '(?i)latar\\s+belakang' END AS p FROM f),
    b AS (SELECT *, CASE WHEN p IS NOT NULL THEN trim(regexp_replace(content, '(?s)^.*?' || p, '')) END AS rest FROM c)
    SELECT page_id, hits >= 2 AS front_matter, CASE WHEN hits >= 2 AND length(rest) >= 80 THEN rest ELSE content END AS stripped FROM b""",
)
def front_matter(spark, sf):
    c = F.col("content")
    return view(spark, sf, "plant_front").select(
        "page_id", P.looks_like_front_matter(c).alias("front_matter"), P.strip_front_matter(c).alias("stripped")
    )


@query(
    "pf11_front_matter_signals",
    """SELECT job_id, page_number,
      CAST(regexp_matches(content, '(?i)\\bVol(ume)?\\.?\\s*\\d+') AS INT) + CAST(regexp_matches(content, '(?i)\\bNo(mor)?\\.?\\s*\\d+') AS INT)
      + CAST(regexp_matches(content, '(?i)\\b(ISSN|E[\\s-]?ISSN)\\b') AS INT) + CAST(regexp_matches(content, '(?i)\\bDOI\\s*:?\\s*10\\.') AS INT) >= 2 AS front_matter
      FROM {plant_pages}""",
)
def front_matter_signals(spark, sf):
    return view(spark, sf, "plant_pages").select(
        "job_id", "page_number", P.looks_like_front_matter(F.col("content")).alias("front_matter")
    )


@query(
    "tx20_strip_markers",
    """SELECT job_id, page_number, trim(regexp_replace(regexp_replace(regexp_replace(content,
        '\\([^)]*\\b\\d{4}[a-z]?\\b[^)]*\\)', ' ', 'g'),
        '\\b[A-Z][a-zA-Z]+(?:\\s*(?:&|et\\s+al\\.?)\\s*[A-Z][a-zA-Z]+)?\\s*\\(\\d{4}[a-z]?\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS stripped
        FROM {plant_pages}""",
)
def strip_markers(spark, sf):
    return view(spark, sf, "plant_pages").select(
        "job_id", "page_number", P.strip_markers(F.col("content")).alias("stripped")
    )
