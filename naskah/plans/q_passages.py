"""Passage retrieval: benchmark texts as citation contexts, documents as source pages."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from naskah.functions import vectors as V
from naskah.operators import passages as P
from naskah.plans.fixtures import table, view
from naskah.plans.q_text import SENTENCES, TOKENS, anchors_sql, keywords_sql
from naskah.plans.registry import query


def _queries(spark, sf):
    return view(spark, sf, "passage_queries")


def _pages(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("content")
    )


CAND = f"""{keywords_sql('query_id, source_id', 'context', '{passage_queries}')},
  hits AS (SELECT kw.query_id, kw.source_id, d.doc_id AS page_number, count(*) AS hits
           FROM kw JOIN {{documents}} d ON d.source = kw.source_id AND contains(lower(d.text), kw.keyword) GROUP BY 1, 2, 3),
  cand AS (SELECT query_id, source_id, page_number, CAST(hits AS BIGINT) AS hits, rn AS page_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY hits DESC, page_number) AS rn FROM hits) WHERE rn <= 10
    UNION ALL
    SELECT q.query_id, q.source_id, p.page_number, 0, p.rn FROM {{passage_queries}} q
    JOIN (SELECT source, doc_id AS page_number, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM {{documents}}) p
      ON p.source = q.source_id AND p.rn <= 10
    WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = q.query_id))"""


@query("jn4_candidate_pages", f"WITH {CAND} SELECT query_id, source_id, page_number, hits FROM cand")
def candidate_pages(spark, sf):
    return P.candidate_pages(_queries(spark, sf), _pages(spark, sf)).select(
        "query_id", "source_id", "page_number", "hits"
    )


@query("tk2_top_pages", f"WITH {CAND} SELECT query_id, CAST(page_rank AS INTEGER) AS page_rank, page_number FROM cand WHERE page_rank <= 10")
def top_pages(spark, sf):
    return P.candidate_pages(_queries(spark, sf), _pages(spark, sf), 10).select(
        "query_id", "page_rank", "page_number"
    )


_QT = "trim(regexp_replace(regexp_replace(context, '\\([^)]*\\b\\d{4}[a-z]?\\b[^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g'))"
_NORM = "trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


def _norm(x: str) -> str:
    return _NORM.replace("{x}", x)


SIGNALS = f"""{CAND},
  qt AS (SELECT query_id, source_id, {_QT} AS text FROM {{passage_queries}}),
  qa AS (WITH {anchors_sql('query_id', 'text', 'qt')} SELECT query_id, list(anchor) FILTER (WHERE kind = 'noun') AS nouns,
         list(anchor) FILTER (WHERE kind = 'number') AS nums FROM anchors GROUP BY 1),
  qf AS (SELECT query_id, source_id, {_norm('text')} AS qn, list_distinct({TOKENS}) AS qtok, string_split({_norm('text')}, ' ') AS qw FROM qt),
  used AS (SELECT DISTINCT source_id, page_number FROM cand),
  sent AS (SELECT source_id, page_number, {SENTENCES} AS s FROM used JOIN {{documents}} ON doc_id = page_number),
  win AS (SELECT source_id, page_number, CAST(i AS INTEGER) AS window_idx, array_to_string(s[i + 1 : i + 3], ' ') AS text,
            page_number * 100000 + i AS wid
          FROM (SELECT *, unnest(range(0, greatest(len(s) - 3, 0) + 1)) AS i FROM sent WHERE len(s) > 0)),
  wa AS (WITH {anchors_sql('wid', 'text', 'win')} SELECT wid, list(anchor) FILTER (WHERE kind = 'noun') AS nouns,
         list(anchor) FILTER (WHERE kind = 'number') AS nums FROM anchors GROUP BY 1),
  wf AS (SELECT w.*, {_norm('text')} AS wn, list_distinct({TOKENS}) AS wtok, coalesce(nouns, []) AS wnoun, coalesce(nums, []) AS wnum
         FROM win w LEFT JOIN wa USING (wid)),
  sig AS (SELECT c.query_id, c.source_id, c.page_number, c.page_rank, window_idx, wf.text AS window_text, qn, wn,
      CASE WHEN len(qw) >= 8 AND len(list_filter(range(1, len(qw) - 6), lambda i: contains(wn, array_to_string(qw[i : i + 7], ' ')))) > 0 THEN 1 ELSE 0 END AS ex,
      CASE WHEN len(coalesce(qa.nouns, [])) = 0 THEN 0 ELSE len(list_intersect(qa.nouns, wnoun)) / len(qa.nouns) END AS noun,
      CASE WHEN len(list_intersect(coalesce(qa.nums, []), wnum)) > 0 THEN 1 ELSE 0 END AS num,
      CASE WHEN len(qtok) = 0 THEN 0 ELSE len(list_intersect(qtok, wtok)) / len(qtok) END AS tok
    FROM cand c JOIN qf USING (query_id, source_id) LEFT JOIN qa USING (query_id) JOIN wf ON wf.source_id = c.source_id AND wf.page_number = c.page_number)"""
LEX = f"""{SIGNALS},
  fz AS (SELECT *, CASE WHEN ex = 1 OR qn = '' OR wn = '' THEN 0 ELSE 1 - levenshtein(left(qn, 400), left(wn, 400)) / greatest(length(left(qn, 400)), length(left(wn, 400))) END AS fuzzy
         FROM sig WHERE ex > 0 OR noun > 0 OR num > 0 OR tok >= 0.2),
  sc AS (SELECT *, 0.6 * tok + 0.25 * ex + 0.1 * fuzzy + 0.05 * noun AS combined FROM fz),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 9) DESC, page_rank, window_idx) AS rn FROM sc) WHERE rn = 1)"""


@query(
    "jn5_match_passage",
    f"""WITH {LEX} SELECT q.query_id, q.source_id, b.page_number AS source_page, window_text AS matched_passage,
      CAST(floor(combined * 100 + 0.5) / 100 AS DOUBLE) AS confidence,
      CASE WHEN combined IS NULL THEN NULL WHEN ex = 1 THEN 'Exact 8-word n-gram match' WHEN fuzzy > 0.6 THEN 'High Levenshtein similarity'
           WHEN noun > 0 THEN 'Shared entity overlap' ELSE 'High token overlap with thesis context' END AS reasoning
    FROM {{passage_queries}} q LEFT JOIN (SELECT * FROM best WHERE combined >= 0.42) b ON b.query_id = q.query_id""",
)
def match_passage(spark, sf):
    return P.match_passages(_queries(spark, sf), _pages(spark, sf))


@query(
    "ag17_passage_summary",
    f"""WITH {LEX}, r AS (SELECT q.query_id, q.source_id, floor(combined * 100 + 0.5) / 100 AS confidence,
        CASE WHEN q.query_id % 7 = 0 THEN 'no-source' WHEN combined >= 0.42 THEN 'matched' ELSE 'no-match' END AS status
        FROM {{passage_queries}} q LEFT JOIN best b ON b.query_id = q.query_id)
      SELECT source_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE status = 'matched') AS BIGINT) AS matched,
        CAST(count(*) FILTER (WHERE status = 'no-match') AS BIGINT) AS no_match, CAST(count(*) FILTER (WHERE status = 'no-source') AS BIGINT) AS no_source,
        CAST(coalesce(floor(avg(CAST(round(confidence * 100) AS BIGINT)) FILTER (WHERE status = 'matched') + 0.5) / 100, 0) AS DOUBLE) AS avg_confidence FROM r GROUP BY 1""",
)
def passage_summary(spark, sf):
    status = (
        F.when(F.col("query_id") % 7 == 0, "no-source")
        .when(F.col("confidence").isNotNull(), "matched")
        .otherwise("no-match")
    )
    return P.passage_summary(match_passage(spark, sf).withColumn("status", status), "source_id")


def word_shapes(texts) -> np.ndarray:
    """A stand-in model for the embedder slot: words counted by first and last letter and length."""
    out = np.zeros((len(texts), 64), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in re.findall("[A-Za-z]+", t):
            w = w.lower()
            out[i, (3 * ord(w[0]) + 7 * ord(w[-1]) + len(w)) % 64] += 1
    return out


def shape_sql(key: str, source: str) -> str:
    """``word_shapes`` of a table as rows (key, dimension, share of a unit vector), in SQL."""
    code = "(3 * ascii(lower(w[1])) + 7 * ascii(lower(w[-1])) + length(w)) % 64"
    return f"""SELECT {key}, c, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v FROM (
      SELECT {key}, {code} AS c, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM {source}) GROUP BY 1, 2)"""


MODEL = "multilingual-e5-small"
FLOOR = 0.78
SEM = f"""{SIGNALS},
  qv AS ({shape_sql('query_id', 'qt')}),
  wv AS ({shape_sql('wid', 'win')}),
  keyed AS MATERIALIZED (SELECT *, page_number * 100000 + window_idx AS wid FROM sig),
  dots AS (SELECT k.query_id, k.wid, round(sum(qv.v * wv.v), 12) AS cosine FROM keyed k JOIN qv USING (query_id) JOIN wv ON wv.wid = k.wid AND wv.c = qv.c GROUP BY 1, 2),
  sem AS (SELECT k.*, coalesce(cosine, 0) AS cosine FROM keyed k LEFT JOIN dots USING (query_id, wid)),
  mg AS (SELECT query_id, greatest(max(cosine), 0) AS top, greatest(coalesce(max(cosine) FILTER (WHERE rn = 2), 0), 0) AS runner
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC) AS rn FROM sem) WHERE rn <= 2 GROUP BY 1),
  sb AS (SELECT *, 0.55 * cosine + 0.2 * ex + 0.15 * noun + 0.1 * num AS combined FROM sem WHERE cosine >= {FLOOR} AND (ex > 0 OR noun > 0 OR num > 0 OR tok >= 0.2)),
  bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(combined, 7) DESC, page_rank, window_idx) AS rn FROM sb) WHERE rn = 1)"""


@query(
    "jn6_match_passage_semantic",
    f"""WITH {SEM} SELECT q.query_id, q.source_id, b.page_number AS source_page, window_text AS matched_passage,
      CAST(floor(combined * 100 + 0.5) / 100 AS DOUBLE) AS confidence,
      CASE WHEN combined IS NULL THEN NULL WHEN ex = 1 THEN 'Semantic embedding + exact n-gram overlap' WHEN noun > 0 THEN 'Semantic embedding + shared entity'
           WHEN num = 1 THEN 'Semantic embedding + shared number/year' ELSE 'Semantic embedding + token overlap' END AS reasoning
    FROM {{passage_queries}} q LEFT JOIN (SELECT bb.* FROM bb JOIN mg USING (query_id)
      WHERE combined >= 0.42 AND (top - runner >= 0.015 OR cosine >= {FLOOR} + 0.05)) b ON b.query_id = q.query_id""",
)
def match_passage_semantic(spark, sf):
    return P.match_passages_semantic(_queries(spark, sf), _pages(spark, sf), word_shapes, MODEL)


@query(
    "wn8_similarity_margin",
    f"""WITH {SEM} SELECT query_id, round(top, 6) AS top, round(runner, 6) AS runner_up, round(top - runner, 6) AS margin FROM mg""",
)
def similarity_margin(spark, sf):
    """Over all windows of each query's candidate pages."""
    scores = P.candidate_cosines(_queries(spark, sf), _pages(spark, sf), word_shapes, FLOOR)[2]
    m = P.similarity_margin(scores, ["query_id"])
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("top", "runner_up", "margin")])


@query(
    "ud3_vector_helpers",
    """SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda k: a.embedding[k]::DOUBLE * b.embedding[k]::DOUBLE)), 6) AS dot,
       round(list_sum(list_transform(range(1, 65), lambda k: a.embedding[k]::DOUBLE * b.embedding[k]::DOUBLE))
         / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS cosine,
       0.0::DOUBLE AS mismatch, true AS round_trip
       FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""",
)
def vector_helpers(spark, sf):
    emb = table(spark, sf, "embeddings")
    nxt = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    a, b = F.col("embedding"), F.col("b")
    return emb.join(nxt, "vec_id").select(
        "vec_id",
        F.round(V.dot(a, b), 6).alias("dot"),
        F.round(V.cosine(a, b), 6).alias("cosine"),
        V.dot(a, F.slice(b, 1, 3)).alias("mismatch"),
        (V.decode_f32(V.encode_f32(a)) == a).alias("round_trip"),
    )


def letter_counts(texts) -> np.ndarray:
    """A stand-in model for the embedder slot: letter frequencies."""
    out = np.zeros((len(texts), 26), dtype=np.float32)
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.lower().encode("ascii", "ignore"), dtype=np.uint8)
        codes = codes[(codes >= 97) & (codes <= 122)] - 97
        out[i] = np.bincount(codes, minlength=26)
    return out


@query(
    "ud1_embedder_slot",
    f"""WITH sent AS (SELECT source AS source_id, doc_id AS page_number, {SENTENCES} AS s FROM {{documents}})
      SELECT source_id, page_number, CAST(unnest(range(0, greatest(len(s) - 3, 0) + 1)) AS INTEGER) AS window_idx,
        26 AS dims, 1.0::DOUBLE AS norm FROM sent WHERE len(s) > 0""",
)
def embedder_slot(spark, sf):
    windows = P.source_windows(_pages(spark, sf))
    embedded = V.embed_texts(windows, "window_text", letter_counts, "passage", e5=True)
    return embedded.select(
        "source_id", "page_number", "window_idx",
        F.size("vector").alias("dims"), F.round(V.dot(F.col("vector"), F.col("vector")), 4).alias("norm"),
    )
