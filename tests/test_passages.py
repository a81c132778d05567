"""Candidate pages and vector scores against plain Python."""

import random
import re

import numpy as np
import pytest
from naskah.operators import passages as P
from pyspark.sql import functions as F


def keywords(context):
    out = []
    for w in context.split():
        w = re.sub(r"[.,;:!?()\"']", "", w)
        if re.match("^[A-Z][a-z]+", w) and len(w) > 2 or re.fullmatch("[A-Z]{2,}", w):
            out.append(w.lower())
        if re.search("[0-9]{2,}", w):
            out.append(w)
    return set(out)


def corpus(seed):
    r = random.Random(seed)
    parts = ["ab", "ABC", "Xy", "12", "2019", "Rumah", "rumahan", "Éa", "CO", "co2", "zz-ABC", "Tabel", "iklim,", "Suku"]
    text = lambda n: " ".join(r.choice(parts) + r.choice(["", "", "s", "12"]) for _ in range(n))
    pages = [(f"s{s}", p * 7, text(r.choice([0, 3, 12]))) for s in range(4) for p in range(25)] + [("s0", 1000, None)]
    queries = [(q, f"s{r.randrange(5)}", text(r.choice([1, 4, 9]))) for q in range(25)] + [(90, "s1", "tanpa kata kunci"), (91, "s1", ""), (92, "none", "ABC")]
    return queries, pages


def frames(spark, queries, pages):
    return (
        spark.createDataFrame(queries, "query_id long, source_id string, context string"),
        spark.createDataFrame(pages, "source_id string, page_number long, content string").repartition(4),
    )


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("chars", [None, 0])
def test_keyword_pages(spark, monkeypatch, seed, chars):
    """One automaton, and the join that takes over when there are too many keywords."""
    if chars is not None:
        monkeypatch.setattr(P, "AUTOMATON_CHARS", chars)
    queries, pages = corpus(seed)
    want = {}
    for q, source, context in queries:
        for s, p, content in pages:
            n = sum(k in (content or "").lower() for k in keywords(context))
            if s == source and n:
                want[q, p] = n
    got = P.keyword_pages(*frames(spark, queries, pages)).collect()
    assert {(r.query_id, r.page_number): r.hits for r in got} == want and len(got) == len(want)
    short = {k for q in queries for k in keywords(q[2]) if len(k) <= 3}
    assert {len(k) for k in short} >= {2, 3}


def test_no_queries_no_pages(spark):
    queries, pages = corpus(0)
    q, p = frames(spark, queries, pages)
    assert P.candidate_pages(q.limit(0), p).count() == 0
    assert P.candidate_pages(q, p.limit(0)).count() == 0


@pytest.mark.parametrize("many", [False, True])
def test_cosine_scores(spark, monkeypatch, many):
    if many:  # parts of queries, several groups of pages
        monkeypatch.setattr(P, "QUERIES_A_GROUP", 3)
        monkeypatch.setattr(P, "PAGES_A_GROUP", 2)
    r = np.random.default_rng(4)
    unit = lambda: (lambda v: (v / np.linalg.norm(v)).astype(np.float32).tolist())(r.normal(size=6))
    queries = [(q, f"s{q % 3}", unit()) for q in range(20)] + [(77, "s1", [1.0, 0.0]), (78, "s1", None)]
    windows = [(f"s{s}", p, w, unit()) for s in range(3) for p in (0, 1, 2, 5, 9) for w in range(4)] + [("s1", 5, 9, None)]
    windows[5] = (*windows[4][:2], 99, windows[4][3])  # equal vectors tie
    candidates = [(q, s, int(p)) for q, s, _ in queries for p in r.choice([0, 1, 2, 5, 9, 500], 3, replace=False)]
    floor = 0.3
    want, margins = {}, {}
    for q, s, p in candidates:
        mine = {q_: v for q_, _, v in queries}[q]
        for ws, wp, wi, v in windows:
            if (ws, wp) == (s, p):
                c = float(np.dot(np.array(mine, float), np.array(v, float))) if mine and v and len(mine) == len(v) else 0.0
                margins.setdefault(q, []).append(c)
                if c >= floor:
                    want[q, s, wp, wi] = round(c, 6)
    out = P.cosine_scores(
        spark.createDataFrame(candidates, "query_id long, source_id string, page_number long").repartition(3),
        spark.createDataFrame(queries, "query_id long, source_id string, vector array<float>"),
        spark.createDataFrame(windows, "source_id string, page_number long, window_idx int, vector array<float>"), floor,
    )
    assert {tuple(x[:4]): round(x.cosine, 6) for x in out.where(F.col("cosine") >= floor).collect()} == want
    top = {x.query_id: (x.top, x.runner_up) for x in P.similarity_margin(out, ["query_id"]).collect()}
    for q, cosines in margins.items():
        best = sorted([*cosines, 0.0, 0.0])[:-3:-1]
        assert top[q] == pytest.approx(best, abs=1e-9)


def test_stored_vectors_spare_the_model(spark):
    windows = spark.createDataFrame([("s", 1, 0, "satu"), ("s", 1, 1, "dua dua")], "source_id string, page_number long, window_idx int, window_text string")
    stored = spark.createDataFrame([("s", 1, 0, [0.0, 1.0]), ("t", 9, 9, [1.0, 0.0])], "source_id string, page_number long, window_idx int, vector array<float>")

    def model(texts):
        assert all("dua" in t for t in texts)
        return np.array([[3.0, 4.0]] * len(texts))

    got = {r.window_idx: r.vector for r in P.window_vectors(windows, model, stored).collect()}
    assert got == {0: [0.0, 1.0], 1: pytest.approx([0.6, 0.8])}
    assert [r.vector for r in P.window_vectors(windows, lambda t: np.zeros((len(t), 2)), None, True).collect()] == [[0.0, 0.0]] * 2
