"""Top-k ranking with score bounds against the full ranking and against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from naskah.constants import STOPWORDS
from naskah.operators import bm25 as BM


def tokens(text):
    return [t for t in re.sub(r"[^a-z0-9\s]", " ", text.lower()).split() if len(t) > 1 and t not in STOPWORDS]


def brute(docs, queries, k):
    counts = [(i, Counter(tokens(t or ""))) for i, t in docs]
    n, avg = len(docs), sum(sum(c.values()) for _, c in counts) / max(len(docs), 1)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in counts:
            s = sum(
                m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
                for t, m in Counter(tokens(text or "")).items() if t in c
            )
            scores += [(-round(s, 9), i)] if s > 0 else []
        out += [(q, i, r + 1, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def rows(df):
    return sorted((r.query_id, r.doc_id, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("seed", "k"), [(0, 1), (1, 3), (2, 10), (3, 500)])
@pytest.mark.parametrize("small", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, seed, k, small):
    if small:  # many shards, blocks of queries, and terms that are not known to all tasks
        for name, value in {"SHARD_POSTINGS": 200, "LEAST_SHARD": 50, "QUERY_BLOCK": 3, "WANTED_TERMS": 2, "BLOCK_DOCS": 4}.items():
            monkeypatch.setattr(BM, name, value)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "x", "dan"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(r.choices(words, weights, k=r.choice([0, 1, 5, 40, 200])))) for i in range(150)]
    docs += [(i + 1000, t) for i, t in docs[:30]] + [(5000, None), (5001, "")]  # copies tie
    queries = [(q, " ".join(r.choices(words, k=r.choice([1, 3, 12])))) for q in range(8)] + [(90, "zzz"), (91, ""), (92, None), (93, "w0 w0 w0 w59")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, text string")
    assert rows(BM.bm25_top_k(d, q, k)) == sorted(brute(docs, queries, k))


def test_empty_sides(spark):
    d = spark.createDataFrame([(1, "satu dua")], "doc_id long, text string")
    q = spark.createDataFrame([("a", "dua")], "query_id string, text string")
    assert BM.bm25_top_k(d.limit(0), q, 3).count() == 0
    assert BM.bm25_top_k(d, q.limit(0), 3).count() == 0
    assert [r.query_id for r in BM.bm25_top_k(d, q, 3).collect()] == ["a"]


def test_bounds_rule_out_blocks():
    """A rare term marks few documents: most postings of the common one are never read."""
    n = 6400
    lengths = np.full(n, 20)
    rows_ = np.concatenate([np.arange(n), np.arange(0, n, 640)])
    terms = np.concatenate([np.zeros(n, np.int64), np.ones(10, np.int64)])
    shard = BM.Shard(lengths, rows_, terms, np.ones(len(rows_), np.int64), 2, 20.0)
    got, scores = shard.best(np.array([0, 1]), np.array([0.1, 5.0]), 5, np.arange(n))
    assert got.tolist() == [0, 640, 1280, 1920, 2560] and len(set(scores)) == 1
    assert shard.scored <= 12 * (BM.BLOCK_DOCS + 1)
