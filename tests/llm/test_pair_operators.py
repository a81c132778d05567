"""Repeated substrings, n-gram joins, vectors, language model: against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from llm_cases import PAGES  # noqa: F401
from naskah.llm import embedding, jaccard, lm, substrings
from naskah.llm.components import components
from naskah.llm.elias_fano import Sequence
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


class Sets:
    """Plain union-find."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, n):
        while self.up[n] != n:
            n = self.up[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: sets.find(n) for a, b in edges if a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def mutated(r, words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = f"w{r.randint(0, 10**6)}"
    return words


def near_texts(seed):
    r = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(500)]
    texts = []
    for size in (5, 9, 30, 120):
        base = r.choices(vocabulary, k=size)
        family = [base]
        for _ in range(25):  # chains: only neighbours are alike
            family.append(mutated(r, r.choice(family), r.randint(0, max(1, size // 40))))
        texts += [" ".join(f) for f in family]
    line = " ".join(r.choices(vocabulary, k=12))
    texts += [line + " " + " ".join(r.choices(vocabulary, k=r.randint(0, 60))) for _ in range(60)]
    return texts + ["a b c d", "A B c d", "a b c", "", None]


def check_components(spark, texts):
    ids = [3 * i + 1 for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").withColumn("component", F.lit("clash"))
    found = {}
    sets = Sets(ids)
    shingles = {}
    for i, t in zip(ids, texts):
        w = WORD.findall((t or "").translate(LOW))
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    for i in ids:
        for j in ids:
            a, b = shingles[i], shingles[j]
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                sets.join(i, j)
    for x in jaccard.join(docs).collect():
        found[x.doc_id] = (x.n_shingles, x.component_id)
    assert found == {i: (len(shingles[i]), sets.find(i)) for i in ids}


def test_jaccard_components(spark):
    check_components(spark, near_texts(1))


def test_jaccard_without_contraction(spark, monkeypatch):
    """The pair join alone finds the same components."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    check_components(spark, near_texts(2))


def test_multi_match_prefixes_keep_every_pair():
    r = np.random.default_rng(5)
    none = np.zeros(0, np.uint64)
    for _ in range(400):
        n = int(r.integers(1, 90))
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = x.copy()
        for _ in range(int(r.integers(0, max(1, n // 7)))):
            y[r.integers(0, len(y))] = r.integers(0, 2**63, dtype=np.uint64)
        y = np.unique(y)
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 75 * (len(x) + len(y) - shared):
            continue
        hot = np.sort(r.choice(x, min(len(x), 5), replace=False)) if r.random() < 0.5 else none
        counts = np.full(len(hot), 1000)
        (tx, lx, bx, _), (ty, ly, by, _) = jaccard.prefix(x, hot, counts), jaccard.prefix(y, hot, counts)
        for need in (bx, by):
            assert len(np.intersect1d(tx[lx <= need], ty[ly <= need])) >= need


def test_jaccard_odd_rows(odd_documents, no_documents):
    out = jaccard.join(odd_documents).collect()
    assert len(out) == odd_documents.count()
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[2] == {(0, 2)}
    assert by[3] == {(1, 3)} and by[None] == {(1, 3)} and by[7] == by[8] == {(9, 7)}
    assert jaccard.join(no_documents).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[a : a + length] for d in data for a in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for a in range(len(d) - length + 1):
            if seen[d[a : a + length]] > 1:
                gone[a : a + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [substrings.HOT, 1])
def test_repeated_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(r.choice("ijklmnop ") for _ in range(r.randint(0, 900))) for _ in range(40)]
    for i in range(0, 40, 2):
        a = r.randint(0, 300)
        texts[i] = texts[i][:200] + passage[a : a + r.choice([380, 399, 400, 401, 600])] + texts[i][200:]
    texts += ["period " * 90, "xyzé" * 300, texts[0], None, "", "q" * 399, "q" * 401, passage * 2]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item int")
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in substrings.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, substrings.LENGTH)


def test_suffix_intervals():
    r = random.Random(7)
    for trial in range(60):
        length = r.choice([3, 10, 40])
        base = bytes(r.choice(b"abc" if trial % 2 else b"abcdefghij") for _ in range(300))
        texts = []
        for _ in range(r.randint(1, 10)):
            t = b""
            while len(t) < r.randint(1, 200):
                a = r.randint(0, 299)
                t += base[a : a + r.randint(1, 90)]
            texts.append(t)
        weights = np.array([r.choice([1, 1, 2]) for _ in texts])
        seen = collections.Counter()
        for t, w in zip(texts, weights):
            for a in range(len(t) - length + 1):
                seen[t[a : a + length]] += w
        want = [[a for a in range(len(t) - length + 1) if seen[t[a : a + length]] >= 2] for t in texts]
        assert [x.tolist() for x in substrings.repeated_starts(texts, weights, length)] == want


def test_repeats_odd_rows(odd_documents, no_documents):
    out = substrings.remove_repeats(odd_documents).collect()
    assert len(out) == odd_documents.count()
    texts = [r.text for r in odd_documents.collect()]
    want = collections.Counter(brute_repeats(texts, substrings.LENGTH))
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    assert substrings.remove_repeats(no_documents).count() == 0


@pytest.mark.parametrize("unit", [embedding.UNIT, 7])
def test_vectors(spark, monkeypatch, unit):
    monkeypatch.setattr(embedding, "UNIT", unit)
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 32))
    x[100:180] = x[100] + 0.06 * r.normal(size=(80, 32))
    x[180:200] = x[180]
    rows = [(i, v.astype(np.float32).tolist(), int(i % 3 == 0)) for i, v in enumerate(x)]
    bad = [None, [0.0] * 32, [float("nan")] * 32, [float("inf")] * 32, [], [1.0, None] * 16]
    rows += [(1000 + i, v, 1) for i, v in enumerate(bad)] + [(2000, rows[180][1], None), (2001, [1.0] * 5, 1), (2002, [1.0] * 5, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit(1))
    ids = [a for a, v, _ in rows]
    sets, links = Sets(ids), collections.Counter()
    good = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and i not in range(1000, 1006)]
    for i, a, l in good:
        for j, b, m in good:
            if i < j and l == m and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= embedding.COSINE:
                sets.join(i, j)
                links[i] += 1
                links[j] += 1
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding.near_duplicates(df).collect()}
    assert got == {i: (links[i], sets.find(i), sets.find(i) == i) for i in ids}
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_elias_fano():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 5), (1000, 10), (70_000, 2**63), (140_000, 10**6)):
        values = np.sort(r.integers(0, top, n, dtype=np.uint64))
        s = Sequence(values)
        assert (s.values() == values).all()
        q = np.sort(np.concatenate([r.integers(0, top, 50, dtype=np.uint64), values[:50]]))
        at, equal = s.successor(q)
        assert (at == np.searchsorted(values, q)).all() and (equal == np.isin(q, values)).all()


def test_language_model(spark, no_documents, odd_documents):
    r = random.Random(9)
    words = [f"w{int(r.expovariate(0.02))}" for _ in range(4000)]
    texts = {i: " ".join(words[40 * i : 40 * i + r.randint(0, 40)]) or None for i in range(100)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("learnt", F.lit("clash"))
    tokens = {i: WORD.findall((t or "").translate(LOW)) + ["\0end"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c, pairs = collections.Counter(), collections.Counter()
    for i, t in tokens.items():
        if not held[i]:
            c.update(t)
            pairs.update(zip(["\0start", *t], t))
    n, v, singles = sum(c.values()), len(c), sum(1 for x in c.values() if x == 1)
    learnt = sum(not h for h in held.values())
    floor, least = max(1.0, n / lm.FREQUENT), max(2, math.ceil(n / lm.FREQUENT))

    def prior(word):
        count = learnt if word == "\0start" else c[word] if c[word] >= least else 0
        return lm.PRIOR * (floor + count)

    def p(word, before):
        total = learnt if before == "\0start" else c[before]
        one = (c[word] or singles + 1) / (n + singles + 1)
        return (pairs[before, word] + prior(before) * one) / (total + prior(before))

    out = lm.score_held_out(docs).collect()
    assert len(out) == 100
    for x in out:
        t = tokens[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert math.isclose(x.score, sum(math.log10(p(w, b)) for b, w in zip(["\0start", *t], t)), rel_tol=1e-3)
    some = [*c, "unknown"]  # probabilities after a word add up to one
    for before in ("\0start", some[0], some[1], "unknown"):
        assert math.isclose(sum(p(w, before) for w in some if w != "\0start"), 1, rel_tol=1e-9)
    assert lm.score_held_out(odd_documents).count() == odd_documents.count()
    assert lm.score_held_out(no_documents).count() == 0
