"""Spelling variants against brute force, with the trie split at every level and inside a leaf."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import documents
from naskah.llm import variants as V


def edits(word, alphabet):
    for i in range(len(word) + 1):
        for c in alphabet:
            yield word[:i] + c + word[i:]
            if i < len(word):
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def brute_words(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def brute(words):
    alphabet = sorted({c for w in words for c in w})
    form, out = {}, {}
    for w, n in words.items():
        near = {x for x in edits(w, alphabet) if x != w and x in words}
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = len(near)
    rows = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], words.get(form[w])))
    return rows


def some_words(seed, n=250):
    """Words close to each other, many of the same letters in another order, some very long."""
    r = random.Random(seed)
    alphabet = "abcdeéßøÿ" if seed % 2 else "abet"
    base = ["".join(r.choice(alphabet) for _ in range(r.choice([5, 6, 7, 12, 90]))) for _ in range(n // 8)]
    words = set(base)
    while len(words) < n:
        w = r.choice(base)
        words.add(r.choice([*edits(w, alphabet[:2])]) if r.random() < 0.7 else "".join(r.sample(w, len(w))))
    return {w: r.choice([3, 3, 4, 7, 7, 20, 100]) for w in sorted(words) if len(w) >= 5}


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("unit", [10_000, 25, 1])
def test_near_words_equal_brute_force(spark, seed, unit):
    words = some_words(seed)
    frame = spark.createDataFrame([*words.items()], "word string, n long").repartition(3)
    got = {r.word: (r.n_near, r.form, r.form_n) for r in V.near_words(frame, unit).collect()}
    want = {}
    for w, form, _, n, near, form_n in brute(words):
        if near:
            want[w] = near
            # a form is kept later only if it is frequent enough
            assert got[w][2] >= 2 * n if form else got[w][2] < 2 * n
            assert not form or got[w][1:] == (form, form_n)
    assert {w: g[0] for w, g in got.items()} == want


def test_large_leaf_is_searched_by_halves():
    """One vector with thousands of words: fewer candidates than all pairs, no near pair lost."""
    r = random.Random(5)
    words = sorted({"".join(r.choice("ez") if i != 6 else "l" for i in range(12)) for _ in range(1500)} | {"e" * 6 + "l" + "z" * 4})
    assert len({bytes(v) for v in V.vectors([w.encode() for w in words]).astype(np.uint8)}) <= 14
    words = [w.encode("latin-1") for w in words]
    tree = V.Subtree(words, np.zeros(len(words), np.int64), b"")
    a, b = tree.pairs()
    got = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
    want = {frozenset((i, j)) for i, x in enumerate(words) for j, y in enumerate(words) if len(x) >= len(y) and V.one_edit(y, x)}
    assert len(got) == len(a) and got == want


def test_routes_reach_every_neighbour():
    r = random.Random(2)
    words = [w.encode("latin-1") for w in some_words(1)]
    counts = V.vectors(words).astype(">u4")
    full = Counter(v.tobytes()[: 4 * k] for v in counts for k in range(V.GROUPS + 1))
    internal = frozenset(p for p, n in full.items() if n > r.choice([5, 20]))
    homes, sent = {}, {}
    for key, rows_, states in V.routes(words, internal):
        for i, s in zip(rows_, states, strict=True):
            (homes if s == 0 else sent).setdefault(int(i), set()).add(key)
    assert set(homes) == set(range(len(words)))
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            if i != j and (V.one_edit(x, y) or V.one_edit(y, x)):
                assert homes[i] & (homes[j] | sent.get(j, set())) or homes[j] & sent.get(i, set())


def test_odd_documents(spark, odd_documents, no_documents):
    r = random.Random(0)
    base = some_words(3, 60)
    texts = [" ".join(r.choices([w.upper() if w.isascii() else w for w in base], k=400)) + "; A-b_c1Üben" for _ in range(30)]
    more = documents(spark, [*texts, texts[0], None, "A" * 5000 + " " + "b" * 70 + "1" + "b" * 70 + "x"], [*range(100, 130), 100, None, None])
    table = odd_documents.unionByName(more).unionByName(more)
    words = brute_words([(x.doc_id, x.text) for x in table.collect()])
    assert any(len(w) > 64 for w in words) or len(words) > 50
    for unit in (20_000, 10):
        assert rows(V.group_variants(table, unit=unit)) == brute(words)
    assert V.group_variants(no_documents).count() == 0
    assert V.group_variants(odd_documents.where("text IS NULL OR text = ''")).count() == 0


def test_chains_and_ties(spark):
    words = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 24, "aabb": 0, "aabbbb": 24, "zzzzz": 5, "zzzzzz": 10, "yzzzz": 10}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    key = next(k for k in range(1000) if all(zlib.crc32(f"{k}:{w}".encode()) % 97 for w in words))
    got = {r.word: r for r in V.group_variants(documents(spark, [text], [key])).collect()}
    assert rows(V.group_variants(documents(spark, [text], [key]))) == brute(brute_words([(key, text)]))
    assert (got["aaaaa"].root, got["aaaab"].form, got["aabbb"].form, got["aabbb"].n_near) == ("aabbb", "aaabb", None, 3)
    assert got["zzzzz"].form == "yzzzz"
