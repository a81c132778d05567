"""Findings of round 3 on the training-data operators."""

import random

from naskah.llm import jaccard
from test_pair_operators import check_components, mutated


def family(seed):
    """Copies of one text: most differ in ten words of 200 and link with none, some in one word."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    base = r.choices(words, k=200)
    texts = []
    for n in [10] * 120 + [1] * 20:
        copy = list(base)
        for at in r.sample(range(len(base)), n):
            copy[at] = r.choice(words)
        texts.append(" ".join(copy))
    return texts


def test_jaccard_forms_few_pairs_in_a_family(spark, monkeypatch):
    formed, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "_verify", lambda pairs, *rest: (formed.append(pairs.count()), verify(pairs, *rest))[1])
    check_components(spark, family(3))
    assert 0 < sum(formed) < 1000  # of 9,730; the 20 close copies are 190 of them


def test_jaccard_keeps_links_of_unequal_sizes(spark, monkeypatch):
    """Parts and extensions of one text, at and beside the threshold, beside copies that make its lists long."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    r = random.Random(4)
    words = ["".join(r.choices("klmnopqrst", k=5)) for _ in range(400)]
    texts = []
    for size in (24, 90, 200):
        base = r.choices(words, k=size)
        texts += [" ".join(base[: round(size * part)]) for part in (0.7, 0.74, 0.76, 0.8, 0.85, 0.9, 0.95, 1)]
        texts += [" ".join(mutated(r, base, k)) for k in (1, 2, 3, 4) for _ in range(4)]
    check_components(spark, texts)
