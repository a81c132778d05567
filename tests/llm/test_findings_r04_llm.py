"""Cases of the fourth round's findings, training-data operators."""

from __future__ import annotations

import pytest

from naskah.llm import secrets
from naskah.llm import text as T


def test_profile_counts_words_below_the_share_of_a_block(spark, monkeypatch):
    # one in ten words; "often" has 12 of 100 words: 11 of the first block's 50, 1 of the second's 50
    monkeypatch.setattr(secrets, "DICTIONARY_SHARE", 9)
    first = " ".join(["often,"] * 11 + [f"word{i}" for i in range(39)])
    second = " ".join(["Often"] + [f"other{i}" for i in range(49)])
    docs = spark.createDataFrame([(1, first), (2, second), (3, None), (4, "")], "doc_id long, text string").repartition(2)
    assert T.BLOCK_BYTES > len(first)
    profile = secrets.profile(docs)
    assert profile.words == {"often"}


@pytest.mark.parametrize("share", [2, 30])
def test_profile_equals_a_plain_count(spark, monkeypatch, share):
    import random
    import string
    from collections import Counter

    monkeypatch.setattr(secrets, "DICTIONARY_SHARE", share)
    pick = random.Random(share)
    words = ["kata", "satu,", "dua", "(tiga)", "Empat", "é́tude", "lima-enam"]
    texts = [" ".join(pick.choice(words[: 3 + i % 5]) for _ in range(pick.randint(0, 30))) for i in range(40)]
    count = Counter(w.lower().strip(string.punctuation) for t in texts for w in t.split() if len(w.encode()) >= 4)
    total = sum(len(t.split()) for t in texts)
    want = {w for w, n in count.items() if len(w) >= 4 and n >= max(2, total / share)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert secrets.profile(docs).words == want
