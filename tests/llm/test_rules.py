"""Rule cascade: brute-force measures, verdicts that do not depend on the order, the order itself."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import documents
from naskah.llm import rules
from naskah.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated(w, k):
    inside = [False] * len(w)
    seen = {}
    for i in range(len(w) - k + 1):
        seen.setdefault(tuple(w[i : i + k]), []).append(i)
    for at in seen.values():
        for i in at if len(at) > 1 else ():
            inside[i : i + k] = [True] * k
    return sum(inside)


def measured(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    pairs = list(zip(w, w[1:], strict=False))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_digits": len(re.findall("[0-9]", text)), "n_exclaims": text.count("!"), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_upper_words": sum(len(re.findall("[A-Z]", x)) > 1 and not re.search("[a-z]", x) for x in w),
        "n_letter_words": sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", x)) for x in w),
        "n_repeat_words": repeated(w, 3), "n_repeat_5": repeated(w, 5),
        "top_pair": max(map(pairs.count, pairs), default=0),
    }


def rejected(m):
    return {
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "word_length": not 3 * m["n_words"] <= m["word_chars"] <= 10 * m["n_words"],
        "digits": 5 * m["n_digits"] > m["word_chars"], "exclaims": 10 * m["n_exclaims"] > m["n_words"],
        "equal_lines": 10 * m["n_dup_lines"] > 4 * m["n_lines"], "upper_case": 10 * m["n_upper_words"] > 3 * m["n_words"],
        "no_letters": 10 * m["n_letter_words"] < 8 * m["n_words"], "frequent_pair": 10 * m["top_pair"] > m["n_words"],
        "long_repeats": 10 * m["n_repeat_5"] > 3 * m["n_words"],
    }


def texts(seed, n=60):
    r = random.Random(seed)
    pool = ["a", "The", "été", "ÉTÉ", "OK", "x#y", "12", "word!", "lorem", "ipsum", "😀", "*", "N.B.", "\x0b", "line"]
    out = [None, "", "\n", " \n\t\r", "A\nA\nA ", "A\n\nA\r\nA\r"]
    for _ in range(n):
        few = r.sample(pool, r.randint(1, len(pool)))
        out.append("".join(r.choice(few) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(r.randint(0, 130))))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_measures_equal_brute_force(seed):
    data = texts(seed)
    (block,) = T.blocks(pa.array(data))
    t = rules.Texts(block)
    want = [measured(x) for x in data]
    for name in want[0]:
        assert t.get(name).tolist() == [m[name] for m in want], name
    rows = np.flatnonzero(np.arange(len(data)) % 3 != 1)
    part = t.keep(rows)
    fresh = rules.Texts(part.block)
    for name in want[0]:
        assert part.get(name).tolist() == fresh.get(name).tolist() == [want[i][name] for i in rows], name


@pytest.mark.parametrize("seed", range(3))
def test_order_does_not_change_the_verdict(seed):
    data = texts(seed, 120)
    (block,) = T.blocks(pa.array(data))
    want = [any(rejected(measured(x)).values()) for x in data]
    assert 0 < sum(want) < len(want)
    for order in (rules.RULES, rules.RULES[::-1], random.Random(seed).sample(rules.RULES, len(rules.RULES))):
        got = rules.judge(rules.Texts(block), order)
        assert (got >= 0).tolist() == want
        for i, x in zip(got, data, strict=True):
            bad = rejected(measured(x))
            assert i < 0 or [bad[r.name] for r in order[: i + 1]] == [False] * i + [True]


def test_order_is_greedy_by_rejections_per_cost():
    named = [rules.Rule(n, (rules.Test(1, m, 1),)) for n, m in [("a", "n_symbols"), ("b", "n_words"), ("c", "n_repeat_words"), ("d", "word_chars")]]
    costs = {"n_symbols": 1.0, "words": 10.0, "n_words": 1.0, "n_repeat_words": 20.0, "word_chars": 2.0}
    # a rejects half of what c rejects at a thirtieth of the cost; afterwards d has nothing left
    verdicts = {0b0000: 50, 0b1101: 20, 0b0100: 20, 0b0010: 10}
    assert [r.name for r in rules.order_rules(named, costs, verdicts)] == ["a", "b", "c", "d"]
    # words are known: b costs its comparison only, c is worth its windows before it
    assert [r.name for r in rules.order_rules(named, costs | {"b": 0.5}, {0b0100: 90, 0b0010: 1}, ["n_words"])][:2] == ["c", "b"]
    assert [r.name for r in rules.order_rules(named, {}, {})] == ["a", "b", "c", "d"]


def test_order_spends_least_in_expectation():
    """With independent rules and measures no order is cheaper than the greedy one."""
    names = ["n_symbols", "n_digits", "n_exclaims", "word_chars"]
    named = [rules.Rule(n, (rules.Test(1, n, 1),)) for n in names]
    costs, share = dict(zip(names, [1.0, 4.0, 2.0, 7.0], strict=True)), [0.1, 0.6, 0.3, 0.5]
    verdicts = {m: round(1e6 * np.prod([p if m >> i & 1 else 1 - p for i, p in enumerate(share)])) for m in range(16)}

    def expected(order):
        left, total = 1.0, 0.0
        for rule in order:
            total += left * costs[rule.name]
            left *= 1 - share[names.index(rule.name)]
        return total

    got = expected(rules.order_rules(named, costs, verdicts))
    assert got == pytest.approx(min(map(expected, itertools.permutations(named))))


def test_cascade_on_odd_rows(spark, odd_documents, no_documents):
    good = " ".join(f"word{i} grows" for i in range(40))
    more = documents(spark, [good, good, "!!! " + good.upper(), " ".join(["same old thing"] * 40), None], [50, 50, 51, 52, None])
    table = odd_documents.unionByName(more)
    want = []
    for r in table.collect():
        m = measured(r.text)
        base = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        want.append((r.doc_id, *[m[c] for c in rules.CONTRACT], base, not base and not any(rejected(m).values())))
    for frame in (table, table.repartition(7)):
        out = rules.quality_rules(frame)
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert rules.quality_rules(no_documents).count() == 0
    clash = table.withColumnRenamed("score", "kept").withColumnRenamed("id", "n_words")
    full = rules.cascade(clash, measures=["n_words"], first=rules.BASE, sample_rows=3)
    assert full.columns == ["doc_id", "lang", "n", "item", "n_words", "base_failed", "kept", "rejected_by"]
    assert full.where("kept <> (rejected_by IS NULL)").isEmpty()
    assert full.where("kept").count() == sum(w[-1] for w in want) == 2


def test_long_text(spark):
    text = "alpha beta gamma delta. " * 150_000
    row = rules.quality_rules(documents(spark, [text])).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed, row.kept) == (600_000, 600_000, True, False)
