"""Token table, budgets and external answers against plain Python."""

import random
import re

import pytest
from naskah.functions import text as T
from naskah.operators import dictionary as D
from naskah.operators import words as WO

TOKEN = re.compile(r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'-]*")
RANGES = "array<struct<start:int,end:int>>"


def brute(page, code, italic):
    spans = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(page)]
    starts = {0, *(m.end() for m in re.finditer("[.!?][\\s  ]+", page, re.ASCII))}
    slanted = {w.lower() for a, b in italic for w in TOKEN.findall(page[a:b]) if len(w) >= 2}
    out = []
    for k, (s, e, t) in enumerate(spans):
        pair = triple = second = third = None
        near = lambda i: i + 1 < len(spans) and spans[i + 1][0] == spans[i][1] + 1 and page[spans[i][1]] in " \t"
        if near(k):
            s2, e2, t2 = spans[k + 1]
            if 4 <= len(t + t2) <= 16 and min(len(t), len(t2)) <= 3 and not any(s < b and e2 > a for a, b in code):
                pair, second = t + t2, s2
                if near(k + 1) and len(t2) == 1 and 5 <= len(pair + spans[k + 2][2]) <= 18:
                    triple, third = pair + spans[k + 2][2], spans[k + 2][0]
        out.append((s, t, s in starts, any(s < b and e > a for a, b in code), t.lower() in slanted, pair, triple, second, third))
    return out


def pages(seed):
    r = random.Random(seed)
    parts = ["ab", "a", "é", "Été", "ÿx", "x'y", "-", "--q", "'a", "b-", "kata", "panjangsekali", "1", "2x", "😀", "×", "ß", "."]
    gaps = [" ", " ", " ", "\t", "\n", ". ", "! \n", "?", "  ", "", ". ", " ", "…"]
    out = ["", " ", ".", "a", "é", "-", "'", ". a", "a.", None]
    return out + ["".join(r.choice(parts) + r.choice(gaps) for _ in range(r.choice([2, 8, 60]))) for _ in range(60)]


@pytest.mark.parametrize("seed", range(3))
def test_word_table(spark, seed, monkeypatch):
    monkeypatch.setattr(WO.W, "skip_ranges", lambda c: T.no_ranges())  # links and citations have their own tests
    r = random.Random(seed)
    rows = []
    for i, page in enumerate(pages(seed)):
        ranges = lambda n: sorted((a, a + r.randrange(6)) for a in r.sample(range(80), n))
        rows.append((f"j{i % 3}", i, page, ranges(r.choice([0, 0, 2])), ranges(r.choice([0, 2]))))
    frame = spark.createDataFrame(rows, f"job_id string, page_number long, content string, code_ranges {RANGES}, italic_ranges {RANGES}")
    got = {}
    for x in WO.word_table(frame.repartition(3)).collect():
        got.setdefault(x.page_number, []).append(tuple(x)[2:])
    for _, i, page, code, italic in rows:
        want = [] if page is None else brute(page, code, italic)
        mine = sorted(got.get(i, []))
        spaced = {x[0] for x in mine if x[3]} - {w[0] for w in want if w[3]}
        assert [(*x[:3], x[3] and x[0] not in spaced, *x[4:]) for x in mine] == want, page
        for o in spaced:  # only reduplications with blanks are skipped besides
            assert re.search(r"-", page[max(0, o - 20) : o + 30])


@pytest.mark.parametrize("n", [1, 2, 7, 40, 10_000])
def test_first_of_job(spark, n):
    r = random.Random(n)
    rows = [(f"j{r.choice([0, 0, 0, 1, 2])}", f"w{i}", r.choice([1, 2, 63, 64, 65, 640, 5000]), r.randrange(5)) for i in range(400)]
    frame = spark.createDataFrame(rows, "job_id string, word string, page_number long, offset int").repartition(5)
    want = []
    for job in ("j0", "j1", "j2"):
        want += sorted((x for x in rows if x[0] == job), key=lambda x: (x[2], x[3], x[1]))[:n]
    assert sorted(map(tuple, D.first_of_job(frame, n).collect())) == sorted(want)


@pytest.mark.parametrize(("budget", "asked"), [(0, {"aa", "bb", "cc", "dd"}), (1, {"aa"}), (2, {"aa", "bb"}), (3, {"aa", "bb", "cc"})])
def test_external_answers(spark, budget, asked):
    verdict = "known boolean, database_only boolean, is_english boolean, source string, tier string"
    open_, local = (False, True, False, "unverified", "unverified"), (True, True, False, "local-database", "local")
    at = {"aa": [(1, 5), (2, 0)], "bb": [(1, 9)], "cc": [(2, 3), (3, 0)], "dd": [(70, 0)], "known": [(1, 0), (9, 9)]}
    rows = [("j", w, p, o, w, *(local if w == "known" else open_)) for w, places in at.items() for p, o in places]
    candidates = spark.createDataFrame(rows, f"job_id string, word string, page_number long, offset int, token string, {verdict}")
    verdicts = candidates.select("word", *[x.split()[0] for x in verdict.split(", ")]).distinct()
    external = spark.createDataFrame([("aa", True), ("bb", False), ("dd", True), ("known", False)], "word string, found boolean")
    check = D.WordCheck(None, verdicts, None, candidates)
    got = {(r.word, r.page_number): r for r in D.with_external(check, external, budget).collect()}
    assert len(got) == len(rows)
    assert {r.word for r in D.within_budget(candidates, verdicts, budget).collect()} == asked
    for (word, page), r in got.items():
        if word == "known":  # a local hit neither asks nor spends
            assert (r.source, r.tier, r.known) == ("local-database", "local", True)
        elif word in asked - {"cc"}:
            first = page == at[word][0][0]
            assert (r.source, r.tier, r.known, r.database_only) == ("kbbi-online", "daring" if first else "local", word != "bb", False)
        else:  # no budget left, or no answer
            assert (r.source, r.tier, r.known, r.database_only) == ("unverified", "unverified", False, True)
    counts = D.tier_counts(D.with_external(check, external, budget)).first()
    assert counts.total == len(rows) and counts.daring == len(asked - {"cc"})
