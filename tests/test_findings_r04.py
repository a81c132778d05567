"""Cases of the fourth round's findings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

PIECES = [
    "a", "kata", "é", "×", "ſ", "\u212a", "İ", "ı", "di", "Di", "dI", "d\u0131", "ke", "Ke", "pada", "pun", "merekapun", "Diapun", "walaupun", "lah", "kah", "tah",
    "rumah", "dirumah", "DIRUMAH", "Dimana", "baca", "lakukan", "bacaé", "kemana", "KEMANA", "\u212aemana", "bagai", "mana", "tika", "dari", " ", "  ", "   ", "\n", "\t",
    "\u00a0", "\u2003", "\x1c", "\x85", ".", "..", "...", "....", "......", ",", ",,", ";", "::", "!!", "??", "!", "1", "12", "123", ",456", ".5", "_", "-", "\ue000", "\0",
    "https://", "http\u017f://x", "www.", "a.org", ".ac.id/x", ".\u0130o", ".com", "😀", "(", ")",
]


def _texts(n: int, size: int, seed: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, size))) for _ in range(n)]


def test_blocks_of_pages_give_the_hits_of_single_rows(spark):
    from naskah.operators import rules as R

    from naskah.plans.fixtures import RULE_SENTENCES

    texts = [*_texts(1000, 40, 1), *(a + b + c for (a, c), b in zip(zip(_texts(90, 4, 2), _texts(90, 4, 3)), RULE_SENTENCES * 5)), None, "", "x" * 300 + "pun", "a  b  c", "aa,bb,cc", "1,23,456", "12,345,678", "di bacaéX"]
    pages = spark.createDataFrame([("j", i, t) for i, t in enumerate(texts)], "job_id string, page_number long, content string").repartition(4)
    ranges = "array<struct<start:int,end:int>>"
    code = F.when(F.col("page_number") % 5 == 0, F.expr(f"cast(array(struct(2, 9), struct(12, 14)) as {ranges})"))
    code = code.when(F.col("page_number") % 5 == 1, F.expr(f"cast(array(struct(4, null)) as {ranges})"))
    code = code.when(F.col("page_number") % 25 == 2, F.expr(f"cast(null as {ranges})")).otherwise(F.expr(f"cast(array() as {ranges})"))
    skip = F.concat(code, R.link_ranges(F.col("content")))
    fast, slow = R.scan_rules(pages, R.RULES, code, links=True), R._scan_rows(pages, R.RULES, skip)
    assert fast.columns == slow.columns
    assert [f.dataType for f in fast.schema] == [f.dataType for f in slow.schema]
    got, want = sorted(map(tuple, fast.collect())), sorted(map(tuple, slow.collect()))
    assert got == want
    assert len({r[2] for r in got}) == len(R.RULES)


def test_own_and_added_rules_scan_together(spark):
    from naskah.operators import rules as R

    added = R.Rule("x.q", "info", "q+", lambda m: F.lit("q"), lambda m: F.upper(m))
    pages = spark.createDataFrame([("j", 1, "qq ada,,di www.q.com/q")], "job_id string, page_number int, content string")
    got = {(r.rule_id, r.offset, r.suggestion) for r in R.scan_rules(pages, [*R.RULES, added], links=True).collect()}
    assert got == {("x.q", 0, "QQ"), ("eyd.repeated-punct", 6, ",")}


def _plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_rule_scan_and_fixes_run_over_batches(spark):
    from naskah.operators import edits as E
    from naskah.operators import rules as R

    pages = spark.createDataFrame([("j", 1, "ada  dua,,")], "job_id string, page_number int, content string")
    hits = R.scan_rules(pages, R.RULES, links=True)
    assert "MapInArrow" in _plan(hits)
    fixes = hits.select("*", F.lit(1).cast("bigint").alias("finding_id"), F.lit(False).alias("is_italic"))
    assert "aggregate(" not in _plan(E.apply_fixes(pages, fixes))
    texts = pages.select("job_id", F.col("content").alias("text"))
    assert "Window" not in _plan(E.reanchor(fixes, texts))


def test_reanchor_takes_tokens_literally(spark):
    from naskah.operators import edits as E

    kinds = "job_id string, finding_id bigint, token string, excerpt string, suggestion string, is_italic boolean"
    rows = [
        ("j", 1, "a\\Eb", "satu a\\Eb dua", "x", False), ("j", 2, "a\\Eb", "tiga a\\Eb empat", "x", False),
        ("j", 3, "dua", None, "x", False), ("j", 4, "dua", "", "", False), ("j", 5, "dua", "", "x", True), ("k", 6, "dua", "", "x", False),
    ]
    texts = spark.createDataFrame([("j", "tiga a\\Eb empat, satu a\\Eb dua dua")], "job_id string, text string")
    got = {r.finding_id: (r.start, r.end, r.reason) for r in E.reanchor(spark.createDataFrame(rows, kinds), texts).collect()}
    assert got == {
        1: (22, 26, None), 2: (5, 9, None), 3: (27, 30, None), 4: (None, None, E.INCOMPLETE),
        5: (None, None, E.ITALIC_BY_HAND), 6: (None, None, E.NOT_FOUND),
    }


def test_fixes_of_a_page_in_every_case():
    from naskah.operators import edits as E

    fixes = [
        (1, 9, 2, "dd", "D", False), (2, 6, 2, "cc", "", True), (3, 3, 2, "bb", "BBB", False), (4, 3, 2, "xx", "y", False),
        (5, None, 2, "a", "b", False), (6, 0, 2, "aa", "", False), (7, 0, 2, "aa", "A", None),
    ]
    text, italic, log = E.fold_fixes("aa bb cc dd", fixes)
    assert (text, italic) == ("aa BBB cc D", [(7, 9)])
    assert log == [(1, None), (2, None), (3, None), (4, E.CHANGED), (5, E.INCOMPLETE), (6, E.INCOMPLETE), (7, None)]


def test_page_facts_equal_the_expressions(spark):
    from naskah.functions import text as T
    from naskah.functions import words as W
    from naskah.operators import rules as R
    from naskah.operators import words as WT
    from naskah.plans.fixtures import CITATION_SENTENCES, RULE_SENTENCES

    more = ["Santoso & Wijaya (2020)", "Kusuma dan Pratama", "et  al.", "ET AL", "(Santoso, 2020a)", "ciri - Ciri", "hal-hal", "ab- ab", "é-é", "www.x.sch.id/a;", "https:/x", "x.y", ".\n"]
    pick = random.Random(5)
    texts = [" ".join(pick.choice(more + PIECES) for _ in range(pick.randint(0, 14))) for _ in range(800)]
    texts += [*_texts(300, 30, 6), *RULE_SENTENCES, *CITATION_SENTENCES, "", "Menurut Al-Azawi et al. Müller dan Siregar 2001"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    ranges = F.expr("array(named_struct('start', 2, 'end', 9), named_struct('start', 12, 'end', 15))")
    rows = df.select(
        "t", W.skip_ranges(t).alias("skip"), R.link_ranges(t).alias("links"), W.redup_offsets(t).alias("redup"), W.italic_words(t, ranges).alias("italic")
    ).collect()
    find = WT._link_finder(R.URL)
    for r in rows:
        assert sorted(set(WT._page_skips(r.t))) == sorted({tuple(x) for x in r.skip}), r.t
        assert sorted(find(r.t)) == sorted(tuple(x) for x in r.links), r.t
        assert set(WT._page_redups(r.t)) == set(r.redup), r.t
        assert WT._page_italics(r.t, [(2, 9), (12, 15)]) == set(r.italic), r.t
    assert sum(len(r.skip) for r in rows) > 300 and sum(len(r.redup) for r in rows) > 20


def test_word_table_takes_ranges_with_an_unknown_bound(spark):
    from naskah.operators.words import word_table

    kinds = "job_id string, page_number int, content string, code_ranges array<struct<start:int,end:int>>, italic_ranges array<struct<start:int,end:int>>"
    df = spark.createDataFrame([("j", 1, "satu dua tiga", [(5, None)], [(None, 3)]), ("j", 2, "empat", None, None)], kinds)
    got = {(r.page_number, r.token): (r.skipped, r.italic) for r in word_table(df).collect()}
    assert got == {(1, "satu"): (False, False), (1, "dua"): (True, False), (1, "tiga"): (True, False), (2, "empat"): (False, False)}


def test_tokens_of_a_block_equal_those_of_single_pages(spark):
    from naskah.functions import text as T
    from naskah.operators import words as WT
    from naskah.operators.words import word_table

    texts = [*_texts(300, 25, 9), "", None, "\u2003Kata. \u00a0Dua", "  Satu", "akhir.", "Awal a b", "-", "ab", "c d"]
    ranges = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([("j", i, t) for i, t in enumerate(texts)], "job_id string, page_number int, content string").select(
        "*", F.when(F.col("page_number") % 3 == 0, F.expr(f"cast(array(struct(3, 9)) as {ranges})")).otherwise(T.no_ranges()).alias("code_ranges"),
        F.when(F.col("page_number") % 4 == 0, F.expr(f"cast(array(struct(0, 30)) as {ranges})")).otherwise(T.no_ranges()).alias("italic_ranges"),
    )
    whole = sorted(map(str, word_table(df.coalesce(1)).collect()))
    facts = lambda t, i: WT.Facts([(3, 9)] if i % 3 == 0 else [], WT._page_skips(t), WT._page_redups(t), WT._page_italics(t, [(0, 30)]) if i % 4 == 0 else set())
    single = []
    for i, t in enumerate(texts):
        if t:
            data, page, s, e, offset, *rest = WT._cut([t], [facts(t, i)])
            single += [(i, int(o), data[a:b].tobytes().decode(), *map(bool, r)) for o, a, b, *r in zip(offset, s, e, *rest)]
    got = sorted((r.page_number, r.offset, r.token, r.at_start, r.skipped, r.italic, r.pair is not None, r.triple is not None) for r in word_table(df).collect())
    assert got == sorted(single) and len(whole) == len(got)
    spans = {(r.page_number, r.t.offset, r.t.token) for r in df.select("page_number", F.explode(__import__("naskah.functions.words", fromlist=["x"]).token_spans(F.col("content"))).alias("t")).collect()}
    assert spans == {g[:3] for g in got}


def test_word_check_deals_words_once_by_page(spark):
    from naskah.functions import text as T
    from naskah.operators import dictionary as D

    texts = [("j", 1, "Kata ru mah kata Adi Adi rumah ru"), ("j", 2, "Adi KaTa kata"), ("k", 1, "ru mah xyz xyz")]
    pages = spark.createDataFrame(texts, "job_id string, page_number int, content string").select(
        "*", T.no_ranges().alias("code_ranges"), T.no_ranges().alias("italic_ranges")
    )
    words = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    vocabulary = spark.createDataFrame([("zzz", "brand")], "word string, classification string")
    check = D.check_words(pages, words("kata", "rumah"), vocabulary)
    assert "second" not in check.tokens.columns
    got = sorted((r.job_id, r.page_number, r.offset, r.token, r.word, r.source) for r in check.candidates.collect())
    local, none = "local-database", "unverified"
    assert got == [("j", 1, 0, "Kata", "kata", local), ("j", 1, 25, "rumah", "rumah", local), ("j", 1, 31, "ru", "ru", none), ("j", 2, 9, "kata", "kata", local), ("k", 1, 7, "xyz", "xyz", none)]
    asked = D.within_budget(check.candidates, check.verdicts, 0).collect()
    assert sorted((r.job_id, r.word, r.offset) for r in asked) == [("j", "ru", 31), ("k", "xyz", 7)]
