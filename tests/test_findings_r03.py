"""Cases of the third round's findings."""

from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__


def test_bm25_rank_keeps_every_scored_pair(spark):
    out = __spark_entry__.queries()["ag19_bm25_rank"](spark, "/root/testdata/sf0.001")
    assert out.columns == ["item_id", "doc_id", "score"]
    assert out.groupBy("item_id").count().agg(F.max("count")).first()[0] > 10


def test_narrative_spans_equal_the_whole_pattern(spark):
    from naskah.functions import citations as C
    from naskah.functions import text as T

    texts = [
        "Menurut Santoso dkk. (2020), lalu Wijaya et al. (2019a, hlm. 4-5) dan A.B. Kusuma (2018).",
        "Ramadan dan\nMüller (2001)(2002) Al-Azawi & Lestari, Siregar (20) (2003)", "(2020)", "", None,
        "tanda  Santoso (2020) di sini",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(C.narrative_spans(F.col("t")).alias("a"), T.spans(F.col("t"), T.js(C.NARRATIVE)).alias("b"), "t").collect()
    for r in got:
        assert r.a == r.b
        assert all(r.t[s.start : s.end] == s.text for s in r.a)
    assert sum(len(r.a) for r in got) == 5


def test_pair_files_finds_titles_inside_words(spark):
    from naskah.operators import linkage as L

    files = spark.createDataFrame([("j", 1, "xxdata miningzz", ""), ("j", 2, "qab", ""), ("k", 3, "xxdata miningzz", "")],
                                  "job_id string, file_id bigint, title string, first_page string")
    refs = spark.createDataFrame([("j", 7, "Q", "2001", "Data mining"), ("j", 8, "R", "2002", "ab")],
                                 "job_id string, reference_id bigint, author string, year string, title string")
    got = {r.file_id: (r.reference_id, r.confidence) for r in L.pair_files(files, refs).collect()}
    assert got == {1: (7, 0.95), 2: (8, 0.95), 3: (None, 0.0)}


def test_rule_gates_and_link_runs_change_no_result(spark):
    from naskah.operators import rules as R
    from naskah.functions import text as T

    texts = [
        "Kata  dua , spasi\u00a0\n; dan selesai,kemudian?? begitu..lalu 12,345.6", "apa\u2003kah, lah\ntah, Diapun di\tbaca Di tulis",
        "(HTTPS://A.b/c) lihat,www.x.y dan a.b.org/z;q x.COM.ly/ \u017fhttp\u017f://a xhttps://b", "", None, "tanda \ue000  a,,b www.a",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    plain = [R.Rule(r.id, r.severity, r.pattern, r.message, r.suggestion, r.ignore_case, r.skip) for r in R.RULES]
    whole = T.span_ranges(t, T.js(R.URL, True))
    got = df.select(
        R.link_ranges(t).alias("a"), whole.alias("b"),
        R.rule_hits(t, R.link_ranges(t), R.RULES).alias("c"), R.rule_hits(t, whole, plain).alias("d"),
    ).collect()
    for r in got:
        assert r.a == r.b and r.c == r.d
    assert sum(len(r.a or []) for r in got) >= 5 and len({h.rule_id for r in got for h in r.c or []}) >= 9


def test_rule_scan_looks_for_links_in_few_runs():
    from naskah.operators import rules as R

    assert all(R.RuleRegistry().select(i)[0].gate for i in ("eyd.missing-space-after-punct", "eyd.di-passive-split"))


def test_coverage_reads_whole_values():
    from naskah.llm import secrets

    assert secrets._coverage("q" * 400 + "lorem" * 80, frozenset({"lorem"})) == 0.5


def test_word_check_looks_for_links_in_runs(spark):
    from naskah.functions import text as T
    from naskah.functions import words as W
    from naskah.operators import rules as R

    texts = ["(HTTPS://A.b/c) www.x a.sch.id/z;q b.XYZ.dev, kata.kata", "x.y.info\u00a0http://q\nwww.", "", None, "Anak - anak\u00e9 ciri-ciri ab- abc"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    old = T.spans(t, T.js(r"\b([A-Za-z\u00c0-\u00ff]{2,})\s*-\s*\1\b", True))
    got = df.select(
        R.link_ranges(t, R.URL_WIDE).alias("a"), T.span_ranges(t, T.js(R.URL_WIDE, True)).alias("b"),
        T.spans(t, T.js(W.SPACED_REDUP, True)).alias("c"), old.alias("d"),
    ).collect()
    for r in got:
        assert r.a == r.b and r.c == r.d
    assert sum(len(r.a or []) for r in got) >= 5 and sum(len(r.c or []) for r in got) >= 1


def test_foreign_words_of_a_lexicon_only(spark):
    from naskah.functions import text as T
    from naskah.operators import evaluation as EV

    pages = spark.createDataFrame([("a", 1, "kata modern, kata modern www.a.com/modern dan Testing framework")], "job_id string, page_number long, content string")
    pages = pages.select("*", T.no_ranges().alias("code_ranges"), T.no_ranges().alias("italic_ranges"))
    vocab = spark.createDataFrame([("framework", "tech"), ("kata", "brand")], "word string, classification string")
    english = spark.createDataFrame([("modern",)], "word string")
    found = EV.foreign_words(pages, EV.foreign_lexicon(vocab, english)).collect()
    assert sorted((r.offset, r.word) for r in found) == [(5, "modern"), (54, "framework")]
