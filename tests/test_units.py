"""Edge cases restated as small fixtures, and brute-force comparisons."""

import random
import re

from pyspark.sql import functions as F

from naskah.functions import citations as C
from naskah.functions import labels as LB
from naskah.functions import passages as P
from naskah.functions import references as R
from naskah.functions import similarity as S
from naskah.functions import text as T
from naskah.functions import words as W
from naskah.operators import calls as CL
from naskah.operators import dictionary as D
from naskah.operators import edits as E
from naskah.operators import linkage as L
from naskah.operators import pages as PG


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def levenshtein(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_spans_equal_finditer(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ,.é\n") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    texts += ["a,,bc,,,d", "", ",,"]
    for pattern in (r"[,.]{2,}", r"[a-z]+", r"b\s"):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", T.spans(F.col("t"), pattern).alias("s")
        ).collect()
        for r in rows:
            assert [(s.start, s.end, s.text) for s in r.s] == [
                (m.start(), m.end(), m.group()) for m in re.finditer(pattern, r.t)
            ]


def test_ranges_are_half_open(spark):
    df = spark.createDataFrame([("[[5,9]]",)], "r string")
    r = T.parse_ranges(F.col("r"))
    row = df.select(
        T.overlaps(F.lit(0), F.lit(5), r).alias("before"), T.overlaps(F.lit(8), F.lit(20), r).alias("at"),
        T.overlaps(F.lit(9), F.lit(12), r).alias("after"), T.overlaps(F.lit(6), F.lit(6), r).alias("empty"),
        T.in_ranges(F.lit(9), r).alias("end"), T.in_ranges(F.lit(5), r).alias("start"),
    ).first()
    assert tuple(row) == (False, True, False, True, False, True)


def test_boundaries_are_ascii(spark):
    # "é" is no word character, so a word may start after it.
    assert one(spark, "édimana", lambda c: c.rlike(T.js(r"\bdimana\b")))
    assert not one(spark, "xdimana", lambda c: c.rlike(T.js(r"\bdimana\b")))
    assert one(spark, "dari pada", lambda c: c.rlike(T.js(r"\bdari\s+pada\b")))


def test_similarity_keys_never_miss(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
    left, right = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})
    for limit, reach, bound in (
        (L.max_distance, L._reach, lambda n: max(1, int(n * 0.3))),
        (D.max_edits, D._edits_reach, lambda n: 1 if n <= 5 else 2),
    ):
        a = spark.createDataFrame([(w,) for w in left], "a string").select("a", F.explode(S.piece_keys(F.col("a"), limit)).alias("k"))
        b = spark.createDataFrame([(w,) for w in right], "b string").select("b", F.explode(S.probe_keys(F.col("b"), limit, reach)).alias("k"))
        met = {(r.a, r.b) for r in a.join(b, "k").select("a", "b").distinct().collect()}
        for x in left:
            for y in right:
                if levenshtein(x, y) <= bound(len(x)):
                    assert (x, y) in met, (x, y)


def test_citation_forms(spark):
    text = ("Menurut Smith (2020) dan (Lee & Kim, 2019; Park et al., 2021, hlm. 4). Tabel (2020). "
            "Penelitian Al - Azawi (2018) ada.")
    keys = [c.citation_key for c in one(spark, text, C.page_citations)]
    assert keys == ["Lee & Kim, 2019", "Park et al., 2021", "Smith, 2020", "Al - Azawi, 2018"]


def match(spark, key, refs):
    keys = spark.createDataFrame([("j", key)], "job_id string, citation_key string")
    df = spark.createDataFrame(
        [("j", i, a, y, "T") for i, (a, y) in enumerate(refs, 1)],
        "job_id string, reference_id long, author string, year string, title string",
    )
    r = L.match_citations(keys, df).first()
    return r.reference_id, r.confidence, r.match_type


def test_linkage_rules(spark):
    assert match(spark, "Smith, 2020", [("Smith, J.", "2020")]) == (1, 1.0, "exact")
    assert match(spark, "Smith, 2020", [("Smith, J.", "n.d.")]) == (1, 1.0, "fuzzy")
    assert match(spark, "Smith, 2020", [("Smyth, J.", "2021")]) == (1, 0.7, "fuzzy")
    assert match(spark, "Smith, 2020", [("Smith, J.", "2023")]) == (None, 0.0, "unmatched")
    assert match(spark, "Smith et al., 2020", [("Smith, J.", "2020"), ("Smith, J., Doe, A., & Roe, B.", "2020")]) == (2, 1.0, "exact")
    assert match(spark, "Contributors, 2020", [("Kubernetes Contributors", "2020")]) == (1, 1.0, "exact")
    assert match(spark, "Smith, 2020", [("Smith, A.", "2020"), ("Smith, B.", "2020")])[0] == 1


def test_entry_splitting(spark):
    numbered = "Daftar Pustaka\n[1] Alpha beta gamma 2001.\n[2] Delta epsilon zeta 2002."
    assert one(spark, numbered, R.split_entries) == ["Alpha beta gamma 2001.", "Delta epsilon zeta 2002."]
    flat = "References Smith, J. (2020). A title here. Doe, A., Lai, B. and Wei, C., 2023. Another title."
    assert len(one(spark, flat, R.split_entries)) == 2
    assert one(spark, "x https://a.b/c\nd-e.\nnext line", R.join_url_lines) == "x https://a.b/cd-e.\nnext line"
    assert one(spark, "tidak ada", R.split_entries) == []


def test_sentences_keep_abbreviations(spark):
    text = "Lihat Dr. Budi. Ia et al. Menulis. U.S. A. Selesai? Ya."
    assert one(spark, text, P.sentences) == ["Lihat Dr. Budi.", "Ia et al. Menulis.", "U.S.", "A. Selesai?", "Ya."]
    assert one(spark, "", lambda c: P.windows(P.sentences(c))) == []


def test_stems_follow_rule_order():
    stems = D.affix_stems("menulis")
    assert "tulis" in stems and stems.index("tulis") < stems.index("ulis")
    assert "kelola" in D.affix_stems("mengelola")
    assert D.affix_stems("a") == []


def test_roman_page_numbers(spark):
    rows = [("iv", True), ("xxxix", True), ("di", False), ("mi", False), ("cm", False), ("ABC", True), ("e-Learning", True)]
    df = spark.createDataFrame(rows, "w string, want boolean")
    for r in df.withColumn("got", W.is_structural(F.col("w"), F.lit(True))).collect():
        assert r.got == r.want, r


def test_suggestions_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abd") for _ in range(rng.randint(2, 9)))
    known, asked = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {r.word: (r.distance, r.suggestion) for r in D.suggest(frame(asked), frame(known)).collect()}
    for w in asked:
        near = [(levenshtein(w, k), k) for k in known if k[0] == w[0]]
        near = [x for x in near if x[0] <= (1 if len(w) <= 5 else 2)]
        assert got.get(w) == (min(near) if near and 3 <= len(w) <= 20 else None), w


def test_carry_forward_crosses_blocks(spark):
    # One job holds all rows; values must pass over several page blocks.
    rows = [("hot", i, (i % 2 == 0) if i in (3, 700) else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "job_id string, page_number int, v boolean")
    got = {r.page_number: r.v for r in PG.carry_forward(df, ["job_id"], "page_number", "v").collect()}
    assert len(got) == 1500
    for i in range(1500):
        assert got[i] == (None if i < 3 else False if i < 700 else True)


def test_score_and_percentages(spark):
    df = spark.createDataFrame([(0, 0, 5), (10, 5, 10), (3, 0, 0), (1000, 0, 1)], "k int, e int, p int")
    assert [r.s for r in df.select(LB.score(F.col("k"), F.col("e"), F.col("p")).alias("s")).collect()] == [100, 79, 99, 0]
    p = spark.createDataFrame([(0, 5), (4, 3), (8, 7)], "b long, a long").select(
        LB.percent_change(F.col("b"), F.col("a")).alias("p")
    )
    assert [r.p for r in p.collect()] == [None, -25.0, -12.5]


def test_apply_fixes_right_to_left(spark):
    pages = spark.createDataFrame([("j", 1, "aa bb cc dd")], "job_id string, page_number int, content string")
    fixes = spark.createDataFrame(
        [("j", 1, 1, 0, 2, "aa", "AAAA", False), ("j", 1, 2, 6, 2, "cc", None, True),
         ("j", 1, 3, 3, 2, "xx", "y", False), ("j", 1, 4, 9, 2, "dd", "", False)],
        "job_id string, page_number int, finding_id long, offset int, length int, token string, suggestion string, is_italic boolean",
    )
    r = E.apply_fixes(pages, fixes).first()
    assert r.new_content == "AAAA bb cc dd"
    assert [tuple(x) for x in r.italic_ranges] == [(8, 10)]
    assert {x.finding_id: x.reason for x in r.log} == {1: None, 2: None, 3: E.CHANGED, 4: E.INCOMPLETE}


def test_reanchor_prefers_context_and_refuses_overlap(spark):
    texts = spark.createDataFrame([("j", "satu kata di sini. dua kata di sana.")], "job_id string, text string")
    f = spark.createDataFrame(
        [("j", 1, "kata", "Kata", "dua kata di sana", False), ("j", 2, "ata", "x", "", False),
         ("j", 3, "hilang", "x", "", False), ("j", 4, "kata", "k", "", True), ("j", 5, "kata di sana", "z", "dua kata di sana.", False)],
        "job_id string, finding_id long, token string, suggestion string, excerpt string, is_italic boolean",
    )
    got = {r.finding_id: (r.start, r.reason) for r in E.reanchor(f, texts).collect()}
    assert got[1] == (23, None)
    assert got[2] == (6, None)
    assert got[3][1] == E.NOT_FOUND and got[4][1] == E.ITALIC_BY_HAND and got[5][1] == E.OVERLAP


def test_locate_excerpt_fallbacks(spark):
    find = lambda text, q: one(spark, text, lambda c: E.locate_excerpt(c, F.lit(q)))
    assert tuple(find("Ini Teks  panjang sekali", "teks panjang")) == (4, 16)
    assert tuple(find("ini teks panjang sekali", "xx teks panjang")) == (4, 16)
    assert tuple(find("tentang pem belajaran ini", "pembelajaran")) == (8, 21)
    assert find("kosong", "zzz") is None


def test_attempt_cap_and_cooldown(spark):
    jobs = spark.createDataFrame([("a", 2), ("b", 3)], "job_id string, attempts int").select(
        "*", F.lit("pending").alias("status"), F.lit(None).cast("timestamp").alias("heartbeat_at"),
        F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )
    got = {r.job_id: r.action for r in CL.stranded_jobs(jobs, F.lit("2024-01-02").cast("timestamp")).collect()}
    assert got == {"a": "requeue", "b": "fail"}


def test_excluded_pages(spark):
    from naskah.operators.findings import parse_excluded_pages

    assert sorted(one(spark, "5-3, 7, 0, x, 7", parse_excluded_pages)) == [3, 4, 5, 7]


def test_pages_without_fixes_stay(spark):
    pages = spark.createDataFrame([("j", 1, "aa"), ("j", 2, "bb")], "job_id string, page_number int, content string")
    fixes = spark.createDataFrame(
        [("j", 1, 1, 0, 2, "aa", "A", False, "eyd", "r"), ("j", 9, 2, 0, 2, "xx", "y", False, "eyd", "r"),
         ("j", None, 3, 0, 2, "xx", "y", False, "eyd", "r")],
        "job_id string, page_number int, finding_id long, offset int, length int, token string, suggestion string, "
        "is_italic boolean, category string, rule_id string",
    )
    done = E.apply_fixes(pages, fixes)
    assert {r.page_number: (r.new_content, len(r.log)) for r in done.collect()} == {1: ("A", 1), 2: ("bb", 0)}
    log = {r.finding_id: (r.applied, r.reason) for r in E.change_log(fixes, done).collect()}
    assert log == {1: (True, None), 2: (False, E.NO_PAGE), 3: (False, E.NO_PAGE)}


def test_linkage_years_and_prefixes(spark):
    keys = spark.createDataFrame(
        [("j", k) for k in ("Smith", "Smith, 2020", "X, 2020", "Xavierson, 2020", "Lee, n.d.", "Kim, 1999")], "job_id string, citation_key string"
    )
    refs = spark.createDataFrame(
        [("j", 1, "Smith, J.", "2020", "t"), ("j", 2, "Xavier, P.", "2021", "t"), ("j", 3, "Kim, A.", "n.d.", "t"), ("j", 4, "Lee, A.", "", "t")],
        "job_id string, reference_id int, author string, year string, title string",
    )
    got = {r.citation_key: (r.reference_id, r.match_type) for r in L.match_citations(keys, refs).collect()}
    assert got["Smith"] == (None, "unmatched")  # a missing year is year 0
    assert got["Smith, 2020"] == (1, "exact")
    assert got["X, 2020"] == (2, "fuzzy") and got["Xavierson, 2020"] == (2, "fuzzy")
    assert got["Lee, n.d."] == (4, "exact")  # both without a year
    assert got["Kim, 1999"] == (3, "fuzzy")  # no number passes


def test_close_names_against_all_pairs(spark):
    r = random.Random(8)
    names = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(150)})
    cited = spark.createDataFrame([(n,) for n in names[::2]], "surname string")
    known = [(n, i % 3 > 0) for i, n in enumerate(names)]
    got = {
        (x.surname, x.name, x.is_surname): x.distance
        for x in L.close_names(cited, spark.createDataFrame(known, "name string, is_surname boolean")).collect()
    }
    want = {}
    for s in names[::2]:
        for n, full in known:
            d = 0 if full and (n.startswith(s) or s.startswith(n)) else levenshtein(s, n)
            if d <= max(1, int(len(s) * 0.3)):
                want[s, n, full] = d
    assert got == want


def test_replaced_partitions_vanish(spark, tmp_path):
    from naskah.sources.tables import replace_partition

    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, 0), (2, 1)], "v int, job_bucket int")
    replace_partition(rows, path)
    for _ in range(2):
        replace_partition(rows.where("v = 1"), path, replaced=rows.select("job_bucket"))
    assert [r.v for r in spark.read.parquet(path).collect()] == [1]


def test_arrivals_over_several_batches(spark, tmp_path):
    import pytest

    from naskah.streaming import streams as ST

    schema = "job_id string, page_number int, content string"
    folder, path = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

    def evaluate(pages):
        return pages.where(F.col("content").contains("bad")).select("job_id", "page_number")

    def state(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        ST.evaluate_arrivals(stream, evaluate, path, str(tmp_path / checkpoint), 4)
        found = ST.current_findings(spark, path, evaluate(spark.createDataFrame([], schema)).schema)
        return sorted((r.job_id, r.page_number) for r in found.collect())

    arrive(("a", 1, "bad"), ("b", 1, "bad"))
    assert state("c1") == [("a", 1), ("b", 1)]
    arrive(("a", 2, "bad"))  # a job split over two batches
    assert state("c1") == [("a", 1), ("a", 2), ("b", 1)]
    arrive(("b", 1, "good"))  # a job that became clean
    assert state("c1") == [("a", 1), ("a", 2)]
    assert state("c2") == [("a", 1), ("a", 2)]  # all of it once more
    (tmp_path / "out" / "evaluated").rename(tmp_path / "out" / "gone")
    with pytest.raises(Exception):  # an unreadable table is no empty one
        ST.current_findings(spark, path, evaluate(spark.createDataFrame([], schema)).schema)


def test_udf_code_reaches_executors(tmp_path):
    """Started from another folder, without PYTHONPATH."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util as u; from pyspark.sql import SparkSession; "
        f"s = u.spec_from_file_location('entry_file', {repo!r} + '/__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); "
        "spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); "
        "print('ROWS', len(m.queries()['ud1_embedder_slot'](spark, '/root/testdata/sf0.001').limit(3).collect()))"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 3" in done.stdout, done.stderr[-2000:]


def test_bm25_top_k(spark):
    from naskah.operators import bm25 as BM

    docs = spark.createDataFrame([(i, "satu dua tiga " * (i + 1) + f"kata{i}") for i in range(6)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "dua kata3"), (2, "zzz")], "query_id long, text string")
    every = sorted(((r.query_id, -r.score, r.doc_id) for r in BM.bm25_rank(docs, queries).collect()))
    top = sorted(((r.query_id, -r.score, r.doc_id) for r in BM.bm25_rank(docs, queries, 2).collect()))
    assert top == every[:2] and top[0][2] == 3
    assert BM.bm25_rank(docs.limit(0), queries).count() == 0  # empty corpus, no overlap
