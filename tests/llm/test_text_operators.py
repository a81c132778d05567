"""BPE, quality, HTML, sharding, secrets, decontamination: exact or brute-force cases."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_cases import PAGES
from naskah.llm import bpe, decontamination, html_text, quality, secrets, sharding
from naskah.llm import text as T
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_and_shingles():
    texts = ["A b\tC", "", None, "é É x y z w", "one two three four five six"]
    (block,) = T.blocks(pa.array(texts))
    w = T.words(block)
    assert np.diff(w.first).tolist() == [3, 0, 0, 6, 6]
    (again,) = T.blocks(pa.array(["a B c"]))
    assert T.words(again).hashes.tolist() == w.hashes[:3].tolist()
    h, first = T.shingles(w)
    assert np.diff(first).tolist() == [1, 0, 0, 2, 2]
    assert len(set(h.tolist())) == 5


@pytest.mark.parametrize("seed", range(5))
def test_rank_queue_equals_library(seed):
    r = random.Random(seed)
    codec, own = bpe.codec(open(VOCABULARY, "rb").read(), public_tokenizers.PATTERN), library()
    for alphabet in ("ab", "abcdehilnorst", "é½😀 \n'", "0123456789 -_"):
        text = "".join(r.choice(alphabet) for _ in range(r.choice([1, 7, 60, 4000])))
        ids = codec.encode(text)
        assert ids.tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_bpe_on_odd_rows(odd_documents, no_documents):
    own = library()
    out = bpe.digests(bpe.encode_decode(odd_documents, VOCABULARY, public_tokenizers.PATTERN)).collect()
    texts = {}
    for r in odd_documents.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    assert len(out) == odd_documents.count()
    for r in out:
        ids = [own.encode_ordinary(t) for t in texts[r.doc_id]]
        assert (r.n_tokens, r.ids_sha256) in [(len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for i in ids]
        assert r.decoded_sha256 in [hashlib.sha256(t.encode()).hexdigest() for t in texts[r.doc_id]]
    assert bpe.encode_decode(no_documents, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_quality_learns_and_covers_odd_rows(spark, odd_documents, no_documents):
    r = random.Random(1)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 9))) for _ in range(400)]
    texts = [" ".join((w.upper() + "!!") if i % 2 else w for w in r.choices(words, k=80)) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(400)] + [(None, 1), (7, None), (9, 5)], "doc_id long, quality int")
    out = quality.classify(docs, labels).join(labels.where("quality < 2"), "doc_id").where("held_out").collect()
    assert len(out) > 40 and np.mean([r.predicted == r.quality for r in out]) > 0.95
    odd = quality.classify(odd_documents, labels.limit(0)).collect()
    assert len(odd) == odd_documents.count() and {r.score for r in odd} == {0.5}
    model = quality.train(docs, labels)
    scored = quality.score(odd_documents, model).collect()
    assert len(scored) == len(odd) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(no_documents, model).count() == 0
    kept = quality.keep_good(odd_documents, labels.limit(0))
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


BODY = "<p>One, two three. Four; five six seven, eight nine ten, and so on.</p>" * 4


@pytest.mark.parametrize("page, want", [
    (f"<div id=wrap><h1>Title</h1><p>The lead, short.</p><div class=text>{BODY}<h2>Part</h2>{BODY}</div></div><p>Copy</p>",
     ["Title", "The lead, short.", 4, "Part", 4]),
    (f"<div class=story>{BODY}</div><aside><article><p>Teaser</p></article></aside>", [4]),
    (f"<article><p>Teaser</p></article><div class=story>{BODY * 3}</div>", ["Teaser", 12]),
])
def test_main_text_by_scores(page, want):
    assert html_text.main_text(page).split("\n\n") == _blocks(want)


def _blocks(want):
    line = BODY[3:].split("</p>")[0]
    return [x for w in want for x in ([line] * w if isinstance(w, int) else [w])]


@pytest.mark.parametrize("page, want", [
    (f"<div class='wrapper no-sidebar'>{BODY}</div>", [4]), (f"<div class='widget Blog'>{BODY}</div>", [4]),
    (f"<div id='page-with-nav'><article>{BODY}</article></div><p>Home</p>", [4]),
    (f"<div class='has-sidebar'><article>{BODY}</article><div class=sidebar><p>Side, bar. A, b, c.</p></div></div>", [4]),
    (f"<article><header class='entry-header'><h1>Title</h1></header>{BODY}<h2 id='related-work'>Related</h2>{BODY}</article>",
     ["Title", 4, "Related", 4]),
    ("<div class='ad'>Buy, now, and buy here.</div><article><p>A short, true text.</p></article>", ["A short, true text."]),
])
def test_main_text_in_hinted_wrappers(page, want):
    assert html_text.main_text(page).split("\n\n") == _blocks(want)


def test_html_rows(spark):
    pages = spark.createDataFrame(
        [(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "<p>a, b.</p>", "x"), (None, "u", "<p>a, b.</p>", None)],
        "page_id long, url string, html string, text string",
    )
    out = html_text.extract(pages).collect()
    assert sorted((r.text, r.n_chars) for r in out) == [("", 0), ("", 0), ("a, b.", 5), ("a, b.", 5)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_shards_fit_and_are_minimal(spark, odd_documents, no_documents):
    r = random.Random(2)
    sizes = [r.choice([0, 10, 100, 900]) for _ in range(500)] + [5000]
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    out = sharding.assign_shards(docs, limit_bytes=2000).collect()
    assert sorted(x.doc_id for x in out) == list(range(501))
    bits = {i: format(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), "060b") for i in range(501)}
    for x in out:
        assert bits[x.doc_id].startswith(x.shard_id) and len(x.shard_id) == x.depth
        inside = [i for i in bits if bits[i].startswith(x.shard_id)]
        assert x.shard_rows == len(inside) and x.shard_bytes == sum(sizes[i] for i in inside)
        assert x.shard_bytes <= 2000 or x.shard_rows == 1
        if x.depth:  # the bucket above was too large
            above = [i for i in bits if bits[i].startswith(x.shard_id[:-1])]
            assert sum(sizes[i] for i in above) > 2000 and len(above) > 1
    assert sharding.assign_shards(odd_documents).count() == odd_documents.count()
    assert sharding.assign_shards(no_documents).count() == 0


def test_shards_split_one_key(spark):
    docs = spark.range(200).select(F.lit(7).alias("doc_id"), F.lit("x" * 10).alias("text"))
    nulls = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x" * 10).alias("text"))
    out = sharding.assign_shards(docs.unionAll(nulls), limit_bytes=300).groupBy("shard_id").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in out) == 250 and max(r.b for r in out) <= 300


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(40)], "doc_id long, text string")
    assigned = sharding.assign_shards(docs, limit_bytes=400)
    sharding.write_shards(docs, assigned, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_secrets(spark, odd_documents, no_documents):
    r = random.Random(4)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(4, 9))) for _ in range(300)]
    base = [" ".join(r.choices(words, k=60)) for _ in range(40)]
    token = hashlib.sha1(b"k").hexdigest()
    docs = spark.createDataFrame(
        [(i, f'{t} token = "{token}" {t[:20]}' if i % 4 == 0 else f"{t} 4929348385146306 {t[:20]}") for i, t in enumerate(base)],
        "doc_id long, text string",
    )
    model = secrets.train(docs, examples=1500)
    found = secrets.scan(docs, model).collect()
    assert {x.doc_id for x in found if x.is_secret} == set(range(0, 40, 4))
    assert all(x.secret == token for x in found if x.is_secret)
    held = secrets.labelled_findings(sorted(model.profile.words), 600, seed=11)
    x = np.array([secrets.features(t, s, e, model.profile) for t, s, e, _ in held])
    right = (secrets.forest_score(model.forest, x) >= secrets.THRESHOLD) == np.array([f[3] for f in held])
    assert right.mean() > 0.97
    clean = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    assert all(token not in t and (secrets.MASK in t) == (i % 4 == 0) for i, t in clean.items())
    same = secrets.redact(odd_documents, model)
    assert same.columns == odd_documents.columns
    assert sorted(map(repr, same.collect())) == sorted(map(repr, odd_documents.collect()))
    assert secrets.scan(no_documents, secrets.train(no_documents, examples=100)).count() == 0


@pytest.fixture(scope="module")
def secrets_model(spark):
    r = random.Random(4)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(4, 9))) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=60))) for i in range(40)], "doc_id long, text string")
    return secrets.train(docs, examples=3000)


@pytest.mark.parametrize("spelling", [
    "token={}", "API_KEY={}", "export DB_PASSWORD={}", "AWS_SECRET_ACCESS_KEY={}", "https://a.example.com/x?access_token={}&user=bob",
    "token = \"{}\"", "password: {}",
])
def test_secrets_by_spelling(secrets_model, spelling):
    r = random.Random(9)
    found = 0
    for i in range(60):
        size, letters = [(40, "0123456789abcdef"), (32, "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"), (14, "abcdefgXYZ23456!@#$%")][i % 3]
        value = "".join(r.choice(letters) for _ in range(size))
        text = f"nur tale {spelling.format(value)} rine salo"
        spans, scores = secrets.findings(text, secrets_model)
        found += value in [text[s:e] for (s, e), x in zip(spans, scores) if x >= secrets.THRESHOLD]
    assert found >= 54


def test_secret_spans_cut_names_only():
    assert [t[s:e] for t in ["a request_id=0123456789abcdef01 b"] for s, e in secrets.spans_of(t)] == ["0123456789abcdef01"]
    t = "ghp_0123456789abcdefXY/token=hunter2!secretX AbCd0123456789abcdefgh=="
    assert [t[s:e] for s, e in secrets.spans_of(t)] == ["ghp_0123456789abcdefXY/", "hunter2!secretX", "AbCd0123456789abcdefgh=="]


def test_decontamination(spark, odd_documents, no_documents):
    r = random.Random(6)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    items = [" ".join(r.choices(words, k=r.randint(15, 90))) + "." for _ in range(30)] + [None, ""]
    texts = [r.choices(words, k=300) for _ in range(60)]
    planted = set()
    for i in range(0, 60, 3):
        item = items[i // 3].split()
        if i % 2:  # a paraphrase: every seventh word another, the end kept
            item = [w if k % 7 or k > len(item) - 8 else r.choice(words) for k, w in enumerate(item)]
        at = r.randint(0, 250)
        texts[i][at:at] = item
        planted.add((i, i // 3))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()}
    assert got == planted
    assert decontamination.leaks(odd_documents, bench).count() == 0
    assert decontamination.leaks(no_documents, bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_decontamination_of_a_paraphrase_in_a_third_of_all_documents(spark):
    r = random.Random(8)
    words = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 9))) for _ in range(3000)]
    often = words[:600]  # each in about 15 % of the documents
    items = [" ".join(r.choices(words[600:], k=50)) + "." for _ in range(10)]
    items[1] = " ".join(w if k % 4 == 3 else r.choice(often) for k, w in enumerate(items[1].split()[:40])) + "."
    copies = [[r.choice(words) if k % 5 == 2 else w for k, w in enumerate(items[0].split())]]
    copies.append([r.choice(words) if k % 4 == 3 else w for k, w in enumerate(items[1].split())])
    texts, planted = [], set()
    for i in range(300):
        t = [r.choice(often) if r.random() < 0.5 else r.choice(words) for _ in range(200)]
        which = 0 if i % 3 == 0 else 1 if i % 30 == 1 else None  # a third; some, only their common words kept
        if which is not None:
            at = r.randint(0, 200)
            t[at:at] = copies[which]
            planted.add((i, which))
        texts.append(" ".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.leaks(docs, bench).collect()} == planted


def test_common_subsequence():
    r = random.Random(3)
    for _ in range(50):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = decontamination._masks(np.array(a))
        assert decontamination.common_subsequence(masks, len(a), np.array(b)) == table[-1][-1]
