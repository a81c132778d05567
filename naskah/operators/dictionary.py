"""Word check: candidates of a page, lookup cascade, suggestions, unknown words."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from naskah.constants import PREFIX_RULES, SUFFIXES
from naskah.functions import similarity as S
from naskah.functions import text as T
from naskah.functions import words as W
from naskah.operators.words import word_table
from naskah.session import materialize

MAX_STEPS = 32
_RULES = [(re.compile(p), r) for p, r in PREFIX_RULES] + [
    (re.compile(rf"([a-z]){s}$"), r"\1") for s in SUFFIXES
]


#: Matches every word that some rule changes; most words have no affix at all.
_AFFIXED = re.compile("|".join(f"(?:{p.pattern})" for p, _ in _RULES))


def affix_stems(word: str) -> list[str]:
    """Stems of a word, breadth first, in the order of the rules."""
    if not _AFFIXED.search(word):
        return []
    order = {word: None}
    todo = [word]
    for step in range(MAX_STEPS):
        if step >= len(todo):
            break
        for pattern, replacement in _RULES:
            stem = pattern.sub(replacement, todo[step], count=1)
            if len(stem) >= 2 and stem not in order:
                order[stem] = None
                todo.append(stem)
    return list(order)[1:]


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Arrow-batched ``affix_stems``; meant for distinct words."""
    return words.map(affix_stems)


def load_dictionary(*tables: DataFrame) -> DataFrame:
    """Distinct trimmed lower-case words of all tables."""
    out = None
    for t in tables:
        part = t.select(F.lower(F.trim("word")).alias("word"))
        out = part if out is None else out.unionByName(part)
    return out.filter("word <> ''").distinct()


def load_vocabulary(spark, path: str) -> DataFrame:
    """Tab-separated ``word, classification, notes`` with a header."""
    raw = spark.read.csv(
        path, sep="\t", header=True, schema="word string, classification string, notes string"
    )
    return normalize_vocabulary(raw)


def normalize_vocabulary(raw: DataFrame) -> DataFrame:
    return raw.select(F.lower(F.trim("word")).alias("word"), "classification").filter("word <> ''")


def fresh_answers(answers: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Stored answers that are not older than the time to live."""
    age = F.unix_micros(now) - F.unix_micros(F.col("fetched_at"))
    return answers.filter(age <= ttl_seconds * 1_000_000)


_SOURCES = {
    "v": "user-vocabulary", "d": "local-database", "a": "kbbi-online",
    "e": "english-list", "n": "kbbi-online", "u": "unverified",
}


def lookup_words(
    words: DataFrame,
    dictionary: DataFrame,
    vocabulary: DataFrame,
    answers: DataFrame | None = None,
    english: DataFrame | None = None,
    use_dictionary: bool = True,
) -> DataFrame:
    """Verdict per distinct word: ``known, database_only, is_english, source, tier``.

    Every probe of a word (itself, reduplicated base, stems) has a rank; the lowest
    rank that hits decides. One join serves vocabulary and dictionary together.
    """
    w = F.col("word")
    base = words.select(F.lower(F.trim(w)).alias("word")).filter("word <> ''").distinct()
    probe = lambda rank, text, via: F.struct(
        rank.alias("rank"), text.alias("probe"), F.lit(via).alias("via")
    )
    first = F.array(
        probe(F.lit(0), w, "v"),
        probe(F.lit(1), W.redup_base(w), "vd"),
        probe(F.lit(2), W.redup_affixed_base(w), "vd"),
        probe(F.lit(3), w, "d"),
    )
    later = F.transform(F.col("stems"), lambda s, i: probe(i + 4, s, "vd"))
    probes = (
        base.withColumn("stems", stems(w))
        .select("word", F.explode(F.concat(first, later)).alias("p"))
        .select("word", "p.rank", "p.probe", "p.via")
        .filter(F.col("probe").isNotNull() & ((F.col("rank") == 0) | (F.length("probe") >= 2) | (F.col("rank") == 3)))
    )
    lexicon = vocabulary.select("word", "classification", F.lit(False).alias("listed"))
    if use_dictionary:
        lexicon = lexicon.unionByName(
            dictionary.select("word", F.lit(None).cast("string").alias("classification"), F.lit(True).alias("listed"))
        )
    lexicon = lexicon.groupBy(F.col("word").alias("probe")).agg(
        F.max("classification").alias("classification"), F.max("listed").alias("listed")
    )
    by_vocabulary = F.contains("via", F.lit("v")) & F.col("classification").isNotNull()
    by_dictionary = F.contains("via", F.lit("d")) & F.col("listed")
    hits = (
        probes.join(lexicon, "probe")
        .filter(by_vocabulary | by_dictionary)
        .groupBy("word")
        .agg(
            F.min_by(F.when(by_vocabulary, F.col("classification")).otherwise("-"), "rank").alias("hit")
        )
    )
    out = base.join(hits, "word", "left")
    if answers is not None:
        out = out.join(answers.groupBy("word").agg(F.max("found").alias("answer")), "word", "left")
    else:
        out = out.withColumn("answer", F.lit(None).cast("boolean"))
    if english is not None:
        out = out.join(
            english.select("word").distinct().withColumn("listed_english", F.lit(True)), "word", "left"
        )
    else:
        out = out.withColumn("listed_english", F.lit(None).cast("boolean"))
    hit, answer = F.col("hit"), F.col("answer")
    via = (
        F.when(hit == "-", "d")
        .when(hit.isNotNull(), "v")
        .when(answer, "a")
        .when(F.col("listed_english"), "e")
        .when(answer.isNotNull(), "n")
        .otherwise("u")
    )
    v = F.col("via")
    names = F.create_map(*[F.lit(x) for kv in _SOURCES.items() for x in kv])
    return out.withColumn("via", via).select(
        "word",
        (v.isin("d", "a", "e") | ((v == "v") & (hit != "typo"))).alias("known"),
        (~v.isin("a", "n")).alias("database_only"),
        ((v == "e") | ((v == "v") & hit.isin("english", "tech"))).alias("is_english"),
        names[v].alias("source"),
        F.when(v == "u", "unverified").otherwise("local").alias("tier"),
    )


PAGES_A_BLOCK = 64


def first_of_job(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of each job by ``page_number, offset, word``.

    Two levels of running counts: rows per block of pages, summed over the blocks before; only
    blocks that begin within the first ``n`` rows are numbered, each by itself, so no task orders
    the rows of a job.
    """
    block = F.floor(F.col("page_number") / PAGES_A_BLOCK)
    placed = rows.withColumn("block", block)
    earlier = Window.partitionBy("job_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = (
        placed.groupBy("job_id", "block").agg(F.count("*").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .filter(F.col("before") < n)
        .select("job_id", "block", "before")
    )
    order = Window.partitionBy("job_id", "block").orderBy("page_number", "offset", "word")
    return (
        placed.join(begins, ["job_id", "block"])
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("before") + F.col("r") <= n)
        .select(*rows.columns)
    )


def within_budget(candidates: DataFrame, verdicts: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` unresolved words per job in page order; 0 means all."""
    if "source" in candidates.columns:  # with their verdict already
        unverified = candidates.filter("source = 'unverified'")
    else:
        unverified = candidates.join(verdicts.filter("source = 'unverified'").select("word"), "word", "left_semi")
    open_words = (
        unverified.groupBy("job_id", "word")
        .agg(F.min(F.struct("page_number", "offset")).alias("at"))
        .select("job_id", "word", "at.page_number", "at.offset")
    )
    return open_words if budget <= 0 else first_of_job(open_words, budget)


def resolve_external(candidates: DataFrame, asked: DataFrame, external: DataFrame) -> DataFrame:
    """``candidates`` (with verdict columns) after asking ``external`` (``word, found``) for ``asked``.

    An answer holds for the whole job. Its tier is ``daring`` where it was asked and ``local``
    afterwards, when it comes from the stored answers. Words without an answer stay unverified.
    """
    answers = external.groupBy("word").agg(F.max("found").alias("found"))
    answered = asked.join(answers, "word").select(
        "job_id", "word", "found", F.struct("page_number", "offset").alias("asked_at")
    )
    new = F.col("found").isNotNull()
    here = F.struct("page_number", "offset") == F.col("asked_at")
    rest = [c for c in candidates.columns if c not in ("known", "database_only", "is_english", "source", "tier")]
    return candidates.join(answered, ["job_id", "word"], "left").select(
        *rest,
        F.coalesce("found", "known").alias("known"),
        F.when(new, False).otherwise(F.col("database_only")).alias("database_only"),
        F.when(new, False).otherwise(F.col("is_english")).alias("is_english"),
        F.when(new, "kbbi-online").otherwise(F.col("source")).alias("source"),
        F.when(new & here, "daring").when(new, "local").otherwise(F.col("tier")).alias("tier"),
    )


def proper_nouns(tokens: DataFrame) -> DataFrame:
    """Words written with a capital at least twice and never in lower case, per job."""
    t = F.col("token")
    return (
        tokens.filter(F.length(t) >= 3)
        .groupBy("job_id", F.lower(t).alias("word"))
        .agg(
            F.count_if(t.rlike(r"^[A-Z][a-zà-ÿ]+\z")).alias("capital"),
            F.count_if(t.rlike(r"^[a-zà-ÿ]+\z")).alias("lower"),
        )
        .filter("capital >= 2 AND lower = 0")
        .select("job_id", "word")
    )


def fragment_probes(tokens: DataFrame) -> DataFrame:
    """``job_id, page_number, joined, offsets`` of neighbouring tokens that may be one word."""
    # one blank after the token, and after the middle one of three, which has one letter
    second = F.col("offset") + F.length("token") + 1
    two = F.struct(F.lower("pair").alias("joined"), F.array("offset", second).alias("offsets"))
    three = F.struct(F.lower("triple").alias("joined"), F.array("offset", second, second + 2).alias("offsets"))
    both = F.array_compact(F.array(two, F.when(F.col("triple").isNotNull(), three)))
    return (
        tokens.filter(F.col("pair").isNotNull())
        .select("job_id", "page_number", F.explode(both).alias("p"))
        .select("job_id", "page_number", "p.joined", "p.offsets")
    )


def known_fragments(probes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Offsets of tokens that are pieces of a known word."""
    known = verdicts.filter("known").select(F.col("word").alias("joined"))
    return probes.join(known, "joined", "left_semi").select(
        "job_id", "page_number", F.explode("offsets").alias("offset")
    ).distinct()


def page_words(tokens: DataFrame) -> DataFrame:
    """Tokens of a ``word_table`` left after the exclusions that a page decides alone.

    Excluded are links, citations, code, reduplications with blanks, structural tokens,
    one-letter words and words set in italics on the page.
    """
    t = F.col("token")
    return tokens.filter(
        (F.length(t) >= 2) & ~F.col("skipped") & ~F.col("italic") & ~W.is_structural(t, F.col("at_start"))
    ).select("job_id", "page_number", "offset", "token", F.lower(t).alias("word"))


def first_occurrence(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key; an aggregate, so rows combine before they are shuffled."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = F.min(F.struct(*order, *rest)).alias("f")
    return df.groupBy(*keys).agg(first).select(*keys, "f.*")


def word_candidates(words: DataFrame, fragments: DataFrame, nouns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First occurrence per page of each of the ``page_words`` to look up, with its verdict.

    Words are dealt once, by page: the fragments of a page meet them as one list, and first occurrences
    need no other exchange. Names, which hold for a whole job, leave the far fewer first occurrences.
    A token that equals its word travels as null.
    """
    page = ["job_id", "page_number"]
    pieces = fragments.groupBy(*page).agg(F.collect_set("offset").alias("pieces"))
    whole = (
        words.drop("word").join(pieces, page, "left")
        .filter(F.col("pieces").isNull() | ~F.array_contains("pieces", F.col("offset")))
        .select(*page, "offset", F.nullif("token", F.lower("token")).alias("token"), F.lower("token").alias("word"))
    )
    first = first_occurrence(whole, [*page, "word"], ["offset"])
    judged = first.join(nouns, ["job_id", "word"], "left_anti").join(verdicts, "word")
    return judged.withColumn("token", F.coalesce("token", "word"))


class WordCheck(NamedTuple):
    tokens: DataFrame
    verdicts: DataFrame  # one row per distinct word, without external answers
    fragments: DataFrame
    candidates: DataFrame  # the words to judge, with their verdict


def check_words(
    pages: DataFrame, dictionary: DataFrame, vocabulary: DataFrame, answers: DataFrame | None = None,
    english: DataFrame | None = None, body: DataFrame | None = None,
) -> WordCheck:
    """All words of ``pages`` (``content, code_ranges, italic_ranges``) against the local tiers.

    ``body`` (``job_id, page_number``) names the pages whose words are judged; names count on all.
    The texts are cut once; tokens, verdicts, fragments and candidates are written, as several tables
    are made of each.
    """
    tokens = materialize(word_table(pages).drop("second", "third"), "tokens", "zstd")
    judged = tokens if body is None else tokens.join(body, ["job_id", "page_number"], "left_semi")
    words, probes = page_words(judged), fragment_probes(judged)
    asked = words.select("word").unionByName(probes.select(F.col("joined").alias("word")))
    verdicts = materialize(lookup_words(asked, dictionary, vocabulary, answers, english), "verdicts", "zstd")
    fragments = materialize(known_fragments(probes, verdicts), "fragments", "zstd")
    candidates = word_candidates(words, fragments, proper_nouns(tokens), verdicts)
    return WordCheck(tokens, verdicts, fragments, materialize(candidates, "candidates", "zstd"))


def with_external(check: WordCheck, external: DataFrame, budget: int) -> DataFrame:
    """The candidates of ``check`` after asking ``external`` within the budget of each job."""
    asked = within_budget(check.candidates.select("job_id", "word", "page_number", "offset", "source"), check.verdicts, budget)
    # answered words are few where there is a budget; once written, Spark knows their size
    answered = materialize(asked.join(external.select("word").distinct(), "word", "left_semi"), "asked", "zstd")
    return resolve_external(check.candidates, answered, external)


def tier_counts(candidates: DataFrame, *by: str) -> DataFrame:
    """Candidates per tier; a word on three pages counts three times. Without ``by`` one row of totals."""
    tier = F.col("tier")
    return candidates.groupBy(*by).agg(
        *[F.count_if(tier == t).alias(t) for t in ("local", "daring", "unverified")],
        F.count("*").alias("total"),
    )


def max_edits(length: Column) -> Column:
    return F.when(length <= 5, 1).otherwise(2)


def _edits_reach(length: Column) -> Column:
    return F.lit(2) + length * 0


def suggest(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Nearest dictionary word with the same first letter: ``word, suggestion, distance``.

    One edit up to five letters, two above; equal distances go to the first word in
    alphabetical order. Words of 3 to 20 letters only.
    """
    w = F.col("word")
    ask = words.select("word").distinct().filter(F.length(w).between(3, 20))
    block = lambda k: F.concat(F.left(w, F.lit(1)), F.lit("|"), k)
    asked = ask.select("word", F.explode(F.transform(S.piece_keys(w, max_edits), block)).alias("piece"))
    offered = dictionary.select(
        F.col("word").alias("entry"),
        F.explode(F.transform(S.probe_keys(w, max_edits, _edits_reach), block)).alias("piece"),
    ).filter(F.length("entry").between(2, 22))
    near = F.levenshtein(w, F.col("entry"), 2)
    # Pieces are few bytes but much work, so their number of partitions is not left to size.
    spark = words.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return (
        asked.repartition(tasks, "piece").join(offered, "piece")
        .withColumn("distance", near)
        .filter((F.col("distance") >= 0) & (F.col("distance") <= max_edits(F.length(w))))
        .groupBy("word")
        .agg(F.min(F.struct("distance", "entry")).alias("b"))
        .select("word", F.col("b.entry").alias("suggestion"), "b.distance")
    )


def unknown_words(candidates: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Findings for candidates that no tier knows."""
    out = candidates.filter("NOT known")
    if suggestions is not None:
        out = out.join(suggestions.select("word", "suggestion"), "word", "left")
    else:
        out = out.withColumn("suggestion", F.lit(None).cast("string"))
    online = F.col("source") == "kbbi-online"
    # The two messages.
    message = F.when(
        online,
        F.concat(
            F.lit('Kata "'), F.col("token"),
            F.lit('" tidak ditemukan di basis data lokal maupun KBBI daring — mungkin istilah '
                  "teknis/asing, nama, atau salah ketik."),
        ),
    ).otherwise(
        F.concat(
            F.lit('Kata "'), F.col("token"),
            F.lit('" belum dapat diverifikasi ke KBBI daring (sumber sedang sibuk atau tidak '
                  "menjawab). Sejauh ini hanya diperiksa di basis data lokal — mungkin istilah "
                  "teknis/asing, nama, atau salah ketik."),
        )
    )
    return out.select(
        "job_id", "page_number", "offset", F.length("token").alias("length"), "token", "word",
        F.when(F.col("database_only"), "kbbi.unknown-word.database-only")
        .otherwise("kbbi.unknown-word").alias("rule_id"),
        F.when(online, "kbbi-daring").otherwise("basis-data").alias("verification_source"),
        message.alias("message"),
        "suggestion",
    )
