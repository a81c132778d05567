"""Passage retrieval: candidate pages, lexical and semantic matching, batches.

Queries are ``query_id, source_id, context``; pages are ``source_id, page_number, content``.
A query only meets pages of its own source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from naskah.constants import (
    CANDIDATE_PAGES, COSINE_FLOOR_OTHER, COSINE_FLOORS, NGRAM_WORDS, PASSAGE_ACCEPT,
    PASSAGE_MARGIN, TOKEN_RATE_ANCHOR,
)
from naskah.functions import passages as P
from naskah.functions import text as T
from naskah.functions.vectors import Embedder, embed_texts
from naskah.session import materialize

AUTOMATON_CHARS = 4_000_000
_KEYWORD_CHARS = 16  # what a keyword costs besides its letters
_KNOWN_WORDS = 500_000
_GRAM = 5
PAGES_A_GROUP = 16
QUERIES_A_GROUP = 5_000


def _grams(word: Column) -> Column:
    """Substrings a keyword may be found by: its own length up to ``_GRAM`` characters."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.lit(_GRAM)),
                lambda n: F.when(
                    F.length(word) >= n,
                    F.transform(
                        F.sequence(F.lit(1), F.length(word) - n + 1),
                        lambda p: F.substring(word, p, n),
                    ),
                ).otherwise(F.array().cast("array<string>")),
            )
        )
    )


def _found_by_grams(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``source_id, page_number, keyword`` by shared substrings of distinct words and keywords."""
    words = pages.select(
        "source_id", "page_number",
        F.explode(F.array_distinct(F.split(F.lower("content"), T.WS + "+"))).alias("word"),
    ).filter("word <> ''")
    grams = wanted.select("keyword").distinct().withColumn("gram", F.left("keyword", F.lit(_GRAM)))
    inside = (
        words.select("word").distinct()
        .withColumn("gram", F.explode(_grams(F.col("word"))))
        .join(grams, "gram")
        .filter(F.contains("word", F.col("keyword")))
        .select("word", "keyword")
    )
    found = words.join(inside, "word").select("source_id", "page_number", "keyword")
    return found.join(wanted, ["source_id", "keyword"]).distinct()


def _found_by_automaton(wanted: dict, pages: DataFrame) -> DataFrame:
    """The same with one automaton of all keywords, run once over each word a task meets.

    ``wanted`` maps a source to its keywords. Pages stay where they are; only hits leave a task.
    """
    kind = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("source_id", "page_number"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for keyword in set().union(*wanted.values()):
            machine.add_word(keyword, keyword)
        machine.make_automaton()
        known: dict[str, tuple[str, ...]] = {}
        words = re.compile(T.NOT_WS + "+", re.ASCII)
        for batch in batches:
            at, keywords = [], []
            for i, (source, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                asked = wanted.get(source)
                if not asked or not text.is_valid:
                    continue
                hits: set[str] = set()
                for word in set(words.findall(text.as_py())):
                    inside = known.get(word)
                    if inside is None:
                        inside = known[word] = tuple({k for _, k in machine.iter(word)})
                    hits.update(inside)
                if len(known) > _KNOWN_WORDS:
                    known.clear()
                hits &= asked
                at += [i] * len(hits)
                keywords += hits
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(keywords, pa.string())],
                ["source_id", "page_number", "keyword"],
            )

    lowered = pages.select("source_id", "page_number", F.lower("content"))
    return lowered.mapInArrow(scan, f"{kind}, keyword string").distinct()


def keyword_pages(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """``query_id, source_id, page_number, hits``: distinct keywords found in each page.

    A keyword has no blanks, so a page holds it iff one of the page's words does. Only pages of
    sources that are asked for are searched. Up to ``AUTOMATON_CHARS`` characters of keywords are
    known to all tasks as one automaton; more of them are joined with the pages' words instead.
    """
    kw = materialize(
        queries.select("query_id", "source_id", F.explode(P.keywords(F.col("context"))).alias("keyword")), "keywords"
    )
    wanted = kw.select("source_id", "keyword").distinct()
    asked = pages.join(queries.select("source_id").distinct(), "source_id", "left_semi")
    chars = wanted.agg(F.coalesce(F.sum(F.length("keyword") + _KEYWORD_CHARS), F.lit(0))).first()[0]
    if chars <= AUTOMATON_CHARS:
        by_source: dict = {}
        for r in wanted.collect():
            by_source.setdefault(r["source_id"], set()).add(r["keyword"])
        found = _found_by_automaton(by_source, asked) if by_source else _found_by_grams(wanted, asked)
    else:
        found = _found_by_grams(wanted, asked)
    return (
        kw.join(found, ["source_id", "keyword"])
        .groupBy("query_id", "source_id", "page_number")
        .agg(F.count("*").alias("hits"))
    )


def candidate_pages(
    queries: DataFrame, pages: DataFrame, limit: int = CANDIDATE_PAGES
) -> DataFrame:
    """The ``limit`` pages with most keywords; without any hit the first pages of the source."""
    hits = materialize(keyword_pages(queries, pages), "keyword-pages")
    best = Window.partitionBy("query_id", "source_id").orderBy(F.desc("hits"), "page_number")
    ranked = hits.withColumn("page_rank", F.row_number().over(best)).filter(
        F.col("page_rank") <= limit
    )
    order = Window.partitionBy("source_id").orderBy("page_number")
    first = (
        pages.select("source_id", "page_number")
        .withColumn("page_rank", F.row_number().over(order))
        .filter(F.col("page_rank") <= limit)
    )
    without = queries.select("query_id", "source_id").join(
        hits.select("query_id", "source_id").distinct(), ["query_id", "source_id"], "left_anti"
    )
    cols = ["query_id", "source_id", "page_number", "page_rank", "hits"]
    return ranked.select(*cols).unionByName(
        without.join(first, "source_id").withColumn("hits", F.lit(0).cast("bigint")).select(*cols)
    )


def source_windows(pages: DataFrame) -> DataFrame:
    """Sentence windows of every page after its masthead is cut."""
    return pages.select(
        "source_id", "page_number",
        F.posexplode(
            P.windows(P.sentences(P.strip_front_matter(F.col("content"))))
        ).alias("window_idx", "window_text"),
    )


def _query_features(queries: DataFrame) -> DataFrame:
    text = P.strip_markers(F.col("context"))
    return queries.select("query_id", "source_id", text.alias("q_text")).select(
        "query_id", "source_id",
        P.normalize(F.col("q_text")).alias("q_norm"),
        F.array_distinct(P.bm25_tokens(F.col("q_text"))).alias("q_tokens"),
        P.text_ngrams(F.col("q_text"), NGRAM_WORDS).alias("q_grams"),
        P.proper_nouns(F.col("q_text")).alias("q_nouns"),
        P.numbers(F.col("q_text")).alias("q_numbers"),
    )


def _window_features(windows: DataFrame) -> DataFrame:
    w = F.col("window_text")
    return windows.select(
        "source_id", "page_number", "window_idx", "window_text",
        P.normalize(w).alias("w_norm"),
        F.array_distinct(P.bm25_tokens(w)).alias("w_tokens"),
        P.proper_nouns(w).alias("w_nouns"),
        P.numbers(w).alias("w_numbers"),
    )


def _signals(pairs: DataFrame, *extra: str) -> DataFrame:
    """Lexical signals of pairs of query and window features."""
    return pairs.select(
        "query_id", "source_id", "page_number", "page_rank", "window_idx", "window_text",
        "q_norm", "w_norm", *extra,
        F.exists("q_grams", lambda g: F.contains(F.col("w_norm"), g)).cast("int").alias("exact"),
        P.overlap_rate(F.col("q_nouns"), F.col("w_nouns")).alias("noun_rate"),
        F.arrays_overlap("q_numbers", "w_numbers").cast("int").alias("number_hit"),
        P.overlap_rate(F.col("q_tokens"), F.col("w_tokens")).alias("token_rate"),
    )


def window_signals(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """Signals of each query against each window of its candidate pages."""
    candidates = candidate_pages(queries, pages)
    used = candidates.select("source_id", "page_number").distinct()
    windows = _window_features(
        source_windows(pages.join(used, ["source_id", "page_number"], "left_semi"))
    )
    return _signals(
        candidates.join(_query_features(queries), ["query_id", "source_id"])
        .join(windows, ["source_id", "page_number"])
    )


def _anchored() -> Column:
    return (
        (F.col("exact") > 0)
        | (F.col("noun_rate") > 0)
        | (F.col("number_hit") > 0)
        | (F.col("token_rate") >= TOKEN_RATE_ANCHOR)
    )


def _best_window(scored: DataFrame, *extra: str) -> DataFrame:
    """Highest score per query; the earlier candidate page and window win ties."""
    return scored.groupBy("query_id", "source_id").agg(
        F.min_by(
            F.struct("page_number", "window_idx", "window_text", "combined", "reason", *extra),
            F.struct((-F.col("combined")).alias("s"), "page_rank", "window_idx"),
        ).alias("b")
    )


def match_passages(queries: DataFrame, pages: DataFrame) -> DataFrame:
    """Lexical match: accepted passage per query, or nulls."""
    fuzzy = F.when(F.col("exact") == 1, 0.0).otherwise(
        P.edit_ratio(F.col("q_norm"), F.col("w_norm"))
    )
    scored = (
        window_signals(queries, pages)
        .filter(_anchored())
        .withColumn("fuzzy", fuzzy)
        .withColumn(
            "combined",
            0.6 * F.col("token_rate") + 0.25 * F.col("exact")
            + 0.1 * F.col("fuzzy") + 0.05 * F.col("noun_rate"),
        )
        .withColumn(
            "reason",
            F.when(F.col("exact") == 1, "Exact 8-word n-gram match")
            .when(F.col("fuzzy") > 0.6, "High Levenshtein similarity")
            .when(F.col("noun_rate") > 0, "Shared entity overlap")
            .otherwise("High token overlap with thesis context"),
        )
    )
    best = _best_window(scored).filter(F.col("b.combined") >= PASSAGE_ACCEPT)
    return _with_result(queries, best)


def _with_result(queries: DataFrame, best: DataFrame) -> DataFrame:
    return queries.select("query_id", "source_id").join(
        best, ["query_id", "source_id"], "left"
    ).select(
        "query_id", "source_id",
        F.col("b.page_number").alias("source_page"),
        F.col("b.window_text").alias("matched_passage"),
        T.round2(F.col("b.combined")).alias("confidence"),
        F.col("b.reason").alias("reasoning"),
    )


def cosine_floor(model: str) -> float:
    return COSINE_FLOORS.get(model, COSINE_FLOOR_OTHER)


def window_vectors(windows: DataFrame, embed: Embedder, stored: DataFrame | None = None, e5: bool = False) -> DataFrame:
    """``source_id, page_number, window_idx, vector`` of ``windows``: stored where there is one, else from the model."""
    keys = ["source_id", "page_number", "window_idx"]
    if stored is None:
        return embed_texts(windows, "window_text", embed, "passage", e5).select(*keys, "vector")
    have = stored.join(windows.select(*keys), keys, "left_semi").select(*keys, "vector")
    missing = windows.join(stored.select(*keys), keys, "left_anti")
    return have.unionByName(embed_texts(missing, "window_text", embed, "passage", e5).select(*keys, "vector"))


def cosine_scores(candidates: DataFrame, query_vectors: DataFrame, windows: DataFrame, floor: float) -> DataFrame:
    """``query_id, source_id, page_number, window_idx, cosine`` of queries and windows of their candidate pages.

    Only scores of at least ``floor`` and the two best of each query and group are returned, so
    two rows a query are enough for its margin. Vectors meet in groups of ``PAGES_A_GROUP`` pages
    of a source; a group that more than ``QUERIES_A_GROUP`` queries ask for is repeated for parts of
    them. Inside, each page's windows are multiplied with the queries that ask for the page.
    Vectors of different lengths score 0.
    """
    group = F.floor(F.col("page_number") / PAGES_A_GROUP).alias("page_group")
    asked = (
        candidates.select("query_id", "source_id", "page_number", group)
        .groupBy("query_id", "source_id", "page_group").agg(F.collect_set("page_number").alias("pages"))
    )
    parts = asked.groupBy("source_id", "page_group").agg(F.ceil(F.count("*") / QUERIES_A_GROUP).cast("int").alias("parts"))
    left = (
        asked.join(parts, ["source_id", "page_group"])
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        .join(query_vectors.select("query_id", "source_id", "vector"), ["query_id", "source_id"])
        .select("source_id", "page_group", "part", "query_id", "pages", "vector")
    )
    right = (
        windows.select("source_id", "page_number", "window_idx", "vector", group)
        .join(parts, ["source_id", "page_group"])
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("source_id", "page_group", "part", "page_number", "window_idx", "vector")
    )

    def score(asking: pa.Table, held: pa.Table) -> pa.Table:
        asking, held = asking.combine_chunks(), held.combine_chunks()
        q, w = _matrix(asking["vector"]), _matrix(held["vector"])
        width = max(q.shape[1], w.shape[1])
        q, w = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, w))
        q_size, w_size = (pc.list_value_length(t["vector"]).fill_null(-1).to_numpy(zero_copy_only=False) for t in (asking, held))
        by_page: dict[int, list[int]] = {}
        for i, pages in enumerate(asking["pages"].to_pylist()):
            for page in pages:
                by_page.setdefault(page, []).append(i)
        numbers = held["page_number"].to_numpy()
        order = np.argsort(numbers, kind="stable")
        cuts = np.flatnonzero(np.diff(numbers[order], prepend=numbers[order[:1]] - 1)) if len(order) else order
        best = np.full((asking.num_rows, 2), -np.inf)
        at = np.full((asking.num_rows, 2), -1)
        found: list[tuple[np.ndarray, ...]] = []
        for rows in np.split(order, cuts[1:]):
            mine = np.array(by_page.get(numbers[rows[0]], []) if len(rows) else [], np.int64)
            if not len(mine):
                continue
            # rounded, so that equal windows score alike wherever they stand in a product
            s = np.where(q_size[mine][:, None] == w_size[rows][None, :], (q[mine] @ w[rows].T).round(12), 0.0)
            i, j = np.nonzero(s >= floor)
            found.append((mine[i], rows[j], s[i, j]))
            both = np.concatenate([best[mine], s], axis=1)
            where = np.concatenate([at[mine], np.broadcast_to(rows, s.shape)], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :2]
            best[mine], at[mine] = np.take_along_axis(both, top, 1), np.take_along_axis(where, top, 1)
        i, j = np.nonzero((best > -np.inf) & (best < floor))
        found.append((i, at[i, j], best[i, j]))
        who, what, cosine = (np.concatenate(x) for x in zip(*found, strict=True))
        who, what = pa.array(who, pa.int64()), pa.array(what, pa.int64())
        return pa.table({
            "query_id": asking["query_id"].take(who), "source_id": asking["source_id"].take(who),
            "page_number": held["page_number"].take(what), "window_idx": held["window_idx"].take(what), "cosine": pa.array(cosine),
        })

    kinds = [(candidates, "query_id"), (candidates, "source_id"), (windows, "page_number"), (windows, "window_idx")]
    schema = ", ".join(f"{c} {t.schema[c].dataType.simpleString()}" for t, c in kinds)
    keys = ["source_id", "page_group", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, f"{schema}, cosine double")


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of doubles from a column of lists; shorter and null ones are filled with zeros."""
    sizes = pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = values
    return out


def similarity_margin(scores: DataFrame, keys: list[str], score: str = "cosine") -> DataFrame:
    """Best and second-best score per key, never below zero, and their distance."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score))
    top = scores.select(*keys, score).withColumn("r", F.row_number().over(order)).filter("r <= 2")
    return top.groupBy(*keys).agg(
        F.greatest(F.max(F.when(F.col("r") == 1, F.col(score))), F.lit(0.0)).alias("top"),
        F.greatest(
            F.coalesce(F.max(F.when(F.col("r") == 2, F.col(score))), F.lit(0.0)), F.lit(0.0)
        ).alias("runner_up"),
    ).withColumn("margin", F.col("top") - F.col("runner_up"))


def accept_semantic(scored: DataFrame, margins: DataFrame, queries: DataFrame, model: str) -> DataFrame:
    """Semantic match over scored windows, with floor, anchor and margin gates."""
    floor = cosine_floor(model)
    keys = ["query_id", "source_id"]
    combined = (
        0.55 * F.col("cosine") + 0.2 * F.col("exact")
        + 0.15 * F.col("noun_rate") + 0.1 * F.col("number_hit")
    )
    reason = (
        F.when(F.col("exact") == 1, "Semantic embedding + exact n-gram overlap")
        .when(F.col("noun_rate") > 0, "Semantic embedding + shared entity")
        .when(F.col("number_hit") == 1, "Semantic embedding + shared number/year")
        .otherwise("Semantic embedding + token overlap")
    )
    best = (
        _best_window(
            scored.filter((F.col("cosine") >= floor) & _anchored())
            .withColumn("combined", combined)
            .withColumn("reason", reason),
            "cosine",
        )
        .filter(F.col("b.combined") >= PASSAGE_ACCEPT)
        .join(margins, keys)
        .filter((F.col("margin") >= PASSAGE_MARGIN) | (F.col("b.cosine") >= floor + 0.05))
    )
    return _with_result(queries, best)


def candidate_cosines(
    queries: DataFrame, pages: DataFrame, embed: Embedder, floor: float,
    stored: DataFrame | None = None, e5: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidate pages, their windows, cosine scores), each written once."""
    candidates = materialize(candidate_pages(queries, pages), "candidates")
    used = candidates.select("source_id", "page_number").distinct()
    windows = materialize(source_windows(pages.join(used, ["source_id", "page_number"], "left_semi")), "windows")
    asked = queries.select("query_id", "source_id", P.strip_markers(F.col("context")).alias("q_text"))
    scores = cosine_scores(
        candidates, embed_texts(asked, "q_text", embed, "query", e5), window_vectors(windows, embed, stored, e5), floor
    )
    return candidates, windows, materialize(scores, "cosines")


def match_passages_semantic(
    queries: DataFrame, pages: DataFrame, embed: Embedder, model: str,
    stored: DataFrame | None = None, e5: bool = False,
) -> DataFrame:
    """Semantic match: accepted passage per query, or nulls.

    ``embed`` is the caller's model, ``stored`` holds window vectors of earlier runs. Windows below
    the model's floor are only counted for the margin; the others get their lexical signals.
    """
    floor = cosine_floor(model)
    candidates, windows, scores = candidate_cosines(queries, pages, embed, floor, stored, e5)
    high = scores.filter(F.col("cosine") >= floor)
    keys = ["source_id", "page_number", "window_idx"]
    features = _window_features(windows.join(high.select(*keys).distinct(), keys, "left_semi"))
    signals = _signals(
        high.join(candidates.drop("hits"), ["query_id", "source_id", "page_number"])
        .join(_query_features(queries), ["query_id", "source_id"])
        .join(features, keys),
        "cosine",
    )
    return accept_semantic(signals, similarity_margin(scores, ["query_id", "source_id"]), queries, model)


def passage_summary(results: DataFrame, *by: str) -> DataFrame:
    """Counts per outcome and mean confidence of matches, 2 places, 0 without matches."""
    status = F.col("status")
    return results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "no-match").alias("no_match"),
        F.count_if(status == "no-source").alias("no_source"),
        F.coalesce(
            T.mean2(F.when(status == "matched", F.col("confidence"))), F.lit(0.0)
        ).alias("avg_confidence"),
    )


def passage_batches(matches: DataFrame, sources: DataFrame) -> DataFrame:
    """One batch per usable source of a job with matched keys, numbered from 1.

    Of several usable sources of one reference the lowest id is taken.
    """
    usable = sources.filter("status = 'done'").groupBy("job_id", "reference_id").agg(
        F.min("source_id").alias("source_id")
    )
    counts = (
        matches.filter("match_type <> 'unmatched' AND reference_id IS NOT NULL")
        .join(usable, ["job_id", "reference_id"])
        .groupBy("job_id", "source_id")
        .agg(F.countDistinct("citation_key").alias("citation_count"))
    )
    order = Window.partitionBy("job_id").orderBy("source_id")
    return counts.withColumn("batch_index", F.row_number().over(order))
