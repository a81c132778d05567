"""BM25 over a corpus table ``doc_id, text`` and a query table ``query_id, text``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from naskah.constants import BM25_B, BM25_K1
from naskah.functions.passages import bm25_tokens
from naskah.session import materialize

SHARD_POSTINGS = 2_000_000
LEAST_SHARD = 50_000
BLOCK_DOCS = 64
QUERY_BLOCK = 2_000
WANTED_TERMS = 1_000_000
_SLACK = 1e-9


def postings(docs: DataFrame) -> DataFrame:
    """``doc_id, term, tf, doc_len``. A document is one row, so its counts combine map-side."""
    tokens = docs.select("doc_id", bm25_tokens(F.col("text")).alias("tokens"))
    return (
        tokens.select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    )


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: number of documents and mean length (empty documents count)."""
    return docs.select(F.size(bm25_tokens(F.col("text"))).alias("len")).agg(
        F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")
    )


def idf(n_docs, df):
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_index(docs: DataFrame) -> DataFrame:
    """Document frequency and idf per term."""
    n_docs = docs.agg(F.count("*")).scalar()
    terms = docs.select(F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    return (
        terms.groupBy("term")
        .agg(F.count("*").alias("df"))
        .select("term", "df", idf(n_docs, F.col("df")).alias("idf"))
    )


def bm25_rank(docs: DataFrame, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """Scores of every (query, document) pair that shares a term, or the ``top_k`` per query.

    Without ``top_k`` the output is as large as all pairs that share a term. Ties go to the
    lower document id.

    Postings are cut to the query terms before they are counted or shuffled.
    A term repeated in the query counts each time.
    """
    q = (
        queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )
    # One scalar subquery holds both numbers, so the corpus is measured once.
    size = corpus_size(docs).select(F.struct("n_docs", "avg_len")).scalar()
    n_docs, avg_len = size["n_docs"], size["avg_len"]
    tokens = docs.select("doc_id", bm25_tokens(F.col("text")).alias("tokens"))
    hits = (
        tokens.select("doc_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
        .join(q.select("term").distinct(), "term", "left_semi")
        .groupBy("doc_id", "term")
        .agg(F.count("*").alias("tf"), F.first("doc_len").alias("doc_len"))
    )
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    weights = q.join(df, "term").select(
        "query_id", "term", (F.col("qtf") * idf(n_docs, F.col("df"))).alias("w")
    )
    tf = F.col("tf") * (BM25_K1 + 1) / (
        F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / avg_len)
    )
    scores = (
        hits.select("doc_id", "term", tf.alias("s"))
        .join(weights, "term")
        .groupBy("query_id", "doc_id")
        .agg(F.sum(F.col("w") * F.col("s")).alias("score"))
        .filter(F.col("score") > 0)
    )
    if top_k is None:
        return scores
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).drop("rank")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one after the other."""
    sizes = ends - starts
    to = np.cumsum(sizes)
    return np.arange(to[-1] if len(to) else 0) + np.repeat(starts - (to - sizes), sizes)


def document_terms(docs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``doc_id, doc_len, terms, tfs``: each document's distinct terms with counts, in its own row.

    ``wanted`` (one column of distinct terms) leaves out all others while it has at most
    ``WANTED_TERMS`` rows; with more, all terms are kept and later joins choose.
    """
    only = None
    if wanted is not None and wanted.count() <= WANTED_TERMS:
        only = pa.array([r[0] for r in wanted.collect()], pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            words = tokens.flatten().cast(pa.string()).dictionary_encode()
            sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            rows, codes = np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy()
            if only is not None:
                keep = pc.is_in(words.dictionary, only).to_numpy(zero_copy_only=False)[codes]
                rows, codes = rows[keep], codes[keep]
            keys, tfs = np.unique(rows * max(len(words.dictionary), 1) + codes, return_counts=True)
            rows, codes = np.divmod(keys, max(len(words.dictionary), 1))
            cuts = pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)), pa.int32())
            terms = words.dictionary.take(pa.array(codes))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(cuts, terms), pa.ListArray.from_arrays(cuts, pa.array(tfs))
            ], ["doc_id", "doc_len", "terms", "tfs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", bm25_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    return tokens.mapInArrow(count, f"doc_id {kind}, doc_len long, terms array<string>, tfs array<long>")


class Shard:
    """Postings of some documents, by term and block of ``BLOCK_DOCS`` documents.

    Documents are numbered by length, so that a block's impacts are alike. A run is the part of a
    term's postings in one block; its largest impact bounds what the term gives any document there.
    """

    def __init__(self, lengths: np.ndarray, rows: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int, avg_len: float):
        self.by_length = np.argsort(lengths, kind="stable")
        number = np.empty(len(lengths), np.int64)
        number[self.by_length] = np.arange(len(lengths))
        docs = number[rows]
        order = np.lexsort((docs, terms))
        self.docs, terms, tfs = docs[order], terms[order], tfs[order]
        norm = BM25_K1 * (1 - BM25_B + BM25_B * lengths[self.by_length] / avg_len)
        self.impacts = tfs * (BM25_K1 + 1) / (tfs + norm[self.docs])
        self.n_blocks = -(-len(lengths) // BLOCK_DOCS)
        run = terms * self.n_blocks + self.docs // BLOCK_DOCS
        new = np.flatnonzero(np.diff(run, prepend=-1))
        self.run_start, self.run_end = new, np.append(new[1:], len(run))
        self.run_block = run[new] % self.n_blocks
        self.run_max = np.maximum.reduceat(self.impacts, new) if len(new) else np.zeros(0)
        self.first_run = np.searchsorted(run[new] // self.n_blocks, np.arange(n_terms + 1))
        self.scored = 0  # postings read, for tests of the pruning

    def _scores(self, runs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of all documents from ``runs``; a document adds up its terms in the order given."""
        at = _ranges(self.run_start[runs], self.run_end[runs])
        self.scored += len(at)
        weights = np.repeat(weights, self.run_end[runs] - self.run_start[runs])
        return np.bincount(self.docs[at], weights * self.impacts[at], minlength=len(self.by_length))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the ``k`` best documents with a positive score; ties go to the lower name.

        Blocks are scored by falling bound, in growing batches; the k-th score so far rules out
        every block whose bound is lower.
        """
        runs = _ranges(self.first_run[terms], self.first_run[terms + 1])
        weights = np.repeat(weights, self.first_run[terms + 1] - self.first_run[terms])
        bounds = np.bincount(self.run_block[runs], weights * self.run_max[runs], minlength=self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        scores, least, at, size = np.zeros(len(self.by_length)), 0.0, 0, 1 + -(-k // BLOCK_DOCS)
        while at < self.n_blocks and bounds[order[at]] >= max(least - _SLACK, _SLACK):
            batch = np.zeros(self.n_blocks, bool)
            batch[order[at : at + size]] = True
            batch &= bounds >= least - _SLACK
            mine = batch[self.run_block[runs]]
            scores += self._scores(runs[mine], weights[mine])
            if len(scores) >= k:
                least = np.partition(scores, -k)[-k]
            at, size = at + size, 2 * size
        if len(scores) > k:
            some = np.flatnonzero((scores >= np.partition(scores, -k)[-k]) & (scores > 0))
        else:
            some = np.flatnonzero(scores > 0)
        some = some[np.lexsort((names[self.by_length[some]], -scores[some]))][:k]
        return self.by_length[some], scores[some]


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, score, rank``: the ``k`` best documents of every query, ties to the lower id.

    The corpus is tokenised once; its terms are stored per document. Documents are dealt by hash
    over shards of about ``SHARD_POSTINGS`` postings, each of which answers all queries, in blocks
    of ``QUERY_BLOCK``, with at most ``k`` rows a query: the output and the last shuffle grow with
    queries and shards, not with pairs. A null text is an empty document; repeated ids are documents
    of their own. A term repeated in the query counts each time.
    """
    spark = docs.sparkSession
    q = materialize(
        queries.select("query_id", F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf")),
        "query-terms",
    )
    stored = materialize(document_terms(docs, q.select("term").distinct()), "postings")
    size = stored.agg(F.count("*").alias("docs"), F.avg("doc_len").alias("avg_len"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    df = stored.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = (
        q.join(df, "term").select("query_id", F.struct("term", (F.col("qtf") * idf(size["docs"], F.col("df"))).alias("w")).alias("t"))
        .groupBy("query_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
        .select("query_id", F.col("ts.term").alias("terms"), F.col("ts.w").alias("weights"))
    )
    weighed = materialize(weighed, "query-weights")
    fine = min(spark.sparkContext.defaultParallelism, -(-size["postings"] // LEAST_SHARD))
    shards = max(1, -(-size["postings"] // SHARD_POSTINGS), fine)
    blocks = max(1, -(-weighed.count() // QUERY_BLOCK))
    avg_len = size["avg_len"] or 1.0

    def answer(postings: pa.Table, asked: pa.Table) -> pa.Table:
        postings, asked = postings.combine_chunks(), asked.combine_chunks()
        sizes = pc.list_value_length(postings["terms"]).to_numpy().astype(np.int64)
        words = postings["terms"].combine_chunks().flatten().dictionary_encode()
        ids = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
        shard = Shard(
            postings["doc_len"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes), words.indices.to_numpy().astype(np.int64),
            postings["tfs"].combine_chunks().flatten().to_numpy(), len(ids), avg_len,
        )
        names = pc.rank(postings["doc_id"].combine_chunks(), tiebreaker="dense").to_numpy()
        found = []
        for i, (terms, weights) in enumerate(zip(asked["terms"].to_pylist(), asked["weights"].to_pylist(), strict=True)):
            here = [(ids[t], w) for t, w in zip(terms, weights, strict=True) if t in ids]
            if here:
                rows, scores = shard.best(np.array([t for t, _ in here]), np.array([w for _, w in here]), k, names)
                found.append((np.full(len(rows), i), rows, scores))
        who, rows, scores = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({"query_id": asked["query_id"].take(pa.array(who)), "doc_id": postings["doc_id"].take(pa.array(rows)), "score": pa.array(scores)})

    left = stored.where(F.size("terms") > 0).select(
        "*", F.pmod(F.xxhash64("doc_id", "doc_len"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    )
    right = weighed.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )
    kinds = [f"{c} {t.schema[c].dataType.simpleString()}" for t, c in ((queries, "query_id"), (docs, "doc_id"))]
    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(answer, ", ".join([*kinds, "score double"]))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
