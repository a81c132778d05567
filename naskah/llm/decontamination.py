"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``ITEM_WORDS`` words. Their TF-IDF matrix (inverse
document frequencies from all documents) gets a randomised SVD: tasks multiply their rows of the
matrix with a random, then twice with an orthonormalised sketch, and only the sums of the sketch's
size travel. Every document is projected window by window, ``CELL`` words apart, and compared with
all passages by cosine in the latent space; a window must also hold a share of the passage's
weight. Candidates are verified by the longest common
subsequence of words with the neighbourhood of the window: a passage that is there in large part
is a leak, a smaller part (a paraphrase) is one if the passage's last sentence, its answer, is
there in order as well.

Letters are lower-cased. Words are hashed into ``FEATURES`` columns, so the projection has a fixed size. All benchmark
words have weight. Words that at most ``COMMON`` of the documents contain weigh alike, so that the
words that a paraphrase replaces never outweigh those it keeps by far. An occurrence near which
other words of an item stand as they do there is not counted as a document's: a leak in a large
part of the documents does not make its own words common. Items come to the driver in blocks of ``BLOCK_ITEMS``; each block is one
pass over the documents.

Defined results: null or empty documents and items without words match nothing. Repeated documents
give repeated rows, repeated items a row each. Long items are matched passage by passage, and the
best passage counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from naskah.llm import text as T

RANK = 128
OVERSAMPLE = 16
FEATURES = 1 << 14
CELL = 16  # a window is two cells
ITEM_WORDS = 64
BLOCK_ITEMS = 20_000
COMMON = 0.02
REACH = 4  # words on either side that tell an occurrence inside an item
TOLD = 2  # of them
COSINE = 0.4
COVER = 0.2
LEAK = 0.7
PARAPHRASE = 0.5
ANSWER = 0.8
SEED = 5
_U64 = np.uint64


class Passages(NamedTuple):
    """Passages of one block of items."""

    words: list[np.ndarray]
    answers: list[np.ndarray]
    item: np.ndarray  # position of the passage's item
    vocabulary: np.ndarray  # sorted word hashes


class Index(NamedTuple):
    passages: Passages
    weights: np.ndarray  # per vocabulary word
    basis: np.ndarray  # FEATURES x rank
    queries: np.ndarray  # passages x rank, unit rows
    norms: np.ndarray  # of the passages before that


def passages(texts: list[str | None]) -> Passages:
    words, answers, item = [], [], []
    for i, text in enumerate(texts):
        block = next(T.blocks(pc.utf8_lower(pa.array([text or ""]))))
        w = T.words(block)
        n = len(w.hashes)
        if not n:
            continue
        low = block.data
        stops = [k for k in range(n - 1) if low[w.ends[k] - 1] in b".!?"]
        answer = w.hashes[stops[-1] + 1 :] if stops else w.hashes[n - max(1, n // 4) :]
        count = max(1, round(n / ITEM_WORDS + 0.49))
        for part in np.array_split(w.hashes, count):
            words.append(part)
            answers.append(answer)
            item.append(i)
    every = np.unique(np.concatenate(words)) if words else np.zeros(0, _U64)
    return Passages(words, answers, np.array(item, np.int64), every)


def _find(vocabulary: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
    return at, vocabulary[at] == x


def neighbours(p: Passages) -> np.ndarray:
    """Sorted pairs of vocabulary words at most REACH apart in a passage."""
    size = len(p.vocabulary)
    pairs = [np.array([-1])]
    for w in p.words:
        at = _find(p.vocabulary, w)[0]
        pairs += [at[:-k] * size + at[k:] for k in range(1, REACH + 1)]
    return np.unique(np.concatenate(pairs))


def document_frequency(docs: DataFrame, p: Passages, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each vocabulary word outside items, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast((p.vocabulary, neighbours(p)))
    size = len(p.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs = shared.value
        total, n = np.zeros(size, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for b in T.blocks(pc.utf8_lower(batch.column(0))):
                w = T.words(b)
                at, hit = _find(vocabulary, w.hashes)
                rows = T.row_of(w.first)
                told = np.zeros(len(at), np.int8)
                for k in range(1, REACH + 1):
                    near = np.flatnonzero(hit[:-k] & hit[k:] & (rows[:-k] == rows[k:]))
                    near = near[_find(pairs, at[near] * size + at[near + k])[1]]
                    told[near] += 1
                    told[near + k] += 1
                free = hit & (told < TOLD)
                pair = np.unique(rows[free] * size + at[free])
                total += np.bincount(pair % size, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *used], pa.int64()), pa.array([n, *total[used]], pa.int64())], names=["word", "n"]
        )

    out = np.zeros(size, np.int64)
    n = 0
    for r in docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["word"] < 0:
            n = r["n"]
        else:
            out[r["word"]] = r["n"]
    return out, n


def _rows(words: list[np.ndarray], vocabulary: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of the unit-length TF-IDF rows."""
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    at, hit = _find(vocabulary, np.concatenate(words)) if words else (np.zeros(0, np.int64), np.zeros(0, bool))
    row, at = row[hit], at[hit]
    value = weights[at]
    cell, place = np.unique(row * FEATURES + (vocabulary[at] % _U64(FEATURES)).astype(np.int64), return_inverse=True)
    total = np.bincount(place, value, len(cell))
    norm = np.sqrt(np.bincount(cell // FEATURES, total**2, len(words)))
    norm[norm == 0] = 1
    return cell // FEATURES, cell % FEATURES, total / norm[cell // FEATURES]


def randomised_svd(spark, p: Passages, weights: np.ndarray, rank: int = RANK) -> np.ndarray:
    """FEATURES x rank basis of right singular vectors of the passages' TF-IDF matrix."""
    width = min(rank, len(p.words)) + OVERSAMPLE
    sketch = np.random.default_rng(SEED).standard_normal((FEATURES, width)).astype(np.float32)
    context = spark.sparkContext
    table = spark.createDataFrame(
        [(int(i), w.tobytes()) for i, w in enumerate(p.words)], "passage long, words binary"
    ).repartition(max(1, min(64, len(p.words) // 500)))

    def multiply(q: np.ndarray) -> np.ndarray:
        """A'A q; a task returns the rows of its own features only."""
        shared = context.broadcast((p.vocabulary, weights, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, w, q = shared.value
            for batch in batches:
                words = [np.frombuffer(x.as_buffer(), _U64) for x in batch.column(1)]
                row, feature, value = _rows(words, vocabulary, w)
                y = np.zeros((len(words), q.shape[1]), np.float32)
                np.add.at(y, row, value[:, None].astype(np.float32) * q[feature])
                used, place = np.unique(feature, return_inverse=True)
                z = np.zeros((len(used), q.shape[1]), np.float32)
                np.add.at(z, place, value[:, None].astype(np.float32) * y[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int64()), pa.array([x.tobytes() for x in z], pa.binary())], names=["feature", "part"]
                )

        out = np.zeros_like(q)
        for r in table.mapInArrow(run, "feature long, part binary").toLocalIterator():
            out[r["feature"]] += np.frombuffer(r["part"], np.float32)
        shared.unpersist()
        return out

    for _ in range(3):
        sketch = np.linalg.qr(multiply(sketch))[0].astype(np.float32)
    small = sketch.T @ multiply(sketch)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[: width - OVERSAMPLE]
    return np.ascontiguousarray(sketch @ vectors[:, order].astype(np.float32))


def build_index(docs: DataFrame, texts: list[str | None], text: str = "text") -> Index | None:
    p = passages(texts)
    if not p.words:
        return None
    frequency, n = document_frequency(docs, p, text)
    weights = np.minimum(np.log((n + 1) / (frequency + 1)), -np.log(COMMON)) + 0.01
    basis = randomised_svd(docs.sparkSession, p, weights)
    row, feature, value = _rows(p.words, p.vocabulary, weights)
    queries = np.zeros((len(p.words), basis.shape[1]), np.float32)
    np.add.at(queries, row, value[:, None].astype(np.float32) * basis[feature])
    norms = np.maximum(np.linalg.norm(queries, axis=1), 1e-12)
    queries /= norms[:, None]
    lengths = np.array([np.linalg.norm(np.bincount(at, minlength=len(weights)) * weights) for at in
                        (_find(p.vocabulary, w)[0] for w in p.words)])
    return Index(p, weights.astype(np.float32), basis, queries, (norms * lengths).astype(np.float32))


def common_subsequence(masks: dict[int, int], n: int, region: np.ndarray) -> int:
    """Length of the longest common subsequence of a passage (bit masks of its words) and a region."""
    full = (1 << n) - 1
    row = full
    for w in region.tolist():
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


def candidates(w: T.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word of the window, passage, cosine) at or above COSINE and COVER."""
    at, hit = _find(index.passages.vocabulary, w.hashes)
    place = np.flatnonzero(hit)
    none = np.zeros(0, np.int64)
    if not len(place):
        return none, none, none, np.zeros(0)
    at, rows = at[hit], T.row_of(w.first)[hit]
    cell = (place - w.first[rows]) // CELL
    code = rows << 32 | cell
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    feature = (index.passages.vocabulary[at] % _U64(FEATURES)).astype(np.int64)
    codes = code[starts]
    least = float(index.norms.min())
    found = []
    step = 4096  # cells at a time
    for lo in range(0, len(starts), step):
        hi = min(len(starts), lo + step + 1)  # one cell more: the second half of the last window
        s, e = starts[lo], starts[hi] if hi < len(starts) else len(code)
        sums = np.add.reduceat(index.basis[feature[s:e]] * index.weights[at[s:e], None], starts[lo:hi] - s, axis=0)
        own = codes[lo:hi]
        follows = np.zeros(len(own), bool)
        follows[:-1] = own[1:] == own[:-1] + 1
        window = sums.copy()
        window[follows] += sums[np.flatnonzero(follows) + 1]
        # a cell whose predecessor is empty starts a window too, the one before it
        norm = np.sqrt(np.einsum("ij,ij->i", window, window))
        take = len(own) if hi == len(starts) else step
        heavy = np.flatnonzero(norm[:take] >= COVER * least)
        score = (window[heavy] / norm[heavy, None]) @ index.queries.T
        i, q = np.nonzero(score >= COSINE)
        cosine = score[i, q]
        i = heavy[i]
        good = cosine * norm[i] >= COVER * index.norms[q]
        found.append((own[i[good]], q[good], cosine[good]))
    own, q, score = (np.concatenate(x) for x in zip(*found))
    return own >> 32, (own & 0xFFFFFFFF) * CELL, q, score


def find_leaks(docs: DataFrame, index: Index, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, item (position), word, cosine, lcs, answer, leak: best candidate per document and item."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        p = ix.passages
        masks: dict[int, dict[int, int]] = {}
        for batch in batches:
            keys, out = [], []
            base = 0
            for b in T.blocks(pc.utf8_lower(batch.column(1))):
                w = T.words(b)
                best: dict[tuple[int, int], tuple] = {}
                for row, at, q, cosine in zip(*(x.tolist() for x in candidates(w, ix))):
                    words, answer = p.words[q], p.answers[q]
                    n = len(words)
                    if q not in masks:
                        masks[q] = _masks(words)
                    lo, hi = w.first[row], w.first[row + 1]
                    reach = n
                    s, e = max(lo, lo + at - reach), min(hi, lo + at + 2 * CELL + reach)
                    ratio = common_subsequence(masks[q], n, w.hashes[s:e]) / n
                    if ratio < PARAPHRASE:
                        continue
                    m = min(len(answer), 4096)
                    told = common_subsequence(_masks(answer[:m]), m, w.hashes[s : min(hi, e + m)]) / m
                    leak = ratio >= LEAK or told >= ANSWER
                    item = int(p.item[q])
                    new = (int(leak), ratio, cosine, told, int(s - lo))
                    if (row, item) not in best or new > best[row, item]:
                        best[row, item] = new
                for (row, item), (leak, ratio, cosine, told, start) in best.items():
                    keys.append(base + row)
                    out.append((item, start, cosine, ratio, told, leak))
                base += len(b.starts)
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[key, "item", "word", "cosine", "lcs", "answer", "leak"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, item long, word long, cosine double, lcs double, answer double, leak int"
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """key, item key, word, cosine, lcs, answer: benchmark items found in documents."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_key).alias("id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    kind = benchmark.schema[item_key].dataType.simpleString()
    doc_kind = docs.schema[key].dataType.simpleString()
    out = None
    for i in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == i)
        rows = block.collect()  # about BLOCK_ITEMS
        index = build_index(docs, [r["text"] for r in rows], text) if rows else None
        if index is None:
            continue
        names = spark.createDataFrame([(n, r["id"]) for n, r in enumerate(rows)], f"item long, id {kind}")
        found = find_leaks(docs, index, key, text).where("leak = 1").join(F.broadcast(names), "item")
        found = found.select(key, F.col("id").alias(item_key), "word", "cosine", "lcs", "answer")
        out = found if out is None else out.unionAll(found)
    if out is None:
        out = spark.createDataFrame([], f"`{key}` {doc_kind}, `{item_key}` {kind}, word long, cosine double, lcs double, answer double")
    return out
