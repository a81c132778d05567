"""Quality score from compression with class dictionaries.

Text compresses better with a zstandard dictionary of its own kind. Two raw-content dictionaries
are cut from texts labelled good and bad. A text is compressed with either and with none; the
difference of the two sizes, normalised by length and by its square root, is turned into a
probability by a logistic curve, which also sees the plain compression ratio and the length (a
text of one repeated word compresses alike with any dictionary). Dictionary texts and the rows the
curve is fitted on are different documents.

Bounded sample (documented limit): at most ``rows`` labelled documents per class for the
dictionaries and as many for the curve, the ones with the smallest hash of their key. Everything
else covers all rows.

Defined results: null text counts as empty. Empty text has size difference 0 and ratio 0 and gets
the curve's value there. Without labels of both classes the score is the share of good labels
(0.5 if there are none). Labels that are null or neither 0 nor 1 are skipped. Repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICTIONARY_BYTES = 1_000_000
LEVEL = 3
ROWS = 2000
THRESHOLD = 0.3
_SIZES = "bad_size long, good_size long, plain_size long, n_bytes long"


class Model(NamedTuple):
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # intercept first
    constant: float | None = None


def remainder(key: Column, modulus: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % modulus


class _Compressors:
    def __init__(self, model: Model) -> None:
        def make(content: bytes) -> zstandard.ZstdCompressor:
            if not content:
                return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False)

        self.all = [make(model.bad), make(model.good), make(b"")]
        self.frame = [len(c.compress(b"")) for c in self.all]

    def sizes(self, text: bytes) -> list[int]:
        return [*(max(0, len(c.compress(text)) - f) for c, f in zip(self.all, self.frame)), len(text)]


_kept: dict[tuple[int, int], _Compressors] = {}


def _compressors(model: Model) -> _Compressors:
    key = (hash(model.good), hash(model.bad))
    if key not in _kept:
        _kept.clear()
        _kept[key] = _Compressors(model)
    return _kept[key]


def features(sizes: np.ndarray) -> np.ndarray:
    """Curve inputs from rows of (bad, good, plain, length) sizes."""
    bad, good, plain, n = sizes.astype(float).T
    n = np.maximum(n, 1)
    return np.stack([(bad - good) / np.sqrt(n), (bad - good) / n, np.log(plain / n + 0.01), np.log(n)], axis=1)


def _measure(df: DataFrame, model: Model, kept: list[str], text: str) -> DataFrame:
    """``kept`` columns and the compressed sizes of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _compressors(shared.value)
        for batch in batches:
            texts = batch.column(len(kept)).cast(pa.binary())
            rows = [c.sizes(x.as_buffer() or b"") if x.is_valid else [0, 0, 0, 0] for x in texts]
            sizes = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *(pa.array(x) for x in sizes.T)],
                names=[*kept, "bad_size", "good_size", "plain_size", "n_bytes"],
            )

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in kept)
    return df.select(*kept, F.col(text).alias("_measured")).mapInArrow(run, f"{schema}, {_SIZES}")


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regularised logistic regression by Newton steps on a bounded sample."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), a.T @ (p - y) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    rows: int = ROWS, size: int = DICTIONARY_BYTES,
) -> Model:
    """Fit on the labelled rows given (the caller leaves held-out rows out)."""
    none = np.zeros(4)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"),
        F.xxhash64(F.col(key).cast("string")).alias("_order"),
    ).withColumn("_side", F.pmod("_order", F.lit(2)).cast("int"))
    counts = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = 0.5 if not counts else float(1 in counts)
        return Model(b"", b"", none, none + 1, np.zeros(5), share)
    picked = None
    for c in (0, 1):
        for side in (0, 1):
            part = known.where((F.col("_label") == c) & (F.col("_side") == side)).orderBy("_order", "_key").limit(rows)
            picked = part if picked is None else picked.unionAll(part)
    # at most 4 * rows keys
    sample = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
    sample = sample.where(F.length("_text") > 0)
    pieces = [max(64, size // max(1, min(rows, counts[c] // 2))) for c in (0, 1)]
    piece = F.when(F.col("_label") == 1, pieces[1]).otherwise(pieces[0])
    middle = F.greatest(F.lit(1), ((F.length("_text") - piece) / 2).cast("int"))
    parts = sample.where("_side = 0").select("_label", "_order", F.substring("_text", middle, piece).alias("part"))
    content = {0: b"", 1: b""}
    for r in sorted(parts.collect(), key=lambda r: (r["_order"], r["part"])):
        content[r["_label"]] += r["part"].encode()
    model = Model(content[1][:size], content[0][:size], none, none + 1, np.zeros(5))
    got = _measure(sample.where("_side = 1"), model, ["_label"], "_text").toPandas()
    if got["_label"].nunique() < 2:
        return model._replace(constant=counts[1] / (counts[0] + counts[1]))
    sizes = got[["bad_size", "good_size", "plain_size", "n_bytes"]].to_numpy()
    mean, scale, weights = _fit_curve(features(sizes), got["_label"].to_numpy(float))
    return model._replace(mean=mean, scale=scale, weights=weights)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, and the sizes it comes from."""
    sizes = _measure(docs, model, [key], text)
    if model.constant is not None:
        return sizes.withColumn("score", F.lit(model.constant))
    bad, good, plain = F.col("bad_size"), F.col("good_size"), F.col("plain_size")
    n = F.greatest(F.col("n_bytes"), F.lit(1))
    x = [(bad - good) / F.sqrt(n), (bad - good) / n, F.log(plain / n + 0.01), F.log(n.cast("double"))]
    z = F.lit(float(model.weights[0]))
    for value, mean, scale, w in zip(x, model.mean, model.scale, model.weights[1:]):
        z = z + (value - float(mean)) / float(scale) * float(w)
    return sizes.withColumn("score", 1 / (1 + F.exp(-z)))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns. All labels are learnt from."""
    model = train(docs, labels, key, text, label)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    return score(rows, model, "row").where(F.col("score") >= THRESHOLD).select("row.*")


def classify(
    docs: DataFrame, labels: DataFrame, held_out: int = 5, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """key, held_out, score, predicted, sizes; labels with crc32(key) mod ``held_out`` = 0 are not learnt from."""
    fold = remainder(F.col(key), held_out)
    model = train(docs, labels.where(fold != 0), key, text, label)
    return score(docs, model, key, text).select(
        key, F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "bad_size", "good_size", "plain_size", "n_bytes",
    )
