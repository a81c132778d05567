"""Vector helpers and the embedder slot."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def _sum_products(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 when the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum_products(a, b)).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when the lengths differ or a vector is zero."""
    norms = _sum_products(a, a) * _sum_products(b, b)
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(
        _sum_products(a, b) / F.sqrt(norms)
    )


@F.pandas_udf(ArrayType(FloatType()))
def decode_f32(raw: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array."""
    return raw.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))


@F.pandas_udf(BinaryType())
def encode_f32(vector: pd.Series) -> pd.Series:
    """Array to little-endian float32 bytes."""
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


Embedder = Callable[[Sequence[str]], np.ndarray]


def embed_texts(
    df: DataFrame, text: str, embed: Embedder | None, role: str = "passage", e5: bool = False
) -> DataFrame:
    """Adds ``vector``: unit vectors from a caller's model, in Arrow batches.

    Without a model the vector is null and the lexical path applies. ``role`` is
    ``query`` or ``passage``; e5 models get it as a prefix.
    """
    if embed is None:
        return df.withColumn("vector", F.lit(None).cast("array<float>"))
    prefix = f"{role}: " if e5 else ""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors = np.asarray(embed([prefix + t for t in texts]), dtype=float)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield pd.Series(list((vectors / np.where(norms == 0, 1, norms)).astype(np.float32)))

    return df.withColumn("vector", run(F.col(text)))
