"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from naskah.llm import bpe, decontamination, embedding, html_text, jaccard, lm, quality, rules, secrets, sharding, substrings, variants, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from all documents because a 400-byte string around them occurs again."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of all documents, learnt from six of seven folds."""
    return lm.score_held_out(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in any document."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all documents, as digests."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, vocabulary, public_tokenizers.PATTERN))


@query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents: candidates that the forest keeps, with its score."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs)).where("is_secret = 1")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document, at most 64 MiB of text each."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


ORACLES["op10_sharding"] = sharding.oracle_sql()


@query
def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of the rule cascade on all documents."""
    return rules.quality_rules(table(spark, sf_dir, "documents"))


ORACLES["op11_rules"] = rules.oracle_sql()


@query
def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their most frequent near word and the root of its chain."""
    return variants.group_variants(table(spark, sf_dir, "documents"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the eight strongest components, whitened."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
