"""Corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, token ids.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. Rows are told apart by key and text, so null and repeated keys
are allowed; equal rows are copies of each other and leave one. Empty tables go through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from naskah.llm import bpe, decontamination, jaccard, quality, secrets
from naskah.session import materialize

BROADCAST_ROWS = 1_000_000
ORACLE_SQL = None  # models, tokenisation and retrieval have no SQL form; stages are tested one by one


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of keyed ``docs`` whose key is not in ``dropped``."""
    dropped = materialize(dropped.select("_key.doc_id", "_key.h").distinct(), "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    same = (docs["_key.h"] == dropped["h"]) & docs["_key.doc_id"].eqNullSafe(dropped["doc_id"])
    return docs.join(dropped, same, "left_anti")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest key."""
    keyed = _keyed(docs)
    members = materialize(jaccard.join(keyed, "_key", "text"), "near-duplicates")
    rest = _without(keyed, members.where(F.col("_key") != F.col("component_id")))
    repeated = materialize(members.groupBy("_key").count().where("count > 1").select("_key"), "repeated")
    if repeated.isEmpty():
        return rest.select(docs.columns)
    again = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    once = rest.join(again, "_key", "left_anti")
    return once.unionByName(rest.join(again, "_key", "left_semi").dropDuplicates(["_key"])).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    keyed = _keyed(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(keyed, decontamination.leaks(keyed, benchmark, "_key", "text")).select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars follows the text."""
    clean = secrets.redact(docs, secrets.train(docs))
    if "n_chars" not in docs.columns:
        return clean
    changed = F.length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), changed))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and whether they decode to the text."""
    import public_tokenizers

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"))
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_decode(rows, vocabulary, public_tokenizers.PATTERN, "row")
    text = F.coalesce(F.col("row.text"), F.lit("")).cast("binary")
    return out.select(
        "row.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", (F.col("decoded") == text).alias("round_trip")
    ).drop("text")


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
