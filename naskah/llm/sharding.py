"""Byte-limited shards by extendible hashing, in DataFrame operations only.

The directory is indexed by the leading bits of a row's hash. A bucket that holds more than
``limit_bytes`` is split on its next bit; one that fits stays, so crowded regions of the hash get
deeper entries than sparse ones. Bits are opened ``STEP`` at a time: one aggregation gives the
sizes of all buckets down to that depth, and only the rows of cells that are still too large take
part in the next one.

Hash: 60 bits of the key's MD5, followed by 60 bits of a row number's MD5. The second half is
reached only by rows that share a key, and stands in for the first where the key is null.

Defined results: empty table: no rows. Null or empty text: 0 bytes, still placed. Repeated keys:
each row is placed by itself; the group is split by row number when it exceeds the limit. A single
row above the limit gets a shard of its own (``shard_rows`` = 1). Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from naskah.session import materialize

HALF = 60
STEP = 6
LIMIT_BYTES = 64 << 20


def _bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, HALF // 4), 16, 10).cast("long")


def _prefix(depth: int) -> list[Column]:
    """The first ``depth`` bits as two columns."""
    if depth <= HALF:
        return [F.shiftright("h", HALF - depth).alias("p1"), F.lit(0).cast("long").alias("p2")]
    return [F.col("h").alias("p1"), F.shiftright("t", 2 * HALF - depth).alias("p2")]


def _bit_string(value: Column, width: Column) -> Column:
    return F.when(width > 0, F.lpad(F.bin(value), width, "0")).otherwise("")


def _open(cells: DataFrame, base: int, limit: int) -> DataFrame:
    """Leaf depth of every cell of depth base + STEP, null where none of its buckets fits.

    A window partition has at most 2**STEP rows.
    """
    depth = base + STEP
    bucket = Window.partitionBy("d", "b1", "b2")
    low = F.col("p2") if depth > HALF else F.col("p1")
    cut = F.expr(f"shiftright({'p2' if depth > HALF else 'p1'}, {depth} - d)")
    opened = (
        cells.withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(depth))))
        .withColumn("b1", F.col("p1") if depth > HALF else cut)
        .withColumn("b2", cut if depth > HALF else low * 0)
        .withColumn("shard_bytes", F.sum("bytes").over(bucket))
        .withColumn("shard_rows", F.sum("rows").over(bucket))
    )
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("d") == 2 * HALF)
    leaf = F.min(F.when(fits, F.struct("d", "b1", "b2", "shard_bytes", "shard_rows")))
    return opened.groupBy("p1", "p2").agg(leaf.alias("leaf"))


def assign_shards(
    df: DataFrame, key: str = "doc_id", text: str = "text", limit_bytes: int = LIMIT_BYTES
) -> DataFrame:
    """One row per row of ``df``: key, n_bytes, shard_id (bit string), depth, shard_bytes, shard_rows."""
    number = F.monotonically_increasing_id().cast("string")
    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
        _bits(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), number))).alias("h"),
        _bits(number).alias("t"),
    )
    rows = materialize(rows, "shard-rows")  # row numbers must not change between passes
    placed, left, base = [], rows, 0
    while True:
        sizes = left.select("bytes", *_prefix(base + STEP)).groupBy("p1", "p2")
        cells = sizes.agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        directory = materialize(_open(cells, base, limit_bytes), "shard-directory")
        base += STEP
        at = [*_prefix(base)]
        leaves = directory.where("leaf IS NOT NULL")
        placed.append(left.withColumns({"p1": at[0], "p2": at[1]}).join(leaves, ["p1", "p2"]))
        large = directory.where("leaf IS NULL")
        if base == 2 * HALF or large.isEmpty():
            break
        left = left.withColumns({"p1": at[0], "p2": at[1]}).join(large.select("p1", "p2"), ["p1", "p2"], "left_semi").select(rows.columns)
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    d = F.col("leaf.d")
    first = _bit_string(F.col("leaf.b1"), F.least(d, F.lit(HALF)))
    second = F.when(d > HALF, _bit_string(F.col("leaf.b2"), d - HALF)).otherwise("")
    return out.select(
        F.col("key").alias(key), F.col("bytes").alias("n_bytes"),
        F.concat(first, second).alias("shard_id"), d.cast("int").alias("depth"),
        F.col("leaf.shard_bytes").alias("shard_bytes"), F.col("leaf.shard_rows").alias("shard_rows"),
    )


def write_shards(df: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``df`` (unique keys) as one Parquet folder per shard."""
    placed = assigned.select(F.col(key).alias("_key"), F.col("shard_id").alias("shard"))
    out = df.join(placed, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle_sql(limit_bytes: int = LIMIT_BYTES) -> str:
    return f"""
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, {HALF // 4}))::BIGINT AS h FROM documents),
l AS (SELECT r.*, d::INTEGER AS depth, h >> ({HALF} - d) AS p FROM r, range(0, 33) x(d)),
s AS (SELECT depth, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM l GROUP BY ALL),
f AS (SELECT l.doc_id, l.n_bytes, min(l.depth) AS depth FROM l JOIN s USING (depth, p)
      WHERE shard_bytes <= {limit_bytes} OR shard_rows = 1 GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth, '0') END AS shard_id,
       depth, shard_bytes, shard_rows
FROM f JOIN l USING (doc_id, n_bytes, depth) JOIN s USING (depth, p)"""
