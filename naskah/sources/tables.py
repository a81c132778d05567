"""Keyed writes over Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """Insert or update: the row with the highest ``version`` per key, ``delta`` on ties.

    An aggregate rather than a window, so rows combine before they are shuffled.
    """
    rest = [c for c in base.columns if c not in key]
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)))
    return (
        both.groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct("_new", version)).alias("r"))
        .select(*key, "r.*")
    )


def insert_missing(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and the rows of ``delta`` whose keys it lacks."""
    new = delta.join(base.select(*keys).distinct(), keys, "left_anti")
    return base.unionByName(new.select(*base.columns))


def replace_partition(df: DataFrame, path: str, by: str = "job_bucket", replaced: DataFrame | None = None) -> None:
    """Overwrites only the partitions that ``df`` holds; running it twice changes nothing.

    ``replaced`` names (in column ``by``) partitions that are replaced even if ``df`` has no row
    for them: those are removed.
    """
    df.write.mode("overwrite").partitionBy(by).option("partitionOverwriteMode", "dynamic").parquet(path)
    if replaced is None:
        return
    gone = replaced.select(by).distinct().join(df.select(by).distinct(), by, "left_anti")
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for row in gone.toLocalIterator():
        files.delete(jvm.org.apache.hadoop.fs.Path(folder, f"{by}={row[0]}"), True)
