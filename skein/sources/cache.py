"""Library archives read once: their extracted rows in one partition for each archive.

A partition is replaced when its archive changes, and nothing else is written;
archives that are gone are passed over by the join with the listing, which also
prunes the partitions that are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.session import cut
from skein.sources.archives import entries_in
from skein.sources.code import ARCHIVE_PATTERN, PACKED, extract

#: Changes when the packed rows change, so that rows of an older engine are read anew.
VERSION = 3
KEY = "archive_key"
#: Archives whose partitions one task writes.
TASK_ARCHIVES = 64


def archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) of the archives under a root; their contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jar,zip}").load(root)
    return raw.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.unix_timestamp("modificationTime").alias("mtime"))


def _key(path: Column) -> Column:
    return F.md5(path)


def load(spark: SparkSession, cache: str) -> DataFrame:
    """The cached rows (packed rows, version, archive, mtime and the partition's key), or none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(cache)
    schema = spark.createDataFrame([], PACKED).selectExpr("*", "0 as version", "'' as archive", "0L as mtime", f"'' as {KEY}").schema
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(cache)


def stale_archives(spark: SparkSession, root: str, cache: str, version: int = VERSION) -> DataFrame:
    """(path, mtime) of the archives that the cache does not hold as they are now."""
    held = load(spark, cache).where(F.col("version") == version).select(F.col("archive").alias("path"), "mtime").distinct()
    return archives(spark, root).join(held, ["path", "mtime"], "left_anti")


def packed_archives(spark: SparkSession, root: str, cache: str, version: int = VERSION) -> DataFrame:
    """Packed rows of all archives under ``root``: partitions that still hold stay, the others are read and written anew.

    An archive without sources, and one that cannot be read, is remembered by one row without a path. A file that
    cannot be read keeps its reason.
    """
    stale = cut(stale_archives(spark, root, cache, version), "stale")
    n = stale.count()
    if n:
        entries = entries_in(stale.repartition(max(1, min(n, spark.sparkContext.defaultParallelism * 4)), "path"), ARCHIVE_PATTERN)
        texts = entries.where("text is not null").select("path", "text", F.lit("jar").alias("source_kind"), "source_path")
        fresh = stale.select(F.col("path").alias("archive"), "mtime").join(extract(texts), F.col("archive") == F.col("source_path"), "left")
        rows = fresh.select(*PACKED.fieldNames(), F.lit(version).alias("version"), "archive", F.col("mtime").cast("long").alias("mtime"), _key(F.col("archive")).alias(KEY))
        # A partition is one archive's: its rows meet in one task, so it is one file.
        rows.repartition(-(-n // TASK_ARCHIVES), KEY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(cache)
    listed = archives(spark, root).select(_key(F.col("path")).alias(KEY), F.col("mtime").alias("now"))
    held = load(spark, cache).where(F.col("version") == version)
    return held.join(listed, KEY).where("mtime = now and path is not null").select(PACKED.fieldNames())


def vacuum(spark: SparkSession, root: str, cache: str) -> int:
    """Remove the partitions of archives that are gone; returns how many."""
    keys = archives(spark, root).select(_key(F.col("path")).alias(KEY))
    gone = load(spark, cache).select(KEY).distinct().join(keys, KEY, "left_anti")
    removed = 0
    for row in gone.toLocalIterator():
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{re.sub('/+$', '', cache)}/{KEY}={row[KEY]}")
        removed += bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
    return removed
