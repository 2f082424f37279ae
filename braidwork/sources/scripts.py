"""Script files as tables: inventory, precedence between copies, and physical lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def inventory(spark: SparkSession, path: str, *, pattern: str = "*.rpy", max_files: int = 100_000, max_bytes: int = 1 << 40) -> DataFrame:
    """(path, size, modified, digest) of every file below ``path`` that fits ``pattern``.

    The caps are checked over names and sizes alone, before any content is read;
    beyond either the call raises ValueError.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > max_files or size > max_bytes:
        raise ValueError(f"{n} files of {size} bytes: more than {max_files} files or {max_bytes} bytes")
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def verified(spark: SparkSession, path: str, expected: DataFrame, *, pattern: str = "*.rpy") -> DataFrame:
    """(path, content, digest) of the files of an inventory, read again.

    A file that has changed since, by ``expected``(path, digest), fails the read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    joined = files.select("path", "content").join(expected.select("path", F.col("digest").alias("_expected")), "path")
    fresh = F.sha2("content", 256)
    failed = F.raise_error(F.concat(F.lit("changed since the inventory: "), F.col("path")))
    return joined.select("path", "content", F.when(fresh == F.col("_expected"), fresh).otherwise(failed).alias("digest"))


def stem(path: Column) -> Column:
    """A path's file name in lower case, without its extension."""
    return F.lower(F.regexp_extract(path, r"([^/\\]*?)(\.[^./\\]*)?$", 1))


def ambiguous(candidates: DataFrame) -> DataFrame:
    """(stem, tier, n_digests) where one tier holds different contents of a stem."""
    counted = candidates.groupBy("stem", "tier").agg(F.count_distinct("digest").alias("n_digests"))
    return counted.where("n_digests > 1")


def preferred(candidates: DataFrame) -> DataFrame:
    """candidates(stem, tier, path, ..) -> the row of each stem with the lowest tier, then the first path without case."""
    order = W.partitionBy("stem").orderBy("tier", F.lower("path"), "path")
    return candidates.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def physical_lines(texts: DataFrame, *, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no, line): lines split at ``\\n`` or ``\\r\\n``, numbered from 1. Null texts have none; an empty text has one empty line."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("_at", "line"))
    return lines.select(key, (F.col("_at") + 1).alias("line_no"), "line")
