"""Stores as folders of generations: each written whole, then named by a manifest row, so readers see one generation or the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "generation long, folder string, n_rows long, at timestamp"


def publish(df: DataFrame, path: str, generation: int) -> int:
    """Write ``df`` as a generation and then name it; the number of its rows. A generation that fails half way is never named."""
    spark, folder = df.sparkSession, f"{path.rstrip('/')}/data/{generation:012d}"
    df.write.mode("errorifexists").parquet(folder)
    n = spark.read.schema(df.schema).parquet(folder).count()
    row = spark.range(1).select(F.lit(generation).cast("long").alias("generation"), F.lit(folder).alias("folder"), F.lit(n).cast("long").alias("n_rows"), F.current_timestamp().alias("at"))
    row.coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/manifest")
    return n


def generations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest named generation."""
    folder = generations(spark, path).orderBy(F.desc("generation")).select("folder").first()[0]
    return spark.read.parquet(folder)


def export(df: DataFrame, path: str, keys: list[str]) -> None:
    """Every row as a JSON line with sorted fields, in order of ``keys`` from file to file: the same rows give the same lines."""
    line = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).select(line.alias("value")).write.mode("errorifexists").text(path)
