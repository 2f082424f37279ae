"""Where queries register: a name, a function of (spark, table), and DuckDB SQL if there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    """Register a (spark, table) function under its name, with its SQL; ``table(name)`` reads a table of the folder."""

    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[function.__name__] = run
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add
