"""Table readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same for a table whose texts are costly to work on: at least a partition per core."""
    return spread(table(spark, sf_dir, name))
