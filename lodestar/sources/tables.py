"""Parquet table reader shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`; any path Spark itself can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
