"""Tables as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.sources.tables import table


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, with the schema that the table has now."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")
