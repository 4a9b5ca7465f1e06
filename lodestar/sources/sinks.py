"""Tables and reports written out: partitions replaced, snapshots refreshed, lines of JSON or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write `rows`, replacing only the partitions of `by` that they hold."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a table that is only ever added to."""
    rows.write.mode("append").parquet(path)


def refresh_snapshot(rows: DataFrame, folder: str, version: int) -> DataFrame:
    """Write a new version of a view beside the old ones, which readers keep until they ask for the latest."""
    rows.write.mode("errorifexists").parquet(f"{folder}/version={version}")
    return latest_snapshot(rows.sparkSession, folder)


def latest_snapshot(spark, folder: str) -> DataFrame:
    """The highest version of a view."""
    every = spark.read.parquet(folder)
    newest = every.agg({"version": "max"}).first()[0]
    return every.where(every["version"] == newest).drop("version")


def report(rows: DataFrame, path: str, form: str = "json") -> None:
    """A report as lines of JSON, or CSV with a header; nested columns need JSON."""
    if form not in ("json", "csv"):
        raise ValueError("a report is json or csv")
    rows.write.mode("overwrite").option("header", form == "csv").format(form).save(path)
