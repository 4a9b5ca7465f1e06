"""Tables kept in buckets of their rows' keys, changed together: several of them under one version, or none.

A commit writes the buckets that it changes beside the old ones, all tables first, and then
one file of the manifest, whose rows name them. Readers take a snapshot of the manifest, so
they see every table as of one version, whatever is written meanwhile. What a killed run has
written is in no manifest; running it again writes it over. Buckets of older versions stay.
One writer at a time is assumed, as one stream's foreachBatch is.

All of it is read and written by Spark, so the folder may be in any store that it knows.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A manifest names at most so many buckets of a table, and they are what comes to the driver.
MOST_BUCKETS = 4096
#: The version of a folder without commits.
NOTHING = -1
_MANIFEST = "name string, bucket int, version long, filled boolean"


@dataclass(frozen=True)
class Kept:
    """How a table is kept: its schema, and the columns whose values decide the bucket."""

    schema: StructType
    by: tuple[str, ...]
    buckets: int = 64


@dataclass(frozen=True)
class Snapshot:
    """Every table as of one version; places: (table, bucket) to the version that wrote it, if it has rows."""

    spark: SparkSession
    folder: str
    tables: dict[str, Kept]
    version: int
    places: dict[tuple[str, int], int]

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table's rows, or those of some of its buckets; other buckets aren't opened."""
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.folder}/{name}/version={v}/_bucket={b}" for (n, b), v in sorted(self.places.items()) if n == name and (wanted is None or b in wanted)]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class VersionedTables:
    """Tables in a shared folder; `create` once, then `commit` versions that grow."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, Kept]):
        if any(not 1 <= t.buckets <= MOST_BUCKETS for t in tables.values()):
            raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets")
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables

    def create(self) -> VersionedTables:
        """An empty manifest; one that exists stays as it is."""
        self._note([])
        return self

    def bucket(self, name: str) -> Column:
        """The bucket of a row by its values as the table has them; null is a value like others."""
        kept = self.tables[name]
        return F.pmod(F.hash(*[F.col(c).cast(kept.schema[c].dataType) for c in kept.by]), F.lit(kept.buckets)).cast("int")

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that rows with the table's `by` columns belong to."""
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())

    def snapshot(self) -> Snapshot:
        entries = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest")
        latest = entries.groupBy("name", "bucket").agg(F.max_by("filled", "version").alias("filled"), F.max("version").alias("version")).collect()
        places = {(r["name"], r["bucket"]): r["version"] for r in latest if r["filled"]}
        return Snapshot(self.spark, self.folder, self.tables, max((r["version"] for r in latest), default=NOTHING), places)

    def commit(self, version: int, changes: dict[str, tuple[DataFrame, Iterable[int]]]) -> bool:
        """Put rows in the place of each table's given buckets, under `version`; False, and nothing done, if it was committed before.

        changes: table to (rows, buckets); rows outside those buckets are an error of the caller that would
        drop others' rows, so they are refused. A bucket without rows is emptied.
        """
        if version <= self.snapshot().version:
            return False
        with ThreadPoolExecutor(max(1, len(changes))) as pool:  # the tables' jobs run beside each other
            filled = list(pool.map(lambda change: self._write(version, change[0], *change[1]), changes.items()))
        self._note([("", 0, version, False), *[(name, b, version, b in full) for (name, (_, buckets)), full in zip(changes.items(), filled, strict=True) for b in sorted(set(buckets))]])
        return True

    def _write(self, version: int, name: str, rows: DataFrame, buckets: Iterable[int]) -> set[int]:
        """Write a table's buckets, splitting large ones into several files; those that got rows."""
        at, schema = f"{self.folder}/{name}/version={version}", self.tables[name].schema
        dealt = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]).withColumn("_bucket", self.bucket(name))
        dealt.hint("rebalance", F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(at)
        written = self.spark.read.schema(StructType([*schema.fields]).add("_bucket", "integer")).parquet(at)
        filled = {r[0] for r in written.select("_bucket").distinct().collect()}
        if not filled <= set(buckets):
            raise ValueError(f"rows of {name} outside the buckets that are replaced")
        return filled

    def _note(self, entries: list[tuple]) -> None:
        """One file for the whole commit, which the write's commit renames into place."""
        self.spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
