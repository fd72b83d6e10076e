"""Keyed upserts without a table format: versions are appended, readers fold them, compaction rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.operators.dedup import latest_per_key
from pressmill.session import written

VERSION = "_version"


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str], seq: str, created: str | None = None) -> DataFrame:
    """``old`` with ``new`` upserted: the last row per key wins, ``created`` stays the first one."""
    latest = written(latest_per_key(new, keys, seq), "merged")  # read twice below
    if created:
        first_seen = old.select(*keys, F.col(created).alias("_created"))
        latest = latest.join(first_seen, keys, "left").withColumn(created, F.coalesce("_created", created)).drop("_created")
    kept = old.join(latest.select(*keys), keys, "left_anti")
    return kept.unionByName(latest.select(*old.columns))


class KeyedTable:
    """An upsert target as a folder of appended versions.

    Writing costs what the new rows cost.  Each write carries a version number that the caller
    raises; writing the same version again after a failure leaves no duplicates, because rows of
    one version and key are the same.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def upsert(self, rows: DataFrame, version: int, at: Column, seq: str) -> None:
        """Write ``rows``; of several rows of one key the one with the highest ``seq`` wins."""
        once = latest_per_key(rows, self.keys, seq).drop(seq)
        once.withColumn("created_at", at).write.mode("overwrite").parquet(f"{self.path}/{VERSION}={version}")

    def current(self) -> DataFrame:
        """The latest row per key with the time the key was first written."""
        rows = self.spark.read.parquet(self.path)
        first = rows.groupBy(*self.keys).agg(F.min("created_at").alias("_created"), F.count("*").alias("_n"))
        again = first.filter(F.col("_n") > 1).drop("_n")
        latest = latest_per_key(rows, self.keys, VERSION).join(again, self.keys, "left")
        return latest.withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")

    def compact(self, target: str) -> KeyedTable:
        """Write the current rows as one version of a new table and return it."""
        self.current().write.partitionBy(VERSION).parquet(target)
        return KeyedTable(self.spark, target, self.keys)


def registry_rows(processed: DataFrame, job_id: Column) -> DataFrame:
    """Metadata registry rows: key, a few columns and the whole record as JSON."""
    return processed.select(
        "document_id",
        job_id.alias("job_id"),
        F.col("cleaned_title").alias("title"),
        F.col("cleaned_publication_date").alias("publication_date"),
        F.to_json(F.struct(*processed.columns)).alias("full_data"),
    )
