"""Resume, membership, first success per document, and sink selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("job_id", "document_id")


def skip_processed(documents: DataFrame, processed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Documents not processed before."""
    return documents.join(processed.select(*keys).distinct(), list(keys), "left_anti")


def only_processed(documents: DataFrame, processed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return documents.join(processed.select(*keys).distinct(), list(keys), "left_semi")


def first_success(
    rows: DataFrame, keys: tuple[str, ...] = KEYS, seq: str = "seq", ok: Column | None = None
) -> DataFrame:
    """Per key the successful row with the lowest ``seq``; failures do not claim a key.

    Only key and ``seq`` are aggregated, and only keys that repeat are joined back, so the wide
    rows move just when the repeated keys are too many to broadcast.
    """
    good = rows.filter(F.col("outcome") == "ok" if ok is None else ok)
    repeated = (
        good.groupBy(*keys)
        .agg(F.min(seq).alias("_first"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    joined = good.join(repeated, list(keys), "left")
    return joined.filter(F.col("_first").isNull() | (F.col(seq) == F.col("_first"))).drop("_first")


def latest_per_key(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the highest ``seq`` per key (``seq`` is unique in a key); wide rows move as above."""
    repeated = (
        rows.groupBy(*keys)
        .agg(F.max(seq).alias("_last"), F.count("*").alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
    )
    joined = rows.join(repeated, list(keys), "left")
    return joined.filter(F.col("_last").isNull() | (F.col(seq) == F.col("_last"))).drop("_last")


def choose_sinks(requested: Column, enabled: Column, fallback: str = "jsonl") -> Column:
    """Requested sinks that are enabled; all enabled when none is requested; else the fallback."""
    asked = F.coalesce(F.size(requested), F.lit(0)) > 0
    wanted = F.when(asked, F.filter(requested, lambda s: F.array_contains(enabled, s))).otherwise(enabled)
    return F.when(F.coalesce(F.size(wanted), F.lit(0)) > 0, wanted).otherwise(F.array(F.lit(fallback)))
