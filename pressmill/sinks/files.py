"""File sinks: daily JSON-lines, result files, error reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_daily(rows: DataFrame, path: str, day: Column, run: str | None = None) -> None:
    """Append JSON lines below one folder per calendar day.

    With ``run`` the rows go to that run's own folder in each day, which a rerun replaces, so that
    a day never holds a run twice; ``day`` must then come from the rows and not from the clock.
    """
    rows = rows.withColumn("ingest_date", day)
    if run is None:
        rows.write.mode("append").partitionBy("ingest_date").json(path)
        return
    writer = rows.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("ingest_date", "run").json(path)


def overwrite_results(rows: DataFrame, path: str) -> None:
    """Replace the result rows; their order is not defined."""
    rows.write.mode("overwrite").json(path)


def write_error_report(errors: DataFrame, summary: DataFrame, path: str) -> bool:
    """Write summary and errors, only when there are errors.  Says whether it did."""
    if summary.first()["total_errors"] == 0:
        return False
    summary.write.mode("overwrite").json(f"{path}/summary")
    errors.write.mode("overwrite").json(f"{path}/errors")
    return True
