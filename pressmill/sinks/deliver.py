"""Bulk delivery, fan-out to several sinks with isolated failures, topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.session import written


def bulk_deliver(
    rows: DataFrame,
    key: str,
    send: Callable[[list[str], list[str]], list[str | None]],
    size: int = fixed.BULK_ROWS,
) -> DataFrame:
    """Send rows as JSON in requests of at most ``size``; one outcome row per request, with its
    rows' ids and errors (``outcomes``), so that what failed can be sent again.

    ``send(ids, bodies)`` returns one error or None per row.  It runs in the tasks and may see a
    row again after a task retry, so it must upsert by id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), size):
                part = batch.iloc[start : start + size]
                try:
                    errors = send(list(part["id"]), list(part["body"]))
                except Exception as problem:  # a failed request fails its rows, not the job
                    errors = [str(problem)] * len(part)
                bad = [e for e in errors if e]
                yield pd.DataFrame(
                    {
                        "rows": [len(part)],
                        "failed": [len(bad)],
                        "error": [bad[0][: fixed.ERROR_TEXT_LENGTH] if bad else None],
                        "outcomes": [[{"id": i, "error": e[: fixed.ERROR_TEXT_LENGTH] if e else None} for i, e in zip(part["id"], errors)]],
                    }
                )

    payload = rows.select(F.col(key).cast("string").alias("id"), F.to_json(F.struct("*")).alias("body"))
    return payload.mapInPandas(run, "rows bigint, failed bigint, error string, outcomes array<struct<id:string,error:string>>")


def write_everywhere(rows: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> DataFrame:
    """Give the same rows to every sink; a sink that fails does not stop the others.

    The rows are computed once, into a table.  Returns ``sink, success, error``.
    """
    spark = rows.sparkSession
    table = written(rows, "fan-out")
    outcomes = []
    for name, write in sinks.items():
        try:
            write(table)
            outcomes.append((name, True, None))
        except Exception as problem:
            outcomes.append((name, False, str(problem)[: fixed.ERROR_TEXT_LENGTH]))
    return spark.createDataFrame(outcomes, "sink string, success boolean, error string")


def topic_rows(bodies: DataFrame, key: str, body: str = "body") -> DataFrame:
    """``key, value`` as a topic takes them."""
    return bodies.select(F.col(key).cast("string").alias("key"), F.col(body).alias("value"))


def publish_to_topic(rows: DataFrame, servers: str, topic: str) -> None:
    """Write key/value rows to Kafka; needs the connector package on the class path."""
    rows.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
