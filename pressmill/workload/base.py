"""Registration of queries: a name, the Spark function, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None
    covers: str


REGISTERED: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name.  ``covers`` lists blueprint operator ids."""

    def register(run: Run) -> Run:
        if run.__name__ in REGISTERED:
            raise ValueError(f"query registered twice: {run.__name__}")
        REGISTERED[run.__name__] = Query(run, sql, covers)
        return run

    return register
