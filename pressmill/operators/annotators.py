"""Plug points: models that a user brings run per Arrow batch, one instance per Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Annotator = Callable[[pd.DataFrame], pd.DataFrame]
_instances: dict[str, tuple[bytes, Annotator | None]] = {}


def annotate(
    df: DataFrame, name: str, factory: Callable[[], Annotator], added: T.StructType, reads: list[str] | None = None
) -> DataFrame:
    """Add the columns an injected annotator computes from each batch of rows.

    ``factory`` runs once per worker process; another factory under the same ``name`` replaces it.  When it returns None,
    because an optional library is missing, the added columns are NULL.  Only the columns that
    ``reads`` names go through Python (all, when it isn't given); the others stay in the JVM.
    """
    names = [f.name for f in added.fields]
    made_by = cloudpickle.dumps(factory)

    @F.pandas_udf(added)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if _instances.get(name, (None,))[0] != made_by:
            _instances[name] = made_by, factory()
        model = _instances[name][1]
        for batch in batches:
            if model is None:
                yield pd.DataFrame({n: [None] * len(batch) for n in names}, index=batch.index)
            else:
                yield model(batch)[names].set_axis(batch.index)

    taken = run.asNondeterministic()(F.struct(*(reads or df.columns)))
    return df.withColumn("_added", taken).select(*df.columns, *[F.col("_added")[n].alias(n) for n in names])
