"""Managed batches: a whole batch processed in parallel, resumable, with ledger and events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.functions.cleaning import DEFAULT_CONFIG, CleaningConfig
from pressmill.operators.dedup import first_success, skip_processed
from pressmill.operators.ordered import progress_points
from pressmill.operators.stats import job_totals
from pressmill.operators.validate import validate_documents
from pressmill.plans.article import Enrichment, process_articles
from pressmill.schema import ARTICLE_FIELDS
from pressmill.session import written
from pressmill.sources.lines import explode_batch


@dataclass
class BatchRun:
    processed: DataFrame
    outcomes: DataFrame
    totals: DataFrame
    checkpoints: DataFrame
    failed_batches: DataFrame


def run_batches(
    batches: DataFrame,
    done: DataFrame | None,
    as_of: Column,
    cfg: CleaningConfig = DEFAULT_CONFIG,
    tools: Enrichment | None = None,
    interval: int = fixed.CHECKPOINT_INTERVAL,
    settle: bool = True,
) -> BatchRun:
    """``batches`` has ``job_id, documents`` (a JSON array); ``done`` has ``job_id, document_id``.

    Documents in ``done`` are always skipped, whether or not a checkpoint was saved.
    """
    items = explode_batch(batches.select("job_id", "documents"))
    failed = items.filter(~F.col("batch_ok")).select("job_id", F.lit("failed").alias("status"))
    # A batch that is no array has no document.  A filter on ``batch_ok`` would move below the explode and parse twice.
    documents = items.filter(F.col("document").isNotNull()).drop("batch_ok")
    checked = validate_documents(documents, sanitize=False).withColumn(
        "outcome", F.when(F.size("errors") > 0, "validation_error").otherwise("ok")
    ).drop("document")
    if settle:
        checked = written(checked, "checked-batch")
    fresh = checked if done is None else skip_processed(checked, done)
    winners = first_success(fresh)
    articles = winners.select("job_id", "seq", *[n for n, *_ in ARTICLE_FIELDS])
    processed = process_articles(articles, as_of, cfg, tools)
    failures = fresh.filter(F.col("outcome") != "ok").select("job_id", "document_id", "seq", "outcome")
    outcomes = winners.select("job_id", "document_id", "seq", "outcome").unionByName(failures)
    timed = outcomes.withColumn("at", F.current_timestamp())
    return BatchRun(
        processed,
        outcomes,
        job_totals(timed).drop("elapsed_ms"),
        progress_points(outcomes, interval),
        failed,
    )
