"""JSON-lines files to processed rows, dead letters and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.cleaning import DEFAULT_CONFIG, CleaningConfig
from pressmill.operators.repair import parse_lines
from pressmill.operators.stats import run_summary
from pressmill.operators.validate import error_rows, tag_outcome, validate_documents
from pressmill.plans.article import Enrichment, envelope, process_articles
from pressmill.schema import ARTICLE_FIELDS
from pressmill.session import written
from pressmill.sinks.files import overwrite_results, write_error_report
from pressmill.sources.lines import mark_lines, number_lines


@dataclass
class FileRun:
    processed: DataFrame
    errors: DataFrame
    summary: DataFrame


def check_lines(lines: DataFrame) -> DataFrame:
    """Repair, validate and tag numbered lines."""
    return tag_outcome(validate_documents(parse_lines(lines)))


def run_lines(
    lines: DataFrame,
    as_of: Column,
    cfg: CleaningConfig = DEFAULT_CONFIG,
    tools: Enrichment | None = None,
    override: dict | None = None,
    settle: bool = True,
    number: Callable[[DataFrame], DataFrame] | None = None,
) -> FileRun:
    """Parsing happens once: its result is a table that the three outputs read.

    ``lines`` has ``line``, or ``number`` adds it to the rows in error, which alone need it.
    """
    tagged = check_lines(lines).drop("document")
    if settle:
        tagged = written(tagged, "checked-lines")
    good = tagged.filter("outcome = 'ok'").select(*[n for n, *_ in ARTICLE_FIELDS])
    bad = tagged.filter(F.col("outcome").isin("json_error", "validation_error"))
    errors = error_rows(number(bad) if number else bad)
    return FileRun(process_articles(good, as_of, cfg, tools, override), errors, run_summary(tagged))


def process_files(
    spark: SparkSession,
    source: str,
    target: str,
    as_of: Column,
    cfg: CleaningConfig = DEFAULT_CONFIG,
    tools: Enrichment | None = None,
    override: dict | None = None,
) -> FileRun:
    """Read files, write the result rows and, when there are errors, the error report next to them."""
    marked = mark_lines(spark, source)
    run = run_lines(marked, as_of, cfg, tools, override, number=lambda bad: number_lines(bad, marked))
    overwrite_results(envelope(run.processed), target)
    write_error_report(run.errors, run.summary, f"{target}_errors")
    return run
