"""Run summaries, rates, and monitoring aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import fixed


def percent_text(part: Column, whole: Column) -> Column:
    """``x.y%``; a whole of zero counts as one."""
    return F.format_string("%.1f%%", part / F.greatest(whole, F.lit(1)) * F.lit(100.0))


def run_summary(tagged: DataFrame, *group: str) -> DataFrame:
    """Line and error counts of outcome-tagged rows and the success rate."""
    counts = tagged.groupBy(*group).agg(
        F.count("*").alias("total_lines"),
        F.count_if(F.col("outcome") == "empty").alias("empty_lines"),
        F.count_if(F.col("outcome") == "ok").alias("processed_successfully"),
        F.count_if(F.col("outcome") == "json_error").alias("json_decode_errors"),
        F.count_if(F.col("outcome") == "validation_error").alias("validation_errors"),
        F.count_if(F.col("outcome") == "processing_error").alias("processing_errors"),
    )
    return counts.withColumn(
        "total_errors", F.col("json_decode_errors") + F.col("validation_errors") + F.col("processing_errors")
    ).withColumn(
        "success_rate",
        percent_text(F.col("processed_successfully"), F.col("total_lines") - F.col("empty_lines")),
    )


def progress_percent(processed: Column, total: Column) -> Column:
    return F.when(total > 0, processed / total * 100).otherwise(F.lit(0.0))


def job_totals(outcomes: DataFrame, job: str = "job_id", at: str = "at", resumed: str | None = None) -> DataFrame:
    """Per job: processed, failed and total documents, elapsed milliseconds and the resumed flag."""
    flag = F.bool_or(resumed) if resumed else F.lit(False)
    out = outcomes.groupBy(job).agg(
        F.count_if(F.col("outcome") == "ok").alias("processed"),
        F.count_if(F.col("outcome") != "ok").alias("failed"),
        F.count("*").alias("total"),
        (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))).alias("_us"),
        flag.alias("resumed"),
    )
    return out.withColumn("elapsed_ms", F.col("_us") / 1000).drop("_us")


def throughput(totals: DataFrame) -> DataFrame:
    """Documents per second and mean milliseconds per document; NULL where undefined."""
    return totals.withColumn(
        "docs_per_second", F.try_divide(F.col("total") * 1000.0, F.col("elapsed_ms"))
    ).withColumn("ms_per_doc", F.try_divide(F.col("elapsed_ms"), F.col("total")))


def processed_count(processed: DataFrame, job: str = "job_id", document: str = "document_id") -> DataFrame:
    """Distinct documents per job, deduplicated by (job, document) before the job is grouped."""
    return (
        processed.select(job, document)
        .distinct()
        .groupBy(job)
        .agg(F.count("*").alias("processed_documents"))
    )


def publisher_metrics(outcomes: DataFrame) -> DataFrame:
    """One row: events in total, those any backend took, and those none took."""
    per_event = outcomes.groupBy("event_id").agg(F.bool_or("success").alias("published"))
    return per_event.agg(
        F.count("*").alias("total_events"),
        F.count_if("published").alias("successful_events"),
        F.count_if(~F.col("published")).alias("failed_events"),
    )


def backend_outcomes(outcomes: DataFrame) -> DataFrame:
    """Successes and failures per backend."""
    return outcomes.groupBy("backend").agg(
        F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures")
    )


def backend_metrics(outcomes: DataFrame) -> DataFrame:
    """Per backend: published, failed, time of the last publish, latest error text."""
    failed = ~F.col("success")
    return outcomes.groupBy("backend").agg(
        F.count_if("success").alias("published"),
        F.count_if(failed).alias("failed"),
        F.max(F.when(F.col("success"), F.col("at"))).alias("last_published_at"),
        F.max_by("error", F.when(failed, F.struct("at", "event_id"))).alias("last_error"),
    )


def message_frequency(errors: DataFrame, message: str = "error_message") -> DataFrame:
    return errors.groupBy(message).agg(F.count("*").alias("n"))


def windowed_traffic(
    log: DataFrame,
    at: str,
    *keys: str,
    is_error: Column | None = None,
    latency: str | None = None,
    width: str = "5 minutes",
    width_seconds: int = 300,
) -> DataFrame:
    """Per window (and key): requests, requests per second, error share, 95th percentile latency.

    Works on tables and on streams; give streams a watermark first.
    """
    aggs = [F.count("*").alias("requests")]
    if is_error is not None:
        aggs.append(F.count_if(is_error).alias("errors"))
    if latency:
        aggs.append(F.percentile_approx(latency, 0.95, 10000).alias("p95"))
    out = log.groupBy(F.window(at, width).alias("w"), *keys).agg(*aggs)
    cols = [F.col("w.start").alias("window_start"), *keys, "requests"]
    cols.append((F.col("requests") / F.lit(width_seconds)).alias("per_second"))
    if is_error is not None:
        cols += ["errors", (F.col("errors") / F.col("requests")).alias("error_rate")]
    if latency:
        cols.append("p95")
    return out.select(*cols)


def threshold_flags(samples: DataFrame, memory: str, cpu: str) -> DataFrame:
    return samples.withColumn("memory_warning", F.col(memory) >= fixed.MEMORY_THRESHOLD).withColumn(
        "cpu_warning", F.col(cpu) >= fixed.CPU_THRESHOLD
    )


def usage_delta(samples: DataFrame, job: str, at: str, *metrics: str) -> DataFrame:
    """Last minus first sample of each metric per job."""
    return samples.groupBy(job).agg(
        *[(F.max_by(m, at) - F.min_by(m, at)).alias(f"{m}_delta") for m in metrics]
    )
