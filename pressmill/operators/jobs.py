"""The job ledger: an append-only table of changes, folded to the state of each job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.operators.ordered import chunk_of, with_previous
from pressmill.operators.stats import progress_percent
from pressmill.schema import LEDGER


def as_ledger(rows: DataFrame) -> DataFrame:
    """Fit rows to the ledger type; columns they lack are NULL."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in LEDGER.fields
        ]
    )


def create_jobs(requests: DataFrame) -> DataFrame:
    """Ledger rows that queue jobs.  ``job_id, at, total_documents`` are needed, the rest is optional."""
    batch = F.concat(F.lit("batch_"), F.date_format("at", "yyyyMMdd_HHmmss"))
    given = F.col("batch_id") if "batch_id" in requests.columns else F.lit(None).cast("string")
    out = requests.withColumn("batch_id", F.coalesce(given, batch))
    out = out.withColumn("status", F.lit("queued")).withColumn("processed_documents", F.lit(0)).withColumn(
        "failed_documents", F.lit(0)
    )
    if "ledger_seq" not in out.columns:
        out = out.withColumn("ledger_seq", F.lit(0))
    return as_ledger(out)


def change_status(jobs: DataFrame, status: str, at: Column, error: Column | None = None) -> DataFrame:
    """Ledger rows that move folded jobs to ``status``."""
    if status not in fixed.JOB_STATUSES:
        raise ValueError(f"unknown job status: {status}")
    return as_ledger(
        jobs.select(
            "job_id",
            (F.col("ledger_seq") + 1).alias("ledger_seq"),
            at.alias("at"),
            F.lit(status).alias("status"),
            (F.lit(None) if error is None else error).alias("error_message"),
        )
    )


def record_progress(jobs: DataFrame, totals: DataFrame, at: Column) -> DataFrame:
    """Ledger rows with the document counts of ``totals`` (job_id, processed, failed)."""
    joined = jobs.select("job_id", "ledger_seq").join(totals, "job_id")
    stats = F.create_map(
        F.lit("processed"), F.col("processed").cast("string"), F.lit("failed"), F.col("failed").cast("string")
    )
    return as_ledger(
        joined.select(
            "job_id",
            (F.col("ledger_seq") + 1).alias("ledger_seq"),
            at.alias("at"),
            F.col("processed").alias("processed_documents"),
            F.col("failed").alias("failed_documents"),
            stats.alias("statistics"),
        )
    )


def allowed_action(status: Column, action: str) -> Column:
    """Whether a job in ``status`` may be paused, resumed or cancelled."""
    return {
        "pause": status == "running",
        "resume": status == "paused",
        "cancel": status.isin("queued", "running", "paused"),
    }[action]


def _latest(value: str) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col("ledger_seq"))).alias(value)


def _stamp(status: str, name: str, first: bool = False) -> Column:
    pick = F.min if first else F.max
    return pick(F.when(F.col("status") == status, F.col("at"))).alias(name)


def fold_jobs(ledger: DataFrame) -> DataFrame:
    """Current state of each job: the latest non-NULL value of every field and its time stamps.

    The aggregation combines on the map side, so a job with a very long history is no hot spot.
    """
    history = ledger.groupBy("job_id").agg(
        F.max("ledger_seq").alias("ledger_seq"),
        _latest("batch_id"),
        _latest("status"),
        _latest("total_documents"),
        _latest("processed_documents"),
        _latest("failed_documents"),
        _latest("error_message"),
        _latest("statistics"),
        F.min("at").alias("created_at"),
        _stamp("running", "started_at", first=True),
        _stamp("paused", "paused_at"),
        F.max(F.when(F.col("status") == "queued", F.struct("ledger_seq", "at"))).alias("_queued"),
        F.min(F.when(F.col("status") == "paused", F.col("ledger_seq"))).alias("_paused_first"),
        F.max(F.when(F.col("status").isin("completed", "failed", "cancelled"), F.col("at"))).alias("completed_at"),
        F.max("at").alias("updated_at"),
    )
    # A job is queued when it is made and whenever it resumes, which takes a pause before.
    resumed = F.when(F.col("_queued.ledger_seq") > F.col("_paused_first"), F.col("_queued.at"))
    names = [c for c in history.columns if not c.startswith("_")]
    names.insert(names.index("completed_at"), "resumed_at")
    history = history.withColumn("resumed_at", resumed).select(*names)
    return history.withColumn(
        "progress_percent", progress_percent(F.col("processed_documents"), F.col("total_documents"))
    )


def merge_metadata(ledger: DataFrame) -> DataFrame:
    """``job_id, metadata``: shallow merge of the metadata maps, later entries win."""
    entries = ledger.filter(F.col("metadata").isNotNull()).select(
        "job_id", "ledger_seq", F.explode("metadata").alias("key", "value")
    )
    latest = entries.groupBy("job_id", "key").agg(F.max_by(F.struct("value"), "ledger_seq").alias("v"))
    return latest.groupBy("job_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", F.col("v.value").alias("value")))).alias("metadata")
    )


def list_jobs(
    jobs: DataFrame, status: str | None = None, batch_id: str | None = None, limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page of folded jobs, newest first, with the true total and the page number."""
    limit = max(1, min(limit, fixed.JOB_PAGE_LIMIT))
    hits = jobs
    if status:
        hits = hits.filter(F.col("status") == status)
    if batch_id:
        hits = hits.filter(F.col("batch_id") == batch_id)
    total = hits.agg(F.count("*")).scalar()
    page = hits.orderBy(F.desc("created_at"), F.asc("job_id")).offset(offset).limit(limit)
    return page.select(
        "*",
        total.alias("total_count"),
        F.lit(offset // limit + 1).cast("bigint").alias("page"),
        F.lit(limit).cast("bigint").alias("page_size"),
    )


def transition_violations(ledger: DataFrame) -> DataFrame:
    """Status changes that are not among the allowed ones."""
    changes = ledger.filter(F.col("status").isNotNull()).select("job_id", "ledger_seq", "at", "status")
    steps = with_previous(
        changes, ["job_id"], "ledger_seq", "status", "previous_status", chunk_of(F.col("ledger_seq"))
    )
    step = F.concat_ws(">", "previous_status", "status")
    allowed = [f"{a}>{b}" for a, b in fixed.JOB_TRANSITIONS]
    return steps.filter(F.col("previous_status").isNotNull() & ~step.isin(allowed))


# --- checkpoints -------------------------------------------------------------


def checkpoint_rows(points: DataFrame, at: Column) -> DataFrame:
    """Checkpoint rows from progress points."""
    return points.select(
        "job_id",
        F.col("processed_documents").alias("processed_count"),
        F.col("total_documents").alias("total_count"),
        F.col("document_id").alias("last_processed_doc_id"),
        "progress_percent",
        at.alias("at"),
    )


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The newest checkpoint per job."""
    others = [c for c in checkpoints.columns if c != "job_id"]
    newest = checkpoints.groupBy("job_id").agg(
        F.max_by(F.struct(*others), F.struct("at", "processed_count")).alias("c")
    )
    return newest.select("job_id", *[F.col(f"c.{c}").alias(c) for c in others])


def expire_checkpoints(checkpoints: DataFrame, as_of: Column, ttl: int = fixed.CHECKPOINT_TTL_SECONDS) -> DataFrame:
    """Checkpoints still alive at ``as_of``."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return checkpoints.filter(age <= ttl * 1_000_000)


def expire_processed(processed: DataFrame, as_of: Column, ttl: int = fixed.CHECKPOINT_TTL_SECONDS) -> DataFrame:
    """Processed-document sets still alive: a job's set lives on from its latest addition."""
    last = processed.groupBy("job_id").agg(F.max("processed_at").alias("_last"))
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("_last").cast("timestamp"))
    alive = last.filter(age <= ttl * 1_000_000).select("job_id")
    return processed.join(alive, "job_id", "left_semi")


def clear_finished(checkpoints: DataFrame, jobs: DataFrame) -> DataFrame:
    """Checkpoints of jobs that have not completed."""
    done = jobs.filter(F.col("status") == "completed").select("job_id")
    return checkpoints.join(done, "job_id", "left_anti")


def batch_outcomes(jobs: DataFrame, totals: DataFrame) -> DataFrame:
    """Outcome row per ended or paused job: status, counts, elapsed time and error."""
    ended = jobs.filter(F.col("status").isin("completed", "paused", "cancelled", "failed"))
    return ended.select("job_id", "batch_id", "status", "error_message").join(totals, "job_id", "left")


def register_jobs(jobs: DataFrame, stage: int, stage_name: str) -> DataFrame:
    """Registration rows: stage, stage name and metadata that also carries them."""
    extra = F.create_map(F.lit("stage"), F.lit(str(stage)), F.lit("stage_name"), F.lit(stage_name))
    own = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, _: ~k.isin("stage", "stage_name"))
    return jobs.select(
        "job_id",
        F.lit(stage).alias("stage"),
        F.lit(stage_name).alias("stage_name"),
        F.map_concat(kept, extra).alias("metadata"),
    )


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)
