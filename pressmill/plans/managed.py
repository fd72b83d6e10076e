"""Jobs from queue to end: ledger rows, progress, checkpoints and events around the article plan.

All jobs of a run advance together, a slice of their documents at a time.  Before each slice the
ledger says which jobs still run, so a pause or cancellation that arrives while a slice is worked
on takes effect at the next one, and what the slice did is still recorded.

What a slice gives (results, handled documents, checkpoints) goes to folders of its own, and counts
from the moment that one commit row names them.  A run that dies in between leaves nothing behind
that is read, and the run that takes its jobs over does the slice again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions.cleaning import DEFAULT_CONFIG, CleaningConfig
from pressmill.operators.dedup import first_success, skip_processed
from pressmill.operators.events import build_events
from pressmill.operators.jobs import allowed_action, change_status, create_jobs, fold_jobs, record_progress
from pressmill.operators.stats import progress_percent
from pressmill.plans.article import Enrichment, process_articles
from pressmill.schema import ARTICLE_FIELDS, LEDGER
from pressmill.session import Scratch, new_shared_path, written

_DONE = T.StructType(
    [T.StructField(n, k) for n, k in (("job_id", T.StringType()), ("document_id", T.StringType()), ("outcome", T.StringType()))]
)
_CHECKPOINTS = "job_id string, processed_count bigint, total_count bigint, last_processed_doc_id string, progress_percent double, at timestamp"


#: Characters of an error that the ledger keeps.
ERROR_LENGTH = 500


class JobStore:
    """Ledger and commits, as appended tables in a folder, and what committed slices of jobs gave."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("ledger", LEDGER), ("done", _DONE), ("checkpoints", _CHECKPOINTS), ("commits", "part string")):
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.path}/{name}")

    def put(self, name: str, part: str, rows: DataFrame) -> None:
        """Write a slice's rows; another try at the slice replaces them.  They count once committed."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/part={part}")

    def commit(self, part: str) -> None:
        self.append("commits", self.spark.createDataFrame([(part,)], "part string").coalesce(1))

    def committed(self, rows: DataFrame) -> DataFrame:
        commits = self.spark.read.schema("part string").parquet(f"{self.path}/commits").distinct()
        return rows.join(commits, "part", "left_semi").drop("part")

    def ledger(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/ledger")

    def done(self) -> DataFrame:
        schema = T.StructType([*_DONE.fields, T.StructField("part", T.StringType())])
        return self.committed(self.spark.read.schema(schema).parquet(f"{self.path}/done"))

    def checkpoints(self) -> DataFrame:
        return self.committed(self.spark.read.schema(f"{_CHECKPOINTS}, part string").parquet(f"{self.path}/checkpoints"))

    def results(self) -> DataFrame:
        return self.committed(self.spark.read.parquet(f"{self.path}/results"))

    def events(self) -> DataFrame:
        return build_events(self.ledger())

    def jobs(self) -> DataFrame:
        """Current state of each job, whether it was resumed, and the run that it started in last (``run``)."""
        started = F.when(F.col("status") == "running", F.try_element_at("metadata", F.lit("run")))
        runs = self.ledger().groupBy("job_id").agg(F.max_by(started, F.when(started.isNotNull(), F.col("ledger_seq"))).alias("run"))
        return fold_jobs(self.ledger()).withColumn("resumed", F.col("resumed_at").isNotNull()).join(runs, "job_id")

    def queue(self, requests: DataFrame) -> None:
        """Queue new jobs: ``job_id, at, total_documents``."""
        self.append("ledger", create_jobs(requests))

    def act(self, action: str, at: Column, which: Column) -> None:
        """Pause, resume or cancel those of the chosen jobs whose status allows it."""
        status = {"pause": "paused", "resume": "queued", "cancel": "cancelled"}[action]
        chosen = self.jobs().filter(which & allowed_action(F.col("status"), action))
        self.append("ledger", written(change_status(chosen, status, at), "action"))


def run_jobs(
    store: JobStore,
    documents: DataFrame,
    as_of: Column,
    now: Callable[[], Column] = F.current_timestamp,
    slices: int = 10,
    cfg: CleaningConfig = DEFAULT_CONFIG,
    tools: Enrichment | None = None,
    during: Callable[[int], None] | None = None,
    run: str | None = None,
    take_over: str | None = None,
) -> str:
    """Run all queued jobs until they end or are stopped; returns the run's name.

    ``documents`` has ``job_id, seq, outcome`` and the article fields, validated.  Documents handled
    before are skipped, whether or not a checkpoint was saved.  ``during`` is called after a slice
    is worked on and before that is recorded.

    Jobs that another run has started are left to it, unless ``take_over`` names that run, which
    its owner knows to be dead.  When a slice fails, the run's jobs become ``failed`` with the
    error, and the exception goes on to the caller.
    """
    run = run or uuid.uuid4().hex
    ledger = lambda rows: store.append("ledger", written(rows, "ledger-rows"))
    with Scratch(store.spark) as scratch:
        mine = written(documents.select("job_id").distinct(), "job-ids")
        waiting = F.col("status") == "queued"
        if take_over:
            waiting = waiting | ((F.col("status") == "running") & F.col("run").eqNullSafe(F.lit(take_over)))
        starting = change_status(store.jobs().filter(waiting).join(mine, "job_id", "left_semi"), "running", now())
        ledger(starting.withColumn("metadata", F.create_map(F.lit("run"), F.lit(run))))
        own = lambda: store.jobs().filter((F.col("status") == "running") & (F.col("run") == run))
        try:
            _work_off(store, documents, own, ledger, run, as_of, now, slices, cfg, tools, during)
        except Exception as error:
            message = F.lit(f"{type(error).__name__}: {error}"[:ERROR_LENGTH])
            ledger(change_status(own(), "failed", now(), message))
            raise
        ledger(change_status(own(), "completed", now()))
    scratch.drop()
    return run


def _work_off(store, documents, own, ledger, run, as_of, now, slices, cfg, tools, during) -> None:
    """Deal what is left to do into slices, once, and work them off in turn."""
    started = written(own().select("job_id").coalesce(1), "started-jobs")
    handled = store.done()
    fresh = skip_processed(documents.join(started, "job_id", "left_semi"), handled)
    bad = fresh.filter(F.col("outcome") != "ok")
    names = ["job_id", "seq", "outcome", *[n for n, *_ in ARTICLE_FIELDS]]
    dealt, slice_of = new_shared_path(store.spark, "dealt"), F.pmod(F.xxhash64("document_id"), F.lit(slices))
    rows = first_success(fresh).select(*names).unionByName(bad.select(*names)).withColumn("slice", slice_of)
    rows.write.partitionBy("slice").parquet(dealt)
    rows = store.spark.read.schema(rows.schema).parquet(dealt)

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy("job_id").agg(F.count_if(F.col("outcome") == "ok").alias("processed"), F.count_if(F.col("outcome") != "ok").alias("failed"))

    totals = written(counted(handled.join(started, "job_id", "left_semi")), "job-totals")
    for k in range(slices):
        running = started if k == 0 else written(own().select("job_id").coalesce(1), "running-jobs")
        if running.isEmpty():
            return
        part = f"{run}-{k}"
        fresh = rows.filter(F.col("slice") == k).join(running, "job_id", "left_semi")
        good = fresh.filter("outcome = 'ok'")
        store.put("results", part, process_articles(good.drop("slice", "outcome"), as_of, cfg, tools))
        store.put("done", part, fresh.select("job_id", "document_id", "outcome"))
        if during:
            during(k)
        touched = written(fresh.groupBy("job_id").agg(F.max_by("document_id", "seq").alias("last_processed_doc_id")), "touched-jobs")
        both = totals.unionByName(counted(fresh)).groupBy("job_id").agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"))
        totals = written(both, "job-totals")
        jobs = written(store.jobs().select("job_id", "ledger_seq", "total_documents"), "job-states")
        of_slice = totals.join(touched, "job_id")
        points = jobs.select("job_id", "total_documents").join(of_slice, "job_id")
        store.put(
            "checkpoints",
            part,
            points.select(
                "job_id",
                F.col("processed").alias("processed_count"),
                F.col("total_documents").alias("total_count"),
                "last_processed_doc_id",
                progress_percent(F.col("processed"), F.col("total_documents")).alias("progress_percent"),
                now().alias("at"),
            ),
        )
        store.commit(part)
        ledger(record_progress(jobs, of_slice.select("job_id", "processed", "failed"), now()))
