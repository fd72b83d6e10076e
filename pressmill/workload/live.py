"""Streams with keyed state: live ingest, events of a growing ledger, deliveries that come due again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.session import new_shared_path
from pressmill.sources.lines import stream_table
from pressmill.streaming import runs, state
from pressmill.workload import derived as D
from pressmill.workload import tracking as T
from pressmill.workload.base import query
from pressmill.workload.derived import stamp, table

S = D.sql_stamp

_ERRORS = f"""SELECT CASE WHEN kind = 5 THEN 'JSONDecodeError' ELSE 'ValidationError' END AS error_type,
    CASE kind WHEN 5 THEN 'All parsing failed. Not a JSON value'
      WHEN 8 THEN 'document_id: must be a string; publication_date: must be a date'
      WHEN 9 THEN 'document_id: field required; text: field required; tags: must be a list of strings'
      ELSE 'document: must be an object' END AS error_message FROM {D.RAW_LINES} WHERE kind IN (5, 8, 9, 10)"""
_WORDS = "CASE WHEN c <> '' THEN length(c) - length(replace(c, ' ', '')) + 1 END"


@query(
    "S5 ST9 J1 J2 E11 V1 R1",
    f"""SELECT document_id, '1.0' AS version, text AS original_text, c AS cleaned_text, nullif({D.sql_clean('title')}, '') AS cleaned_title,
      source_url AS cleaned_source_url, {_WORDS} AS cleaned_word_count,
      CASE WHEN c <> '' THEN '{{"cleaned_reading_time":' || greatest(1, CAST(round_even({_WORDS} / 200, 0) AS BIGINT)) || '}}' END AS cleaned_additional_metadata,
      NULL AS error_type, NULL AS error_message
    FROM (SELECT *, {D.sql_clean('text')} AS c FROM {D.EXPECTED_LINES} WHERE outcome = 'ok')
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error_type, error_message
    FROM (SELECT * FROM ({_ERRORS}) UNION ALL SELECT * FROM ({_ERRORS}))""",
)
def live_records(spark, sf):
    """Files of raw lines as they arrive, each line in two of them: a record once, an error each time."""
    folder, target, progress = (new_shared_path(spark, f"live-{n}") for n in ("lines", "target", "progress"))
    lines = D.raw_lines(spark, sf).select("value")
    handle = state.record_batches(target, F.lit("2024-06-01").cast("date"))
    for copy in range(2):  # the second run begins with the state that the first one left
        lines.repartition(3).write.mode("append").text(folder)
        q = state.new_documents(state.arriving_lines(spark, folder)).writeStream.foreachBatch(handle)
        q.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    texts = ["document_id", "version", "original_text", "cleaned_text", "cleaned_title", "cleaned_source_url"]
    records = spark.read.parquet(f"{target}/records").select(
        *texts, "cleaned_word_count",
        F.when(F.size("cleaned_additional_metadata") > 0, F.to_json("cleaned_additional_metadata")).alias("cleaned_additional_metadata"),
    )
    return records.unionByName(spark.read.parquet(f"{target}/errors").select("error_type", "error_message"), allowMissingColumns=True)


_LEDGER_CLOSED = f"(SELECT max(happened) - INTERVAL 6 HOURS FROM {D.LEDGER_SQL})"
_PAST = f"(SELECT * FROM {D.LEDGER_SQL} WHERE happened < {_LEDGER_CLOSED})"


def _growing_ledger(spark, sf):
    """Steps of the ledger told in three parts, with rows up to four hours late."""
    ledger = D.ledger(spark, sf)
    told = F.unix_seconds("at") + 3600 * F.pmod(F.xxhash64("job_id", "ledger_seq"), F.lit(5))
    bounds = ledger.agg(F.percentile_approx(told, [0.3, 0.7])).first()[0]
    part = F.when(told < bounds[0], 0).when(told < bounds[1], 1).otherwise(2)
    folder, target, progress = (new_shared_path(spark, f"ledger-{n}") for n in ("rows", "steps", "progress"))
    for k in range(3):
        ledger.where(part == k).write.mode("append").parquet(folder)
        steps = state.job_steps(stream_table(spark, folder, ledger.schema), "6 hours")
        out = runs.run_available(steps, target, progress)
    return out


@query("ST1 ST2", f"SELECT id, type, time, subject, {T._DATA} AS data FROM {T._EVENTS.replace(D.LEDGER_SQL, _PAST)}")
def live_lifecycle_events(spark, sf):
    events = state.live_events(_growing_ledger(spark, sf))
    return events.select("id", "type", "time", "subject", F.to_json("data").alias("data"))


@query(
    "L5 B2 B3",
    f"""SELECT job_id, ledger_seq, batch_id, status, total_documents, processed_documents, error_message,
      round(processed_documents / total_documents * 100, 6) AS progress_percent, {S('created_at')} AS created_at,
      {S('started_at')} AS started_at, {S('paused_at')} AS paused_at, {S('resumed_at')} AS resumed_at,
      {S('completed_at')} AS completed_at, {S('updated_at')} AS updated_at
    FROM (SELECT * REPLACE (CAST(ledger_seq AS BIGINT) AS ledger_seq) FROM {T._JOBS.replace(D.LEDGER_SQL, _PAST)})""",
)
def live_job_states(spark, sf):
    """The jobs as the stream left them: the last step of each."""
    jobs = state.live_jobs(_growing_ledger(spark, sf))
    last = jobs.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in jobs.columns if c != "job_id"]), "ledger_seq").alias("j"))
    times = ["created_at", "started_at", "paused_at", "resumed_at", "completed_at", "updated_at"]
    return last.select("job_id", "j.*").select(
        "job_id", "ledger_seq", "batch_id", "status", "total_documents", "processed_documents", "error_message",
        F.round("progress_percent", 6).alias("progress_percent"), *[stamp(t).alias(t) for t in times],
    )


_TOLD = """(SELECT event_id, attempt, status, ts AS happened FROM (SELECT e.event_id, a.attempt, a.status, e.ts FROM events e JOIN {attempts} a USING (event_id))
  UNION ALL SELECT e.event_id, a.attempt + 1, 200, e.ts + INTERVAL 1 SECOND FROM events e JOIN {attempts} a USING (event_id) WHERE e.event_id % 5 = 0)""".format(attempts=T._ATTEMPTS)


@query(
    "ST6 K11",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, 'webhook' AS backend, target, CAST(attempt AS INTEGER) AS attempt, status, {S('due')} AS due_at FROM (
      SELECT event_id, 'retry' AS target, attempt + 1 AS attempt, status, happened + (2 ** attempt)::INTEGER * INTERVAL 1 SECOND AS due
      FROM {_TOLD} WHERE attempt < 3 AND event_id % 5 <> 0 AND (status IS NULL OR status IN (429, 500, 302))
      UNION ALL SELECT event_id, 'dead', attempt, status, happened FROM {_TOLD}
      WHERE status = 404 OR (attempt >= 3 AND (status IS NULL OR status IN (429, 500, 302))))
    WHERE target = 'dead' OR due < (SELECT date_trunc('milliseconds', max(happened)) - INTERVAL 1 MINUTE FROM {_TOLD})""",
)
def live_redelivery(spark, sf):
    """Outcomes of deliveries, each told twice; a success a second later calls off what would come due."""
    at = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    first = T._attempts(spark, sf).join(at, "event_id")
    good = first.where("event_id % 5 = 0").select("event_id", (F.col("attempt") + 1).alias("attempt"), F.lit(200).alias("status"), (F.col("at") + F.expr("interval 1 second")).alias("at"))
    told = first.unionByName(good).withColumn("backend", F.lit("webhook"))
    folder = new_shared_path(spark, "attempts")
    told.unionByName(told).write.parquet(folder)
    due = state.deliveries_due(stream_table(spark, folder, told.schema))
    out = runs.run_available(due, new_shared_path(spark, "due"), new_shared_path(spark, "due-progress"))
    return out.select("event_id", "backend", "target", "attempt", "status", stamp("due_at").alias("due_at"))
