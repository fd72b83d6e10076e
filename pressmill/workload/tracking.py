"""Metrics, ordered operators, joins, job ledger and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.operators import dedup as J
from pressmill.operators import events as EV
from pressmill.operators import jobs as B
from pressmill.operators import ordered as O
from pressmill.operators import stats as A
from pressmill.workload import derived as D
from pressmill.workload.base import query
from pressmill.workload.derived import stamp, table

S = D.sql_stamp

# --- aggregates ------------------------------------------------------------------------------


@query(
    "A3 A4",
    f"""SELECT job_id, processed, failed, total, round(us / 1000, 3) AS elapsed_ms, resumed,
      round(CASE WHEN total > 0 THEN processed / total * 100 ELSE 0 END, 6) AS percent FROM (
      SELECT job_id, count(*) FILTER (outcome = 'ok') AS processed, count(*) FILTER (outcome <> 'ok') AS failed,
        count(*) AS total, epoch_us(max(happened)) - epoch_us(min(happened)) AS us, bool_or(seq % 97 = 0) AS resumed
      FROM {D.OUTCOMES} GROUP BY job_id)""",
)
def job_totals(spark, sf):
    o = D.outcomes(spark, sf).withColumn("again", F.col("seq") % 97 == 0)
    return A.job_totals(o, resumed="again").select(
        "job_id",
        "processed",
        "failed",
        "total",
        F.round("elapsed_ms", 3).alias("elapsed_ms"),
        "resumed",
        F.round(A.progress_percent(F.col("processed"), F.col("total")), 6).alias("percent"),
    )


@query(
    "A11",
    f"""SELECT job_id, round(total * 1000.0 / nullif(ms, 0), 6) AS docs_per_second, round(ms / total, 6) AS ms_per_doc FROM (
      SELECT job_id, count(*) AS total, (epoch_us(max(happened)) - epoch_us(min(happened))) / 1000 AS ms FROM {D.OUTCOMES} GROUP BY job_id)""",
)
def job_throughput(spark, sf):
    t = A.throughput(A.job_totals(D.outcomes(spark, sf)))
    return t.select(
        "job_id",
        F.round("docs_per_second", 6).alias("docs_per_second"),
        F.round("ms_per_doc", 6).alias("ms_per_doc"),
    )


@query(
    "A12",
    f"SELECT job_id, count(DISTINCT document_id) AS processed_documents FROM {D.OUTCOMES} WHERE outcome = 'ok' GROUP BY job_id",
)
def processed_counts(spark, sf):
    return A.processed_count(D.outcomes(spark, sf).filter("outcome = 'ok'"))


_DELIVERIES = """(SELECT CAST(event_id AS VARCHAR) AS event_id, backend, ts AS happened,
    (event_id * 7 + n) % 5 > 1 AS success, CASE WHEN (event_id * 7 + n) % 5 <= 1 THEN 'refused ' || event_id % 3 END AS error
  FROM events, (VALUES ('redis_streams', 13), ('webhook', 7), ('kafka', 5)) b(backend, n))"""


def _deliveries(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    size = F.length("backend").cast("bigint")
    out = EV.fan_out(e, D.BACKENDS).withColumn("ok", (F.col("event_id") * 7 + size) % 5 > 1)
    return out.select(
        F.col("event_id").cast("string").alias("event_id"),
        "backend",
        F.col("ts").cast("timestamp").alias("at"),
        F.col("ok").alias("success"),
        F.when(~F.col("ok"), F.concat(F.lit("refused "), (F.col("event_id") % 3).cast("string"))).alias("error"),
    )


@query(
    "A5",
    f"""SELECT count(*) AS total_events, count(*) FILTER (p) AS successful_events, count(*) FILTER (NOT p) AS failed_events
    FROM (SELECT event_id, bool_or(success) AS p FROM {_DELIVERIES} GROUP BY event_id)""",
)
def publisher_metrics(spark, sf):
    return A.publisher_metrics(_deliveries(spark, sf))


@query(
    "A5",
    f"SELECT backend, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures FROM {_DELIVERIES} GROUP BY backend",
)
def backend_outcomes(spark, sf):
    return A.backend_outcomes(_deliveries(spark, sf))


@query(
    "A6",
    f"""SELECT backend, count(*) FILTER (success) AS published, count(*) FILTER (NOT success) AS failed,
      {S('max(happened) FILTER (success)')} AS last_published_at, arg_max(error, happened) FILTER (NOT success) AS last_error
    FROM {_DELIVERIES} GROUP BY backend""",
)
def backend_metrics(spark, sf):
    m = A.backend_metrics(_deliveries(spark, sf))
    return m.withColumn("last_published_at", stamp("last_published_at"))


@query("A7", "SELECT props AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY props")
def error_message_frequency(spark, sf):
    errors = table(spark, sf, "events").filter("event_type = 'error'")
    return A.message_frequency(errors.withColumnRenamed("props", "message"), "message")


_BIN = "time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '2000-01-01')"


@query(
    "A8",
    f"""SELECT {S(_BIN)} AS window_start, event_type, count(*) AS requests, round(count(*) / 300, 9) AS per_second
    FROM events GROUP BY {_BIN}, event_type""",
)
def request_rates(spark, sf):
    t = A.windowed_traffic(table(spark, sf, "events"), "ts", "event_type")
    return t.select(stamp("window_start").alias("window_start"), "event_type", "requests", F.round("per_second", 9).alias("per_second"))


@query(
    "A9",
    f"""SELECT {S(_BIN)} AS window_start, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY {_BIN}""",
)
def latency_percentiles(spark, sf):
    t = A.windowed_traffic(table(spark, sf, "events"), "ts", latency="value")
    return t.select(stamp("window_start").alias("window_start"), "p95")


@query(
    "A10",
    f"""SELECT {S(_BIN)} AS window_start, count(*) FILTER (event_type = 'error') AS errors,
      round(count(*) FILTER (event_type = 'error') / count(*), 9) AS error_rate FROM events GROUP BY {_BIN}""",
)
def error_rates(spark, sf):
    t = A.windowed_traffic(table(spark, sf, "events"), "ts", is_error=F.col("event_type") == "error")
    return t.select(stamp("window_start").alias("window_start"), "errors", F.round("error_rate", 9).alias("error_rate"))


@query(
    "A13",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity * 2 AS memory, l_quantity + 50 AS cpu,
      l_quantity * 2 >= 90 AS memory_warning, l_quantity + 50 >= 95 AS cpu_warning FROM lineitem""",
)
def resource_warnings(spark, sf):
    samples = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_quantity") * 2).alias("memory"), (F.col("l_quantity") + 50).alias("cpu"),
    )
    return A.threshold_flags(samples, "memory", "cpu")


@query(
    "A14",
    "SELECT user_id, round(arg_max(value, ts) - arg_min(value, ts), 6) AS value_delta FROM events GROUP BY user_id",
)
def usage_deltas(spark, sf):
    d = A.usage_delta(table(spark, sf, "events"), "user_id", "ts", "value")
    return d.select("user_id", F.round("value_delta", 6).alias("value_delta"))


# --- order, top-k, windows ---------------------------------------------------------------------

# Ledger rows with the last status before each.
_STEPS = f"""(SELECT *, lag(status IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ledger_seq) AS before FROM {D.LEDGER_SQL})"""
_JOBS = f"""(SELECT job_id, max(ledger_seq) AS ledger_seq, arg_max(batch_id, ledger_seq) AS batch_id,
    arg_max(status, ledger_seq) FILTER (status IS NOT NULL) AS status,
    arg_max(total_documents, ledger_seq) FILTER (total_documents IS NOT NULL) AS total_documents,
    arg_max(processed_documents, ledger_seq) FILTER (processed_documents IS NOT NULL) AS processed_documents,
    arg_max(error_message, ledger_seq) FILTER (error_message IS NOT NULL) AS error_message,
    min(happened) AS created_at, min(happened) FILTER (status = 'running') AS started_at, max(happened) FILTER (status = 'paused') AS paused_at,
    max(happened) FILTER (status = 'queued' AND before = 'paused') AS resumed_at,
    max(happened) FILTER (status IN ('completed', 'failed', 'cancelled')) AS completed_at, max(happened) AS updated_at
  FROM {_STEPS} GROUP BY job_id)"""


@query(
    "L1",
    f"""SELECT job_id, batch_id, {S('created_at')} AS created_at, (SELECT count(*) FROM {_JOBS} WHERE status = 'failed') AS total_count,
      CAST(3 AS BIGINT) AS page FROM {_JOBS} WHERE status = 'failed' ORDER BY created_at DESC, job_id LIMIT 25 OFFSET 50""",
)
def job_listing(spark, sf):
    page = B.list_jobs(B.fold_jobs(D.ledger(spark, sf)), status="failed", limit=25, offset=50)
    return page.select("job_id", "batch_id", stamp("created_at").alias("created_at"), "total_count", "page")


@query(
    "L1",
    f"SELECT job_id, status FROM {_JOBS} WHERE batch_id = 'batch-7' ORDER BY created_at DESC, job_id LIMIT 100",
)
def job_listing_by_batch(spark, sf):
    return B.list_jobs(B.fold_jobs(D.ledger(spark, sf)), batch_id="batch-7", limit=500).select("job_id", "status")


@query(
    "L3",
    """SELECT event_type, event_id FROM (SELECT event_type, event_id,
      row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 10000""",
)
def newest_events_per_stream(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id")
    return O.newest_per_group(e, ["event_type"], "event_id", fixed.STREAM_MAX_EVENTS)


@query(
    "L4",
    f"""SELECT job_id, seq, document_id, processed_documents, total_documents,
      round(processed_documents / total_documents * 100, 6) AS progress_percent FROM (
      SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq)::BIGINT AS processed_documents,
        count(*) OVER (PARTITION BY job_id) AS total_documents FROM {D.OUTCOMES})
    WHERE outcome = 'ok' AND processed_documents % 10 = 0""",
)
def progress_points(spark, sf):
    p = O.progress_points(D.outcomes(spark, sf), fixed.CHECKPOINT_INTERVAL)
    return p.select(
        "job_id", "seq", "document_id", "processed_documents", "total_documents",
        F.round("progress_percent", 6).alias("progress_percent"),
    )


@query(
    "L5 B1 B2 B3",
    f"""SELECT job_id, ledger_seq, batch_id, status, total_documents, processed_documents, error_message,
      round(processed_documents / total_documents * 100, 6) AS progress_percent, {S('created_at')} AS created_at,
      {S('started_at')} AS started_at, {S('paused_at')} AS paused_at, {S('resumed_at')} AS resumed_at,
      {S('completed_at')} AS completed_at, {S('updated_at')} AS updated_at
    FROM (SELECT * REPLACE (CAST(ledger_seq AS BIGINT) AS ledger_seq) FROM {_JOBS})""",
)
def job_states(spark, sf):
    j = B.fold_jobs(D.ledger(spark, sf))
    times = ["created_at", "started_at", "paused_at", "resumed_at", "completed_at", "updated_at"]
    return j.select(
        "job_id", "ledger_seq", "batch_id", "status", "total_documents", "processed_documents", "error_message",
        F.round("progress_percent", 6).alias("progress_percent"), *[stamp(t).alias(t) for t in times],
    )


@query(
    "L6",
    f"""SELECT job_id, CAST(ledger_seq AS BIGINT) AS ledger_seq, previous_status, status FROM (
      SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ledger_seq) AS previous_status
      FROM {D.LEDGER_SQL} WHERE status IS NOT NULL)
    WHERE previous_status IS NOT NULL AND previous_status || '>' || status NOT IN ('queued>running', 'running>completed',
      'running>paused', 'paused>queued', 'queued>cancelled', 'running>cancelled', 'running>failed', 'paused>cancelled')""",
)
def illegal_transitions(spark, sf):
    return B.transition_violations(D.ledger(spark, sf)).select("job_id", "ledger_seq", "previous_status", "status")


@query(
    "L6",
    f"""SELECT job_id, status = 'running' AS may_pause, status = 'paused' AS may_resume,
      status IN ('queued', 'running', 'paused') AS may_cancel FROM {_JOBS}""",
)
def allowed_actions(spark, sf):
    j = B.fold_jobs(D.ledger(spark, sf))
    return j.select(
        "job_id", *[B.allowed_action(F.col("status"), a).alias(f"may_{a}") for a in ("pause", "resume", "cancel")]
    )


# --- joins and sets ---------------------------------------------------------------------------------


def _batch(spark, sf):
    return table(spark, sf, "documents").select(F.lit("job-1").alias("job_id"), F.col("doc_id").alias("document_id"), "source")


def _done(spark, sf):
    return table(spark, sf, "labels").select(F.lit("job-1").alias("job_id"), F.col("doc_id").alias("document_id"))


@query("J1", "SELECT doc_id AS document_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_skips_processed(spark, sf):
    return J.skip_processed(_batch(spark, sf), _done(spark, sf)).select("document_id", "source")


@query(
    "J2",
    f"""SELECT job_id, document_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id, document_id ORDER BY seq) AS rn
      FROM {D.OUTCOMES} WHERE outcome = 'ok') WHERE rn = 1""",
)
def first_success_per_document(spark, sf):
    return J.first_success(D.outcomes(spark, sf)).select("job_id", "document_id", "seq")


@query("J3", "SELECT doc_id AS document_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def processed_membership(spark, sf):
    return J.only_processed(_batch(spark, sf), _done(spark, sf)).select("document_id")


@query(
    "J4",
    """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN p_size % 3 = 0 THEN 'jsonl' ELSE 'jsonl|elasticsearch' END
      WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN 'jsonl' ELSE 'jsonl|elasticsearch' END
      WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN 'jsonl' ELSE 'elasticsearch' END ELSE 'jsonl' END AS sinks FROM part""",
)
def chosen_sinks(spark, sf):
    size = F.col("p_size")
    requested = (
        F.when(size % 4 == 0, F.lit(None).cast("array<string>"))
        .when(size % 4 == 1, F.array().cast("array<string>"))
        .when(size % 4 == 2, F.array(F.lit("postgresql"), F.lit("elasticsearch")))
        .otherwise(F.array(F.lit("postgresql")))
    )
    enabled = F.when(size % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("jsonl"), F.lit("elasticsearch")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(J.choose_sinks(requested, enabled), "|").alias("sinks"))


@query(
    "J5",
    "SELECT event_id, backend FROM events, (VALUES ('redis_streams'), ('webhook'), ('kafka')) b(backend)",
)
def event_fan_out(spark, sf):
    return EV.fan_out(table(spark, sf, "events").select("event_id"), D.BACKENDS)


# --- ledger ---------------------------------------------------------------------------------------------


@query(
    "B1",
    """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, strftime(o_orderdate, 'batch_%Y%m%d_%H%M%S') AS batch_id, 'queued' AS status,
      CAST(o_custkey AS BIGINT) AS total_documents, CAST(0 AS BIGINT) AS processed_documents FROM orders""",
)
def created_jobs(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
        F.col("o_custkey").alias("total_documents"),
    )
    return B.create_jobs(o).select("job_id", "batch_id", "status", "total_documents", "processed_documents")


@query(
    "B2 B3 L5",
    f"""SELECT job_id, CASE WHEN status IN ('paused', 'running', 'queued') THEN 'cancelled' ELSE status END AS status,
      CASE WHEN status IN ('paused', 'running', 'queued') THEN '2030-01-01 00:00:00.000000' ELSE {S('completed_at')} END AS completed_at FROM {_JOBS}""",
)
def cancelled_open_jobs(spark, sf):
    """Cancel every job that may be cancelled through the ledger, then fold again."""
    ledger = D.ledger(spark, sf)
    jobs = B.fold_jobs(ledger)
    at = F.lit("2030-01-01 00:00:00").cast("timestamp")
    change = B.change_status(jobs.filter(B.allowed_action(F.col("status"), "cancel")), "cancelled", at)
    after = B.fold_jobs(B.as_ledger(ledger).unionByName(change))
    return after.select("job_id", "status", stamp("completed_at").alias("completed_at"))


@query(
    "B3",
    f"""SELECT j.job_id, o.processed AS processed_documents, o.failed AS failed_documents,
      round(o.processed / j.total_documents * 100, 6) AS progress_percent FROM {_JOBS} j JOIN (
      SELECT job_id, count(*) FILTER (outcome = 'ok') AS processed, count(*) FILTER (outcome <> 'ok') AS failed
      FROM {D.OUTCOMES} GROUP BY job_id) o USING (job_id)""",
)
def recorded_progress(spark, sf):
    ledger = B.as_ledger(D.ledger(spark, sf))
    totals = A.job_totals(D.outcomes(spark, sf))
    rows = B.record_progress(B.fold_jobs(ledger), totals, F.lit("2030-01-01").cast("timestamp"))
    after = B.fold_jobs(ledger.unionByName(rows)).join(totals.select("job_id"), "job_id", "left_semi")
    return after.select("job_id", "processed_documents", "failed_documents", F.round("progress_percent", 6).alias("progress_percent"))


@query(
    "B4",
    """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 'origin=final|priority=' || o_orderpriority || '|worker=' || o_orderkey % 7 AS metadata
    FROM orders""",
)
def merged_metadata(spark, sf):
    m = B.merge_metadata(D.ledger(spark, sf))
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return m.select("job_id", F.array_join(pairs, "|").alias("metadata"))


def _checkpoints(spark, sf):
    points = O.progress_points(D.outcomes(spark, sf), fixed.CHECKPOINT_INTERVAL)
    return B.checkpoint_rows(points, F.col("at"))


_POINTS = f"""(SELECT job_id, processed_count, document_id AS last_processed_doc_id, happened FROM (
  SELECT *, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq)::BIGINT AS processed_count
  FROM {D.OUTCOMES}) WHERE outcome = 'ok' AND processed_count % 10 = 0)"""


@query(
    "B5",
    f"""SELECT job_id, max(processed_count) AS processed_count,
      arg_max(last_processed_doc_id, processed_count) AS last_processed_doc_id FROM {_POINTS} GROUP BY job_id""",
)
def latest_checkpoints(spark, sf):
    return B.latest_checkpoints(_checkpoints(spark, sf)).select("job_id", "processed_count", "last_processed_doc_id")


@query(
    "B6",
    f"""SELECT job_id, processed_count FROM {_POINTS}
    WHERE happened >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS""",
)
def live_checkpoints(spark, sf):
    as_of = table(spark, sf, "events").agg(F.max("ts")).scalar()
    return B.expire_checkpoints(_checkpoints(spark, sf), as_of).select("job_id", "processed_count")


@query(
    "B6",
    f"""SELECT job_id, document_id FROM {D.OUTCOMES} WHERE job_id IN (SELECT job_id FROM {D.OUTCOMES} GROUP BY job_id
      HAVING max(happened) >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)""",
)
def live_processed_sets(spark, sf):
    as_of = table(spark, sf, "events").agg(F.max("ts")).scalar()
    done = D.outcomes(spark, sf).select("job_id", "document_id", F.col("at").alias("processed_at"))
    return B.expire_processed(done, as_of, 3600).select("job_id", "document_id")


@query(
    "B7",
    f"SELECT p.job_id, p.processed_count FROM {_POINTS} p WHERE p.job_id NOT IN (SELECT job_id FROM {_JOBS} WHERE status = 'completed')",
)
def cleared_checkpoints(spark, sf):
    jobs = B.fold_jobs(D.ledger(spark, sf))
    return B.clear_finished(_checkpoints(spark, sf), jobs).select("job_id", "processed_count")


@query(
    "B8",
    f"""SELECT j.job_id, j.status, j.error_message, o.processed, o.failed FROM {_JOBS} j LEFT JOIN (
      SELECT job_id, count(*) FILTER (outcome = 'ok') AS processed, count(*) FILTER (outcome <> 'ok') AS failed
      FROM {D.OUTCOMES} GROUP BY job_id) o ON j.job_id = o.job_id WHERE j.status IN ('completed', 'paused', 'cancelled', 'failed')""",
)
def batch_outcomes(spark, sf):
    jobs = B.fold_jobs(D.ledger(spark, sf))
    totals = A.job_totals(D.outcomes(spark, sf))
    return B.batch_outcomes(jobs, totals).select("job_id", "status", "error_message", "processed", "failed")


@query(
    "K8",
    """SELECT CAST(o_orderkey AS VARCHAR) AS job_id, 1 AS stage, 'cleaning' AS stage_name,
      'origin=api|priority=' || o_orderpriority || '|stage=1|stage_name=cleaning' AS metadata FROM orders""",
)
def registered_jobs(spark, sf):
    created = D.ledger(spark, sf).filter("ledger_seq = 0")
    r = B.register_jobs(created, 1, "cleaning")
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return r.select("job_id", "stage", "stage_name", F.array_join(pairs, "|").alias("metadata"))


# --- events -----------------------------------------------------------------------------------------------

_EVENTS = f"""(SELECT *, 'cleaning.' || kind AS type, sha256(job_id || '|cleaning.' || kind || '|' || ledger_seq) AS id,
    strftime(happened, '%Y-%m-%dT%H:%M:%S.%fZ') AS time, 'job/' || job_id AS subject FROM (
  SELECT *, CASE WHEN status = 'running' THEN 'job.started' WHEN status = 'queued' AND before = 'paused' THEN 'job.resumed'
      WHEN status IN ('paused', 'completed', 'failed', 'cancelled') THEN 'job.' || status
      WHEN status IS NULL AND processed_documents IS NOT NULL THEN 'job.progress' END AS kind
  FROM {_STEPS}) WHERE kind IS NOT NULL)"""
_DATA = """'{"job_id":"' || job_id || '","batch_id":"' || batch_id || '"' ||
  CASE WHEN processed_documents IS NOT NULL THEN ',"documents_processed":"' || processed_documents || '"' ELSE '' END ||
  CASE WHEN error_message IS NOT NULL THEN ',"error":"' || error_message || '"' ELSE '' END || '}'"""
_BODY = f"""'{{"specversion":"1.0","type":"' || type || '","source":"cleaning-stage","id":"' || id || '","time":"' || time ||
  '","subject":"' || subject || '","datacontenttype":"application/json","data":' || {_DATA} || '}}'"""


def _lifecycle(spark, sf):
    return EV.build_events(D.ledger(spark, sf))


@query("ST1", f"SELECT id, type, time, subject FROM {_EVENTS}")
def lifecycle_events(spark, sf):
    return _lifecycle(spark, sf).select("id", "type", "time", "subject")


@query("ST2", f"SELECT id, {_BODY} AS body FROM {_EVENTS}")
def event_bodies(spark, sf):
    return _lifecycle(spark, sf).select("id", EV.event_json().alias("body"))


@query("ST3", f"SELECT id, type FROM {_EVENTS} WHERE kind IN ('job.failed', 'job.paused')")
def wanted_events(spark, sf):
    return EV.filter_events(_lifecycle(spark, sf), ["job.failed", "cleaning.job.paused"]).select("id", "type")


_HEADERS = "'ce-id=' || id || '|ce-source=cleaning-stage|ce-specversion=1.0'"


@query(
    "K10 J5",
    f"""SELECT event_id, backend, attempt, CASE WHEN backend = 'webhook' THEN {_DATA} ELSE {_BODY} END AS body,
      CASE WHEN backend = 'webhook' THEN 'Content-Type=application/json|' || {_HEADERS} || '|ce-subject=' || subject || '|ce-time=' || time || '|ce-type=' || type
        ELSE {_HEADERS} || '|ce-type=' || type END AS headers,
      CASE WHEN backend = 'redis_streams' THEN 'data=' || {_DATA} || '|datacontenttype=application/json|id=' || id ||
        '|source=cleaning-stage|specversion=1.0|subject=' || subject || '|time=' || time || '|type=' || type END AS fields
    FROM (SELECT *, id AS event_id, 1 AS attempt FROM {_EVENTS}, (VALUES ('redis_streams'), ('webhook'), ('kafka')) b(backend))""",
)
def event_outbox(spark, sf):
    def flat(c):
        pairs = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.array_join(pairs, "|")

    box = EV.outbox(_lifecycle(spark, sf), D.BACKENDS)
    return box.select("event_id", "backend", "attempt", "body", flat("headers").alias("headers"), flat("fields").alias("fields"))


_ATTEMPTS = """(SELECT event_id, CAST(event_id % 3 + 1 AS INTEGER) AS attempt,
  CAST(CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 429 WHEN 4 THEN 500 WHEN 5 THEN 204 ELSE 302 END AS INTEGER) AS status
  FROM events)"""


def _attempts(spark, sf):
    statuses = F.array(*[F.lit(s).cast("int") for s in (None, 200, 404, 429, 500, 204, 302)])
    return table(spark, sf, "events").select(
        "event_id",
        (F.col("event_id") % 3 + 1).cast("int").alias("attempt"),
        F.get(statuses, F.pmod("event_id", F.lit(7)).cast("int")).alias("status"),
    )


@query(
    "K11",
    f"""SELECT event_id, attempt + 1 AS attempt, CAST(pow(2, attempt) AS BIGINT) AS delay_seconds FROM {_ATTEMPTS}
    WHERE attempt < 3 AND (status IS NULL OR status IN (429, 500, 302))""",
)
def deliveries_due_again(spark, sf):
    return EV.due_again(_attempts(spark, sf)).select("event_id", "attempt", "delay_seconds")


@query(
    "K11 ST6",
    f"""SELECT event_id, attempt, status FROM {_ATTEMPTS}
    WHERE status = 404 OR (attempt >= 3 AND (status IS NULL OR status IN (429, 500, 302)))""",
)
def exhausted_deliveries(spark, sf):
    return EV.exhausted(_attempts(spark, sf))


@query("A5 J5", f"SELECT event_id, bool_or(success) AS published FROM {_DELIVERIES} GROUP BY event_id")
def published_events(spark, sf):
    return EV.published(_deliveries(spark, sf))


@query(
    "ST5",
    "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS",
)
def event_backlog(spark, sf):
    as_of = table(spark, sf, "events").agg(F.max("ts")).scalar()
    return EV.backlog(table(spark, sf, "events"), "ts", as_of, 24).select("event_id")


def _sessions_sql(key: str, gap: str) -> str:
    part = f"PARTITION BY {key} " if key else ""
    lead = f"{key}, " if key else ""
    return f"""SELECT {lead}{S('min(ts)')} AS session_start, {S('max(ts)')} AS last_activity,
      {S(f"max(ts) + INTERVAL {gap}")} AS idle_from, count(*) AS events FROM (
      SELECT *, sum(opens) OVER ({part}ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER ({part}ORDER BY ts, event_id) < INTERVAL {gap} THEN 0 ELSE 1 END AS opens FROM events))
      GROUP BY {lead}s"""


@query("ST7", _sessions_sql("user_id", "1 HOUR"))
def idle_sessions_by_user(spark, sf):
    s = O.activity_sessions(table(spark, sf, "events"), "ts", 3600, "user_id")
    times = ["session_start", "last_activity", "idle_from"]
    return s.select("user_id", *[stamp(t).alias(t) for t in times], "events")


@query("ST7", _sessions_sql("", "300 SECONDS"))
def idle_sessions_overall(spark, sf):
    """One clock for the whole system."""
    s = O.activity_sessions(table(spark, sf, "events"), "ts", fixed.IDLE_SECONDS)
    return s.select(*[stamp(t).alias(t) for t in ["session_start", "last_activity", "idle_from"]], "events")
