"""Lifecycle events: build, filter, serialise, fan out, retry.

Event types are ``<namespace>.<kind>``.  Namespace and source are parameters: set them to what
your consumers filter on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.functions import fixed
from pressmill.functions.binding import explode_rows
from pressmill.operators.ordered import chunk_of, with_previous

NAMESPACE = "cleaning"
SOURCE = "cleaning-stage"


def event_type(kind: Column, namespace: str = NAMESPACE) -> Column:
    return F.concat(F.lit(f"{namespace}."), kind)


def build_events(ledger: DataFrame, namespace: str = NAMESPACE, source: str = SOURCE) -> DataFrame:
    """One event per ledger row that starts, advances, pauses, resumes or ends a job.

    The id is a hash of job, type and ledger position, so building twice gives the same events.
    """
    # Rows without a status (progress) lie between changes of it and don't count as the one before.
    changes = ledger.filter(F.col("status").isNotNull())
    steps = with_previous(changes, ["job_id"], "ledger_seq", "status", "previous_status", chunk_of(F.col("ledger_seq")))
    others = ledger.filter(F.col("status").isNull()).withColumn("previous_status", F.lit(None).cast("string"))
    steps = steps.unionByName(others)
    return typed_events(steps, namespace, source)


def typed_events(steps: DataFrame, namespace: str = NAMESPACE, source: str = SOURCE) -> DataFrame:
    """Events of ledger rows that know the status before theirs (``previous_status``)."""
    kind = (
        F.when(F.col("status") == "running", "job.started")
        .when((F.col("status") == "queued") & (F.col("previous_status") == "paused"), "job.resumed")
        .when(
            F.col("status").isin("paused", "completed", "failed", "cancelled"),
            F.concat(F.lit("job."), F.col("status")),
        )
        .when(F.col("status").isNull() & F.col("processed_documents").isNotNull(), "job.progress")
    )
    typed = steps.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    payload = {
        "job_id": F.col("job_id"),
        "batch_id": F.col("batch_id"),
        "documents_processed": F.col("processed_documents").cast("string"),
        "documents_total": F.col("total_documents").cast("string"),
        "error": F.col("error_message"),
    }
    pairs = [x for name, value in payload.items() for x in (F.lit(name), value)]
    name = event_type(F.col("kind"), namespace)
    return typed.select(
        F.lit(fixed.SPEC_VERSION).alias("specversion"),
        name.alias("type"),
        F.lit(source).alias("source"),
        F.sha2(F.concat_ws("|", "job_id", name, F.col("ledger_seq").cast("string")), 256).alias("id"),
        F.date_format(
            F.to_utc_timestamp("at", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
        ).alias("time"),
        F.concat(F.lit("job/"), F.col("job_id")).alias("subject"),
        F.lit(fixed.CONTENT_TYPE).alias("datacontenttype"),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("data"),
    )


def filter_events(events: DataFrame, wanted: list[str] | None, namespace: str = NAMESPACE) -> DataFrame:
    """Events of the wanted types; no list means all.  Short (``job.paused``) and full names work."""
    if not wanted:
        return events
    names = {n if n.startswith(f"{namespace}.") else f"{namespace}.{n}" for n in wanted} | set(wanted)
    return events.filter(F.col("type").isin(sorted(names)))


def event_json() -> Column:
    """The event as JSON; fields that are NULL are absent."""
    return F.to_json(
        F.struct("specversion", "type", "source", "id", "time", "subject", "datacontenttype", "data")
    )


def http_headers() -> Column:
    """Headers of the binary HTTP form."""
    pairs = [
        ("ce-specversion", "specversion"),
        ("ce-type", "type"),
        ("ce-source", "source"),
        ("ce-id", "id"),
        ("ce-time", "time"),
        ("ce-subject", "subject"),
        ("Content-Type", "datacontenttype"),
    ]
    built = F.create_map(*[x for h, c in pairs for x in (F.lit(h), F.col(c))])
    return F.map_filter(built, lambda _, v: v.isNotNull() & (v != ""))


def message_headers() -> Column:
    """Headers of a queue message."""
    pairs = [("ce-specversion", "specversion"), ("ce-type", "type"), ("ce-source", "source"), ("ce-id", "id")]
    return F.create_map(*[x for h, c in pairs for x in (F.lit(h), F.col(c))])


def stream_fields() -> Column:
    """Flat fields of a stream entry: absent time and subject are empty, data is JSON text."""
    names = ["specversion", "type", "source", "id", "time", "subject", "datacontenttype"]
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(F.col(n), F.lit("")))]
    data = F.when(F.size("data") > 0, F.to_json("data"))
    built = F.create_map(*pairs, F.lit("data"), data)
    return F.map_filter(built, lambda _, v: v.isNotNull())


def fan_out(events: DataFrame, backends: list[str]) -> DataFrame:
    """Each event once per backend.  Backends are settings, so they are constants of the plan."""
    names = F.array(*[F.lit(b) for b in backends]) if backends else F.array().cast("array<string>")
    return events.withColumn("backend", F.explode(names))


def outbox(events: DataFrame, backends: list[str]) -> DataFrame:
    """Delivery rows: body, headers and, for stream backends, flat fields; the first attempt is due."""
    forms = events.select(
        F.col("id").alias("event_id"),
        event_json().alias("_body"),
        F.to_json("data").alias("_data"),
        http_headers().alias("_http"),
        message_headers().alias("_message"),
        stream_fields().alias("_fields"),
    )

    def delivery(backend: str) -> Column:
        webhook = backend == "webhook"
        fields = F.col("_fields") if "stream" in backend else F.lit(None).cast("map<string,string>")
        return F.struct(
            F.lit(backend).alias("backend"),
            F.lit(1).alias("attempt"),
            F.col("_data" if webhook else "_body").alias("body"),
            F.col("_http" if webhook else "_message").alias("headers"),
            fields.alias("fields"),
        )

    if not backends:
        return forms.select("event_id", delivery("none").alias("d")).select("event_id", "d.*").limit(0)
    # Each form is built once per event, and a row carries only the form its backend takes.
    rows = explode_rows(forms, F.array(*[delivery(b) for b in backends]), "d", "event_id")
    return rows.select("event_id", "d.*")


def is_retryable(status: Column) -> Column:
    """No status (time-out), 429 and anything that is neither 2xx nor 4xx may be tried again."""
    good = F.coalesce(status.between(200, 299), F.lit(False))
    client = F.coalesce(status.between(400, 499) & (status != 429), F.lit(False))
    return ~good & ~client


def due_again(attempts: DataFrame, limit: int = fixed.DELIVERY_ATTEMPTS) -> DataFrame:
    """Failed deliveries to try again, with the next attempt number and its delay in seconds."""
    retry = attempts.filter(is_retryable(F.col("status")) & (F.col("attempt") < limit))
    return retry.withColumn("delay_seconds", F.pow(F.lit(2), F.col("attempt")).cast("bigint")).withColumn(
        "attempt", F.col("attempt") + 1
    )


def exhausted(attempts: DataFrame, limit: int = fixed.DELIVERY_ATTEMPTS) -> DataFrame:
    """Failed deliveries that will not be tried again: the dead letters."""
    failed = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    return attempts.filter(failed & (~is_retryable(F.col("status")) | (F.col("attempt") >= limit)))


def published(outcomes: DataFrame) -> DataFrame:
    """Per event whether any backend took it."""
    return outcomes.groupBy("event_id").agg(F.bool_or("success").alias("published"))


def backlog(events: DataFrame, at: str, as_of: Column, hours: int) -> DataFrame:
    """Events not older than ``hours`` at ``as_of``."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return events.filter(age <= hours * 3_600_000_000)
