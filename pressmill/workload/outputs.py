"""Sinks and streams: each query writes to its own folder below the shared one and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pressmill.functions.cleaning import clean_text
from pressmill.functions.counts import count_words
from pressmill.operators import events as EV
from pressmill.operators.stats import windowed_traffic
from pressmill.operators.validate import error_rows
from pressmill.plans.article import process_articles
from pressmill.plans.batch_run import run_batches
from pressmill.plans.file_run import check_lines, process_files
from pressmill.plans.managed import JobStore, run_jobs
from pressmill.operators.stats import run_summary as summarise
from pressmill.session import new_shared_path, written
from pressmill.sinks import deliver, files
from pressmill.sinks.upsert import KeyedTable, merge_latest, registry_rows
from pressmill.sources.lines import stream_lines, stream_table
from pressmill.streaming import runs
from pressmill.workload import derived as D
from pressmill.workload.base import query
from pressmill.workload.derived import stamp, table
from pressmill.workload.enrich import articles

S = D.sql_stamp
_AS_OF = "2024-06-01"


def _as_of():
    return F.lit(_AS_OF).cast("date")


# --- sinks -----------------------------------------------------------------------------------


@query(
    "K1",
    "SELECT '2024-01-0' || (1 + doc_id % 3) AS ingest_date, doc_id, text FROM documents UNION ALL "
    "SELECT '2024-01-03', page_id + 1000000000, url FROM pages",
)
def daily_json_lines(spark, sf):
    """Three runs, one of them twice; none takes away what another wrote."""
    path = new_shared_path(spark, "daily")
    day = F.concat(F.lit("2024-01-0"), (F.col("doc_id") % 3 + 1).cast("string"))
    files.append_daily(table(spark, sf, "documents").select("doc_id", "text").where("doc_id % 2 = 0"), path, day, "even")
    files.append_daily(table(spark, sf, "documents").select("doc_id", "text").where("doc_id % 2 = 1"), path, day, "odd")
    more = table(spark, sf, "pages").select((F.col("page_id") + 1000000000).alias("doc_id"), F.col("url").alias("text"))
    for _ in range(2):
        files.append_daily(more, path, F.lit("2024-01-03"), "pages")
    return spark.read.schema("doc_id bigint, text string, ingest_date string").json(path).drop("run")


@query(
    "K2 E11",
    f"""SELECT 'd' || doc_id AS document_id, '1.0' AS version, {D.sql_clean("CASE WHEN kind IN (2, 3) THEN " + D.sql_json_unicode('body') + " WHEN kind = 4 THEN body || '\"' ELSE body END")} AS cleaned_text
    FROM {D.RAW_LINES} WHERE kind IN (0, 1, 2, 3, 4, 7)""",
)
def processed_files(spark, sf):
    """Text files in, result files out: the whole file run."""
    source = new_shared_path(spark, "input")
    D.raw_lines(spark, sf).select("value").write.text(source)
    target = new_shared_path(spark, "results")
    process_files(spark, source, target, _as_of())
    schema = "document_id string, version string, processed_data struct<cleaned_text: string>"
    out = spark.read.schema(schema).json(target)
    return out.select("document_id", "version", "processed_data.cleaned_text")


@query(
    "K6",
    "SELECT CASE WHEN kind = 5 THEN 'JSONDecodeError' ELSE 'ValidationError' END AS error_type, count(*) AS n, max(total) AS total_errors"
    f" FROM {D.RAW_LINES}, (SELECT count(*) AS total FROM {D.RAW_LINES} WHERE kind IN (5, 8, 9, 10)) WHERE kind IN (5, 8, 9, 10) GROUP BY ALL",
)
def error_report(spark, sf):
    tagged = written(check_lines(D.raw_lines(spark, sf)).drop("document"), "checked")
    path = new_shared_path(spark, "report")
    files.write_error_report(error_rows(tagged), summarise(tagged), path)
    total = spark.read.schema("total_errors bigint").json(f"{path}/summary").agg(F.max("total_errors")).scalar()
    errors = spark.read.schema("error_type string").json(f"{path}/errors")
    return errors.groupBy("error_type").agg(F.count("*").alias("n")).withColumn("total_errors", total)


@query(
    "K3",
    f"""SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'relabelled' ELSE source END AS source,
      CASE WHEN doc_id >= 0 THEN '2024-01-01 00:00:00.000000' ELSE '2024-01-02 00:00:00.000000' END AS created_at FROM documents
    UNION ALL SELECT -1 - page_id, url, '2024-01-02 00:00:00.000000' FROM pages""",
)
def upserted_table(spark, sf):
    """Version 1 replaces the labelled documents and adds the pages; first-written times stay."""
    t = KeyedTable(spark, new_shared_path(spark, "upsert"), ["doc_id"])
    first = table(spark, sf, "documents").select("doc_id", "source", F.lit(0).alias("seq"))
    t.upsert(first, 1, F.lit("2024-01-01").cast("timestamp"), "seq")
    relabelled = table(spark, sf, "labels").select("doc_id").distinct().join(table(spark, sf, "documents"), "doc_id").select("doc_id", F.lit("relabelled").alias("source"), F.lit(2).alias("seq"))
    # an earlier row of the same keys in the same write, which loses
    relabelled = relabelled.unionByName(relabelled.select("doc_id", F.lit("draft").alias("source"), F.lit(1).alias("seq")))
    pages = table(spark, sf, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("url").alias("source"), F.lit(1).alias("seq"))
    t.upsert(relabelled.unionByName(pages), 2, F.lit("2024-01-02").cast("timestamp"), "seq")
    compacted = t.compact(new_shared_path(spark, "compacted"))
    return compacted.current().select("doc_id", "source", stamp("created_at").alias("created_at"))


@query(
    "K3",
    """SELECT o_custkey AS k, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey
    UNION ALL SELECT -1 - s_suppkey, s_acctbal FROM supplier""",
)
def merged_latest_rows(spark, sf):
    """The last row per key wins; keys only in the old table stay."""
    old = table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("k"), F.col("s_acctbal").alias("price"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return merge_latest(old, new, ["k"], "o_orderkey")


@query(
    "K4",
    "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 = 3 THEN 'rejected' END AS error, true AS within_limit FROM documents",
)
def bulk_requests(spark, sf):
    """Requests of at most 500 rows; a stand-in for the index rejects some ids."""

    def send(ids, bodies):
        return ["rejected" if i.endswith("3") else None for i in ids]

    out = deliver.bulk_deliver(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", send)
    rows = out.select((F.col("rows") <= 500).alias("within_limit"), F.explode("outcomes").alias("o"))
    return rows.select("o.id", "o.error", "within_limit")


@query(
    "K5",
    """SELECT sink, success, n FROM (VALUES ('jsonl', true), ('search', false), ('parquet', true)) s(sink, success),
      (SELECT count(*) AS n FROM documents) WHERE success UNION ALL SELECT 'search', false, 0""",
)
def isolated_sinks(spark, sf):
    """A sink that fails leaves the others alone."""
    jsonl, parquet = new_shared_path(spark, "sink"), new_shared_path(spark, "sink")

    def broken(df):
        raise ConnectionError("unreachable")

    rows = table(spark, sf, "documents").select("doc_id", "text")
    out = deliver.write_everywhere(
        rows,
        {
            "jsonl": lambda df: df.write.json(jsonl),
            "search": broken,
            "parquet": lambda df: df.write.parquet(parquet),
        },
    )
    counts = (
        spark.read.schema("doc_id bigint").json(jsonl).select(F.lit("jsonl").alias("sink"))
        .unionByName(spark.read.parquet(parquet).select(F.lit("parquet").alias("sink")))
        .groupBy("sink")
        .agg(F.count("*").alias("n"))
    )
    return out.join(counts, "sink", "left").select("sink", "success", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "K7",
    "SELECT 'doc-' || doc_id AS document_id, 'job-' || doc_id % 5 AS job_id, 'Title ' || source || '!' AS title, true AS whole FROM documents",
)
def metadata_registry(spark, sf):
    """The same records written twice stay one row per document and job."""
    rows = process_articles(articles(spark, sf), _as_of())
    job = F.concat(F.lit("job-"), (F.substring("document_id", 5, 20).cast("bigint") % 5).cast("string"))
    reg = written(registry_rows(rows, job), "registry")
    t = KeyedTable(spark, new_shared_path(spark, "registry-table"), ["document_id", "job_id"])
    for version in (1, 2):
        t.upsert(reg.withColumn("seq", F.lit(version)), version, F.lit("2024-01-01").cast("timestamp"), "seq")
    whole = F.get_json_object("full_data", "$.version") == "1.0"
    return t.current().select("document_id", "job_id", "title", whole.alias("whole"))


@query(
    "K9",
    "SELECT CAST(event_id AS VARCHAR) AS key, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS value FROM events",
)
def topic_messages(spark, sf):
    body = F.to_json(F.struct("event_id", "event_type"))
    return deliver.topic_rows(table(spark, sf, "events").withColumn("body", body), "event_id")


# --- managed batches -----------------------------------------------------------------------------


def _batches(spark, sf):
    """One batch per document: its lines as articles, repeats and empty ids among them."""
    d = table(spark, sf, "documents")
    lines = F.split(D._plain(F.col("text")), "\\. ")
    items = F.transform(
        lines,
        lambda s, i: F.struct(
            F.when(i % 5 != 4, F.concat(F.lit("s"), (i % 7).cast("string"))).alias("document_id"), s.alias("text")
        ),
    )
    return d.select(F.col("doc_id").cast("string").alias("job_id"), F.to_json(items).alias("documents"))


_ITEMS = """(SELECT CAST(doc_id AS VARCHAR) AS job_id, unnest(parts) AS text, unnest(range(len(parts))) AS seq FROM (
  SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x1f"\\\\\\x7f]', ' ', 'g'), '. ') AS parts FROM documents))"""
_WINNERS = f"""(SELECT job_id, 's' || seq % 7 AS document_id, min(seq) AS seq FROM {_ITEMS} WHERE seq % 5 <> 4 GROUP BY ALL)"""


@query(
    "3.3 S3 V1 J1 J2",
    f"""SELECT w.job_id, w.document_id, w.seq, {D.sql_clean('i.text')} AS cleaned_text FROM {_WINNERS} w
    JOIN {_ITEMS} i ON w.job_id = i.job_id AND w.seq = i.seq WHERE w.document_id <> 's3'""",
)
def processed_batches(spark, sf):
    """Whole batches; documents called s3 were processed before."""
    b = _batches(spark, sf)
    done = b.select("job_id", F.lit("s3").alias("document_id"))
    run = run_batches(b, done, _as_of())
    return run.processed.select("job_id", "document_id", F.col("seq").cast("bigint").alias("seq"), "cleaned_text")


@query(
    "A3 B8",
    f"""SELECT job_id, count(DISTINCT CASE WHEN seq % 5 <> 4 THEN seq % 7 END) AS processed,
      count(*) FILTER (seq % 5 = 4) AS failed FROM {_ITEMS} GROUP BY job_id""",
)
def batch_totals(spark, sf):
    return run_batches(_batches(spark, sf), None, _as_of()).totals.select("job_id", "processed", "failed")


# --- streams --------------------------------------------------------------------------------------


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = stream_table(spark, f"{sf}/events.parquet", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(spark, stream, label):
    return runs.run_available(stream, new_shared_path(spark, label), new_shared_path(spark, f"{label}-progress"))


@query(
    "S5",
    "SELECT kind IN (0, 7, 8, 9, 10) AS sound, kind = 6 AS blank, count(*) AS n FROM " + D.RAW_LINES + " GROUP BY ALL",
)
def streamed_lines(spark, sf):
    """New files of lines, parsed as they arrive."""
    from pressmill.operators.repair import parse_strict
    from pressmill.sources.lines import is_blank

    folder = new_shared_path(spark, "arrivals")
    D.raw_lines(spark, sf).repartition(4).select("value").write.text(folder)
    lines = stream_lines(spark, folder, files_per_batch=2)
    parsed = lines.select(
        parse_strict(F.col("value")).isNotNull().alias("sound"), is_blank(F.col("value")).alias("blank")
    )
    return _run(spark, parsed, "lines").groupBy("sound", "blank").agg(F.count("*").alias("n"))


@query("ST3", "SELECT event_id FROM events WHERE event_type IN ('error', 'click')")
def streamed_filter(spark, sf):
    stream = _events(spark, sf).withColumnRenamed("event_type", "type")
    return _run(spark, EV.filter_events(stream, ["error", "click"]).select("event_id"), "filtered")


@query("ST4", "SELECT event_id, event_type FROM events")
def streamed_dedup(spark, sf):
    """Every event arrives twice and comes out once."""
    twice = _events(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return _run(spark, runs.drop_repeats(twice, "ts", "event_id").select("event_id", "event_type"), "dedup")


@query("ST5", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 48 HOURS")
def streamed_backlog(spark, sf):
    recent = runs.recent(_events(spark, sf), "ts", F.lit("2024-01-15").cast("timestamp"), 48)
    return _run(spark, recent.select("event_id"), "backlog")


@query(
    "ST6",
    """SELECT 'retry' AS target, event_id, CAST(a + 1 AS INTEGER) AS attempt FROM (SELECT event_id, event_id % 3 + 1 AS a FROM events)
      WHERE event_id % 4 = 0 AND a < 3
    UNION ALL SELECT 'dead', event_id, CAST(a AS INTEGER) FROM (SELECT event_id, event_id % 3 + 1 AS a FROM events)
      WHERE event_id % 4 = 1 OR (event_id % 4 = 0 AND a >= 3)""",
)
def streamed_dead_letters(spark, sf):
    status = F.when(F.col("event_id") % 4 == 0, 503).when(F.col("event_id") % 4 == 1, 404).otherwise(200)
    attempts = _events(spark, sf).select(
        "event_id", (F.col("event_id") % 3 + 1).cast("int").alias("attempt"), status.alias("status")
    )
    retry, dead = new_shared_path(spark, "retry"), new_shared_path(spark, "dead")
    handle = runs.split_failures(retry, dead)
    query = (
        attempts.writeStream.foreachBatch(handle)
        .option("checkpointLocation", new_shared_path(spark, "split-progress"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "event_id bigint, attempt int"
    back = [(spark.read.schema(schema).parquet(p), n) for p, n in ((retry, "retry"), (dead, "dead"))]
    a, b = [df.select(F.lit(n).alias("target"), "event_id", "attempt") for df, n in back]
    return a.unionByName(b)


_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES FROM events)"


@query(
    "ST7",
    f"""SELECT user_id, session_start, idle_from, events FROM (
      SELECT user_id, {S('min(ts)')} AS session_start, {S('max(ts) + INTERVAL 1 HOUR')} AS idle_from,
        max(ts) + INTERVAL 1 HOUR AS closes, count(*) AS events FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens
        FROM events)) GROUP BY user_id, s) WHERE closes <= {_CLOSED}""",
)
def streamed_idle_sessions(spark, sf):
    """Sessions whose gap the watermark has passed."""
    sessions = runs.idle_sessions(_events(spark, sf), "ts", "user_id", gap_seconds=3600)
    out = _run(spark, sessions, "sessions")
    return out.select("user_id", stamp("session_start").alias("session_start"), stamp("idle_from").alias("idle_from"), "events")


_BIN = "time_bucket(INTERVAL 5 MINUTES, ts, TIMESTAMP '2000-01-01')"


@query(
    "ST10 A8 A10",
    f"""SELECT {S(_BIN)} AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors
    FROM events GROUP BY {_BIN} HAVING {_BIN} + INTERVAL 5 MINUTES <= {_CLOSED}""",
)
def streamed_traffic(spark, sf):
    live = runs.live_traffic(_events(spark, sf), "ts", is_error=F.col("event_type") == "error")
    out = _run(spark, live, "traffic")
    return out.select(stamp("window_start").alias("window_start"), "requests", "errors")


@query(
    "ST8 ST9",
    f"""SELECT doc_id, CASE WHEN c <> '' THEN length(c) - length(replace(c, ' ', '')) + 1 END AS words
    FROM (SELECT doc_id, {D.sql_clean('text')} AS c FROM documents)""",
)
def paused_and_resumed_stream(spark, sf):
    """A job paused before its third micro-batch and resumed: every document once, none lost."""
    folder = new_shared_path(spark, "job-input")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs.repartition(6).write.parquet(folder)
    target, progress = new_shared_path(spark, "job-output"), new_shared_path(spark, "job-progress")
    work = runs.append_once(
        spark,
        lambda df: df.select("doc_id", count_words(clean_text(F.col("text"))).alias("words")),
        target,
        ("doc_id",),
    )
    seen: list[int] = []

    def control():
        status = "paused" if len(seen) == 2 else "running"
        return spark.createDataFrame([("job", 1, status)], "job_id string, ledger_seq int, status string")

    def handle(batch, number):
        work(batch, number)
        seen.append(number)

    def stream():
        return stream_table(spark, folder, docs.schema, files_per_batch=2)

    first = runs.run_controlled(stream(), handle, progress, control, "job")
    seen.append(-1)
    second = runs.run_controlled(stream(), handle, progress, control, "job")
    if (first, second) != ("paused", "completed"):
        raise RuntimeError(f"unexpected run states: {first}, {second}")
    return spark.read.parquet(target).select("doc_id", "words")


_PAUSED = "source IN ('src1', 'src3')"
_STEPS_OF_A_PAUSED_JOB = "job.started|job.paused|job.progress|job.resumed|job.started|job.progress|job.completed"


@query(
    "B1 B2 B3 B5 A3 ST1 ST8 J1 J2 L5",
    f"""SELECT source AS job_id, 'completed' AS status, count(*) AS total_documents,
      count(*) FILTER (doc_id % 10 <> 3) AS processed_documents, count(*) FILTER (doc_id % 10 = 3) AS failed_documents,
      {_PAUSED} AS resumed, CASE WHEN {_PAUSED} THEN '{_STEPS_OF_A_PAUSED_JOB}'
        ELSE 'job.started|job.progress|job.progress|job.completed' END AS steps,
      CAST(2 AS BIGINT) AS checkpoints, count(*) FILTER (doc_id % 10 <> 3) AS results
    FROM documents GROUP BY source""",
)
def managed_jobs(spark, sf):
    """A job for each source; two are paused while their first slice is worked on, and resumed."""
    rows = articles(spark, sf).withColumn("seq", F.substring("document_id", 5, 20).cast("bigint"))
    rows = rows.withColumn("job_id", F.col("author")).withColumn("outcome", F.when(F.col("seq") % 10 == 3, "validation_error").otherwise("ok"))
    store = JobStore(spark, new_shared_path(spark, "jobs"))
    clock = iter(range(1000))

    def now():
        return F.timestamp_seconds(F.lit(1704067200 + next(clock)))

    totals = rows.groupBy("job_id").agg(F.count("*").alias("total_documents"))
    store.queue(totals.withColumn("at", now()))
    chosen = F.col("job_id").isin("src1", "src3")
    run_jobs(store, rows, _as_of(), now, 2, during=lambda k: store.act("pause", now(), chosen) if k == 0 else None)
    stopped = store.jobs().filter(chosen & (F.col("status") != "paused"))
    if not stopped.isEmpty():
        raise AssertionError("a paused job went on")
    store.act("resume", now(), chosen)
    run_jobs(store, rows, _as_of(), now, 2)
    kinds = store.events().select(F.substring_index("subject", "/", -1).alias("job_id"), "time", F.expr("substring(type, 10)").alias("kind"))
    steps = kinds.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "kind"))), lambda e: e["kind"]), "|").alias("steps"))
    points = store.checkpoints().groupBy("job_id").agg(F.count("*").alias("checkpoints"))
    results = store.results().groupBy("job_id").agg(F.count("*").alias("results"))
    jobs = store.jobs().select("job_id", "status", "total_documents", "processed_documents", "failed_documents", "resumed")
    out = jobs.join(steps, "job_id").join(points, "job_id").join(results, "job_id", "left")
    return out.withColumn("results", F.coalesce("results", F.lit(0)))


class _Killed(BaseException):
    """The driver of a run goes away."""


_STEPS_OF_A_TAKEN_JOB = "job.started|job.progress|job.started|job.progress|job.completed"


@query(
    "B1 B2 B3 B5 ST1 J1 J2 K2",
    f"""SELECT source AS job_id, CASE WHEN source < 'src5' THEN 'completed' ELSE 'failed' END AS status,
      CASE WHEN source >= 'src5' THEN 'ValueError: no space left' END AS error_message,
      CASE WHEN source < 'src5' THEN '{_STEPS_OF_A_TAKEN_JOB}' ELSE 'job.started|job.progress|job.failed' END AS steps,
      CASE WHEN source < 'src5' THEN count(*) FILTER (doc_id % 10 <> 3) END AS results,
      CASE WHEN source < 'src5' THEN count(*) FILTER (doc_id % 10 <> 3) END AS documents
    FROM documents GROUP BY source""",
)
def interrupted_jobs(spark, sf):
    """A run that dies between a slice's results and its commit, taken over by another; and one whose slice fails."""
    rows = articles(spark, sf).withColumn("seq", F.substring("document_id", 5, 20).cast("bigint"))
    rows = rows.withColumn("job_id", F.col("author")).withColumn("outcome", F.when(F.col("seq") % 10 == 3, "validation_error").otherwise("ok"))
    store = JobStore(spark, new_shared_path(spark, "jobs"))
    clock = iter(range(1000))

    def now():
        return F.timestamp_seconds(F.lit(1704067200 + next(clock)))

    def stop(problem):
        def during(k):
            if k == 1:
                raise problem

        return during

    store.queue(rows.groupBy("job_id").agg(F.count("*").alias("total_documents")).withColumn("at", now()))
    taken, failing = rows.where("job_id < 'src5'"), rows.where("job_id >= 'src5'")
    try:
        run_jobs(store, taken, _as_of(), now, 2, during=stop(_Killed()), run="first")
    except _Killed:
        run_jobs(store, taken, _as_of(), now, 2, take_over="first")
    try:
        run_jobs(store, failing, _as_of(), now, 2, during=stop(ValueError("no space left")))
    except ValueError:
        pass  # told by the ledger
    kinds = store.events().select(F.substring_index("subject", "/", -1).alias("job_id"), "time", F.expr("substring(type, 10)").alias("kind"))
    steps = kinds.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "kind"))), lambda e: e["kind"]), "|").alias("steps"))
    results = store.results().where("job_id < 'src5'").groupBy("job_id").agg(F.count("*").alias("results"), F.count_distinct("document_id").alias("documents"))
    jobs = store.jobs().select("job_id", "status", "error_message")
    out = jobs.join(steps, "job_id").join(results, "job_id", "left")
    known = lambda c: F.when(F.col("status") == "completed", F.coalesce(c, F.lit(0))).alias(c)
    return out.select("job_id", "status", "error_message", "steps", known("results"), known("documents"))
