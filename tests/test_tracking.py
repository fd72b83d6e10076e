import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.operators import dedup as J
from pressmill.operators import events as EV
from pressmill.operators import jobs as B
from pressmill.operators import ordered as O
from pressmill.operators import stats as A
from pressmill.operators import validate as V

T0 = dt.datetime(2024, 1, 1)


def _ledger(spark, rows):
    """rows: (job, seq, status, total, processed, failed, error)"""
    df = spark.createDataFrame(
        [(j, s, T0 + dt.timedelta(minutes=s), "b", st, t, p, f, e) for j, s, st, t, p, f, e in rows],
        "job_id string, ledger_seq bigint, at timestamp, batch_id string, status string, total_documents bigint,"
        " processed_documents bigint, failed_documents bigint, error_message string",
    )
    return B.as_ledger(df)


def _path(job, *statuses):
    return [(job, i, s, 10 if i == 0 else None, None, None, None) for i, s in enumerate(statuses)]


LEGAL = [
    ("queued", "running", "completed"),
    ("queued", "running", "paused", "queued", "running", "completed"),
    ("queued", "cancelled"),
    ("queued", "running", "cancelled"),
    ("queued", "running", "failed"),
    ("queued", "running", "paused", "cancelled"),
]


def test_transitions(spark):
    rows = [r for i, p in enumerate(LEGAL) for r in _path(f"ok{i}", *p)]
    rows += _path("bad", "queued", "running", "completed", "running") + _path("worse", "queued", "completed")
    found = B.transition_violations(_ledger(spark, rows)).collect()
    assert sorted((r.job_id, r.previous_status, r.status) for r in found) == [
        ("bad", "completed", "running"), ("worse", "queued", "completed"),
    ]


def test_fold(spark):
    rows = [
        ("j", 0, "queued", 1000, 0, 0, None),
        ("j", 1, "running", None, None, None, None),
        ("j", 2, None, None, 455, 5, None),
        ("j", 3, "paused", None, None, None, None),
        ("j", 4, "queued", None, None, None, None),
    ]
    r = B.fold_jobs(_ledger(spark, rows)).first()
    assert (r.status, r.total_documents, r.processed_documents, r.failed_documents, r.progress_percent) == ("queued", 1000, 455, 5, 45.5)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    assert (r.created_at, r.started_at, r.paused_at, r.resumed_at, r.completed_at) == (at(0), at(1), at(3), at(4), None)


def test_listing_pages_and_cap(spark):
    rows = [(f"j{i:03}", 0, "queued", 1, 0, 0, None) for i in range(130)]
    jobs = B.fold_jobs(_ledger(spark, rows))
    page = B.list_jobs(jobs, limit=1000, offset=100).collect()
    assert len(page) == 30 and page[0].total_count == 130 and page[0].page == 2 and page[0].job_id == "j100"
    assert B.list_jobs(jobs, status="failed").count() == 0


def test_metadata_merge_later_wins(spark):
    df = spark.createDataFrame(
        [("j", 1, {"a": "1", "b": "1"}), ("j", 3, {"b": "3"}), ("j", 2, {"b": "2", "c": "2"}), ("k", 1, None)],
        "job_id string, ledger_seq int, metadata map<string,string>",
    )
    assert [(r.job_id, r.metadata) for r in B.merge_metadata(df).collect()] == [("j", {"a": "1", "b": "3", "c": "2"})]


def test_unknown_status_is_refused(spark):
    with pytest.raises(ValueError):
        B.change_status(B.fold_jobs(_ledger(spark, _path("j", "queued"))), "stopped", F.current_timestamp())


def test_checkpoints_expire_and_clear(spark):
    df = spark.createDataFrame(
        [("a", 10, T0), ("a", 20, T0 + dt.timedelta(hours=1)), ("b", 10, T0 - dt.timedelta(days=2))],
        "job_id string, processed_count int, at timestamp",
    )
    assert {(r.job_id, r.processed_count) for r in B.latest_checkpoints(df).collect()} == {("a", 20), ("b", 10)}
    as_of = F.lit(T0 + dt.timedelta(hours=24))
    assert {r.job_id for r in B.expire_checkpoints(df, as_of).collect()} == {"a"}
    done = spark.createDataFrame([("a", "completed")], "job_id string, status string")
    assert [r.job_id for r in B.clear_finished(df, done).collect()] == ["b"]


def _series(spark, n=1000):
    return spark.range(n).select(
        (F.col("id") % 3 == 0).cast("int").alias("g"), F.col("id").alias("seq"), (F.col("id") * 7 % 5).alias("v"),
        F.when(F.col("id") % 11 == 0, "bad").otherwise("ok").alias("outcome"),
    )


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_chunks_do_not_change_results(spark, width):
    df = _series(spark)
    w = Window.partitionBy("g").orderBy("seq")
    chunk = O.chunk_of(F.col("seq"), width)
    prev = O.with_previous(df, ["g"], "seq", "v", "p", chunk).withColumn("want", F.lag("v").over(w))
    assert prev.filter(~F.col("p").eqNullSafe(F.col("want"))).count() == 0 and prev.count() == 1000
    hit = F.col("outcome") == "ok"
    total = O.with_running_count(df, ["g"], "seq", hit, "n", chunk).withColumn(
        "want", F.sum(hit.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    assert total.filter(F.col("n") != F.col("want")).count() == 0 and total.count() == 1000


def test_newest_per_group_is_exact_under_skew(spark):
    df = _series(spark)
    got = {(r.g, r.seq) for r in O.newest_per_group(df, ["g"], "seq", 50, spread=4).collect()}
    rows = [(r.g, r.seq) for r in df.collect()]
    want = {(g, s) for g in (0, 1) for s in sorted(s for h, s in rows if h == g)[-50:]}
    assert got == want


def test_progress_points(spark):
    df = spark.createDataFrame([("j", i, f"d{i}", "bad" if i == 3 else "ok") for i in range(25)], "job_id string, seq bigint, document_id string, outcome string")
    points = O.progress_points(df, 10).orderBy("seq").collect()
    assert [(p.seq, p.processed_documents, p.progress_percent) for p in points] == [(10, 10, 40.0), (20, 20, 80.0)]


def test_sessions_split_at_exact_gap(spark):
    times = [0, 299, 598, 898, 1197, 5000]
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=s),) for s in times], "ts timestamp")
    s = O.activity_sessions(df, "ts", 300).orderBy("session_start").collect()
    assert [(r.events, (r.idle_from - T0).seconds) for r in s] == [(3, 898), (2, 1497), (1, 5300)]


def test_first_success(spark):
    rows = [("j", "a", 0, "bad"), ("j", "a", 1, "ok"), ("j", "a", 2, "ok"), ("j", "b", 3, "ok"), ("k", "a", 0, "ok"), ("j", "c", 4, "bad")]
    df = spark.createDataFrame(rows, "job_id string, document_id string, seq int, outcome string")
    assert {(r.job_id, r.document_id, r.seq) for r in J.first_success(df).collect()} == {("j", "a", 1), ("j", "b", 3), ("k", "a", 0)}


def test_resume_and_membership(spark):
    docs = spark.createDataFrame([("j", str(i)) for i in range(5)], "job_id string, document_id string")
    done = spark.createDataFrame([("j", "1"), ("j", "1"), ("k", "2")], "job_id string, document_id string")
    assert sorted(r.document_id for r in J.skip_processed(docs, done).collect()) == ["0", "2", "3", "4"]
    assert [r.document_id for r in J.only_processed(docs, done).collect()] == ["1"]


def test_sinks_chosen(spark):
    rows = [(["a", "x"], ["a", "b"]), ([], ["a", "b"]), (None, ["b"]), (["x"], ["a"]), (None, [])]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<q: array<string>, e: array<string>>")
    got = [r[0] for r in df.orderBy("i").select(J.choose_sinks(F.col("r.q"), F.col("r.e"))).collect()]
    assert got == [["a"], ["a", "b"], ["b"], ["jsonl"], ["jsonl"]]


def test_events(spark):
    rows = _path("j", "queued", "running", "paused", "queued", "running") + [("j", 5, None, None, 10, 0, None)]
    rows += [("j", 6, "failed", None, None, None, "boom")]
    ledger = _ledger(spark, rows)
    events = EV.build_events(ledger, "org.example", "unit").cache()
    kinds = [r.type for r in events.orderBy("time").collect()]
    assert kinds == [f"org.example.job.{k}" for k in ("started", "paused", "resumed", "started", "progress", "failed")]
    assert events.select("id").distinct().count() == 6
    again = {r.id for r in EV.build_events(ledger, "org.example", "unit").collect()}
    assert again == {r.id for r in events.collect()}
    short = EV.filter_events(events, ["job.paused", "org.example.job.failed"], "org.example")
    assert short.count() == 2 and EV.filter_events(events, [], "org.example").count() == 6
    body = json.loads(events.filter("type like '%failed'").select(EV.event_json().alias("b")).first().b)
    assert body["data"]["error"] == "boom" and body["specversion"] == "1.0" and "documents_total" not in body["data"]


def test_event_without_optional_fields(spark):
    df = spark.createDataFrame(
        [("1.0", "t", "s", "e1", None, None, "application/json", {})],
        "specversion string, type string, source string, id string, time string, subject string, datacontenttype string, data map<string,string>",
    )
    row = df.select(EV.event_json(), EV.http_headers(), EV.stream_fields()).first()
    assert "subject" not in json.loads(row[0]) and "ce-subject" not in row[1] and row[1]["Content-Type"] == "application/json"
    assert row[2]["subject"] == "" and "data" not in row[2]


def test_retry_rules(spark):
    rows = [(None, 1), (429, 2), (500, 3), (404, 1), (200, 1), (302, 2)]
    df = spark.createDataFrame(rows, "status int, attempt int")
    due = {(r.status, r.attempt, r.delay_seconds) for r in EV.due_again(df).collect()}
    assert due == {(None, 2, 2), (429, 3, 4), (302, 3, 4)}
    assert {(r.status, r.attempt) for r in EV.exhausted(df).collect()} == {(500, 3), (404, 1)}


def test_metrics(spark):
    rows = [("1", "a", True, None, 1), ("1", "b", False, "x", 2), ("2", "a", False, "y", 3), ("2", "b", False, "z", 4)]
    df = spark.createDataFrame(rows, "event_id string, backend string, success boolean, error string, at int")
    assert tuple(A.publisher_metrics(df).first()) == (2, 1, 1)
    got = {r.backend: (r.published, r.failed, r.last_published_at, r.last_error) for r in A.backend_metrics(df).collect()}
    assert got == {"a": (1, 1, 1, "y"), "b": (0, 2, None, "z")}


def test_empty_summary(spark):
    df = spark.createDataFrame([], "outcome string")
    s = A.run_summary(df).first()
    assert (s.total_lines, s.success_rate) == (0, "0.0%")


def test_batch_bounds(spark):
    df = spark.createDataFrame([("a", 5)] * 3 + [("b", 2000)], "batch_id string, interval int")
    got = {r.batch_id: (r.documents, r.accepted) for r in V.batch_shape(df, interval="interval").collect()}
    assert got == {"a": (3, True), "b": (1, False)}


def test_output_contract(spark):
    df = spark.createDataFrame([("a", [1, 2]), (None, [3])], "id string, e array<int>")
    r = V.output_contract(df, ["id"], 2, "e").first()
    assert (r.row_count, r.missing_id, r.entity_count, r.sound) == (2, 1, 3, False)
