"""Keyed state of streams."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pressmill.operators import events as EV
from pressmill.operators import jobs as J
from pressmill.plans.file_run import check_lines
from pressmill.sources.lines import stream_table
from pressmill.streaming import runs, state

DAY = datetime(2024, 1, 1)


def test_a_batch_reads_its_own_input_only(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")

    def send(lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)
        q = state.new_documents(state.arriving_lines(spark, folder)).writeStream.foreachBatch(state.record_batches(target, F.lit("2024-06-01").cast("date")))
        q = q.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        q.awaitTermination()
        return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]

    doc = lambda k, **more: json.dumps({"document_id": f"d{k}", "text": f"text {k}."} | more)
    assert send([doc(1), doc(2), doc(2), "no json", "no json", "", json.dumps({"document_id": "d3"})]) == [7]
    assert send([doc(1), doc(3), "no json", *[doc(k) for k in range(10, 15)]]) == [8]
    assert send([doc(3, title="again")]) == [1]
    records = spark.read.parquet(f"{target}/records")
    assert sorted(r.document_id for r in records.collect()) == sorted(["d1", "d2", "d3", *(f"d{k}" for k in range(10, 15))])
    assert "cleaned_title" in records.columns and records.where("cleaned_title = 'again'").count() == 0
    errors = [r.error_type for r in spark.read.parquet(f"{target}/errors").collect()]
    assert sorted(errors) == ["JSONDecodeError"] * 3 + ["ValidationError"]


def test_blank_lines_go_before_the_check(spark, tmp_path):
    """The choice of lines that aren't blank doesn't copy the parsing and the checks into a condition."""
    spark.createDataFrame([("x",)], "value string").write.text(str(tmp_path / "in"))
    lines = state.arriving_lines(spark, str(tmp_path / "in"))
    optimizer = spark._jsparkSession.sessionState().optimizer()
    plans = [optimizer.execute(df._jdf.queryExecution().analyzed()) for df in (check_lines(lines), state.new_documents(lines))]
    parsings = [plan.toString().count("parseJson") for plan in plans]
    assert 0 < parsings[1] <= parsings[0]


def test_steps_of_a_ledger_told_out_of_order(spark, tmp_path):
    rows = [
        ("a", 0, 0, "queued", None, None), ("a", 1, 1, "running", None, None), ("a", 2, 2, None, 5, None), ("a", 3, 3, "paused", None, None),
        ("a", 4, 4, "queued", None, None), ("a", 5, 5, "running", None, None), ("a", 6, 6, "failed", None, "boom"),
        ("b", 0, 2, "queued", None, None), ("b", 1, 3, "cancelled", None, None), ("c", 0, 900, "queued", None, None),
    ]
    schema = "job_id string, ledger_seq bigint, at timestamp, status string, processed_documents bigint, error_message string"
    ledger = J.as_ledger(spark.createDataFrame([(j, s, DAY + timedelta(minutes=m), st, p, e) for j, s, m, st, p, e in rows], schema))
    parts = [[3, 0, 7, 2], [5, 1, 4], [8, 6], [9]]
    folder, target = str(tmp_path / "ledger"), str(tmp_path / "steps")
    told = ledger.collect()
    for part in parts:
        spark.createDataFrame([told[k] for k in part], ledger.schema).coalesce(1).write.mode("append").parquet(folder)
        steps = runs.run_available(state.job_steps(stream_table(spark, folder, ledger.schema), "10 minutes"), target, str(tmp_path / "progress"))
    past = ledger.where("job_id <> 'c'")  # the last job's rows wait for the watermark
    events = lambda df: {(r.id, r.type, r.time, tuple(sorted(r.data.items()))) for r in df.collect()}
    assert events(state.live_events(steps)) == events(EV.build_events(past)) and steps.count() == 9
    assert {r.type for r in state.live_events(steps).collect()} >= {"cleaning.job.resumed", "cleaning.job.paused", "cleaning.job.progress"}
    last = state.live_jobs(steps).where("(job_id = 'a' AND ledger_seq = 6) OR (job_id = 'b' AND ledger_seq = 1)")
    folded = J.fold_jobs(past)
    assert {tuple(r) for r in last.select(*[c for c in folded.columns if c != "statistics"]).collect()} == {tuple(r) for r in folded.drop("statistics").collect()}


def test_deliveries_come_due_on_their_own(spark, tmp_path):
    def outcome(event, attempt, status, second):
        return event, "webhook", attempt, status, DAY + timedelta(seconds=second)

    schema = "event_id string, backend string, attempt int, status int, at timestamp"
    parts = [
        [outcome("lost", 1, None, 0), outcome("late", 1, 503, 0), outcome("gone", 1, 404, 0), outcome("busy", 1, 429, 1), outcome("fine", 1, 200, 0)],
        [outcome("late", 1, 503, 0), outcome("late", 2, 200, 1), outcome("clock", 1, 200, 100)],
        [outcome("lost", 2, 500, 101), outcome("busy", 2, 200, 101), outcome("clock", 1, 200, 300)],
        [outcome("lost", 3, 500, 301), outcome("lost", 3, 500, 301), outcome("clock", 1, 200, 600)],
    ]
    folder, target = str(tmp_path / "attempts"), str(tmp_path / "due")
    for part in parts:
        told = spark.createDataFrame(part, schema)
        told.coalesce(1).write.mode("append").parquet(folder)
        due = runs.run_available(state.deliveries_due(stream_table(spark, folder, told.schema), "1 minute"), target, str(tmp_path / "progress"))
    got = {(r.event_id, r.target, r.attempt, r.status, (r.due_at - DAY).total_seconds()) for r in due.collect()}
    assert got == {
        ("lost", "retry", 2, None, 2), ("busy", "retry", 2, 429, 3), ("gone", "dead", 1, 404, 0),
        ("lost", "retry", 3, 500, 105), ("lost", "dead", 3, 500, 301),
    } and due.count() == 5


def test_sessions_of_one_clock_merge_up_a_tree(spark):
    import random

    from pressmill.operators import ordered as O

    rng = random.Random(5)
    for _ in range(1):
        at, times = 0.0, []
        for _ in range(200):
            at += rng.choice([1, 5, 9, 9.999999, 10, 11, 40, 300])
            times.append(DAY + timedelta(seconds=at))
        want, gap = [], timedelta(seconds=10)
        for t in times:
            if want and t - want[-1][1] < gap:
                want[-1][1], want[-1][2] = t, want[-1][2] + 1
            else:
                want.append([t, t, 1])
        rows = spark.createDataFrame([(t, k % 2) for k, t in enumerate(times)] + [(None, 1)], "ts timestamp, k int")
        for width in (3, 4096):
            got = O.activity_sessions(rows, "ts", 10, width=width).collect()
            assert sorted([r.session_start, r.last_activity, r.events] for r in got) == want, width
        whole = {tuple(r) for r in O.activity_sessions(rows, "ts", 10, "k").collect()}
        assert {tuple(r) for r in O.activity_sessions(rows, "ts", 10, "k", width=3).collect()} == whole
    assert O.activity_sessions(rows.limit(0), "ts", 10).count() == 0


def test_no_window_of_a_clock_sees_more_than_its_width(spark):
    from pressmill.operators import ordered as O

    slots = spark.range(10_000).select(F.col("id").alias("_slot"), (F.col("id") * 10).alias("_a"), (F.col("id") * 10 + F.col("id") % 7).alias("_b"), F.lit(1).cast("bigint").alias("_n"))
    wide, rows = 16, slots
    while rows.count() > 16:
        assert rows.groupBy(F.floor(F.col("_slot") / wide)).count().agg(F.max("count")).first()[0] <= 2 * 16
        rows = O._joined_in_chunks(rows, (), F.floor(F.col("_slot") / wide), 6).where("_edge")
        wide *= 16
