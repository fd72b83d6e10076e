import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from pressmill.functions.cleaning import clean_text
from pressmill.functions.counts import count_words
from pressmill.session import new_shared_path, shared_folder, written
from pressmill.sinks import deliver, files
from pressmill.sinks.upsert import KeyedTable, merge_latest
from pressmill.sources.lines import stream_lines, stream_table
from pressmill.streaming import runs



def _day(n):
    return F.lit(f"2024-01-0{n}").cast("timestamp")


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "document_id string, text string")


def test_daily_append_keeps_earlier_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    files.append_daily(_rows(spark, ("a", "1")), path, F.lit("2024-01-01"))
    files.append_daily(_rows(spark, ("b", "2"), ("c", "3")), path, F.lit("2024-01-01"))
    files.append_daily(_rows(spark, ("d", "4")), path, F.lit("2024-01-02"))
    assert spark.read.json(path).groupBy("ingest_date").count().count() == 2 and spark.read.json(path).count() == 4


def test_a_run_told_twice_leaves_one_copy(spark, tmp_path):
    path, day = str(tmp_path / "out"), F.concat(F.lit("2024-01-0"), "text")
    files.append_daily(_rows(spark, ("a", "1"), ("b", "2")), path, day, "first")
    files.append_daily(_rows(spark, ("c", "1")), path, day, "second")
    files.append_daily(_rows(spark, ("a", "1"), ("b", "2")), path, day, "first")
    got = sorted((r.ingest_date.isoformat(), r.run, r.document_id) for r in spark.read.json(path).collect())
    assert got == [("2024-01-01", "first", "a"), ("2024-01-01", "second", "c"), ("2024-01-02", "first", "b")]


def test_error_report_only_with_errors(spark, tmp_path):
    none = spark.createDataFrame([(0,)], "total_errors int")
    assert not files.write_error_report(_rows(spark), none, str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()


def test_upsert_keeps_last_row_and_first_time(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["document_id"])
    t.upsert(_rows(spark, ("a", "1"), ("b", "1")).withColumn("seq", F.lit(1)), 1, _day(1), "seq")
    for _ in range(2):  # a repeated write of one version changes nothing
        again = _rows(spark, ("b", "1b"), ("b", "2"), ("c", "2")).withColumn("seq", F.length("text") * -1)
        t.upsert(again, 2, _day(2), "seq")
    want = {("a", "1", 1), ("b", "2", 1), ("c", "2", 2)}
    assert {(r.document_id, r.text, r.created_at.day) for r in t.current().collect()} == want
    small = t.compact(str(tmp_path / "c"))
    small.upsert(_rows(spark, ("a", "3")).withColumn("seq", F.lit(1)), 3, _day(2), "seq")
    assert {(r.document_id, r.text, r.created_at.day) for r in small.current().collect()} == {("a", "3", 1), ("b", "2", 1), ("c", "2", 2)}


def test_merge_latest(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 10)], "k string, v int, created int")
    new = spark.createDataFrame([("b", 3, 20, 1), ("b", 4, 20, 2), ("c", 5, 20, 1)], "k string, v int, created int, seq int")
    out = merge_latest(old, new, ["k"], "seq", "created").collect()
    assert {tuple(r) for r in out} == {("a", 1, 10), ("b", 4, 10), ("c", 5, 20)}


def test_bulk_chunks_and_failures(spark):
    def send(ids, bodies):
        if "7" in ids:
            raise ConnectionError("down")
        return [None] * len(ids)

    rows = spark.range(1200).coalesce(1)
    out = deliver.bulk_deliver(rows, "id", send).collect()
    assert sorted(r.rows for r in out) == [200, 500, 500]
    assert [(r.failed, r.error) for r in out if r.failed] == [(500, "down")]
    failed = [o.id for r in out for o in r.outcomes if o.error]
    assert len(failed) == 500 and "7" in failed and all(o.error in (None, "down") for r in out for o in r.outcomes)


def test_fan_out_isolates_failures(spark):
    seen = []

    def broken(df):
        raise ValueError("no")

    out = deliver.write_everywhere(spark.range(3), {"bad": broken, "good": lambda df: seen.append(df.count())})
    assert [tuple(r) for r in out.collect()] == [("bad", False, "no"), ("good", True, None)] and seen == [3]


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    assert new_shared_path(spark, "x") != new_shared_path(spark, "x")
    assert written(spark.range(3), "x").count() == 3


def test_stream_of_new_files(spark, tmp_path):
    folder, out, progress = (tmp_path / n for n in ("in", "out", "progress"))
    folder.mkdir()
    (folder / "a.jsonl").write_text("1\n2\n")
    stream = stream_lines(spark, str(folder)).select("value")
    assert runs.run_available(stream, str(out), str(progress)).count() == 2
    (folder / "b.jsonl").write_text("3\n")
    again = stream_lines(spark, str(folder)).select("value")
    assert sorted(r.value for r in runs.run_available(again, str(out), str(progress)).collect()) == ["1", "2", "3"]


def test_pause_resume_without_loss_or_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(40).select(F.col("id"), (F.col("id") % 30).alias("document_id")).repartition(4).write.parquet(source)
    batches = []
    state = {"status": "running"}
    store = runs.append_once(spark, lambda df: df.dropDuplicates(["document_id"]), str(tmp_path / "out"), ("document_id",))

    def handle(df, n):
        store(df, n)
        batches.append(n)
        if len(batches) == 2:
            state["status"] = "paused"

    def control():
        return spark.createDataFrame([("j", 1, "running"), ("j", 2, state["status"])], "job_id string, ledger_seq int, status string")

    def go():
        stream = stream_table(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
        return runs.run_controlled(stream, handle, str(tmp_path / "progress"), control, "j")

    assert go() == "paused" and batches == [0, 1]
    assert go() == "paused" and batches == [0, 1]
    state["status"] = "running"
    assert go() == "completed" and batches == [0, 1, 2, 3]
    ids = [r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(ids) == list(range(30))


def test_a_batch_of_one_file_is_worked_on_in_many_parts(spark, tmp_path):
    handle = runs.append_once(spark, lambda df: df, str(tmp_path / "out"), ("document_id",))
    rows = spark.range(1000).withColumnRenamed("id", "document_id")
    handle(rows.coalesce(1), 0)
    handle(rows.unionByName(rows.select((F.col("document_id") + 1000).alias("document_id"))).coalesce(1), 1)
    cores = spark.sparkContext.defaultParallelism
    assert all(len(glob.glob(str(tmp_path / "out" / f"batch={n}" / "*.parquet"))) >= cores for n in (0, 1))
    ids = [r.document_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(ids) == list(range(2000))


def test_a_text_whose_words_are_counted_is_cleaned_once(spark):
    docs = spark.createDataFrame([("a <b>b</b>  c",), ("",), (" ",), (None,)], "text string")
    counted = docs.select(count_words(clean_text(F.col("text"))).alias("words"))
    assert [r.words for r in counted.collect()] == [3, None, None, None]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("<[^>]*+>") == 1


def test_a_failing_batch_is_not_taken_for_a_pause(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)

    def handle(df, n):
        raise ValueError("broken handler")

    stream = stream_table(spark, source, spark.range(1).schema)
    calm = spark.createDataFrame([("j", 1, "running")], "job_id string, ledger_seq int, status string")
    with pytest.raises(Exception, match="broken handler"):
        runs.run_controlled(stream, handle, str(tmp_path / "progress"), lambda: calm, "j")


def test_stream_drops_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"e{i % 5}", t0 + dt.timedelta(minutes=i)) for i in range(20)]
    spark.createDataFrame(rows, "id string, ts timestamp").write.parquet(source)
    stream = stream_table(spark, source, spark.read.parquet(source).schema)
    out = runs.run_available(runs.drop_repeats(stream, "ts"), str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(r.id for r in out.collect()) == [f"e{i}" for i in range(5)]
    assert glob.glob(str(tmp_path / "out" / "*.parquet"))
