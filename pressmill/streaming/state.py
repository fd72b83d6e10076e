"""Keyed state of streams: documents seen, jobs as their ledger grows, deliveries that come due again.

State lives in a persistent store and goes with the watermark; a batch reads its own input and the
state of the keys in it, never earlier output.  Documents have an entry for each key.  Jobs and
deliveries share an entry by ``buckets`` of keys, a table that is folded as a whole: an entry for
each would cost several calls between Python and the store for each of them in every batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pressmill.functions import fixed
from pressmill.functions.cleaning import DEFAULT_CONFIG, CleaningConfig
from pressmill.operators.events import NAMESPACE, SOURCE, is_retryable, typed_events
from pressmill.operators.stats import progress_percent
from pressmill.operators.validate import error_rows
from pressmill.plans.article import Enrichment, process_articles
from pressmill.plans.file_run import check_lines
from pressmill.schema import ARTICLE_FIELDS
from pressmill.sources.lines import drop_blank

STORE = "spark.sql.streaming.stateStore.providerClass"
PERSISTENT = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_persistent_state(spark: SparkSession) -> None:
    """Keep state on disk next to the tasks and in the checkpoint, not on the heap; needed for timers."""
    spark.conf.set(STORE, PERSISTENT)


# --- documents ----------------------------------------------------------------


def arriving_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """``file, value, arrived``: lines of files as they appear; a line arrives when its file was last changed."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(
        F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_modification_time").alias("arrived")
    )


def new_documents(lines: DataFrame, within: str = f"{fixed.CHECKPOINT_TTL_SECONDS} seconds") -> DataFrame:
    """Lines repaired, validated and tagged; a sound document whose id came before, up to ``within`` ago, is left out.

    Only sound documents claim an id, so one that is mended and sent again comes through.  Blank
    lines and lines in error all pass.  The state holds ids, not documents.
    """
    use_persistent_state(lines.sparkSession)
    # Before the check: a condition on its outcome would move below the parsing and hold a copy of all of it.
    tagged = check_lines(drop_blank(lines)).drop("document")
    own = F.concat(F.lit("line|"), F.uuid())  # meets no other, in a rerun of the batch either
    key = F.when(F.col("outcome") == "ok", F.concat(F.lit("id|"), F.col("document_id"))).otherwise(own)
    return tagged.withColumn("_key", key).withWatermark("arrived", within).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def record_batches(
    target: str, as_of: Column, cfg: CleaningConfig = DEFAULT_CONFIG, tools: Enrichment | None = None
) -> Callable[[DataFrame, int], None]:
    """A batch handler: whole records to ``target/records``, dead letters to ``target/errors``.

    Each batch has a folder of its own, which a rerun replaces.  Lines of a stream have no number.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        good = batch.where("outcome = 'ok'").select(*[n for n, *_ in ARTICLE_FIELDS])
        process_articles(good, as_of, cfg, tools).write.mode("overwrite").parquet(f"{target}/records/batch={number}")
        bad = batch.withColumn("line", F.lit(None).cast("bigint"))
        error_rows(bad).write.mode("overwrite").parquet(f"{target}/errors/batch={number}")
        batch.unpersist()

    return handle


# --- tables by bucket -----------------------------------------------------------

#: Entries of the store that keys are dealt to.
BUCKETS = 512


def bucket_of(buckets: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def _flagged(ddl: str) -> dict[str, str]:
    """Names and types of columns, with a ``..._null`` column after each number, which pandas keeps whole only without nulls."""
    out = {}
    for part in ddl.split(", "):
        name, kind = part.split()
        out[name] = kind
        if kind == "bigint":
            out[f"{name}_null"] = "boolean"
    return out


def flagged_ddl(ddl: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in _flagged(ddl).items())


def with_flags(ddl: str) -> list[Column]:
    out = []
    for name, kind in (part.split() for part in ddl.split(", ")):
        value = F.col(name).cast(kind)
        out += [F.coalesce(value, F.lit(0)).alias(name), value.isNull().alias(f"{name}_null")] if kind == "bigint" else [value.alias(name)]
    return out


def without_flags(ddl: str) -> list[Column]:
    return [
        F.when(~F.col(f"{name}_null"), F.col(name)).alias(name) if kind == "bigint" else F.col(name)
        for name, kind in (part.split() for part in ddl.split(", "))
    ]


class StoredTable:
    """A table as one value of the store."""

    KINDS = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}

    def __init__(self, handle, name: str, ddl: str):
        self.value = handle.getValueState(name, "table binary")
        self.columns = list(_flagged(ddl))
        self.schema = pa.schema([(n, self.KINDS[k]) for n, k in _flagged(ddl).items()])

    def read(self) -> pd.DataFrame:
        held = self.value.get()
        if held is None:
            return self.schema.empty_table().to_pandas()
        return pa.ipc.open_stream(bytes(held[0])).read_all().to_pandas()

    def write(self, rows: pd.DataFrame) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.Table.from_pandas(rows[self.columns], self.schema, preserve_index=False))
        self.value.update((sink.getvalue().to_pybytes(),))


# --- jobs -----------------------------------------------------------------------

_LATEST = "batch_id string, status string, total_documents bigint, processed_documents bigint, failed_documents bigint, error_message string, statistics string"
_STAMPS = "created_us bigint, started_us bigint, paused_us bigint, resumed_us bigint, completed_us bigint, updated_us bigint"
_ROW = f"job_id string, ledger_seq bigint, at_us bigint, {_LATEST}"
_STEP = f"{_ROW}, previous_status string, " + ", ".join(f"job_{c}" for c in f"{_LATEST}, {_STAMPS}".split(", "))


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(", ")]


def _last_known(known: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every row the last ``known`` one up to it in its group, which begins at ``start``; -1 if there is none."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    return np.where(at >= start, at, -1)


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values`` at those places; None, or 0 among numbers, at -1."""
    return np.where(at >= 0, values[at], 0 if values.dtype.kind == "i" else None)


def fold_steps(jobs: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Rows of a ledger in the order of their numbers, each with the job after it, and all ``jobs`` after them.

    Numbers that may be null have a column ``..._null`` beside them, so they stay whole numbers.
    """
    own = jobs["job_id"].isin(rows["job_id"])
    old, k = jobs[own], int(own.sum())
    group = pd.factorize(np.r_[old["job_id"].to_numpy(object), rows["job_id"].to_numpy(object)], use_na_sentinel=False)[0]
    n = len(group)
    new = np.arange(n) >= k
    seq = np.r_[np.zeros(k, np.int64), rows["ledger_seq"].to_numpy(np.int64)]
    numbered = np.r_[np.zeros(k, bool), ~rows["ledger_seq_null"].to_numpy(bool)]
    order = np.lexsort((seq, numbered, new, group))
    new, group = new[order], group[order]
    first = np.r_[True, group[1:] != group[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    both = lambda name, kind: np.r_[old[name].to_numpy(kind), rows[name].to_numpy(kind)][order]
    after: dict[str, np.ndarray] = {}

    def keep(name: str, values: np.ndarray, places: np.ndarray) -> None:
        after[name] = _taken(values, places)
        if values.dtype.kind == "i":
            after[f"{name}_null"] = places < 0

    for name, kind in (part.split() for part in _LATEST.split(", ")):
        if kind == "bigint":
            keep(name, both(name, np.int64), _last_known(~both(f"{name}_null", bool), start))
        else:
            values = both(name, object)
            keep(name, values, _last_known(~pd.isna(values), start))
    status = both("status", object)
    told = _last_known(~pd.isna(status), start)
    before = np.where(first | pd.isna(status), -1, np.r_[-1, told[:-1]])
    at = rows["at_us"].to_numpy(np.int64)

    def stamp(name: str, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unknown = np.r_[old[f"{name}_null"].to_numpy(bool), np.zeros(n - k, bool)][order]
        return np.r_[old[name].to_numpy(np.int64), at][order], np.where(new, hit, ~unknown)

    for name, pick in (("created_us", "cummin"), ("updated_us", "cummax")):
        keep(name, getattr(pd.Series(stamp(name, new)[0]).groupby(group), pick)().to_numpy(), np.arange(n))
    values, hit = stamp("started_us", status == "running")
    earliest = pd.Series(np.where(hit, np.arange(n), n)).groupby(group).cummin().to_numpy()
    keep("started_us", values, np.where(earliest < n, earliest, -1))
    values, hit = stamp("paused_us", status == "paused")
    paused = _last_known(hit, start)
    keep("paused_us", values, paused)
    ended = (status == "completed") | (status == "failed") | (status == "cancelled")
    for name, hit in (("resumed_us", (status == "queued") & (paused >= 0)), ("completed_us", ended)):
        values, hit = stamp(name, hit)
        keep(name, values, _last_known(hit, start))
    ids = both("job_id", object)
    last = np.r_[first[1:], True]
    steps = {name: rows[name].to_numpy()[order[new] - k] for name in _flagged(_ROW)}
    steps |= {"previous_status": _taken(status, before)[new], **{f"job_{c}": v[new] for c, v in after.items()}}
    folded = pd.DataFrame({"job_id": ids[last], **{c: v[last] for c, v in after.items()}})
    return pd.DataFrame(steps), folded if own.all() else pd.concat([jobs[~own], folded], ignore_index=True)


class JobSteps(StatefulProcessor):
    """The ledger rows of a bucket of jobs in the order of their numbers, each with the status before it and the job after it.

    A row waits until the watermark has passed its time, so rows that come in another order, but
    in time, are put right.  The state of a bucket is a table of its folded jobs and one of the rows that wait.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.folded, self.waiting = StoredTable(handle, "folded", f"job_id string, {_LATEST}, {_STAMPS}"), StoredTable(handle, "waiting", _ROW)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self.ripe([r[self.waiting.columns] for r in rows], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.ripe([], timerValues)

    def ripe(self, more: list[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        waiting = self.waiting.read()
        held = pd.concat([waiting, *more], ignore_index=True).drop_duplicates(["job_id", "ledger_seq", "ledger_seq_null"], keep="last")
        past = held["at_us"] < timers.getCurrentWatermarkInMs() * 1000
        later, steps = held[~past], None
        if past.any():
            steps, jobs = fold_steps(self.folded.read(), held[past])
            self.folded.write(jobs)
        if len(later) or len(waiting):
            self.waiting.write(later)
        if len(later):
            self.handle.registerTimer(int(later["at_us"].min()) // 1000 + 1)
        if steps is not None:
            yield steps[list(_flagged(_STEP))]

    def close(self) -> None:
        pass


def job_steps(ledger: DataFrame, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Every row of a growing ledger once, with ``previous_status`` and the job's folded state after it (``job_...``).

    Rows without a time never come due and are left out.  ``buckets`` is fixed by the checkpoint.
    """
    use_persistent_state(ledger.sparkSession)
    rows = ledger.select(
        "job_id", "ledger_seq", "at", F.unix_micros("at").alias("at_us"),
        *[(F.to_json(F.col(n)) if n == "statistics" else F.col(n)).alias(n) for n in _names(_LATEST)],
    )
    rows = rows.where("at IS NOT NULL").withWatermark("at", late)
    rows = rows.select(bucket_of(buckets, "job_id"), "at", *with_flags(_ROW))
    steps = rows.groupBy("bucket").transformWithStateInPandas(JobSteps(), flagged_ddl(_STEP), "Append", "EventTime")
    return steps.select(*without_flags(_STEP)).withColumn("at", F.timestamp_micros("at_us")).drop("at_us")


def live_events(steps: DataFrame, namespace: str = NAMESPACE, source: str = SOURCE) -> DataFrame:
    """The lifecycle events of ``job_steps``: those that the batch form builds from the whole ledger."""
    return typed_events(steps, namespace, source)


def live_jobs(steps: DataFrame) -> DataFrame:
    """The folded job after each step, in the columns of the batch form; the highest ``ledger_seq`` of a job is its state."""
    stamp = lambda n: F.timestamp_micros(f"job_{n}_us").alias(f"{n}_at")
    order = ["created", "started", "paused", "resumed", "completed", "updated"]
    return steps.select(
        "job_id", "ledger_seq",
        *[F.col(f"job_{n}").alias(n) for n in _names(_LATEST) if n != "statistics"],
        F.from_json("job_statistics", "map<string, string>").alias("statistics"),
        *[stamp(n) for n in order],
        progress_percent(F.col("job_processed_documents"), F.col("job_total_documents")).alias("progress_percent"),
    )


# --- deliveries -------------------------------------------------------------------

_DELIVERY = "event_id string, backend string, target string, attempt bigint, status bigint, due_us bigint"
_TOLD = "event_id string, backend string, attempt bigint, status bigint, at_us bigint, good boolean, again boolean"
_OPEN = "event_id string, backend string, settled bigint, attempt bigint, status bigint, due_us bigint"


def settle(known: pd.DataFrame, told: pd.DataFrame, limit: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Dead letters among outcomes that were not told before, and all deliveries ``known`` after them.

    ``attempt`` 0 of a delivery says that none waits to be tried again, ``settled`` 0 that none is settled.
    """
    key = ["event_id", "backend"]
    rows = told.sort_values(["attempt", "at_us"], kind="stable").drop_duplicates([*key, "attempt"])
    rows = rows.merge(known[[*key, "settled", "attempt"]].rename(columns={"attempt": "open"}), "left", key)
    done, open_ = (rows[c].fillna(0).astype("int64") for c in ("settled", "open"))
    rows = rows.assign(settled=done)[rows["attempt"] > np.maximum(done, open_)]
    final = rows["good"] | ~rows["again"] | (rows["attempt"] >= limit)
    dead = rows[final & ~rows["good"]].rename(columns={"at_us": "due_us", "at_us_null": "due_us_null"}).assign(target="dead")
    # Every outcome that counts ends the wait of the one before, so the last of each delivery stands.
    rows = rows.assign(settled=np.where(final, rows["attempt"], rows["settled"]), final=final)
    most = rows.groupby(key, dropna=False, sort=False)["settled"].transform("max")
    last = rows.assign(settled=most, settled_null=False).drop_duplicates(key, keep="last")
    wait = np.left_shift(np.int64(1_000_000), np.where(last["final"], 0, last["attempt"]))
    last = last.assign(due_us=last["at_us"] + wait, due_us_null=last["at_us_null"], attempt=last["attempt"].where(~last["final"], 0))
    old = known.merge(last[key].assign(told=True), "left", key)["told"].isna().to_numpy()
    return dead, pd.concat([known[old], last[known.columns]], ignore_index=True)


class Redelivery(StatefulProcessor):
    """Outcomes of a bucket of deliveries of an event to a backend, and when the next attempts are due.

    A failure that may be tried again waits 2 to the power of its attempt in seconds and comes out
    when the watermark passes that time, unless a success, or a later attempt, came before.  The
    last attempt's failure, and one that is not to be tried again, come out as dead letters.
    """

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle) -> None:
        self.handle = handle
        self.known = StoredTable(handle, "deliveries", _OPEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        dead, known = settle(self.known.read(), pd.concat([*rows], ignore_index=True), self.limit)
        yield from self.kept(dead, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.known.read()
        due = (known["attempt"] > 0) & ~known["due_us_null"] & (known["due_us"] < timerValues.getCurrentWatermarkInMs() * 1000)
        again = known[due].assign(target="retry", attempt=known["attempt"][due] + 1)
        if len(again):
            known = known.assign(settled=known["settled"].where(~due, known["attempt"]), attempt=known["attempt"].where(~due, 0))
            yield from self.kept(again, known)

    def kept(self, out: pd.DataFrame, known: pd.DataFrame) -> Iterator[pd.DataFrame]:
        self.known.write(known)
        wait = known["due_us"][(known["attempt"] > 0) & ~known["due_us_null"]]
        if len(wait):
            self.handle.registerTimer(int(wait.min()) // 1000 + 1)
        if len(out):
            yield out[list(_flagged(_DELIVERY))]

    def close(self) -> None:
        pass


def deliveries_due(attempts: DataFrame, late: str = "1 minute", limit: int = fixed.DELIVERY_ATTEMPTS, buckets: int = BUCKETS) -> DataFrame:
    """``event_id, backend, target, attempt, status, due_at`` from outcomes (``event_id, backend, attempt, status, at``).

    ``target`` is ``retry`` (the next attempt is due) or ``dead``.  An attempt told twice counts once.
    ``buckets`` is fixed by the checkpoint.
    """
    use_persistent_state(attempts.sparkSession)
    rows = attempts.select(
        F.col("event_id").cast("string").alias("event_id"), "backend", F.col("attempt").cast("int").alias("attempt"),
        F.col("status").cast("int").alias("status"), "at", F.unix_micros("at").alias("at_us"),
        F.coalesce(F.col("status").between(200, 299), F.lit(False)).alias("good"), is_retryable(F.col("status")).alias("again"),
    )
    rows = rows.where("attempt IS NOT NULL").withWatermark("at", late).select(bucket_of(buckets, "event_id", "backend"), "at", *with_flags(_TOLD))
    out = rows.groupBy("bucket").transformWithStateInPandas(Redelivery(limit), flagged_ddl(_DELIVERY), "Append", "EventTime").select(*without_flags(_DELIVERY))
    out = out.withColumn("attempt", F.col("attempt").cast("int")).withColumn("status", F.col("status").cast("int"))
    return out.withColumn("due_at", F.timestamp_micros("due_us")).drop("due_us")
