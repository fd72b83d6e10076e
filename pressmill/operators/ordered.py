"""Order-dependent operators that never put a whole key into one task.

Rows of a key are cut into chunks along the order; a window runs inside each chunk, and a second
one runs over the chunk summaries.  A key with a third of all rows is then many chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 100_000
SALT_ROWS, SALT_STEP = 1_000_000, 64
#: Slots, or sessions at the edges of chunks, that one window of a clock sees.
TREE_WIDTH = 4096


def chunk_of(order: Column, width: int = CHUNK) -> Column:
    """Chunk number of an integer order value."""
    return F.floor(order / F.lit(width))


def with_previous(df: DataFrame, group: list[str], order: str, value: str, out: str, chunk: Column) -> DataFrame:
    """Add the value of the row before, by ``order`` within ``group``; NULL on the first row."""
    inner = Window.partitionBy(*group, "_chunk").orderBy(order)
    across = Window.partitionBy(*group).orderBy("_chunk")
    df = df.withColumn("_chunk", chunk)
    ends = (
        df.groupBy(*group, "_chunk")
        .agg(F.max_by(F.struct(value), order).alias("_end"))
        .withColumn("_before", F.lag("_end").over(across))
        .drop("_end")
    )
    local = df.withColumn("_prev", F.lag(F.struct(value)).over(inner))
    return (
        local.join(ends, [*group, "_chunk"])
        .withColumn(out, F.coalesce("_prev", "_before")[value])
        .drop("_chunk", "_prev", "_before")
    )


def with_running_count(df: DataFrame, group: list[str], order: str, hit: Column, out: str, chunk: Column) -> DataFrame:
    """Add the number of rows up to and with this one, by ``order`` within ``group``, where ``hit``."""
    inner = Window.partitionBy(*group, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_chunk", chunk).withColumn("_hit", F.when(hit, 1).otherwise(0).cast("bigint"))
    sums = (
        df.groupBy(*group, "_chunk")
        .agg(F.sum("_hit").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0)))
        .drop("_n")
    )
    return (
        df.withColumn("_here", F.sum("_hit").over(inner))
        .join(sums, [*group, "_chunk"])
        .withColumn(out, F.col("_here") + F.col("_before"))
        .drop("_chunk", "_hit", "_here", "_before")
    )


def newest_per_group(df: DataFrame, group: list[str], order: str, n: int, spread: int | None = None) -> DataFrame:
    """The ``n`` rows with the highest ``order`` per group; order values are unique in a group.

    Each group is cut down to ``n`` rows per salt, in steps of ``SALT_STEP`` salts less, so no
    ranking sees more than ``n * SALT_STEP`` rows of one group, or ``SALT_ROWS`` in the first
    step.  ``spread`` is the number of salts; without it the rows are counted.
    """
    if spread is None:
        spread = -(-df.count() // SALT_ROWS)
    while True:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(max(spread, 1))))
        within = Window.partitionBy(*group, "_salt").orderBy(F.desc(order))
        df = salted.withColumn("_rank", F.row_number().over(within)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
        if spread <= 1:
            return df
        spread = spread // SALT_STEP if spread > SALT_STEP else 1


def progress_points(
    outcomes: DataFrame, interval: int, job: str = "job_id", seq: str = "seq", total: str | None = None
) -> DataFrame:
    """The rows at which every ``interval``-th success of a job falls, with its running percent."""
    counted = with_running_count(
        outcomes, [job], seq, F.col("outcome") == "ok", "processed_documents", chunk_of(F.col(seq))
    )
    hits = counted.filter(
        (F.col("outcome") == "ok") & (F.pmod(F.col("processed_documents"), F.lit(interval)) == 0)
    )
    if total is None:
        sizes = outcomes.groupBy(job).agg(F.count("*").alias("total_documents"))
        hits = hits.join(sizes, job)
    else:
        hits = hits.withColumn("total_documents", F.col(total))
    return hits.withColumn(
        "progress_percent", F.col("processed_documents") / F.col("total_documents") * 100
    )


def activity_sessions(events: DataFrame, at: str, gap_seconds: int, *keys: str, width: int = TREE_WIDTH) -> DataFrame:
    """Sessions of activity per key: a gap of ``gap_seconds`` or more closes one; its end starts idleness.

    Without keys all events share one clock.  Events in the same gap-wide slot are always in one
    session, so rows are first folded to one per slot.  Slots are then joined to sessions within
    chunks of ``width`` slots.  Only the first and the last session of a chunk may go on beside it;
    these meet in chunks ``width`` times as wide, and so on up a tree, so no task reads all slots
    of a clock, however long it runs.
    """
    micros = gap_seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    slots = (
        events.withColumn("_us", us)
        .where("_us IS NOT NULL")
        .groupBy(*keys, F.floor(F.col("_us") / F.lit(micros)).alias("_slot"))
        .agg(F.min("_us").alias("_a"), F.max("_us").alias("_b"), F.count("*").alias("_n"))
    )
    ends = slots.agg(F.min("_slot"), F.max("_slot")).first()
    rows, closed, wide = slots, [], width
    while True:
        sessions = _joined_in_chunks(rows, keys, F.floor(F.col("_slot") / F.lit(wide)), micros)
        if ends[0] is None or ends[0] // wide == ends[1] // wide:
            break
        closed.append(sessions.where("NOT _edge"))
        rows, wide = sessions.where("_edge"), wide * width
    for part in closed:
        sessions = sessions.unionByName(part)
    return sessions.select(
        *keys,
        F.timestamp_micros("_a").alias("session_start"),
        F.timestamp_micros("_b").alias("last_activity"),
        F.timestamp_micros(F.col("_b") + micros).alias("idle_from"),
        F.col("_n").alias("events"),
    )


def _joined_in_chunks(rows: DataFrame, keys: tuple[str, ...], chunk: Column, micros: int) -> DataFrame:
    """Intervals (``_slot, _a, _b, _n``) joined to sessions inside each chunk of slots; ``_edge``: the chunk's first or last."""
    rows = rows.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk")
    order = inside.orderBy("_a")
    gap = F.col("_a") - F.lag("_b").over(order)
    numbered = rows.withColumn("_opens", F.when(gap < micros, 0).otherwise(1)).withColumn("_session", F.sum("_opens").over(order))
    numbered = numbered.withColumn("_final", F.max("_session").over(inside))
    return (
        numbered.groupBy(*keys, "_chunk", "_session")
        .agg(F.min("_slot").alias("_slot"), F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_n").alias("_n"), F.max("_final").alias("_final"))
        .withColumn("_edge", (F.col("_session") == 1) | (F.col("_session") == F.col("_final")))
        .select(*keys, "_slot", "_a", "_b", "_n", "_edge")
    )
