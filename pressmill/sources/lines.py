"""JSON-lines files, batch values and tables as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pressmill.functions.fixed import WS


def read_raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, value``: one row per line, in no order."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def mark_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, row_id, value``: every line with what its number can be found from later."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row_id"),
        "value",
    )


def number_lines(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rows`` (some of ``marked``, with its columns) with ``line``, 1-based and counting blank lines.

    Files may be split.  One row per block is kept of ``marked`` (its row count and lowest row id),
    and the blocks before it in the file give its offset.  Only ``rows`` meet that table, so those
    who need the numbers of a few lines don't move the others.
    """
    blocks = marked.groupBy("file", "block").agg(
        F.count("*").alias("n"), F.min("row_id").alias("first_id")
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = blocks.select(
        "file",
        "block",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
    )
    numbered = rows.join(shifts, ["file", "block"]).withColumn("line", F.col("row_id") + F.col("shift"))
    return numbered.drop("block", "row_id", "shift")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line, value`` of every line."""
    marked = mark_lines(spark, path)
    return number_lines(marked, marked).select("file", "line", "value")


def is_blank(value: Column) -> Column:
    return value.isNull() | value.rlike(f"^{WS}*$")


def drop_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(~is_blank(F.col("value")))


def explode_batch(batches: DataFrame, value: str = "documents") -> DataFrame:
    """One row per document of a JSON array value, with its ``seq``; keeps the other columns.

    A value that is no JSON array yields one row with ``batch_ok = false``.
    """
    others = [c for c in batches.columns if c != value]
    items = batches.select(
        *others,
        F.try_variant_get(F.try_parse_json(value), "$", "array<variant>").alias("_items"),
    )
    return items.select(
        *others,
        F.col("_items").isNotNull().alias("batch_ok"),
        F.posexplode_outer("_items").alias("seq", "document"),
    )


def unprocessed(table: DataFrame, done: str = "processed", cap: int | None = None) -> DataFrame:
    """Rows not processed yet, at most ``cap`` of them when given."""
    rows = table.filter(~F.col(done))
    return rows if cap is None else rows.limit(cap)


def stream_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """``file, value`` for every line of every file that appears in ``folder``."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("file"), "value")


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A Parquet file or folder as a stream; a pattern path lets both work."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")
