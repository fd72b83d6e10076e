"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pressmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC; ``conf`` wins over these."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    named = os.environ.get("PRESSMILL_TEST_SCRATCH") or tempfile.mkdtemp(prefix="pressmill-")
    os.environ["PRESSMILL_TEST_SCRATCH"] = named
    return named


class Scratch:
    """Owner of the shared paths handed out inside its ``with`` block, until ``drop``.

    Results stay readable after the block, as they may still read those paths: the owner calls
    ``drop`` once they are written elsewhere.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._open.append(self)
        return self

    def __exit__(self, *problem) -> None:
        self._open.remove(self)

    def drop(self) -> None:
        """Delete the paths, from whatever store they are in."""
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path nobody else uses, below the shared folder; the innermost open ``Scratch`` owns it."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    return path


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Cut lineage through a Parquet table in the shared folder.

    Branches that follow read the table instead of computing ``df`` again, and a lost
    executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    target = path or new_shared_path(spark, label)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)
