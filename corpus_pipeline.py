"""The corpus pipeline: from documents to packed sequences of tokens.

``STAGES`` run one after the other; each one's result is written as Parquet and read again as the
next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.llm import near_duplicates, packing, passages, pii, quality_model
from pressmill.llm.common import table
from pressmill.llm.queries import tokenizer_file
from pressmill.session import Scratch, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, learnt from trusted labels, doesn't reject."""
    stable = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = quality_model.learnt(stable, table(spark, sf_dir, "labels"))
    return quality_model.scored(docs, model).where("predicted = 1").select(*docs.columns)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the first in the table."""
    rows = written(docs.withColumn("__place", F.monotonically_increasing_id()), "near-rows")
    classes = near_duplicates.classes(rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("__place").alias("place")))
    kept = classes.where("place = class_place").select(F.col("place").alias("__place"))
    return rows.join(kept, "__place", "left_semi").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document has."""
    return passages.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[Scratch] = []


def alone(stage: Stage) -> Stage:
    """The stage, which first drops what the stage before left behind.

    A stage's result reads its intermediate tables until it is written, and the next stage starts
    after that, with the written result as its ``docs``.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            _left.pop().drop()
        with Scratch(spark) as scratch:
            out = stage(spark, docs, sf_dir)
        _left.append(scratch)
        return out

    return run_stage


STAGES = [
    ("quality_classifier", alone(keep_good)),
    ("near_duplicates", alone(keep_one_of_each_class)),
    ("substring_dedup", alone(cut_repeated_passages)),
    ("pii", alone(redact_personal_data)),
    ("best_fit_packing", alone(pack_sequences)),
]

#: No stage can be said in SQL; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with Scratch(spark) as result:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            last.drop()
        last = result
    return STAGES[-1][1](spark, docs, sf_dir)
