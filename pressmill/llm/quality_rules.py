"""Quality rules with thresholds of their own for each language and source.

Measures are taken of every text.  For each language and source a mergeable quantile sketch of
each measure gives quartiles; a text far outside them, by Tukey's fences widened to ``REACH``
times the spread, fails.  Fixed base rules hold besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import WordHashes, mix, slices, texts_of
from pressmill.session import written

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Measures compared with thresholds: the lowest spread that counts, so that a group of nearly
#: equal texts doesn't fail what differs by a trifle; and whether low values fail as well.
MEASURES = {"symbol_share": (0.02, False), "repeat_share": (0.05, False), "dup_line_share": (0.05, False), "mean_word": (1.0, True)}
#: Fences stand so many spreads outside the quartiles.
REACH = 4.0
#: Sketch size parameter (k of KLL): rank error about 0.7 %.
SKETCH_K = 400
#: Groups with fewer texts take the thresholds of their language, or else of all texts.
LEAST_TEXTS = 200


def words_of(line: bytes) -> list[bytes]:
    """Runs of bytes other than blank, tab, line feed, vertical tab, form feed and return."""
    return line.split()


def counts_of(text: str, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    duplicates = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                duplicates += bool(line.encode("utf-8", "surrogatepass").split())
            seen.add(line)
    repeats = 0
    if len(words) > 3:
        h = hashes.array(words)
        windows = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(len(words), bool)
            for k in range(3):
                covered[k : k + len(windows)] |= twice
            repeats = int(covered.sum())
    return len(words), len(text) - spaces, symbols, duplicates, repeats


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every whole text; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            texts = texts_of(batch, "text")
            rows = np.array([counts_of(t, hashes) for t in texts], np.int64)
            lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(c) for c in rows.T), pa.array(lines)],
                ["doc_id", "lang", "source", *COUNTS, "n_lines"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"])
    return (
        rows.mapInArrow(run, schema)
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("symbol_share", F.col("n_symbols") / F.greatest("word_chars", F.lit(1)))
        .withColumn("repeat_share", F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)))
        .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)))
        .withColumn("mean_word", F.col("word_chars") / F.greatest("n_words", F.lit(1)))
    )


def sketches(rows: DataFrame) -> DataFrame:
    """A sketch of each measure for each language and source, over texts that pass the base rules."""
    return (
        rows.where("NOT base_failed")
        .groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES))
    )


def fences(merged: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Lowest and highest values that pass, of each group of ``keys`` with enough texts."""
    quartile = lambda m, q: F.kll_sketch_get_quantile_double(F.col(m), F.lit(q))
    bounds = []
    for m, (least, both) in MEASURES.items():
        spread = F.greatest(quartile(m, 0.75) - quartile(m, 0.25), F.lit(least))
        low = quartile(m, 0.25) - REACH * spread if both else F.lit(float("-inf"))
        bounds += [low.alias(f"{label}_{m}_low"), (quartile(m, 0.75) + REACH * spread).alias(f"{label}_{m}_high")]
    return merged.where(F.col("n") >= (LEAST_TEXTS if keys else 1)).select(*(F.col(k).alias(f"{label}_{k}") for k in keys), *bounds)


def merged(sketched: DataFrame, keys: list[str]) -> DataFrame:
    return sketched.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in MEASURES))


def judged(docs: DataFrame) -> DataFrame:
    """Every document with its counts, ``base_failed`` and ``kept``.

    Null languages and null sources are groups of their own.  Null and empty texts have no words
    and so fail the base rules.  Equal rows are judged alike; an empty table gives no row.  Other
    columns are not read.
    """
    rows = written(measured(docs), "measures")
    sketched = written(sketches(rows), "sketches")
    levels = [(["lang", "source"], "own"), (["lang"], "lang")]
    out = rows
    for keys, label in levels:
        bounds = fences(merged(sketched, keys), keys, label)
        out = out.join(bounds, [F.col(k).eqNullSafe(F.col(f"{label}_{k}")) for k in keys], "left")
    overall = fences(merged(sketched, []), [], "all").first()
    everywhere = {k: F.lit(v) for k, v in overall.asDict().items()} if overall else {}
    inside = F.lit(True)
    for m in MEASURES:
        ends = [f"{m}_low", f"{m}_high"]
        low, high = (F.coalesce(*(F.col(f"{label}_{e}") for _, label in levels), everywhere.get(f"all_{e}", F.lit(None).cast("double"))) for e in ends)
        inside = inside & F.coalesce(F.col(m).between(low, high), F.lit(True))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
