"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.session import written


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``id, component`` for every id of ``links`` (columns ``a`` and ``b``); a component is named by its lowest id.

    Each round every id takes its lowest neighbour as its parent, follows parents to the top, and
    the links between tops are the next round's: those within a tree are gone, so the links shrink
    by the round.  Links of a hub are summed before they are dealt out, and every step is a
    written table, so neither a hub nor a lost executor costs the work before.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-links")
    total, k = None, 0
    while True:
        k += 1
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("a").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e"))
        tops = _tops(written(ends.groupBy("e.id").agg(F.min("e.to").alias("name")), f"{label}-{k}"), f"{label}-{k}")
        total = tops if total is None else written(_through(total, tops), f"{label}-{k}-total")
        of_a, of_b = (tops.select(F.col("id").alias(c), F.col("name").alias(f"top_{c}")) for c in "ab")
        between = edges.join(of_a, "a").join(of_b, "b").where("top_a <> top_b")
        edges = written(between.select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b")).distinct(), f"{label}-{k}-between")
        if edges.isEmpty():
            return total.select("id", F.col("name").alias("component"))


def _through(names: DataFrame, after: DataFrame) -> DataFrame:
    """``names`` with each name replaced by the name that it has in ``after``, if any."""
    further = after.select(F.col("id").alias("name"), F.col("name").alias("next"))
    return names.join(further, "name", "left").select("id", F.coalesce("next", "name").alias("name"), (F.col("next") < F.col("name")).alias("moved"))


def _tops(parents: DataFrame, label: str) -> DataFrame:
    """Every id with the top of its tree, in as many steps as the logarithm of the tree's height."""
    names, k = parents, 0
    while True:
        k += 1
        moved = written(_through(names, names), f"{label}-up-{k}")
        names = moved.select("id", "name")
        if moved.where("moved").isEmpty():
            return names
