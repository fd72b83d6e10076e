"""Entities of long texts: one pass, the same at every length and gazetteer size."""

import time

import pytest
from pyspark.sql import functions as F

from pressmill.operators import entities as E

UNIT = "New York on 2024-01-05, then Paris: 5 percent "


def tagged(spark, n, max_planned=5000):
    gazetteer = spark.createDataFrame([("New York", "GPE"), ("Paris", "GPE"), ("York on", "GPE")], "phrase string, type string")
    docs = spark.createDataFrame([((UNIT * n).strip(),)], "text string")
    return E.tag_entities(docs, "text", gazetteer, max_planned=max_planned).first().entities


@pytest.mark.parametrize("max_planned", [5000, 0])
def test_offsets_across_the_parts_of_a_scan(spark, max_planned):
    n = 3 * E.SCAN_PART + 5
    got = [(e.text, e.type, e.start_char, e.end_char) for e in tagged(spark, n, max_planned)]
    want = []
    for k in range(n):
        for text, kind in [("New York", "GPE"), ("2024-01-05", "DATE"), ("Paris", "GPE"), ("5 percent", "PERCENT")]:
            at = k * len(UNIT) + UNIT.index(text)
            want.append((text, kind, at, at + len(text)))
    assert got == want


def test_scan_carries_its_state(spark):
    n = 2 * E.SCAN_PART + 3
    step = lambda total, x: (total + x, F.when(x % 2 == 0, F.array(total + x)).otherwise(F.array().cast("array<bigint>")))
    rows = spark.createDataFrame([(list(range(n)),), ([],)], "xs array<bigint>")
    got = [r[0] for r in rows.select(E.scanned(F.col("xs"), F.lit(0).cast("bigint"), "bigint", step)).collect()]
    assert got == [[k * (k + 1) // 2 for k in range(n) if k % 2 == 0], []]


def test_cost_grows_with_the_text(spark):
    tagged(spark, 10)
    took = []
    for n in (1000, 8000):  # 8,000 and 64,000 words
        start = time.time()
        assert len(tagged(spark, n)) == 4 * n
        took.append(time.time() - start)
    assert took[1] < 16 * max(took[0], 1)
