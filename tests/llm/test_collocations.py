"""Collocations: the index against plain counts, the query against its SQL."""

import os
import random
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from check import compare
from pressmill.llm import collocations
from pressmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LETTERS = ["a", "b", "A", "é", "c\tB", "a b a", "b,a", "c. a", "\n", "!", "x\x00", "a;;a  b"]


def n_grams(ids, n):
    grams = Counter()
    for k in range(len(ids) - n + 1):
        gram = tuple(ids[k : k + n])
        if all(gram):
            grams[gram] += 1
    return grams


@pytest.mark.parametrize("seed,words,length", [(1, 3, 200), (2, 40, 500), (3, 1, 50), (4, 5, 1)])
def test_index_counts_every_phrase(seed, words, length):
    rng = random.Random(seed)
    ids = [rng.choice([0, *range(1, words + 1)]) for _ in range(length)]
    index = collocations.Index(np.array(ids), 4)
    for n, x in enumerate(index.phrases(4), 1):
        want = n_grams(ids, n)
        assert dict(zip(map(tuple, x.ids.tolist()), x.size.tolist())) == want
        if n < 4:  # either way leads to the same longer phrases
            for longer in (index.left(x), index.right(x)):
                assert dict(zip(map(tuple, longer.ids.tolist()), longer.size.tolist())) == n_grams(ids, n + 1)


def test_wide_ids_are_ranked_before_they_are_packed():
    ids = np.array([1, 2**30, 5, 0, 1, 2**30, 5, 2**30])
    transform = collocations.Transform(np.r_[ids, 0], 4)
    assert sorted(transform.leads.tolist()) == list(range(9))
    circle = np.r_[ids, 0]
    rows = sorted(range(9), key=lambda k: [int(circle[(k + j) % 9]) for j in range(4)])
    assert transform.last.tolist() == [int(circle[k - 1]) for k in rows]


def made_up(seed, n):
    rng = random.Random(seed)
    return [(k, rng.choice(["en", "de", None, "und"]), rng.choice([None, "", *(rng.choice(["", " "]).join(rng.choices(LETTERS, k=rng.randrange(30))) for _ in range(8))]), k) for k in range(n)]


@pytest.mark.parametrize("size", [20, 10**6])
def test_equal_to_sql_on_made_up_texts(spark, size):
    docs = spark.createDataFrame(made_up(size, 150), "doc_id long, lang string, text string, phrase long")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    text, _, ok = compare(spark, con, "made_up", lambda s, sf: collocations.collocations(docs.repartition(3), size=size), collocations.SQL, SF)
    assert ok, text


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    text, _, ok = compare(spark, con, "op13", QUERIES["op13_collocations"], collocations.SQL, SF)
    assert ok, text


def test_counts_past_64_bits(spark):
    big = 4 * 10**14
    rows = [("en", "a", 1, big), ("en", "b", 1, big), ("en", "a b", 2, big - 1), ("en", "b a", 2, 10)]
    got = {r.phrase: r.score for r in collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, length int, a long")).collect()}
    assert got == {"a b": 1000000 * (big - 1) ** 2 // big**2, "b a": 0}


def test_leading_by_salts_is_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice("xy"), f"p{k}", rng.randrange(4), rng.randrange(3)) for k in range(3000)], "lang string, phrase string, a long, score long")
    whole = {tuple(r) for r in collocations.leading(rows, 50).collect()}
    monkeypatch.setattr(collocations, "RANKED", 10)
    assert {tuple(r) for r in collocations.leading(rows, 50).collect()} == whole and len(whole) == 100


def test_edges(spark):
    schema = "doc_id long, lang string, text string, a string, n int, length int"
    rows = [(1, None, None, "x", 1, 1), (2, "en", "", "x", 1, 1), (3, "en", ".,;\n", None, None, None), (4, "fr", "w " * 300_000, "x", 1, 1), (5, "en", "q" * 500_000, "x", 1, 1), (5, "en", "q" * 500_000, "x", 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in collocations.collocations(docs).select("lang", "phrase", "a", "l", "r", "n", "score").collect()]
    # "w w" stands inside "w w w", which takes the cut after its first word
    assert got == [("fr", "w w w", 299_998, 300_000, 299_999, 300_000, 1000000 * 299_998**2 // (300_000 * 299_999))]
    assert collocations.collocations(docs.limit(0)).count() == 0
