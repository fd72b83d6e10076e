"""The backoff model against a plain one, and its distributions' sums."""

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import backoff, blobs
from pressmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


class Plain:
    """Katz's model over tuples of words, with the discounts given."""

    def __init__(self, texts, order, discounts):
        self.order, self.discounts = order, discounts
        self.counts = {n: Counter() for n in range(1, order + 1)}
        self.starts = 0
        for text in texts:
            words = ["<s>", *self.words(text)]
            self.starts += 1
            for n in self.counts:
                for k in range(1 if n == 1 else n - 1, len(words)):
                    self.counts[n][tuple(words[k - n + 1 : k + 1])] += 1
        self.total = sum(self.counts[1].values())
        self.vocabulary = [w for (w,) in self.counts[1]]

    @staticmethod
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [w.decode() for w in low.encode().split()] + ["</s>"]

    def left(self, n, c):
        d = self.discounts[n]
        return d.left[c] if c < len(d.left) else c - d.taken

    def p(self, history, w):
        n = len(history) + 1
        c = self.counts[n][(*history, w)]
        if n == 1:
            return self.left(1, c) / self.total if c else 1 - sum(self.left(1, c) for c in self.counts[1].values()) / max(self.total, 1)
        of_context = self.starts if history == ("<s>",) else self.counts[n - 1][history]
        if not of_context:
            return self.p(history[1:], w)
        if c:
            return self.left(n, c) / of_context
        seen = [x for x in self.vocabulary if self.counts[n][(*history, x)]]
        freed = 1 - sum(self.left(n, self.counts[n][(*history, x)]) for x in seen) / of_context
        return freed / (1 - sum(self.p(history[1:], x) for x in seen)) * self.p(history[1:], w)

    def score(self, text):
        words = ["<s>", *self.words(text)]
        return sum(log10(self.p(tuple(words[max(0, k - self.order + 1) : k]), words[k])) for k in range(1, len(words)))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "é", "x1", " ", "of", "rare%d" % seed, *(f"w{k}" for k in range(30))]
    return [None, "", "  \n", *(" ".join(rng.choices(vocabulary, [2.0 ** -(k / 4) for k in range(len(vocabulary))], k=rng.randrange(40))) for _ in range(n))]


@pytest.mark.parametrize("order,size", [(1, 1000), (2, 60), (3, 60), (4, 10**6)])
def test_scores_equal_a_plain_model(spark, order, size):
    texts = corpus(order, 120)
    docs = spark.createDataFrame([(k, t, k % 4 != 1) for k, t in enumerate(texts)], "doc_id long, text string, mine boolean").repartition(3)
    got = backoff.scored(docs, F.col("mine"), order, size)
    plain = Plain([t for k, t in enumerate(texts) if k % 4 != 1], order, got.discounts)
    rows = got.rows.collect()
    assert len(rows) == len(texts)
    for r in rows:
        words, single = plain.words(texts[r.doc_id]), plain.counts[1]
        assert r.held_out == (r.doc_id % 4 == 1) and r.n_tokens == len(words) and r.train_tokens == plain.total
        assert r.n_known == sum(single[(w,)] > 0 for w in words)
        base = sum(log10((single[(w,)] + 0.5) / (plain.total + 0.5 * (len(single) + 1))) for w in words)
        assert r.base_score == pytest.approx(base, abs=1e-9) and r.score == pytest.approx(plain.score(texts[r.doc_id]), abs=1e-7)


def test_every_distribution_sums_to_one(spark):
    texts = corpus(9, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = Plain(texts, 3, backoff.scored(docs, F.lit(True), 3, 500).discounts)
    contexts = [(), ("<s>",), ("the",), ("<s>", "the"), ("the", "a"), ("of", "the"), ("w29",), ("never",)]
    for h in contexts:
        assert sum(plain.p(h, w) for w in plain.vocabulary) + plain.p(h, "never seen") == pytest.approx(1, abs=1e-9), h


def test_tables_of_the_model(spark):
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "b a"), (3, "c " * 9)], "doc_id long, text string")
    got = backoff.scored(docs, F.lit(True), 2)
    counts = {n: sorted(c for r in got.counts.where(F.col("n") == n).collect() for c in blobs.expand(r["counts"])) for n in (1, 2)}
    # the start stands among the words as the context of first words
    assert counts == {1: [3, 3, 3, 4, 9], 2: [1, 1, 1, 1, 2, 2, 3, 8]}
    keys = [r["keys"] for r in got.weights.collect()]
    assert sum(len(blobs.expand_keys(k)) for k in keys) == 4  # the start, a, b and c


def test_discounts():
    plain = backoff.Discounts.of([600, 250, 120, 70, 45, 30, 1200, 9000])
    assert len(plain.left) == backoff.MOST_K + 1 and all(0 < left < r for r, left in enumerate(plain.left) if r)
    freed = sum(n * (r - left) for r, (n, left) in enumerate(zip([0, 600, 250, 120, 70, 45], plain.left)))
    assert freed == pytest.approx(600)  # what Good and Turing leave to the unseen
    odd = backoff.Discounts.of([3, 5, 9, 1, 0, 0, 20, 90])
    assert odd.left == (0.0, 0.5) and odd.of_counts(np.array([0, 1, 2, 7])).tolist() == [0, 0.5, 1.5, 6.5]


def test_packing():
    rng = np.random.default_rng(1)
    for values in (np.zeros(0, np.int64), np.zeros(5, np.int64), np.array([0, 255, 256, 2**40]), rng.integers(0, 2**63, 99)):
        assert np.array_equal(blobs.expand(blobs.squeeze(values)), values)
    assert np.array_equal(blobs.expand(blobs.squeeze(np.array([-1.5, 0.0, 3e300])), "<f8"), [-1.5, 0.0, 3e300])
    keys = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert np.array_equal(blobs.expand_keys(blobs.squeeze_keys(keys)), keys)
    parts = list(blobs.cuts(keys, 6))
    assert np.array_equal(np.concatenate([keys[s] for _, s in parts]), keys) and all((keys[s] >> np.uint64(58) == b).all() for b, s in parts)
    assert blobs.bits_for(0) == 6 and blobs.bits_for(1 << 40) > 18


def test_edges(spark):
    schema = "doc_id long, text string, score string, block long, mine boolean"
    rows = [(None, "b a", "x", 1, True), (1, "a " * 300_000, "y", 2, None), (1, "b a", None, None, True), (2, None, "z", 3, True), (2, "", "z", 3, False), (3, "q" * 1_000_000, "z", 3, False)]
    docs = spark.createDataFrame(rows, schema)
    got = backoff.scored(docs, F.col("mine"), 2, 1000).rows.collect()
    assert len(got) == 6 and {r.train_tokens for r in got} == {7} and all(np.isfinite([r.score, r.base_score]).all() for r in got)
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.held_out) for r in got) == [(0, 3, 3, False), (1, 3, 3, False), (1, 300_001, 300_001, True), (2, 1, 1, False), (2, 1, 1, True), (3, 2, 1, True)]
    assert len({r.score for r in got if r.n_tokens == 3}) == 1
    assert backoff.scored(docs.limit(0), F.col("mine")).rows.count() == 0
    untaught = backoff.scored(docs, F.lit(False)).rows.collect()
    assert {(r.score, r.n_known, r.train_tokens) for r in untaught} == {(0.0, 0, 0)}


def test_query_beats_the_base_on_held_out_texts(spark):
    got = QUERIES["op11_backoff_scores"](spark, SF).collect()
    assert len(got) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
