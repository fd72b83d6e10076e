"""Language identification, quality model and quality rules."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressmill.llm import language, quality_model, quality_rules
from pressmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_bundles_are_sums_of_bound_letter_vectors():
    texts, codes = ["Ab, cab!", "", "éa  b", "12"], language.letter_codes()
    keys, owner, has = language.trigrams(texts, codes)
    got = language.bundles(keys, owner, len(texts), 256)
    assert has.tolist() == [True, False, True, False]
    for k, text in enumerate(texts):
        points = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        points = " ".join(points.split(" ")) if False else " " + " ".join(points.split()) + " " if points.split() else " "
        want = np.zeros(256)
        for a, b, c in zip(points, points[1:], points[2:]):
            if b != " ":
                x, y, z = (np.unpackbits(language.letter_vectors(np.array([ord(p)]), 256).view(np.uint8)) * 2.0 - 1 for p in (a, b, c))
                want += -np.roll(x, 128) * -np.roll(y, 64) * z  # exclusive or is the product, but for the sign
        assert np.array_equal(got[k], want), text


def test_blocks_give_the_same_bundles(monkeypatch):
    texts, codes = [f"word{chr(97 + k % 26)} other{chr(98 + k % 20)}" for k in range(40)], language.letter_codes()
    keys, owner, _ = language.trigrams(texts, codes)
    whole = language.bundles(keys, owner, len(texts), 128)
    monkeypatch.setattr(language, "COLUMNS", 7)
    monkeypatch.setattr(language, "ROWS", 3)
    assert np.array_equal(language.bundles(keys, owner, len(texts), 128), whole)


def test_languages_of_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score string, place int"
    rows = [(1, "the cat and the dog", "en", "x", 1), (2, "le chat et la souris", "fr", "y", 2), (3, None, "en", "z", 3), (4, "", None, None, 4), (5, "12 34", "fr", "q", 5), (1, "the cat and the dog", "en", "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    model = language.prototypes(docs, F.col("text"), F.col("lang"))
    assert set(model) == {"en", "fr"}
    got = {(r.doc_id, r.lang_pred, round(r.score, 3), r.place) for r in language.predict(docs, model).collect()}
    assert {g[:2] for g in got} == {(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und")} and len(got) == 5
    none = spark.createDataFrame([], schema)
    assert language.predict(none, model).count() == 0 and language.prototypes(none, F.col("text"), F.col("lang")) == {}
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = QUERIES["op2_quality_classifier"](spark, f"{SF}/../sf0.01").join(labels, "doc_id", "left").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_prior_and_risk():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(2, 1, (3000, 5)), rng.normal(-2, 1, (3000, 5))
    unlabelled = np.r_[good[:1400], bad[:600]]
    rng.shuffle(unlabelled)
    ones = lambda x: np.c_[x, np.ones(len(x))]
    assert abs(quality_model.estimated_prior(ones(good[1500:]), ones(unlabelled)) - 0.7) < 0.08
    model = quality_model.fitted(good[1500:].astype(np.float32), unlabelled.astype(np.float32)) if quality_model.FEATURES == 5 else None
    if model is None:
        pad = lambda x: np.c_[x, np.zeros((len(x), quality_model.FEATURES - 5))]
        model = quality_model.fitted(pad(good[1500:]), pad(unlabelled))
        assert (model.score(pad(good[:500])) > 0.5).mean() > 0.97 and (model.score(pad(bad[1000:])) < 0.5).mean() > 0.97


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "t"), (None, "Some words here.", "u"), (2, "", "t")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_model.learnt(docs, labels)
    assert [r.score for r in quality_model.scored(docs, model).collect()] == [0.5] * 4
    assert quality_model.scored(docs.limit(0), model).count() == 0
    assert np.isfinite(quality_model.features(["x" * 1_000_000, "퟿", "\n"], quality_model.kind_tables())).all()


def counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = text.split("\n")
    duplicates = sum(bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered)


@pytest.mark.parametrize("text", ["", " \n\n", "a b c a b c", "x\nx\n \n \n", "a\x1cb\x85c d e", "# a|b <c>\n# a|b <c>", "a a a a", "é é\té é é"])
def test_counts_equal_the_plain_ones(text):
    from pressmill.llm.common import WordHashes

    assert quality_rules.counts_of(text, WordHashes()) == counts(text)


def test_quality_rules(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "LEAST_TEXTS", 5)
    plain = lambda k: " ".join(f"w{(k * 7 + j * j) % 1009}x{j}" for j in range(60))
    rows = [(k, plain(k), "en", "a") for k in range(20)]
    rows += [(50, plain(50).replace(" ", " ### "), "en", "a"), (51, "short", "en", "a"), (52, None, None, None), (53, "w " * 80, "en", "b"), (54, plain(54), "fr", None), (54, plain(54), "fr", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, source string, kept string")
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert quality_rules.judged(docs).count() == len(rows)
    assert {k for k, r in got.items() if r.base_failed} == {51, 52, 53}
    assert {k for k, r in got.items() if not r.kept} == {50, 51, 52, 53}
    for k, text, *_ in rows:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text or "")
    assert quality_rules.judged(docs.limit(0)).count() == 0


def test_query_keeps_clean_documents(spark):
    got = QUERIES["op9_quality_rules"](spark, SF).collect()
    assert len(got) == 200 and sum(r.kept for r in got) > 120
    assert all(not r.kept for r in got if r.base_failed)
