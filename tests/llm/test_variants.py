"""Spelling variants against plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pressmill.llm import variants
from pressmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(docs, drop_one=31):
    """The result's rows from ``(doc_id, text)``, with a deletion neighbourhood to find the pairs."""
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if drop_one and h % drop_one == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    holes = {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault(w[:k] + w[k + 1 :], set()).add(w)
        holes.setdefault(w, set()).add(w)
    near = {w: set() for w in words}
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    forms = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 10 * words[w]:
                forms[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out.add((w, form, root, n, len(near[w]), words.get(form)))
    return out


def result(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def made_up(seed, n):
    rng = random.Random(seed)
    stems = ["abcabcab", "aaaaaaaa", "abababab", "éàéàéàé", "internation", "zzzzzzz"]
    docs = []
    for k in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2, 3])):
                at, c = rng.randrange(len(w) + 1), rng.choice("abé")
                w = rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.append(rng.choice([w, w, w.upper(), w.capitalize()]))
        docs.append((k, rng.choice([" ", ", ", "-1 "]).join(words)))
    return docs


@pytest.mark.parametrize("crowd", [4096, 2, 40])
def test_equal_to_all_pairs(spark, crowd):
    docs = made_up(crowd, 120)
    got = result(variants.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), crowd=crowd))
    assert got == plain(docs) and sum(r[1] is not None for r in got) > 20


def test_roots_follow_forms_to_the_last(spark):
    docs = [(1, "lettertz " * 2 + "lettertx " * 20 + "letterts " * 200 + "letters " * 2000 + "another " * 3)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: (r.form, r.root) for r in variants.variants(docs, drop_one=None).collect()}
    assert got == {"lettertz": ("letterts", "letters"), "lettertx": ("letterts", "letters"), "letterts": ("letters", "letters"), "letters": (None, "letters"), "another": (None, "another")}
    chain = spark.createDataFrame([(f"w{k:02}", f"w{k + 1:02}") for k in range(11)], "word string, form string")
    assert {r.root for r in variants.roots(chain).collect()} == {"w11"}


@pytest.mark.parametrize("tile", [1, 2, 512])
def test_near_pairs_of_one_group(monkeypatch, tile):
    monkeypatch.setattr(variants, "TILE", tile)
    words = np.array(["aaaaaaa", "aaaaaaaa", "aaaaaab", "baaaaaa", "aaabaaaa", "aaaaaabb"])
    got = {frozenset((words[a], words[b])) for low, high in [(0, 3), (3, 5), (5, 8)] for a, b in zip(*variants.near_pairs(words, 7, low, high))}
    assert got == {frozenset((a, b)) for a in words for b in words if one_edit(a, b) and 7 in (len(a), len(b)) and a != b}


def test_query_equals_a_plain_one(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op12_spelling_variants"](spark, SF)) == plain(rows)


def test_edges(spark):
    schema = "doc_id long, text string, word string, n int, shared string"
    long = "q" * 100_000
    rows = [(None, "sentence sentence", "x", 1, "y"), (1, None, None, None, None), (2, "", "w", 2, "s"), (3, f"{long} {long} {long}", "w", 2, "s"), (4, "sentense sentense 12", "w", 2, "s"), (4, "sentense sentense 12", "w", 2, "s")]
    docs = spark.createDataFrame(rows, schema)
    got = result(variants.variants(docs, drop_one=None))
    assert got == {("sentence", None, "sentence", 2, 1, None), ("sentense", None, "sentense", 4, 1, None), (long, None, long, 3, 0, None)}
    assert variants.variants(docs.limit(0)).count() == 0
