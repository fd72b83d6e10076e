"""Spelling variants: words one edit apart, found by dense comparison of tiles of words.

Two words differ by one inserted, deleted or replaced code point exactly if the lengths of their
common prefix and common suffix together reach the longer length less one.  Words are compared in
tiles: matrices of code points, padded with zeros, a block against a block, column by column.

Which blocks meet: a pair belongs to the shorter length ``m`` of the two and to the position of
its edit (the common prefix's length).  With the edit in a stretch ``[low, high)`` of positions,
both words share what is before ``low`` and what follows ``high``.  So words are grouped by ``m``,
a stretch, and what they share; the first stretches are the halves of ``m``.  A group of more than
``CROWD`` words is dealt anew by halves of its stretch, down to one position, and from there its
words differ in that one code point only.  Each pair meets in one group that counts it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import slices
from pressmill.session import written

#: Words at least so long, and found at least so often, are compared.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
TIMES = 10
#: Words in a group before it is dealt anew; words in a side of a tile; rows in a bucket of groups.
CROWD, TILE, BUCKET = 4096, 512, 200_000
#: Distinct words that a task sums before it hands them on.
HELD = 400_000

RUNS = "[A-Za-zÀ-ÿ]+"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def counted(docs: DataFrame, drop_one: int | None = 31) -> DataFrame:
    """``word, n``: runs of letters in all texts, ``A`` to ``Z`` lowered.

    A run loses one code point where the checksum of its document and itself is a multiple of
    ``drop_one`` (None: never), as planted misspellings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        from zlib import crc32

        letters, held = re.compile(RUNS).findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for piece in slices(batches, "text"):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                if not text:
                    continue
                start = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(letters(text)).items():
                    word = word.lower() if word.isascii() else word.translate(LOWER)
                    if drop_one is not None and not (h := crc32(word.encode(), start)) % drop_one:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1 :]
                    held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def stretch(word: Column, m: Column, low: Column, high: Column) -> Column:
    """What words of a group share: the code points before ``low``, and those that follow ``high`` positions of ``m``."""
    before = F.substring(word, F.lit(1), low)
    rest = F.greatest(m - high, F.lit(0))
    after = F.when(rest > 0, F.substring(word, F.char_length(word) - rest + 1, rest)).otherwise(F.lit(""))
    return F.concat_ws("\n", before, after)


def grouped(words: DataFrame, crowd: int) -> DataFrame:
    """``word, n, m, low, high, shared``: every word in the groups that it is compared in.

    ``high`` is past ``m`` by one in the last stretch, as a code point may be appended.
    """
    length = F.char_length("word")
    both = words.select("*", F.explode(F.array(length, length - 1)).alias("m")).where(f"m >= {LEAST_LENGTH}")
    half = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("low"), half.alias("high")), F.struct(half.alias("low"), (F.col("m") + 1).alias("high")))
    rows = both.select("*", F.explode(halves).alias("s")).select("word", "n", "m", "s.low", "s.high")
    keys, done = ["m", "low", "high", "shared"], None
    while True:
        rows = written(rows.withColumn("shared", stretch(F.col("word"), F.col("m"), F.col("low"), F.col("high"))), "variant-groups")
        large = written(rows.groupBy(*keys).count().where(F.col("count") > crowd).where("high - low > 1").select(*keys), "variant-crowds")
        small = rows.join(large, keys, "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        rows = rows.join(large, keys, "left_semi").select("word", "n", "m", F.explode(halves).alias("s")).select("word", "n", "m", "s.low", "s.high")


def matrix(words: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words, ``width`` columns from the left, and as many to the right end."""
    codes = np.ascontiguousarray(words.astype(f"U{width + 1}")).view(np.uint32).reshape(len(words), -1)
    if codes.max(initial=0) < 256:
        codes = codes.astype(np.uint8)
    right = np.take_along_axis(codes, np.maximum(lengths[:, None] - width + np.arange(width), 0), 1)
    return codes[:, :width], right


def alike(a: np.ndarray, b: np.ndarray, backwards: bool) -> np.ndarray:
    """Lengths of common prefixes (or suffixes) of each row of a block with each of another."""
    same = np.ones((len(a), len(b)), bool)
    total = np.zeros((len(a), len(b)), np.uint8 if a.shape[1] < 256 else np.uint32)
    for k in range(a.shape[1])[:: -1 if backwards else 1]:
        same &= a[:, k, None] == b[None, :, k]
        if not same.any():
            break
        total += same
    return total


def near_pairs(words: np.ndarray, m: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs one edit apart in a group, with the edit in its stretch of positions.

    Words of ``m`` code points are compared with one another and with those of ``m + 1``.
    """
    lengths = np.char.str_len(words)
    left, right = matrix(words, lengths, m)
    short, long = np.flatnonzero(lengths == m), np.flatnonzero(lengths == m + 1)
    found = [(np.zeros(0, np.int64),) * 2]
    for others, same_length in ((short, True), (long, False)):
        for i in range(0, len(short), TILE):
            for k in range(i if same_length else 0, len(others), TILE):
                a, b = short[i : i + TILE], others[k : k + TILE]
                prefix, suffix = alike(left[a], left[b], False), alike(right[a], right[b], True)
                near = (prefix.astype(np.int64) + suffix >= (m - 1 if same_length else m)) & (prefix >= low) & (prefix < high)
                if same_length:
                    near &= prefix < m
                    if i == k:
                        near = np.triu(near, 1)
                x, y = np.nonzero(near)
                found.append((a[x], b[y]))
    return tuple(np.concatenate(c) for c in zip(*found))


def compared(table: pa.Table) -> pa.Table:
    """One bucket of groups: for each word in it, its near words' number and the most frequent of them."""
    words, n = np.array(table["word"].to_pylist(), dtype=str), table["n"].to_numpy()
    m, low, high = (table[c].to_numpy() for c in ("m", "low", "high"))
    shared = np.unique(np.array(table["shared"].to_pylist(), dtype=str), return_inverse=True)[1]
    order = np.lexsort([shared, high, low, m])
    keys = np.stack([m, low, high, shared])[:, order]
    starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]) if len(order) else np.zeros(0, int)
    pairs = [(np.zeros(0, np.int64),) * 2]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
        if b - a > 1:
            at = order[a:b]
            x, y = near_pairs(words[at], int(m[at[0]]), int(low[at[0]]), int(high[at[0]]))
            pairs += [(at[x], at[y]), (at[y], at[x])]
    of, other = (np.concatenate(c) for c in zip(*pairs))
    rank = np.unique(words, return_inverse=True)[1]
    best_first = np.lexsort([rank[other], -n[other], of])
    of, other = of[best_first], other[best_first]
    mine, first, times = np.unique(of, return_index=True, return_counts=True)
    best = other[first]
    columns = {"word": words[mine].tolist(), "n_near": times, "best_n": n[best], "best": words[best].tolist()}
    return pa.table({k: pa.array(v, pa.string() if k in ("word", "best") else pa.int64()) for k, v in columns.items()})


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``word, n_near, best, best_n`` of every word that has near words, among distinct ``words`` (``word, n``).

    ``best`` is the near word with the highest ``n``, the smallest in code-point order among equals.
    """
    groups = grouped(words, crowd)
    buckets = max(64, groups.count() // BUCKET)
    bucket = F.pmod(F.xxhash64("m", "low", "high", "shared"), F.lit(buckets)).alias("bucket")
    found = groups.select("*", bucket).groupBy("bucket").applyInArrow(compared, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last word on each word's way over ``forms`` (``word, form``), by doubled steps.

    A form is ``TIMES`` as frequent as its word, so ways are short and never closed.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, drop_one: int | None = 31, crowd: int = CROWD) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of every distinct word of at least 7 code points and 2 occurrences.

    ``form`` is the word's most frequent near word if that is ten times as frequent, else null;
    ``root`` follows forms to the last, or is the word.  Null and empty texts have no words; equal
    rows count each; a run of any length is one word; an empty table gives no row; other columns
    than ``doc_id`` (null: empty) and ``text`` aren't read.
    """
    words = written(counted(docs, drop_one).where(f"char_length(word) >= {LEAST_LENGTH} AND n >= {LEAST_COUNT}"), "variant-words")
    near = written(near_words(words, crowd), "variant-near")
    chosen = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= TIMES * F.col("n"), F.lit(False)))
    chosen = written(chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n")), "variant-forms")
    last = roots(chosen.where("form IS NOT NULL").select("word", "form"))
    return chosen.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
