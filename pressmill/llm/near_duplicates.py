"""Near duplicates by order min-hash, verified by banded alignment.

The k-mers of a text are its shingles of five words, each labelled with its occurrence.  A sketch
takes the ``KEPT`` k-mers of lowest hash and keeps them in the order of the text, so texts meet
in a sketch if they share k-mers *and* their order.  Texts that meet are aligned: the similarity
is the aligned shingles over all shingles of both, aligned ones once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import WordHashes, mix, slices, texts_of
from pressmill.llm.components import components
from pressmill.session import written

WORDS = 5
SIMILARITY = 0.8
#: Sketches of a text, and k-mers in each: two texts of similarity 0.8 meet in one of them with
#: probability 1 - (1 - 0.8**4) ** 14 = 0.9994.
SKETCHES, KEPT = 14, 4
#: Members of a bucket with which all its members are compared.
PIVOTS = 3
FURTHER_PIVOTS = 4
#: Buckets up to this size are searched in full for what the pivots left apart.
SMALL_BUCKET = 64
MULTIPLIERS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of runs of ``size`` words; of all words if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(min(size, len(words))))
    for k in range(min(size, len(words))):
        out = mix(out + words[k : k + n] * np.uint64(2 * k + 3))
    return out


def labelled(kmers: np.ndarray) -> np.ndarray:
    """K-mers told apart by their occurrence: the first, the second and so on of each."""
    order = np.argsort(kmers, kind="stable")
    same = kmers[order[1:]] == kmers[order[:-1]]
    if not same.any():
        return kmers
    run = np.arange(len(kmers))
    start = np.where(np.r_[True, ~same], run, 0)
    occurrence = np.empty(len(kmers), np.uint64)
    occurrence[order] = run - np.maximum.accumulate(start)
    return np.where(occurrence > 0, mix(kmers + occurrence * np.uint64(0xD1B54A32D192ED03)), kmers)


def sketches(kmers: np.ndarray, kept: int = KEPT) -> np.ndarray:
    """For each sketch a hash of the lowest k-mers in text order."""
    if not len(kmers):
        return np.zeros(0, np.uint64)
    named = labelled(kmers)
    if len(named) <= kept:
        places = np.tile(np.arange(len(named)), (SKETCHES, 1))
    elif len(named) > 50_000:
        places = np.sort([np.argpartition(named * m, kept)[:kept] for m in MULTIPLIERS], axis=1)
    else:
        places = np.sort(np.argpartition(named[None, :] * MULTIPLIERS[:, None], kept, axis=1)[:, :kept], axis=1)
    out = MULTIPLIERS.copy()
    for column in named[places].T:
        out = mix(out + column)
    return out


def longest_common(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence among paths within ``band`` of the diagonal.

    One row of the table is the bits of an integer that holds the columns in the band only.
    """
    places: dict[int, list[int]] = {}
    for j, value in enumerate(b):
        places.setdefault(value, []).append(j)
    width = 2 * band + 1
    full = (1 << width) - 1
    row, low, total = full, -band, 0
    for i, value in enumerate(a):
        if i:
            total += not row & 1
            row = row >> 1 | 1 << (width - 1)
            low += 1
        match = 0
        for j in places.get(value, ()):
            if 0 <= j - low < width:
                match |= 1 << (j - low)
        if match:
            hit = row & match
            row = ((row + hit) | (row & ~match)) & full
    return total + width - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of both; 0 where it can't reach ``least``."""
    n, m = len(a), len(b)
    need = least / (1 + least) * (n + m) - 1e-9
    if not n or not m or min(n, m) < need:
        return 0.0
    k = min(n, m)
    differ = np.flatnonzero(a[:k] != b[:k])
    head = int(differ[0]) if len(differ) else k
    differ = np.flatnonzero(a[n - k + head :][::-1] != b[m - k + head :][::-1])
    tail = int(differ[0]) if len(differ) else k - head
    a, b = a[head : n - tail], b[head : m - tail]
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    if head + tail + min(len(a), len(b)) < need:
        return 0.0
    same = len(a) if np.array_equal(a, b) else longest_common(a.tolist(), b.tolist(), int(n + m - 2 * need) + 1)
    found = head + tail + same
    return found / (n + m - found) if found >= need else 0.0


def sketched(docs: DataFrame) -> DataFrame:
    """For each row: ``doc_id``, ``place`` (tells rows apart), ``text_hash``, ``sketch`` and the words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        known = WordHashes()
        for batch in slices(batches, "text"):
            hashes, marks, words = [], [], []
            for text in batch.column("text").to_pylist():
                own = known.array(text.split()) if text else np.zeros(0, np.uint64)
                hashes.append(None if text is None else xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                marks.append(sketches(shingles(own)).view(np.int64))
                words.append((own >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), pa.array(hashes, pa.binary()), pa.array(marks, pa.list_(pa.int64())), pa.array(words, pa.binary())],
                ["doc_id", "place", "text_hash", "sketch", "words"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("place"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, place long, text_hash binary, sketch array<long>, words binary")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those pairs ``a, b`` whose texts (``place, words``) align to ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words_a"):
            of = lambda x: shingles(np.frombuffer(x, "<u4").astype(np.uint64))
            found = [similarity(of(x), of(y), least) for x, y in zip(batch.column("words_a").to_pylist(), batch.column("words_b").to_pylist())]
            kept = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])
            yield kept.filter(pa.compute.greater_equal(kept.column("similarity"), least))

    a = texts.select(F.col("place").alias("a"), F.col("words").alias("words_a"))
    b = texts.select(F.col("place").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a long, b long, similarity double")


def ordered_pairs(rows: DataFrame) -> DataFrame:
    return rows.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shingled(texts: DataFrame) -> DataFrame:
    """``place, n, shingle`` of every labelled shingle of ``texts`` (``place, words``), ``n`` being how many its text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            for place, words in zip(batch.column("place").to_pylist(), batch.column("words").to_pylist()):
                own = labelled(shingles(np.frombuffer(words, "<u4").astype(np.uint64)))
                columns = [np.full(len(own), place, np.int64), np.full(len(own), len(own), np.int32), own.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "n", "shingle"])

    return texts.select("place", "words").mapInArrow(run, "place long, n int, shingle long")


def sharing_rare_shingles(members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """All pairs ``x, y`` of ``members`` (``place, component, outside``) that may be alike to ``least``, of
    different components and one of them ``outside``.

    A prefix filter without loss: shingles stand in one order, rarest first.  Two texts with n and m
    shingles need least / (1 + least) * (n + m) in common, so the first that they share has at least
    as many after it, itself included, in both.
    """
    own = written(shingled(texts.join(members.select("place"), "place", "left_semi")), "shingles")
    count = own.groupBy("shingle").agg(F.count("*").alias("count")).where("count > 1")
    ranked = own.join(count, "shingle").groupBy("place", "n").agg(F.sort_array(F.collect_list(F.struct("count", "shingle"))).alias("shared"))
    listed = ranked.select("place", "n", F.size("shared").alias("listed"), F.posexplode("shared").alias("k", "s"))
    left = (F.col("listed") - F.col("k")).alias("left")
    prefix = listed.where(F.col("listed") - F.col("k") >= least * F.col("n") - 1e-9).select("place", "n", left, F.col("s.shingle").alias("shingle"))
    prefix = written(prefix.join(members, "place"), "prefixes")
    y = prefix.select("shingle", F.col("place").alias("y"), F.col("component").alias("other"), F.col("n").alias("m"), F.col("left").alias("other_left"))
    met = prefix.where("outside").withColumnRenamed("place", "x").join(y, "shingle").where("component <> other")
    return met.where(F.least("left", "other_left") >= least / (1 + least) * (F.col("n") + F.col("m")) - 1e-9).select("x", "y")


def linked(named: DataFrame, more: DataFrame, label: str) -> DataFrame:
    """``named`` (``id, component``) after further links ``a, b``, which join components, of which there are fewer than documents."""
    for end in ("a", "b"):
        of = named.select(F.col("id").alias(end), F.col("component").alias("name"))
        more = more.join(of, end, "left").withColumn(end, F.coalesce("name", end)).drop("name")
    merged = components(more, label).select(F.col("id").alias("component"), F.col("component").alias("merged"))
    out = named.join(merged, "component", "left").select("id", F.coalesce("merged", "component").alias("component"))
    return out.unionByName(merged.join(named.select("id"), F.col("component") == F.col("id"), "left_anti").select(F.col("component").alias("id"), F.col("merged").alias("component")))


def with_components(met: DataFrame, named: DataFrame) -> DataFrame:
    """``bucket, place, component`` of members of buckets; what has no link is a component of its own."""
    rows = met.select("place", "bucket").join(named, F.col("place") == F.col("id"), "left")
    return rows.select("bucket", "place", F.coalesce("component", "place").alias("component"))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``place, doc_id, class_place, class_id`` of every row of ``docs`` (``place, doc_id, text``).

    ``class_place`` is the lowest place of the class, ``class_id`` its lowest ``doc_id``.  Equal
    texts are one class, of any length and empty ones too; each null text is a class of its own.
    Texts of fewer than five words are one shingle.  An empty table gives no row.

    Equal texts are brought to one representative by a hash, then representatives meet in
    buckets.  All members of a bucket are compared with a few pivots of it, not with one another;
    members that are then still apart are compared among themselves in buckets of bounded size.  In
    larger ones those outside the main component meet further pivots first, and what is apart even
    then is compared with all members that share one of its rarest shingles.
    """
    every = written(sketched(docs), "sketched")
    hashed = every.where("text_hash IS NOT NULL")
    first = hashed.groupBy("text_hash").agg(F.min("place").alias("rep"))
    membership = written(hashed.select("place", "doc_id", "text_hash").join(first, "text_hash").select("place", "doc_id", "rep"), "membership")
    reps = membership.where("place = rep").select("place")
    texts = every.select("place", "words")
    buckets = every.select("place", F.posexplode("sketch").alias("band", "mark")).join(reps, "place", "left_semi")
    buckets = buckets.select("place", F.xxhash64("band", "mark").alias("bucket"))
    # The same orders in all buckets, so a document that is first in one is first in many, and a
    # member meets a few pivots and not a few for each bucket.
    mixed = [F.min(F.struct(F.xxhash64("place", F.lit(k)), "place"))["place"].alias(f"p{k}") for k in range(1, PIVOTS)]
    pivots = buckets.groupBy("bucket").agg(F.count("*").alias("size"), F.min("place").alias("p0"), *mixed).where("size > 1")
    met = written(buckets.join(pivots, "bucket"), "buckets")
    pairs = met.select(F.col("place").alias("x"), F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("y"))
    links = written(verified(ordered_pairs(pairs), texts, least), "links")
    named = components(links, "first")
    small = with_components(met.where(f"size BETWEEN 3 AND {SMALL_BUCKET}"), named)
    split = small.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    apart = written(small.join(split.select("bucket"), "bucket"), "apart")
    other = apart.select("bucket", F.col("place").alias("y"), F.col("component").alias("other"))
    crossing = apart.withColumnRenamed("place", "x").join(other, "bucket").where("x < y AND component <> other")
    # In a larger bucket those outside its main component meet further pivots, other ones in each bucket.
    large = with_components(met.where(f"size > {SMALL_BUCKET}"), named)
    further = [F.min(F.struct(F.xxhash64("place", F.lit(k), "bucket"), "place", "component")) for k in range(FURTHER_PIVOTS)]
    mains = large.groupBy("bucket").agg(F.mode("component", True).alias("main"), F.array(*further).alias("pivots"))
    outside = large.join(mains, "bucket").where("component <> main").select("place", "component", F.explode("pivots").alias("p"))
    outside = outside.where("component <> p.component").select(F.col("place").alias("x"), F.col("p.place").alias("y"))
    crossing = written(ordered_pairs(crossing.select("x", "y").unionByName(outside)).join(links, ["a", "b"], "left_anti"), "crossing")
    named = written(linked(named, verified(crossing, texts, least).select("a", "b"), "second"), "named")
    # What the pivots of larger buckets leave outside meets all that share rare shingles with it.
    large = with_components(met.where(f"size > {SMALL_BUCKET}"), named)
    mains = large.groupBy("bucket").agg(F.mode("component", True).alias("main"), F.min("component").alias("low"), F.max("component").alias("high"))
    members = large.join(mains.where("low < high"), "bucket").groupBy("place").agg(F.first("component").alias("component"), F.bool_or(F.col("component") != F.col("main")).alias("outside"))
    rare = ordered_pairs(sharing_rare_shingles(written(members, "members"), texts, least)).join(crossing, ["a", "b"], "left_anti")
    named = linked(named, verified(rare, texts, least).select("a", "b"), "classes")
    rows = membership.join(named, F.col("rep") == F.col("id"), "left").select("place", "doc_id", F.coalesce("component", "rep").alias("class_place"))
    rows = rows.unionByName(every.where("text_hash IS NULL").select("place", "doc_id", F.col("place").alias("class_place")))
    lowest = rows.groupBy("class_place").agg(F.min("doc_id").alias("class_id"))
    return rows.join(lowest, "class_place").select("place", "doc_id", "class_place", "class_id")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``place``, a number for each row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("place"))
