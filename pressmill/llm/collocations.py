"""Collocations: word n-grams of each language from one FM-index for each shard of text.

A shard is some million words of one language, as ids of its own dictionary, with 0 between pieces.
Its index has the Burrows-Wheeler transform of the ids and of the ids reversed, with rows sorted to
a fixed depth, which is exact for patterns up to that length.  An n-gram is a pair of intervals,
one in each; extending it to the right or to the left narrows both at once, for all n-grams of a
length together, and the interval's size is the count in the shard.

Counts are summed over shards in two steps.  Hashed n-grams with their counts go to buckets, which
tell each shard what may reach the least count in all (a hash shared by two n-grams only adds).
Those alone are written out as words, and exact counts are sums of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm import blobs
from pressmill.llm.blobs import batch_of, chained, cuts, expand, expand_keys, grouped, squeeze, squeeze_keys
from pressmill.llm.common import slices, texts_of
from pressmill.session import written

#: Longest phrase; least count of a candidate; rows returned for each language.
LONGEST, LEAST, MOST = 3, 10, 2000
#: A candidate goes if a longer one around it has at least so many hundredths of its count.
COVERED = 50
#: Rows of one language that one task ranks, about.
RANKED = 500_000

SHARD_ROWS = "shard long, lang string, tokens long, words binary, sequence binary"
ASKED_ROWS = "n int, shard long, bucket int, keys binary, counts binary"
ANSWER_ROWS = "n int, shard long, bucket int, frequent binary, many long"

#: Bytes of a text in lower case (A to Z only), blanks for tabs, and 255 where a piece ends.
CLEANED = bytes(255 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shards(docs: DataFrame, size: int = blobs.BLOCK) -> DataFrame:
    """Texts in shards of one language and about ``size`` words: the dictionary, and ids with 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, tuple[dict, list]] = {}
        totals: dict[str, int] = {}

        def shard(lang: str) -> pa.RecordBatch:
            nonlocal made
            ids, parts = held.pop(lang)
            total = totals.pop(lang)
            words = b" ".join([b"", *list(ids)[1:]])
            row = {"shard": task + made, "lang": lang, "tokens": total}
            row["words"] = len(words).to_bytes(8, "little") + pa.compress(words, codec="zstd", asbytes=True)
            sequence = np.concatenate(parts)
            row["sequence"] = squeeze(sequence[np.r_[True, (sequence[1:] > 0) | (sequence[:-1] > 0)]])
            made += 1
            return batch_of([row], SHARD_ROWS)

        for piece in slices(batches, "text"):
            for lang, text in zip(piece.column("lang").to_pylist(), texts_of(piece, "text")):
                words = text.encode("utf-8", "surrogatepass").translate(CLEANED).replace(b"\xff", b" \xff ").split()
                if not words:
                    continue
                ids, parts = held.setdefault(lang, ({b"\xff": 0}, []))
                for w in words:
                    if w not in ids:
                        ids[w] = len(ids)
                part = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
                parts += [part, np.zeros(1, np.int32)]
                totals[lang] = totals.get(lang, 0) + int(np.count_nonzero(part))
                if totals[lang] >= size:
                    yield shard(lang)
                elif sum(totals.values()) >= 2 * size:
                    yield shard(max(totals, key=totals.get))
        for lang in list(held):
            yield shard(lang)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SHARD_ROWS)


def dictionary(blob: bytes) -> list[bytes]:
    """The words of a shard by id; none has id 0."""
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).split(b" ")


class Transform:
    """Burrows-Wheeler transform of ids (as a circle), with rows sorted by their first ``depth`` ids."""

    def __init__(self, ids: np.ndarray, depth: int):
        bits = int(ids.max(initial=1)).bit_length()
        key, width = ids.astype(np.uint64), bits
        for k in range(1, depth):
            if width + bits > 64:
                key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
                width = int(key.max()).bit_length()
            key, width = key << np.uint64(bits) | np.roll(ids, -k).astype(np.uint64), width + bits
        rows = np.argsort(key, kind="stable")
        self.last = ids[rows - 1]
        #: The row that each row's last id, put before it, leads to.
        self.leads = np.empty(len(ids), np.int64)
        self.leads[np.argsort(self.last, kind="stable")] = np.arange(len(ids))


@dataclass
class Intervals:
    """N-grams: ids (one row each), first rows in the two transforms, sizes."""

    ids: np.ndarray
    first: np.ndarray
    mirrored: np.ndarray
    size: np.ndarray


class Index:
    """Both transforms of a shard's ids."""

    def __init__(self, ids: np.ndarray, depth: int):
        circle = np.r_[ids, 0].astype(np.int64)
        self.forward, self.backward = Transform(circle, depth), Transform(circle[::-1], depth)
        self.counts = np.bincount(circle)

    def words(self) -> Intervals:
        starts = np.cumsum(self.counts) - self.counts
        ids = np.flatnonzero(self.counts[1:]) + 1
        return Intervals(ids[:, None], starts[ids], starts[ids], self.counts[ids])

    @staticmethod
    def extended(transform: Transform, first: np.ndarray, mirrored: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every interval by every id but 0 before it: which one, the id, first rows and sizes."""
        which = np.repeat(np.arange(len(size)), size)
        rows = np.arange(len(which)) + np.repeat(first - (np.cumsum(size) - size), size)
        pairs, at, counts = np.unique(which.astype(np.uint64) << np.uint64(32) | transform.last[rows].astype(np.uint64), return_index=True, return_counts=True)
        which, ids = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        before = np.cumsum(counts) - counts
        smaller = before - (np.cumsum(size) - size)[which]  # ids below this one in the same interval
        real = ids > 0
        return which[real], ids[real], transform.leads[rows[at]][real], (mirrored[which] + smaller)[real], counts[real]

    def right(self, x: Intervals) -> Intervals:
        which, ids, mirrored, first, size = self.extended(self.backward, x.mirrored, x.first, x.size)
        return Intervals(np.c_[x.ids[which], ids], first, mirrored, size)

    def left(self, x: Intervals) -> Intervals:
        which, ids, first, mirrored, size = self.extended(self.forward, x.first, x.mirrored, x.size)
        return Intervals(np.c_[ids, x.ids[which]], first, mirrored, size)

    def phrases(self, longest: int) -> Iterator[Intervals]:
        """All n-grams up to ``longest`` by length, extended to the right and to the left in turn."""
        x = self.words()
        yield x
        for n in range(2, longest + 1):
            x = self.right(x) if n % 2 == 0 else self.left(x)
            yield x


def keyed(row: dict, longest: int) -> Iterator[tuple[int, np.ndarray, Intervals, list[bytes]]]:
    """Length, ordered keys (by language and words), the n-grams in that order, and the dictionary."""
    from xxhash import xxh3_64_intdigest

    words = dictionary(row["words"])
    hashes = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    lang = np.array([xxh3_64_intdigest(row["lang"].encode())], np.uint64)
    for n, x in enumerate(Index(expand(row["sequence"]), longest).phrases(longest), 1):
        keys = np.broadcast_to(lang, len(x.ids))
        for k in range(n):
            keys = chained(keys, hashes[x.ids[:, k]])
        order = np.argsort(keys)
        yield n, keys[order], Intervals(x.ids[order], x.first[order], x.mirrored[order], x.size[order]), words


def asked(rows: DataFrame, longest: int, bits: int) -> DataFrame:
    """Keys and counts of the n-grams of each shard, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for n, keys, x, _ in keyed(row, longest):
                    yield batch_of([{"n": n, "shard": row["shard"], "bucket": b, "keys": squeeze_keys(keys[s]), "counts": squeeze(x.size[s])} for b, s in cuts(keys, bits)], ASKED_ROWS)

    return rows.mapInArrow(run, ASKED_ROWS)


def answered(least: int):
    """One bucket: which keys of each shard have a sum of ``least`` or more over all shards."""

    def run(table: pa.Table) -> pa.Table:
        rows, out = table.to_pylist(), []
        for n in sorted({r["n"] for r in rows}):
            mine = [r for r in rows if r["n"] == n]
            sent = [expand_keys(r["keys"]) for r in mine]
            keys, at = grouped(sent)
            enough = (np.bincount(at, np.concatenate([expand(r["counts"]) for r in mine]), len(keys)) >= least)[at]
            begin = 0
            for r, k in zip(mine, sent):
                bits = enough[begin : begin + len(k)]
                begin += len(k)
                out.append({"n": n, "shard": r["shard"], "bucket": r["bucket"], "frequent": np.packbits(bits).tobytes(), "many": len(k)})
        return pa.Table.from_batches([batch_of(out, ANSWER_ROWS)])

    return run


def spelled(longest: int):
    """The n-grams of one shard that may be frequent, as words, with their counts there."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        answers = sorted(right.to_pylist(), key=lambda r: (r["n"], r["bucket"]))
        phrases, lengths, counts = [], [], []
        for n, _, x, words in keyed(row, longest):
            told = [np.unpackbits(np.frombuffer(r["frequent"], np.uint8), count=r["many"]) for r in answers if r["n"] == n]
            use = np.flatnonzero(np.concatenate(told)) if told else np.zeros(0, int)
            if sum(map(len, told)) != len(x.size):
                raise ValueError("answers don't fit the shard")
            parts = [[words[i] for i in column] for column in x.ids[use].T.tolist()]
            phrases += [b" ".join(p).decode("utf-8", "replace") for p in zip(*parts)]
            lengths += [n] * len(use)
            counts.append(x.size[use])
        return pa.table({"lang": pa.array([row["lang"]] * len(phrases), pa.string()), "phrase": pa.array(phrases, pa.string()), "length": pa.array(lengths, pa.int32()), "a": pa.array(np.concatenate(counts), pa.int64())})

    return run


def frequencies(held: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """``lang, phrase, length, a``: every n-gram up to ``longest`` words with at least ``least`` occurrences in its language."""
    total = int(held.agg(F.sum("tokens")).first()[0] or 0)
    to_buckets = asked(held, longest, blobs.bits_for(longest * total))
    answers = written(to_buckets.groupBy("bucket").applyInArrow(answered(least), ANSWER_ROWS), "phrase-answers")
    local = held.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(spelled(longest), "lang string, phrase string, length int, a long")
    return local.groupBy("lang", "phrase", "length").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(found: DataFrame) -> DataFrame:
    """``lang, phrase, length, a, l, r, score`` of each phrase of two words or more, by its lowest-scoring cut."""
    words, length = F.split("phrase", " "), F.col("length")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(words, k + 1, length - k), " ").alias("tail"))
    cut_up = found.where("length > 1").select("lang", "phrase", "length", "a", F.explode(F.transform(F.sequence(F.lit(1), length - 1), cut)).alias("c"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = found.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    both = cut_up.select("lang", "phrase", "length", "a", "c.*").join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    # counts below 10^15: all products fit 38 digits, and a score is at most 1,000,000
    score = F.expr("(cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) * cast(1000000 as decimal(7, 0))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("w")
    return both.groupBy("lang", "phrase", "length", "a").agg(lowest).select("lang", "phrase", "length", "a", "w.l", "w.r", "w.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """Without candidates that stand inside a longer one with ``covered`` hundredths of their count."""
    words, length = F.split("phrase", " "), F.col("length")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), length - 1), lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    around = candidates.where("length > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    around = around.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return candidates.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))).drop("longer")


def leading(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each language by score, count and phrase, with ``rank``; ranked by salts first, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = 1 + rows.count() // RANKED
    while salts > 1:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
        rows = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_rank") <= most).drop("_rank", "_salt")
        salts = salts // 64 if salts > 64 else 1
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most: int = MOST, size: int = blobs.BLOCK) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the leading phrases of each language.

    A null language is ``und``; null and empty texts, and texts of marks alone, have no words;
    equal rows count each; a very long text makes its shard as long; an empty table gives no row.
    Other columns than ``lang`` and ``text`` aren't read.
    """
    held = written(shards(docs, size), "phrase-shards")
    found = written(frequencies(held, longest, least), "phrase-counts")
    candidates = written(scored(found), "phrase-scores")
    totals = held.groupBy("lang").agg(F.sum("tokens").alias("n"))
    return leading(uncovered(candidates), most).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows by DuckDB.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS id, regexp_split_to_array(piece, '[\x20\x09]+') AS ws FROM pieces),
words AS (SELECT lang, id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM numbered),
runs AS (
  SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM words WHERE w <> '' WINDOW o AS (PARTITION BY id ORDER BY i)),
grams AS (
  SELECT lang, 1 AS len, w AS phrase FROM runs
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, len, phrase, lang || '/' || phrase AS id, count(*) AS a FROM grams GROUP BY lang, len, phrase HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM runs GROUP BY lang),
cand AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE len > 1),
cut AS (
  SELECT c.lang, c.phrase, c.len, c.a, k, c.lang || '/' || array_to_string(ws[1:k], ' ') AS head, c.lang || '/' || array_to_string(ws[k + 1:len], ' ') AS tail
  FROM cand c CROSS JOIN (VALUES (1), (2)) v(k) WHERE k < len),
scores AS (
  SELECT cut.*, h.a AS l, t.a AS r, (1000000::HUGEINT * cut.a * cut.a) // (h.a::HUGEINT * t.a) AS score
  FROM cut JOIN f h ON h.id = cut.head JOIN f t ON t.id = cut.tail),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT id, max(a) AS longer FROM (
    SELECT lang || '/' || array_to_string(ws[1:2], ' ') AS id, a FROM cand WHERE len = 3
    UNION ALL SELECT lang || '/' || array_to_string(ws[2:3], ' '), a FROM cand WHERE len = 3) GROUP BY id),
kept AS (SELECT l.* FROM lowest l LEFT JOIN around x ON x.id = l.lang || '/' || l.phrase WHERE coalesce(100 * x.longer < 50 * l.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM ranked r JOIN totals USING (lang) WHERE rank <= 2000
"""
