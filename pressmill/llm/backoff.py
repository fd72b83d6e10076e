"""A Katz backoff model of words, and the log-probability of every text under it.

Texts are held in blocks (``blobs``).  Distinct n-grams of a block go to buckets of the key space,
which sum them to the table of counts; counts of counts give Good-Turing discounts; what discounts
free in each context, over what its followers leave of the shorter context, is its backoff weight.
Counts and weights are stored in tables, partitioned by the length of the n-gram; a token is scored
by the longest n-gram that the tables hold, or by its context's weight and the shorter context.

Tokens are words (runs of other than ASCII white space, ``A`` to ``Z`` lowered) and one end for
each text.  A start stands before each text as context only.  Words never seen in training are one
class, as in the base score.  Keys are 64-bit hashes of words.

Discounts: Katz's, for counts up to the highest ``k`` <= ``MOST_K`` at which each lies between 0
and 1.  Where no ``k`` >= 2 serves (tiny or odd corpora), half a count is taken from every count.
Counts above ``k`` lose what ``k`` loses, so that every context keeps some mass for what it hasn't
seen, and all distributions sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm import blobs
from pressmill.llm.blobs import batch_of, chained, cuts, expand, expand_keys, grouped, squeeze, squeeze_keys
from pressmill.llm.common import slices, texts_of
from pressmill.session import new_shared_path, written

MOST_K = 5
START, END = np.uint64(0x5D1B6A3C9F70E2B5), np.uint64(0x2C7FE41D08B395A7)

BLOCK_ROWS = "block long, tokens long, doc_ids array<long>, trained array<boolean>, lengths binary, words binary, sequence binary"
COUNT_ROWS = "kind string, n int, block long, bucket int, keys binary, counts binary, owned binary, histogram array<long>"
PART_ROWS = (
    "kind string, n int, block long, bucket int, keys binary, counts binary, freed binary, below binary, at binary, doc binary, times binary,"
    " doc_ids array<long>, trained array<boolean>, tokens binary, known binary, base binary, score binary"
)
WEIGHT_ROWS = "kind string, n int, block long, bucket int, keys binary, weights binary, doc binary, doc_ids array<long>, trained array<boolean>, tokens binary, known binary, base binary, score binary"


def blocks(docs: DataFrame, trained: Column, size: int = blobs.BLOCK) -> DataFrame:
    """Texts in blocks of about ``size`` tokens: hashes of a block's distinct words, and its tokens as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        task, made = TaskContext.get().partitionId(), 0
        ids: dict[bytes, int] = {}
        doc_ids, flags, parts, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            words = np.fromiter((xxh3_64_intdigest(w) for w in ids), np.uint64, len(ids))
            row = {"block": (task << 32) + made, "tokens": total, "doc_ids": doc_ids, "trained": flags}
            row["lengths"] = squeeze(np.array([len(p) for p in parts]))
            row["words"] = squeeze(np.r_[START, END, words])
            row["sequence"] = squeeze(np.concatenate(parts))
            return batch_of([row], BLOCK_ROWS)

        for piece in slices(batches, "text"):
            for doc_id, flag, text in zip(piece.column("doc_id").to_pylist(), piece.column("trained").to_pylist(), texts_of(piece, "text")):
                words = text.encode("utf-8", "surrogatepass").lower().split()
                for w in words:
                    if w not in ids:
                        ids[w] = len(ids) + 2
                parts.append(np.array([0, *map(ids.__getitem__, words), 1], np.int32))
                doc_ids.append(doc_id)
                flags.append(flag)
                total += len(words) + 1
                if total >= size:
                    yield block()
                    made += 1
                    ids, doc_ids, flags, parts, total = {}, [], [], [], 0
        if parts:
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(trained, F.lit(False)).alias("trained"))
    return rows.mapInArrow(run, BLOCK_ROWS)


class Grams:
    """The n-grams of one block, up to a length: their distinct keys in order, and which one ends at each token."""

    def __init__(self, row: dict, order: int):
        lengths = expand(row["lengths"])
        self.docs = len(lengths)
        self.doc = np.repeat(np.arange(self.docs, dtype=np.int32), lengths)
        self.place = np.arange(len(self.doc), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
        self.trained = np.array(row["trained"], bool)
        hashes, sequence = expand(row["words"], "<u8"), expand(row["sequence"]).astype(np.int32)
        by_key = np.argsort(hashes, kind="stable")
        rank = np.empty(len(by_key), np.int32)
        rank[by_key] = np.arange(len(by_key))
        self.keys, self.ends, self.first = {1: hashes[by_key]}, {1: rank[sequence]}, {}
        at = hashes[sequence]
        for n in range(2, order + 1):
            here = np.flatnonzero(self.place >= n - 1)
            longer = np.zeros(len(at), np.uint64)
            longer[here] = chained(at[here - 1], hashes[sequence[here]])
            keys, first, ends = np.unique(longer[here], return_index=True, return_inverse=True)
            self.keys[n], self.first[n] = keys, here[first]
            self.ends[n] = np.full(len(at), -1, np.int32)
            self.ends[n][here] = ends
            at = longer
            del longer, first, ends, here

    def counts(self, n: int) -> np.ndarray:
        """Occurrences of each distinct n-gram in training texts."""
        here = np.flatnonzero((self.ends[n] >= 0) & self.trained[self.doc])
        return np.bincount(self.ends[n][here], minlength=len(self.keys[n]))


def requests(rows: DataFrame, order: int, bits: int) -> DataFrame:
    """The distinct n-grams of each block with its counts, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                grams = Grams(row, order)
                for n in range(1, order + 1):
                    counts, keys = grams.counts(n), grams.keys[n]
                    out = [{"n": n, "block": row["block"], "bucket": b, "keys": squeeze_keys(keys[s]), "counts": squeeze(counts[s])} for b, s in cuts(keys, bits)]
                    yield batch_of(out, COUNT_ROWS)

    return rows.mapInArrow(run, COUNT_ROWS)


def summed(table: pa.Table) -> pa.Table:
    """One bucket: counts of all blocks added up, as the model's rows and as answers to the blocks.

    In its answer, one block that has the n-gram in a training text is named its owner.
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["block"]))
    out = []
    for n in sorted({r["n"] for r in rows}):
        mine = [r for r in rows if r["n"] == n]
        sent, counts = [expand_keys(r["keys"]) for r in mine], np.concatenate([expand(r["counts"]) for r in mine])
        keys, at = grouped(sent)
        totals = np.bincount(at, counts, len(keys)).astype(np.int64)
        having = np.flatnonzero(counts)
        owner = np.zeros(len(at), bool)
        owner[having[np.unique(at[having], return_index=True)[1]]] = True
        real = (totals > 0) & (keys != START if n == 1 else True)
        c = totals[real]
        histogram = [*np.bincount(np.minimum(c, MOST_K + 2), minlength=MOST_K + 3)[1 : MOST_K + 2].tolist(), len(c), int(c.sum())]
        bucket = mine[0]["bucket"]
        out.append({"kind": "model", "n": n, "bucket": bucket, "keys": squeeze_keys(keys[totals > 0]), "counts": squeeze(totals[totals > 0]), "histogram": histogram})
        begin = 0
        for r, k in zip(mine, sent):
            part = slice(begin, begin + len(k))
            begin += len(k)
            out.append({"kind": "answer", "n": n, "block": r["block"], "bucket": bucket, "counts": squeeze(totals[at[part]]), "owned": np.packbits(owner[part]).tobytes()})
    return pa.Table.from_batches([batch_of(out, COUNT_ROWS)])


@dataclass(frozen=True)
class Discounts:
    """Counts left after discounting, for one length: ``left[r]`` of r <= k, and r less ``taken`` above."""

    left: tuple[float, ...]
    taken: float
    types: int
    total: int

    @staticmethod
    def of(histogram: list[int]) -> Discounts:
        *ns, types, total = (int(x or 0) for x in histogram)
        for k in range(MOST_K, 1, -1):
            if all(ns[: k + 1]) and (a := (k + 1) * ns[k] / ns[0]) < 1:
                d = [((r + 1) * ns[r] / (ns[r - 1] * r) - a) / (1 - a) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return Discounts((0.0, *(r * x for r, x in enumerate(d, 1))), k * (1 - d[-1]), types, total)
        return Discounts((0.0, 0.5), 0.5, types, total)

    def of_counts(self, counts: np.ndarray) -> np.ndarray:
        table = np.array(self.left)
        return np.where(counts < len(table), table[np.minimum(counts, len(table) - 1)], counts - self.taken)


def evaluated(discounts: dict[int, Discounts], freed_once: float, bits: int):
    """Scores of one block, but for weights of contexts, which are asked of the contexts' buckets."""
    order, seen = max(discounts), discounts[1]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = Grams(row, order)
        totals, owned = {}, {}
        answers = sorted(right.to_pylist(), key=lambda r: (r["n"], r["bucket"]))
        for n in range(1, order + 1):
            mine = [(expand(r["counts"]), r["owned"]) for r in answers if r["n"] == n]
            totals[n] = np.concatenate([c for c, _ in mine]) if mine else np.zeros(0, np.int64)
            owned[n] = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8), count=len(c)) for c, o in mine]).astype(bool) if mine else np.zeros(0, bool)
            if len(totals[n]) != len(grams.keys[n]):
                raise ValueError("answers don't fit the block")
        with np.errstate(divide="ignore", invalid="ignore"):
            share = {1: discounts[1].of_counts(totals[1]) / max(seen.total, 1)}
            for n in range(2, order + 1):
                share[n] = discounts[n].of_counts(totals[n]) / totals[n - 1][grams.ends[n - 1][grams.first[n] - 1]]
            logs = {n: np.log10(p) for n, p in share.items()}
            logs[1] = np.where(totals[1] > 0, logs[1], np.log10(freed_once))

        scored = np.flatnonzero(grams.place > 0)
        value, ahead, out = np.zeros(len(scored)), np.arange(len(scored)), []
        asked = {}
        for n in range(order, 0, -1):
            at = scored[ahead]
            ends = grams.ends[n][at]
            hit = (ends >= 0) & (totals[n][ends] > 0) if n > 1 else np.ones(len(at), bool)
            value[ahead[hit]] = logs[n][ends[hit]]
            ahead, missed = ahead[~hit], at[~hit]
            if n > 1:
                contexts = grams.ends[n - 1][missed - 1]
                open_ = contexts >= 0
                open_[open_] = totals[n - 1][contexts[open_]] > 0
                pairs, times = np.unique(contexts[open_].astype(np.uint64) << np.uint64(32) | grams.doc[missed[open_]].astype(np.uint64), return_counts=True)
                asked[n] = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), times
        known = totals[1][grams.ends[1][scored]]
        base = np.log10((known * (known > 0) + 0.5) / (seen.total + 0.5 * (seen.types + 1)))
        of = grams.doc[scored]
        sums = {"score": np.bincount(of, value, grams.docs), "base": np.bincount(of, base, grams.docs), "known": np.bincount(of, known > 0, grams.docs).astype(np.int64), "tokens": np.bincount(of, minlength=grams.docs)}
        out.append({"kind": "doc", "n": 0, "block": row["block"], "bucket": int(row["block"]) % (1 << bits), "doc_ids": row["doc_ids"], "trained": row["trained"]} | {k: squeeze(v) for k, v in sums.items()})
        for n in range(2, order + 1):
            mine = np.flatnonzero(owned[n])
            contexts = grams.ends[n - 1][grams.first[n][mine] - 1]
            size = len(grams.keys[n - 1])
            freed = np.bincount(contexts, totals[n][mine] - discounts[n].of_counts(totals[n][mine]), size)
            below = np.bincount(contexts, share[n - 1][grams.ends[n - 1][grams.first[n][mine]]], size)
            context, doc, times = asked[n]
            use = np.zeros(size, bool)
            use[contexts] = True
            use[context] = True
            used = np.flatnonzero(use)
            keys = grams.keys[n - 1][used]
            for b, s in cuts(keys, bits):
                a, z = np.searchsorted(context, [used[s][0], used[s][-1] + 1])
                message = {"keys": squeeze_keys(keys[s]), "counts": squeeze(totals[n - 1][used[s]]), "freed": squeeze(freed[used[s]]), "below": squeeze(below[used[s]])}
                message |= {"at": squeeze(np.searchsorted(used[s], context[a:z])), "doc": squeeze(doc[a:z]), "times": squeeze(times[a:z])}
                out.append({"kind": "context", "n": n, "block": row["block"], "bucket": b} | message)
        return pa.Table.from_batches([batch_of(out, PART_ROWS)])

    return run


def weighed(table: pa.Table) -> pa.Table:
    """One bucket of contexts: their weights as the model's rows, and what they add to the scores of texts."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["n"], r["block"]))
    out = [r for r in rows if r["kind"] == "doc"]
    for n in sorted({r["n"] for r in rows if r["kind"] == "context"}):
        mine = [r for r in rows if r["n"] == n]
        sent = [expand_keys(r["keys"]) for r in mine]
        keys, at = grouped(sent)
        freed, below = (np.bincount(at, np.concatenate([expand(r[c], "<f8") for r in mine]), len(keys)) for c in ("freed", "below"))
        counts = np.zeros(len(keys), np.int64)
        counts[at] = np.concatenate([expand(r["counts"]) for r in mine])
        weights = np.log10(freed / counts / (1 - below))
        out.append({"kind": "model", "n": n, "bucket": mine[0]["bucket"], "keys": squeeze_keys(keys), "weights": squeeze(weights)})
        begin = 0
        for r, k in zip(mine, sent):
            own = weights[at[begin : begin + len(k)]]
            begin += len(k)
            doc = expand(r["doc"])
            if len(doc):
                docs, place = np.unique(doc, return_inverse=True)
                add = np.bincount(place, own[expand(r["at"])] * expand(r["times"]), len(docs))
                out.append({"kind": "part", "n": n, "block": r["block"], "doc": squeeze(docs), "score": squeeze(add)})
    return pa.Table.from_batches([batch_of(out, WEIGHT_ROWS)])


def gathered(train_tokens: int):
    """The rows of one block, from its own sums and what contexts add."""
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["n"], r["bucket"] or 0, r["doc"] or b""))
        own = next(r for r in rows if r["kind"] == "doc")
        score = expand(own["score"], "<f8").copy()
        for r in rows:
            if r["kind"] == "part":
                score[expand(r["doc"])] += expand(r["score"], "<f8")
        columns = [own["doc_ids"], [not t for t in own["trained"]], expand(own["tokens"]), expand(own["known"]), np.full(len(score), train_tokens), expand(own["base"], "<f8"), score]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], list(kinds))

    return run


@dataclass(frozen=True)
class Scored:
    """Rows of texts, and the model: ``counts`` (n, bucket, keys, counts) and ``weights`` (n, bucket, keys of contexts, log10 weights), packed."""

    rows: DataFrame
    counts: DataFrame
    weights: DataFrame
    discounts: dict[int, Discounts]


def scored(docs: DataFrame, trained: Column, order: int = 2, size: int = blobs.BLOCK) -> Scored:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    The model learns from the rows where ``trained`` holds (null: it doesn't), all of them, and
    scores all rows.  A null or empty text is its end alone.  Equal rows count and are scored each
    for itself.  Without training texts every token is unknown and certain: score 0.  An empty
    table gives no row.  A very long text is a block of its own, read whole.  Columns other than
    ``doc_id`` and ``text`` matter to ``trained`` only.

    Tables in the shared folder hold the blocks, the counts and the weights; a lost executor costs
    the blocks or buckets it had.  Scores are sums in a fixed order.
    """
    spark = docs.sparkSession
    held = written(blocks(docs, trained, size), "backoff-blocks")
    bits = blobs.bits_for(order * int(held.agg(F.sum("tokens")).first()[0] or 0))

    counts_at = new_shared_path(spark, "backoff-counts")
    asked = requests(held, order, bits).select("n", "block", "bucket", "keys", "counts")
    asked.groupBy("bucket").applyInArrow(summed, COUNT_ROWS).write.partitionBy("kind", "n").parquet(counts_at)
    counts = spark.read.schema(COUNT_ROWS).parquet(counts_at)
    model, answers = counts.where("kind = 'model'"), counts.where("kind = 'answer'")
    sums = {r["n"]: list(r)[1:] for r in model.groupBy("n").agg(*(F.sum(F.get("histogram", F.lit(i))) for i in range(MOST_K + 3))).collect()}
    discounts = {n: Discounts.of(sums.get(n, [0] * (MOST_K + 3))) for n in range(1, order + 1)}
    first = discounts[1]
    low = [int(x or 0) for x in sums.get(1, [0] * (MOST_K + 3))]
    few = len(first.left) - 1
    kept = sum(low[r - 1] * first.left[r] for r in range(1, few + 1))
    above = low[-1] - sum(r * low[r - 1] for r in range(1, few + 1)), low[-2] - sum(low[:few])
    freed_once = 1 - (kept + above[0] - first.taken * above[1]) / first.total if first.total else 1.0

    weights_at = new_shared_path(spark, "backoff-weights")
    parts = held.groupBy("block").cogroup(answers.select("n", "block", "bucket", "counts", "owned").groupBy("block")).applyInArrow(evaluated(discounts, freed_once, bits), PART_ROWS)
    parts.groupBy("bucket").applyInArrow(weighed, WEIGHT_ROWS).write.partitionBy("kind", "n").parquet(weights_at)
    weights = spark.read.schema(WEIGHT_ROWS).parquet(weights_at)
    rows = weights.where("kind IN ('doc', 'part')").groupBy("block").applyInArrow(
        gathered(first.total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return Scored(rows, model.select("n", "bucket", "keys", "counts"), weights.where("kind = 'model'").select("n", "bucket", "keys", "weights"), discounts)
