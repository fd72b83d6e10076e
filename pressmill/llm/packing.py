"""Documents packed into sequences of tokens: best fit, then local search by moves and swaps.

Documents are encoded where they lie and cut into pieces.  Pieces go to shards of a few ten
thousand rows by a hash, so that any number of documents is packed by as many tasks, and a
shard loses less than one sequence against packing everything at once.
"""

from __future__ import annotations

import binascii
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import slices, texts_of
from pressmill.session import written

CAPACITY = 2048
#: Pieces in a shard, about: a shard is packed in one task's memory.
SHARD_PIECES = 40_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class ChunkEncoder(dict):
    """Token ids of whole texts, encoded by chunks between blanks.

    Only for ``word_bpe_49k``, whose tokens hold no white space: the ids of a text are the ids of
    its chunks in order, and each different chunk is encoded once.  A chunk of Latin letters and
    closing marks is lower-cased and goes to the tokenizer's merges directly, as its letters are
    one word there; every other chunk goes through the whole tokenizer.
    """

    MARKS = ".,!?;:|*#$%&"

    def __init__(self, path: str, most_chars: int = 8_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most_chars
        self.merge = self.tokenizer.model.tokenize
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.shown = {n: shown[n] for n in range(256)}
        self.words, self.chars = {}, 0

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(self.MARKS)
        if not word.isalpha() or not word.isascii() and max(word) > "\xff":
            return self.whole(chunk)
        low = word.lower()
        ids = self.words.get(low)
        if ids is None:
            seen = low if low.isascii() else "".join(map(self.shown.__getitem__, low.encode()))
            ids = self.words[low] = array("I", [t.id for t in self.merge(seen)]).tobytes()
        marks = chunk[len(word) :]
        if marks:
            tail = self.words.get(marks)
            if tail is None:
                tail = self.words[marks] = self.whole(marks)
            ids += tail
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = self.chunk(chunk)
        if self.chars > self.most:
            self.clear()
            self.words, self.chars = {}, 0
        self.chars += len(chunk)
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece of a document's ids and ``end_id``; only longer documents are cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkEncoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            out = [[] for _ in range(6)]
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("place").to_pylist(), map(encoder.encode, texts_of(batch, "text")))
            for doc, place, ids in rows:
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    for c, v in zip(out, (doc, k, a // 4, len(part) // 4, binascii.crc32(part), place)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "place"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("place")).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit, longest first.  Open sequences are found by the lowest set bit among free spaces."""
    bins: list[list[int]] = []
    free_lists: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        rest = mask >> n
        if rest:
            free = n + (rest & -rest).bit_length() - 1
            b = free_lists[free].pop()
            if not free_lists[free]:
                mask ^= 1 << free
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if free > n:
            free_lists[free - n].append(b)
            mask |= 1 << (free - n)
    return bins


class Exchange:
    """Local search on underfull sequences.

    An exchange takes one or two documents of a giving sequence for none, one or two of a fuller
    one that gets closer to full by it, so the sum of squared fills only rises.  The emptiest
    sequences give first; one that becomes empty is gone.
    """

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = [sum(lengths[i] for i in b) for b in bins]

    def groups(self, b: int) -> list[tuple[int, ...]]:
        """What sequence ``b`` may exchange: nothing, one document, two documents; each length once.

        Two documents of each length make all sums of pairs.  Different lengths in one sequence add up
        to its capacity at most, so they are few and their pairs no more than about the capacity.
        """
        seen: dict[int, tuple[int, ...]] = {0: ()}
        items, times = [], Counter()
        for i in self.bins[b]:
            seen.setdefault(self.lengths[i], (i,))
            times[self.lengths[i]] += 1
            if times[self.lengths[i]] <= 2:
                items.append(i)
        for x in range(len(items)):
            for y in range(x):
                seen.setdefault(self.lengths[items[x]] + self.lengths[items[y]], (items[x], items[y]))
        return list(seen.values())

    def offers(self, chosen: list[int]) -> None:
        self.owner, self.size, self.items = [], [], []
        for b in chosen:
            for g in self.groups(b):
                self.owner.append(b)
                self.size.append(sum(self.lengths[i] for i in g))
                self.items.append(g)
        self.owner_of, self.size_of = np.array(self.owner, np.int64), np.array(self.size, np.int64)
        self.many = np.array([len(g) for g in self.items], np.int64)
        self.fills = np.array(self.fill, np.int64)[self.owner_of]
        self.live = np.ones(len(self.owner), bool)

    def search(self, sweeps: int = 3) -> list[list[int]]:
        for _ in range(sweeps):
            under = [b for b, f in enumerate(self.fill) if 0 < f < self.capacity]
            if len(under) < 2:
                break
            self.offers(under)
            moved = sum(self.give(b) for b in sorted(under, key=lambda b: self.fill[b])[: max(8, len(under) // 4)])
            if not moved:
                break
        return [b for b in self.bins if b]

    def give(self, giver: int) -> int:
        """Exchanges out of one sequence until none is left that helps; their number."""
        steps = 0
        while self.bins[giver]:
            best = None
            for g in sorted(self.groups(giver)[1:], key=lambda g: -sum(self.lengths[i] for i in g)):
                size = sum(self.lengths[i] for i in g)
                gain = size - self.size_of
                ok = self.live & (gain > 0) & (gain <= self.capacity - self.fills) & (self.fills >= self.fill[giver]) & (self.owner_of != giver)
                if len(g) == 2:
                    ok &= self.many <= 1
                at = np.flatnonzero(ok)
                if len(at):
                    gains = gain[at]
                    k = at[np.argmax(gains * (self.fills[at] - self.fill[giver] + gains))]
                    worth = int(gain[k] * (self.fills[k] - self.fill[giver] + gain[k]))
                    if best is None or worth > best[0]:
                        best = worth, int(k), g, int(gain[k])
            if best is None:
                break
            _, k, g, gain = best
            taker, back = self.owner[k], self.items[k]
            self.bins[giver] = [i for i in self.bins[giver] if i not in g] + list(back)
            self.bins[taker] = [i for i in self.bins[taker] if i not in back] + list(g)
            self.fill[giver] -= gain
            self.fill[taker] += gain
            self.live[(self.owner_of == giver) | (self.owner_of == taker)] = False
            steps += 1
        return steps


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Indexes of each sequence: best fit, then local search."""
    return Exchange(lengths, best_fit(lengths, capacity), capacity).search()


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pieces of all documents with their sequence and offset in it (columns of ``PACKED``).

    A null or empty text is one token, the end id.  Equal rows are packed each for itself.  An
    empty table gives no row.  Other columns than ``doc_id`` and ``text`` are not read.
    """
    ready = written(pieces(docs, tokenizer_path, capacity), "pieces")
    shards = max(1, -(-ready.count() // shard_pieces))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("place", "ascending"), ("piece", "ascending")])
        lengths = group.column("length").to_pylist()
        shard = group.column("shard")[0].as_py()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, members in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = (shard << 32) + k, at
                at += lengths[i]
        kept = group.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    by = F.pmod(F.xxhash64("place", "piece"), F.lit(shards)).alias("shard")
    return ready.select("*", by).groupBy("shard").applyInArrow(run, PACKED)
