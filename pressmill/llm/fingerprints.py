"""Context-triggered piecewise hashes of texts, and their likeness by edit distance.

A rolling hash of the last seven bytes ends a chunk wherever it is one less than a multiple of
the block size; each chunk gives one of 64 characters.  A fingerprint holds the block size, the
signature at it, and the signature at twice of it: ``size:signature:signature``.  Fingerprints
whose block sizes are equal or twice one another are compared where they share a size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import slices
from pressmill.session import written

WINDOW = 7
SMALLEST = 3
#: A signature has about so many characters, and half of them at least if the text allows.
AIM = 64
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ODD = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Powers:
    """Powers of an odd number and of its inverse modulo 2 to the 64th, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)], dtype=np.uint64) for x in (ODD, inverse))
        return self.up[:n], self.down[:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the window that ends there: sum, weighted sum and shifted bytes."""
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    n = len(data)
    total, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):  # k bytes back
        part = wide[WINDOW - 1 - k : WINDOW - 1 - k + n]
        total += part
        weighted += part * np.uint32(WINDOW - k)
        shifted ^= part << np.uint32(5 * k)
    return total + weighted + shifted


def signature(data: np.ndarray, ends: np.ndarray, powers: Powers) -> str:
    """One character for each chunk; ``ends`` are the last bytes of all chunks but the last."""
    starts = np.r_[0, ends + 1]
    starts = starts[starts < len(data)]
    if not len(starts):
        return ""
    up, down = powers.to(len(data))
    sums = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * up, starts) * down[starts]
    return LETTERS[((sums * ODD) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str, powers: Powers) -> str:
    """The fingerprint of a whole text; of an empty one ``3::``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = SMALLEST
    while size * AIM < len(data):
        size *= 2
    hashes = rolling(data)
    ends = np.flatnonzero(hashes % np.uint32(SMALLEST) == SMALLEST - 1)
    values = hashes[ends]
    at = lambda size: ends[values % np.uint32(size) == size - 1]
    while size > SMALLEST and len(at(size)) + 1 < AIM // 2:
        size //= 2
    return f"{size}:{signature(data, at(size), powers)}:{signature(data, at(2 * size), powers)}"


def edits(a: str, b: str) -> int:
    """Edit distance (insert, delete, replace), a column of the table in the bits of an integer."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for ch in b:
        match = where.get(ch, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        rise = down | ~(diagonal | up) & full
        fall = up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up = fall | ~(diagonal | rise) & full
        down = rise & diagonal
    return score


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, else one less the share of edits at the best size in common; 0 without one."""
    if a == b:
        return 1.0
    (size_a, *sigs_a), (size_b, *sigs_b) = a.split(":"), b.split(":")
    at_a, at_b = ({int(s) * (1 + k): sig for k, sig in enumerate(sigs)} for s, sigs in ((size_a, sigs_a), (size_b, sigs_b)))
    best = 0.0
    for size in at_a.keys() & at_b.keys():
        x, y = at_a[size], at_b[size]
        if x and y:
            best = max(best, 1 - edits(x, y) / max(len(x), len(y)))
    return best


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def range_of(value: Column, bounds: list[int], first: int = 0) -> Column:
    """Number of ``bounds`` (ascending) below ``value``, by a tree of comparisons; null counts as lowest."""
    if not bounds:
        return F.lit(first)
    k = len(bounds) // 2
    above = range_of(value, bounds[k + 1 :], first + k + 1)
    return F.when(value > F.lit(bounds[k]), above).otherwise(range_of(value, bounds[:k], first))


def compared(docs: DataFrame, range_rows: int = 5_000, most_ranges: int = 1024) -> DataFrame:
    """Each document's fingerprint, its edited text's, and both likenesses (columns of ``COLUMNS``).

    The next document is the one before in order of ``doc_id``; after the lowest comes the
    highest, and a single document follows itself.  Null ids count as lowest.  Rows of one id are
    taken in order of a hash of their texts; rows alike in both are interchangeable.  A null text
    is empty; an empty table gives no row; other columns are not read.

    The order is cut into ranges of ids (``range_rows`` rows, about; more where the ranges would
    exceed ``most_ranges``, which is all that the driver knows of the order).  The first row of each
    range also goes to the end of the range before, so every range is worked through alone, row
    by row, in whatever task it is in.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    count = rows.count()
    wanted = min(most_ranges, max(1, count // range_rows))
    bounds = rows.stat.approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    rows = rows.withColumn("range", range_of(F.col("doc_id"), sorted({int(b) for b in bounds})))
    lowest = F.coalesce("doc_id", F.lit(-(1 << 63)))
    first = rows.groupBy("range").agg(F.max(F.struct(lowest.alias("rank"), F.bitwise_not("tie").alias("back"), "doc_id", "text")).alias("first"))
    heads = written(first.select("range", "first.doc_id", "first.text"), "heads")
    present = sorted(r["range"] for r in heads.select("range").collect())
    before = {r: present[(k + 1) % len(present)] for k, r in enumerate(present)}
    pairs = heads.sparkSession.createDataFrame(list(before.items()), "range int, goes_to int")
    tails = heads.join(pairs, "range").select("doc_id", "text", F.lit(0).cast("long").alias("tie"), F.col("goes_to").alias("range"), F.lit(True).alias("tail"))
    dealt = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    dealt = dealt.repartition(max(len(present), 1), "range").sortWithinPartitions("range", "tail", F.desc_nulls_last("doc_id"), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held = Powers(), None
        for batch in slices(batches, "text"):
            out = []
            for doc, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range"))):
                mark = fingerprint(text, powers)
                if held is not None and held[3] == part:
                    own, before_text, before_mark, _ = held
                    new = edited(before_text, text)
                    new_mark = fingerprint(new, powers)
                    digest = sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own, len(before_text), digest, before_mark, new_mark, likeness(before_mark, new_mark), likeness(before_mark, mark)))
                held = doc, text, mark, part
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names)

    return dealt.select("doc_id", "text", "range").mapInArrow(run, COLUMNS)
