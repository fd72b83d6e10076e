"""Language of a text by hyperdimensional profiles.

Each letter has a random binary vector, drawn from its code point.  Shifting permutes a vector,
exclusive or binds: the vector of three letters in a row is the first shifted twice, bound with
the second shifted once and the third.  A text is the bundle (sum of signs) of its trigrams, a
language the bundle of all its texts; the language of the nearest bundle by cosine is predicted.
Runs of characters that aren't letters count as one blank, which is a letter of its own here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import mix, slices, texts_of

DIMENSIONS = 1024
#: A shift by so many places is the permutation.
STEP = 64
UNKNOWN = "und"
#: Languages in a model, at most: there are fewer than 8,000 language codes.
MOST_LANGUAGES = 8192
#: Trigrams and texts whose counts stand in one block.
COLUMNS, ROWS = 4096, 512
POINT_BITS = 21


def letter_codes() -> np.ndarray:
    """For each code point the code it counts as: itself if a letter, else the blank's."""
    letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letters, np.arange(0x110000), 0x20).astype(np.uint64)


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Packed random vectors, 64 places in an integer, of letter codes."""
    words = np.arange(dimensions // STEP, dtype=np.uint64)
    return mix(mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[:, None] + words * np.uint64(0xD1B54A32D192ED03))


def trigram_vectors(keys: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of trigrams as 0 and 1, one row each."""
    low = np.uint64((1 << POINT_BITS) - 1)
    parts = [(keys >> np.uint64(POINT_BITS * k)) & low for k in (2, 1, 0)]
    letters = np.unique(np.concatenate(parts))
    vectors = letter_vectors(letters, dimensions)
    a, b, c = (vectors[np.searchsorted(letters, p)] for p in parts)
    bound = np.roll(a, 2, axis=1) ^ np.roll(b, 1, axis=1) ^ c
    return np.unpackbits(bound.view(np.uint8), axis=1, count=dimensions).astype(np.float32)


def trigrams(texts: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all trigrams, the index of each one's text, and which texts have a letter."""
    blank = np.uint64(0x20)
    joined = "\n\n".join(["", *(t.lower() for t in texts), ""])
    points = codes[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.array([len(t.lower()) if not t.isascii() else len(t) for t in texts], np.int64) + 2
    owner = np.concatenate([np.repeat(np.arange(len(texts)), lengths), np.full(2, len(texts) - 1)]).astype(np.int32)
    kept = np.ones(len(points), bool)
    kept[1:] = (points[1:] != blank) | (points[:-1] != blank)
    kept[np.r_[0, np.cumsum(lengths)]] = True  # every text starts and ends in a blank of its own
    points, owner = points[kept], owner[kept]
    keys = (points[:-2] << np.uint64(2 * POINT_BITS)) | (points[1:-1] << np.uint64(POINT_BITS)) | points[2:]
    real = (points[1:-1] != blank) & (owner[1:-1] == owner[:-2])
    has = np.zeros(len(texts), bool)
    has[owner[1:-1][points[1:-1] != blank]] = True
    return keys[real], owner[1:-1][real], has


def bundles(keys: np.ndarray, owner: np.ndarray, owners: int, dimensions: int) -> np.ndarray:
    """Sum of the signs of each owner's trigram vectors, in blocks of bounded size."""
    known = np.unique(keys)
    at = np.searchsorted(known, keys)
    out = np.zeros((owners, dimensions), np.float64)
    for first in range(0, len(known), COLUMNS):
        some = known[first : first + COLUMNS]
        vectors = trigram_vectors(some, dimensions)
        inside = (at >= first) & (at < first + len(some)) if len(known) > COLUMNS else slice(None)
        columns, rows = at[inside] - first, owner[inside]
        for top in range(0, owners, ROWS):
            n = min(ROWS, owners - top)
            mine = (rows >= top) & (rows < top + n) if owners > ROWS else slice(None)
            counts = np.bincount((rows[mine] - top).astype(np.int64) * len(some) + columns[mine], minlength=n * len(some))
            counts = counts.reshape(n, len(some)).astype(np.float32)
            out[top : top + n] += 2.0 * (counts @ vectors) - counts.sum(axis=1, keepdims=True)
    return out


def prototypes(docs: DataFrame, text: Column, lang: Column, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Bundle of each language over all rows with a non-null language.

    Tasks bundle what they read and Spark sums the bundles, so a language that holds most rows
    is a few vectors by then.  The result has one vector for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = letter_codes(), {}
        for batch in slices(batches, "text"):
            names = batch.column("lang").to_pylist()
            order = sorted(set(names))
            number = np.array([order.index(n) for n in names]) if len(order) < 64 else np.searchsorted(order, names)
            keys, owner, _ = trigrams(texts_of(batch, "text"), codes)
            for name, vector in zip(order, bundles(keys, number[owner], len(order), dimensions)):
                sums[name] = sums.get(name, 0) + vector
        for name, vector in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimensions), pa.array(range(dimensions), pa.int32()), pa.array(vector)], ["lang", "i", "v"]
            )

    rows = docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")).where("lang IS NOT NULL")
    summed = rows.mapInArrow(run, "lang string, i int, v double").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    found = summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("v"))
    out = {r["lang"]: np.array(r["v"]) for r in found.take(MOST_LANGUAGES + 1)}
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different languages to learn")
    return dict(sorted(out.items()))


def predict(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine with the predicted language, 0 at least).

    A text that is null, or has no letter, and every text where nothing was learnt, is ``und``
    with score 0.  Equal cosines go to the language first in order.  Columns of these two names
    are replaced; all others stay as they are.
    """
    names = list(model)
    kept = docs.drop("lang_pred", "score")
    dimensions = len(next(iter(model.values()))) if model else DIMENSIONS
    profile = np.stack([v / max(np.linalg.norm(v), 1e-12) for v in model.values()], axis=1).astype(np.float32) if model else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = letter_codes()
        for batch in slices(batches, text):
            pred, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            if profile is not None:
                keys, owner, has = trigrams(texts_of(batch, text), codes)
                vectors = bundles(keys, owner, batch.num_rows, dimensions)
                norms = np.linalg.norm(vectors, axis=1)
                cosines = (vectors @ profile) / np.maximum(norms, 1e-12)[:, None]
                best = cosines.argmax(axis=1)
                pred[has] = np.array(names, object)[best[has]]
                score[has] = np.clip(cosines[np.arange(len(best)), best], 0, 1)[has]
            out = [c for c, n in zip(batch.columns, batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*out, pa.array(pred, pa.string()), pa.array(score)], [*(n for n in batch.schema.names if n != text), "lang_pred", "score"])

    fields = [f for f in kept.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])
    return kept.mapInArrow(run, schema)
