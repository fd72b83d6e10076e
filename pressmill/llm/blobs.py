"""Packed arrays in binary columns, and sums of them over blocks of text.

Operators that count n-grams hold a block of texts (some million words) in one row, and send the
block's distinct keys, in order and packed, to buckets of the key space.  A bucket sums what all
blocks sent and answers each of them in the order of its keys.  A key is sent once for each block,
however often it occurs, so no frequent key makes a large bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pressmill.llm.common import mix

#: Words in a block, and distinct keys that a bucket receives, about.
BLOCK, BUCKET = 1 << 21, 1 << 21
#: Buckets at least (as a power of two), so that small inputs spread as well.
LEAST_BITS = 6


def squeeze(values: np.ndarray) -> bytes:
    """An array of 64-bit values as compressed planes of bytes, without the planes that are all zero."""
    whole = np.ascontiguousarray(values).astype("<u8") if values.dtype.kind != "f" else np.ascontiguousarray(values.astype("<f8")).view("<u8")
    width = (int(whole.max()).bit_length() + 7) // 8 if len(whole) else 0
    planes = np.ascontiguousarray(whole.view(np.uint8).reshape(-1, 8).T[:width])
    return bytes([width]) + len(whole).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expand(blob: bytes, kind: str = "<i8") -> np.ndarray:
    """The array that ``squeeze`` packed."""
    width, n = blob[0], int.from_bytes(blob[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    if width and n:
        planes = pa.decompress(blob[9:], decompressed_size=width * n, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(kind)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys, packed by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(expand(blob, "<u8"), dtype=np.uint64)


def bits_for(keys: int) -> int:
    """So many bits of a key number the buckets, for about ``BUCKET`` of ``keys`` in each."""
    return max(LEAST_BITS, (max(int(keys), 1) // BUCKET).bit_length())


def cuts(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets that hold some of ascending ``keys``, each with its stretch of them."""
    if not len(keys):
        return
    bucket = keys >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(bucket[a]), slice(a, b)


def chained(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of n-grams, from the keys of all words but the last and of the last word."""
    return mix(before + np.uint64(0x9E3779B97F4A7C15)) + last


def grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several arrays, and the place among them of every key in turn."""
    return np.unique(np.concatenate(keys), return_inverse=True)


def batch_of(rows: list[dict], ddl: str) -> pa.RecordBatch:
    """Arrow rows with the columns of ``ddl``; what a row lacks is null."""
    names = [part.split()[0] for part in ddl.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    types = [kinds[part.split()[1]] for part in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, types)], names)
