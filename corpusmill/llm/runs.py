"""Sorted runs of integer columns that travel through a shuffle as compressed blobs.

Map tasks sort what they found and send one blob for each bucket; reduce tasks merge the blobs of a bucket. The JVM
then moves a few large rows instead of many small ones. Buckets are cut from the key, so equal keys meet.
"""

from __future__ import annotations

import numpy as np
import zstandard

_HEAD = 8


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit integers of one length, in one compressed blob; bytes of one rank lie together, which compresses better."""
    n = len(columns[0])
    planes = (np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, 8).T).tobytes() for c in columns)
    raw = b"".join([np.int64(n).tobytes(), *planes])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes, width: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, _HEAD + 8 * n * i).reshape(8, n).T).view(np.uint64).ravel() for i in range(width)]


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a key whose high bits are spread evenly."""
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def scatter(columns: list[np.ndarray], bucket: np.ndarray):
    """One ``(bucket, blob)`` for each bucket that occurs, sorted by the first column."""
    order = np.lexsort((columns[0], bucket))
    sizes = np.bincount(bucket)
    at = 0
    for b in np.flatnonzero(sizes):
        take = order[at : at + sizes[b]]
        at += sizes[b]
        yield int(b), pack([c[take] for c in columns])


def join(blobs: list[bytes], width: int) -> list[np.ndarray]:
    pieces = [unpack(b, width) for b in blobs]
    return [np.concatenate([p[i] for p in pieces]) if pieces else np.zeros(0, np.uint64) for i in range(width)]


def gather(batches, width: int):
    """The columns of each bucket of the partition, whole; one bucket at a time."""
    blobs: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blobs.setdefault(b, []).append(blob)
    while blobs:
        _, parts = blobs.popitem()
        yield join(parts, width)


def buckets_for(rows: int, width: int, least: int, mb: int = 24) -> int:
    return max(least, -(-rows * width * 8 // (mb << 20)))


def run_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside runs of the given starts and sizes; the caller bounds the sizes."""
    left, right = [], []
    for size in np.unique(sizes):
        if size < 2:
            continue
        at = starts[sizes == size]
        i, j = np.triu_indices(int(size), 1)
        left.append((at[:, None] + i[None, :]).ravel())
        right.append((at[:, None] + j[None, :]).ravel())
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)
