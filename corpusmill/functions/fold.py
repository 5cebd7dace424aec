"""Folding of text in whole Arrow batches: NFKC, lower case, letters and digits (Unicode L and N) only.

``str.isalnum`` is true exactly for the categories L and N, so ``[\\W_]`` is the complement of what is kept.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_DROP = re.compile(r"[\W_]+")
_DROP_IN_BATCH = re.compile(r"[^\w\n]+|_+")


def fold(text: str | None) -> str:
    return _DROP.sub("", unicodedata.normalize("NFKC", text or "").lower())


def fold_many(texts: list[str | None]) -> list[str]:
    """``fold`` of each text, in one pass over the joined batch; nulls fold to the empty string."""
    if not texts:
        return []
    whole = "\n".join([(t or "").replace("\n", " ") for t in texts])
    out = _DROP_IN_BATCH.sub("", unicodedata.normalize("NFKC", whole).lower()).split("\n")
    return out if len(out) == len(texts) else [fold(t) for t in texts]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and the n + 1 offsets of the texts in it."""
    whole = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return whole, offsets


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection of 64-bit integers whose bits look random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_keys(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key of the k code points from each position on; exact (injective) for k up to 3. Runs over text borders."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = points.astype(np.uint64)
    if k <= 3:
        key = p[:n].copy()
        for j in range(1, k):
            key = (key << np.uint64(21)) | p[j : n + j]
        return key
    key = np.zeros(n, np.uint64)
    for j in range(k):
        key = key * np.uint64(0x9E3779B97F4A7C15) + p[j : n + j] + np.uint64(1)
    return mix64(key)


def inside(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n positions start a k-gram that stays within its text."""
    ok = np.zeros(n, bool)
    if n:
        diff = np.zeros(n + 1, np.int32)
        ends = np.minimum(np.maximum(offsets[1:] - k + 1, offsets[:-1]), n)
        np.add.at(diff, np.minimum(offsets[:-1], n), 1)
        np.add.at(diff, ends, -1)
        ok = np.cumsum(diff[:n]) > 0
    return ok


def grams(text: str, k: int = 3) -> np.ndarray:
    """Sorted distinct keys of the k-grams of one folded text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.unique(gram_keys(points, k))
