"""Hashes of words and their windows, and integers packed for a shuffle."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLANES = 0x80  # flag in the first byte


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts in turn, and the words of each text.

    Words are what ASCII white space separates, which is what splitting bytes does.
    """
    known, parts, counts = _Hashes(), [], []
    for text in texts:
        words = text.encode().split() if text else []
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        counts.append(len(words))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(counts, np.int64)


def windows(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``width`` words that lies in one text, the text
    of each, and the place of its first word among all words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    rolled = words[:n].copy()
    for j in range(1, width):
        rolled = rolled * _BASE + words[j : n + j]
    text_of = np.repeat(np.arange(len(counts)), counts)[:n]
    left = np.cumsum(counts)[text_of] - np.arange(n)
    inside = np.flatnonzero(left >= width)
    return rolled[inside], text_of[inside], inside


def bucket_of(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket of each hash; equal ranges of hashes, so sorted hashes have sorted buckets."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))


def spans(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    starts = runs(sorted_values).tolist()
    return list(zip(starts, [*starts[1:], len(sorted_values)]))


def pack(values: np.ndarray, planes: bool = False) -> bytes:
    """Non-negative integers in as many bytes each as the largest needs; with ``planes`` all
    low bytes first, then the next, compressed: few need their highest bytes."""
    values = np.ascontiguousarray(values)
    if values.dtype not in ("<u8", "<i8", "<u4", "<i4"):
        values = values.astype("<u8")
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    raw = values.view(np.uint8).reshape(-1, values.itemsize)[:, :width]
    if planes:
        return bytes([width | _PLANES]) + zlib.compress(raw.T.tobytes(), 1)
    return bytes([width]) + raw.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0] & ~_PLANES
    if packed[0] & _PLANES:
        raw = np.frombuffer(zlib.decompress(packed[1:]), np.uint8).reshape(width, -1).T
    else:
        raw = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")
