"""Words of Arrow text columns as numpy arrays, for the operators that work on batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import GAP

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def batch_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) into the words of all texts, and the words. Null: none."""
    # A copy, as slices of a batch keep offsets that the lists below do not share.
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.split_pattern_regex(texts, GAP)
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    flat = parts.flatten()
    keep = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(keep)])
    bounds = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    return ends[bounds], flat.filter(pa.array(keep))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words; each distinct word of the batch is hashed once."""
    import xxhash

    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    coded = pc.dictionary_encode(words)
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return table[coded.indices.to_numpy()]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of a sequence of hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text; a longer text is a slice of its own."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    which = (np.cumsum(length) - length) // size
    cut = np.flatnonzero(np.diff(which)) + 1
    for a, b in zip([0, *cut], [*cut, len(batch)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


_STEP = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20_240_501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of _STEP and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[i] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Offsets (one more than texts) into the words of all texts, a 64-bit hash of each word, and (bytes, first, end) of the words.

    Works on the UTF-8 bytes at once: gaps and A-Z are single bytes. A word's hash is a polynomial of its bytes'
    random numbers, taken from running sums over the whole buffer.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    n = len(data)
    if not n:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint64), (data, np.zeros(0, np.int64), np.zeros(0, np.int64))
    gap = _IS_GAP[data]
    begins = ~gap
    begins[1:] &= gap[:-1]
    ends = ~gap
    ends[:-1] &= gap[1:]
    edge = at[(at > 0) & (at < n)]  # a text ends where the next begins, without a gap
    begins[edge] = ~gap[edge]
    ends[edge - 1] = ~gap[edge - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * up, out=total[1:])
    h = mix64((total[end] - total[first]) * down[first])
    return np.searchsorted(first, at), h, (data, first, end)


def text_grams(bounds: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each k-gram of words; a text with fewer words has its whole sequence as one."""
    n = np.diff(bounds)
    every = gram_hashes(h, k)
    own = np.repeat(np.arange(len(n)), n)
    inside = np.zeros(len(h), dtype=bool)
    if len(every):
        inside[: len(every)] = own[: len(every)] == own[k - 1 :]
    at = np.flatnonzero(inside)
    own, grams = own[at], every[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        more = np.array([gram_hashes(h[bounds[i] : bounds[i + 1]], int(n[i]))[0] for i in short], dtype=np.uint64)
        own, grams = np.concatenate([own, short]), np.concatenate([grams, more])
    return own, grams
