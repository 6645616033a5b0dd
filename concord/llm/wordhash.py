"""Hashes of words and of word shingles, computed on Arrow buffers.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A word's 64-bit hash is a
difference of prefix sums of a polynomial, so a batch of texts takes a few array
operations and no Python object per word. A polynomial modulo 2**64 gives words
with a regular pattern of 1,024 letters or more one hash, whatever its base, so
words of over 64 bytes are hashed one by one by another function. Different words
share a hash by chance only, about one pair in 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LONG = 64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        if len(_POWERS) > 2:
            _POWERS.clear()
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def text_buffers(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an array without nulls, and where each text begins (one place more than texts)."""
    places = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[places[0] : places[-1]]
    return data, places - places[0]


_LEAN: list[bool] = []


def lean() -> None:
    """Let a worker give memory back as soon as it is free: workers of several operators, and of earlier stages, share an executor."""
    if not _LEAN:
        _LEAN.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(libc := ctypes.CDLL(None), "mallopt"):  # fixed thresholds, which else grow with what was freed
            libc.mallopt(-3, 1 << 22)  # M_MMAP_THRESHOLD
            libc.mallopt(-1, 1 << 22)  # M_TRIM_THRESHOLD


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text, of at least a row."""
    lean()
    _, at = text_buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, in order, and the index of its text."""
    data, at = text_buffers(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LETTERS[_FOLD[data]] * up[: len(data)], out=sums[1:])
        found = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    for k in np.flatnonzero(end - begin > _LONG):
        found[k] = xxhash.xxh3_64_intdigest(data[begin[k] : end[k]].tobytes().lower())
    return found, np.searchsorted(at, begin, "right") - 1


def shingles(texts: pa.StringArray, size: int) -> list[np.ndarray]:
    """The set of each text's shingles of `size` words, ascending; with fewer words, the whole sequence as one."""
    words, owner = word_hashes(texts)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    with np.errstate(over="ignore"):
        total = np.zeros(len(words), np.uint64)
        for k in range(size):
            whole = max(len(words) - k, 0)  # shingles that reach the k-th word after their first
            total[:whole] = total[:whole] * np.uint64(_BASE) + words[k:]
        found = mix(total)
        out = []
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            n = b - a
            if n >= size:
                out.append(np.unique(found[a : b - size + 1]))
            elif n:
                h = np.uint64(n)
                for w in words[a:b]:
                    h = h * np.uint64(_INVERSE) + w
                out.append(mix(np.array([h], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
