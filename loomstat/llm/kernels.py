"""NumPy kernels on Arrow string columns: words as 64-bit hashes, shingles, minima."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def frugal(run: Callable) -> Callable:
    """A task's generator that gives freed memory back to the system in the end: Python workers live on and hold it otherwise."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(BLOCK, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= BLOCK:
            _powers[key] = have
    return have[:n]


def find_sorted(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, whether it is there) of each value asked for."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def word_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs between white space and text edges."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges] = True
    before, after = np.empty_like(word), np.empty_like(word)
    before[:1], before[1:] = False, word[:-1]
    after[-1:], after[:-1] = False, word[1:]
    return np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and each text's first word (n+1 entries)."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    low = _LOWER[data]
    start, end = word_bounds(low, offs)
    return span_hashes(low, start, end), np.searchsorted(start, offs)


#: Bytes that are hashed at once: the arrays beside them take about 30 bytes for each.
BLOCK = 1 << 17


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans (ascending, disjoint) of data: polynomials in _R, from running sums over blocks of whole spans."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + BLOCK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        part = data[lo:hi]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power(_R, len(part), "r"), out=sums[1:])
        a, b = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix64(((sums[b] - sums[a]) * _power(_RI, len(part), "ri")[a]) ^ (b - a).astype(np.uint64))
        i = j
    return out


def slices(col: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (from, to, bytes, offsets) of whole texts, of about `most` bytes each; a longer text is a run of its own."""
    data, offs = string_buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, flat, and offsets. Fewer than `size` words: all of them as one."""
    n = len(first) - 1
    count = np.diff(first)
    m = max(len(words) - size + 1, 0)
    flat = np.zeros(m, np.uint64)
    for j, factor in enumerate(mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)):  # without linear relations
        flat += words[j : j + m] * factor
    flat = mix64(flat)
    sets = []
    for i in range(n):
        a, k = first[i], count[i]
        if k >= size:
            s = np.sort(flat[a : a + k - size + 1])
            sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif k:
            h = np.uint64(k)
            with np.errstate(over="ignore"):
                for w in words[a : a + k]:
                    h = mix64(np.array([h * _R + w]))[0]
            sets.append(np.array([h], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    offs = np.zeros(n + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=offs[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), offs


def segment_min(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Minimum of each non-empty segment; the largest value for empty ones."""
    out = np.full(len(offs) - 1, np.uint64(2**64 - 1), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full] = np.minimum.reduceat(values, offs[full])
    return out


def minhashes(flat: np.ndarray, offs: np.ndarray, count: int, seed: int) -> np.ndarray:
    """(texts, count) 32-bit minhash values."""
    rng = np.random.default_rng(seed)
    x, a = rng.integers(0, 2**64, count, np.uint64), rng.integers(0, 2**64, count, np.uint64) | np.uint64(1)
    out = np.empty((len(offs) - 1, count), np.uint32)
    for k in range(count):
        out[:, k] = (mix64(segment_min((flat ^ x[k]) * a[k], offs)) >> np.uint64(32)).astype(np.uint32)
    return out
