"""Words and shingles of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 21)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers


def slices(texts: list[bytes], most: int = 1 << 21):
    """Ranges of texts of about `most` bytes each (one text at least)."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def ranges_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each range, by its bytes alone."""
    return sums_hash(_RANDOM[data], start, end)


def sums_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range, from running sums of a polynomial in a fixed base."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * power[: len(values)], dtype=np.uint64, out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_ranges(texts: list[bytes], apart: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, with lower A-Z lower-cased, where each text begins, text number, start and end of each word); apart: by byte, whether it separates words."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    data = _LOWER[data] if lower else data
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    np.logical_not(apart[data], out=inside[1:])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    return data, begins, np.searchsorted(begins, start, "right") - 1, start, end


def space_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word between ASCII white space, with lower A-Z lower-cased, in text order."""
    data, _, owner, start, end = word_ranges(texts, _SPACE, lower)
    return owner, ranges_hash(data, start, end)


def shingle_sets(texts: list[bytes], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: (bounds of length texts + 1, hashes ascending in each text).

    A text of fewer than `width` words has its whole sequence as one shingle; one without words has none."""
    owner, word = space_words(texts)
    n = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    salt = [np.uint64(0xD6E8FEB86659FD93 + 2 * i * 0x632BE59BD9B4E019 & (2**64 - 1) | 1) for i in range(width)]
    owners, hashes = [], []
    if len(word) >= width:
        h = np.zeros(len(word) - width + 1, np.uint64)
        for i in range(width):
            h = mix(h + word[i : len(word) - width + 1 + i] * salt[i])
        whole = owner[: len(h)] == owner[width - 1 :]
        owners.append(owner[: len(h)][whole])
        hashes.append(h[whole])
    for k in range(1, width):
        short = np.flatnonzero(n == k)
        h = np.full(len(short), k, np.uint64)
        for i in range(k):
            h = mix(h + word[first[short] + i] * salt[i])
        owners.append(short)
        hashes.append(h)
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])
        owner, h = owner[keep], h[keep]
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64), h


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum, modulo 2**64, of each segment; 0 for an empty one."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]
