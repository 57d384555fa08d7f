"""Vectorised word hashing over Arrow batches (numpy inside tasks).

Words are maximal runs of bytes outside space and \\x09-\\x0D, with A-Z lower-cased: the code-point
definition ``[^\\x20\\x09-\\x0D]+`` read on UTF-8 bytes, since every separator is one ASCII byte.
A word's hash is a polynomial over randomised bytes, finalised to 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = (9, 10, 11, 12, 13, 32)
CHUNK = 1 << 19          # bytes hashed at a time: bounds the temporary arrays, never the text
_POWERS = 1 << 16

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_R = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_POWERS - 1, 0x9E3779B97F4A7C15, np.uint64)]))
_GRAM = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """Groups of (document, bytes) of about CHUNK bytes; longer texts are cut between words."""
    group: list[tuple[int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t):
            end = min(len(t), at + CHUNK)
            if end < len(t):
                # never inside a word: go on to the next separator
                nxt = [p for s in SEPARATORS if (p := t.find(bytes([s]), end)) >= 0]
                end = min(nxt, default=len(t))
            group.append((i, t[at:end]))
            size += end - at
            at = end
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def run_hashes(body: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each of the consecutive words of ``size`` bytes that make up ``body`` (A-Z hashed as a-z)."""
    first = np.cumsum(size) - size
    pos = np.arange(len(body)) - np.repeat(first, size)
    weight = _R[pos & (_POWERS - 1)]
    if size.max() > _POWERS:
        weight = weight * (np.uint64(2) * (pos >> 16).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(_BYTE[body] * weight, first) + size.astype(np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets of length documents + 1)."""
    counts = np.zeros(len(texts), np.int64)
    out = []
    for group in _pieces(texts):
        buf = np.frombuffer(b" " + b" ".join(p for _, p in group) + b" ", np.uint8)
        sep = _IS_SEP[buf]
        edge = np.flatnonzero(sep[1:] != sep[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        if not len(starts):
            continue
        size = ends - starts
        out.append(run_hashes(buf[~sep], size))
        at = np.cumsum([1] + [len(p) + 1 for _, p in group])
        per = np.diff(np.searchsorted(starts, at))
        np.add.at(counts, [i for i, _ in group], per)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (across documents: callers pick the valid starts)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h += words[j:j + m] * _GRAM[j]
    return mix(h + np.uint64(n))


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each text; a shorter text gives its whole sequence as one."""
    words, off = word_hashes(texts)
    grams = gram_hashes(words, n)
    sets = []
    for a, b in zip(off[:-1], off[1:]):
        if b - a >= n:
            sets.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            sets.append(gram_hashes(words[a:b], int(b - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def list_column(arrays: Iterable[np.ndarray], dtype=np.int64) -> pa.ListArray:
    """Arrow list column out of numpy arrays (64-bit hashes are reinterpreted as signed)."""
    arrays = [np.ascontiguousarray(a).view(dtype) if a.dtype.itemsize == np.dtype(dtype).itemsize else a.astype(dtype)
              for a in arrays]
    off = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat))
