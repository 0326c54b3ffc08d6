"""Byte-level word kernels shared by the text operators.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``.  All kernels work on one
Arrow batch at a time: the texts are laid end to end in one byte array and every step is a numpy
pass over it, so there is no per-word Python but for words above ``LONG_WORD`` bytes.  Null texts
count as empty.

Words are hashed by mixing eight bytes at a time, runs of words by mixing the hashes of two runs of
half the length.  Every step is mixed nonlinearly, so that regular texts (few letters, few words)
collide no more often than others.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

SHINGLE = 5
#: Words above this many bytes are hashed one by one.
LONG_WORD = 64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Odd multipliers, and the bytes of a chunk that belong to a word with so many bytes left.
_LEFT, _RIGHT, _SIZE, _CHUNK = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xC2B2AE3D27D4EB4F, 0x9E3779B97F4A7C15))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class Words(NamedTuple):
    """Word ``i`` is ``buffer[start[i]:end[i]]``; text ``t`` has words ``first[t]:first[t + 1]``."""

    buffer: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values; bijective."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def split(texts: list[bytes | None], lower: bool = False) -> Words:
    """Words of each text; ``lower`` folds A-Z only."""
    texts = [t or b"" for t in texts]
    # A space behind each text; eight more, so that eight bytes can be read from the start of any word.
    buffer = np.frombuffer(b"\n".join(texts) + b"\n" * 9, dtype=np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    space = _SPACE[buffer]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[0::2], edge[1::2]
    limits = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return Words(buffer, start, end, np.searchsorted(start, limits))


def word_hashes(w: Words) -> np.ndarray:
    """One well-mixed 64-bit hash for each word."""
    length = w.end - w.start
    out = mix(length.astype(np.uint64) * _SIZE)
    eight = np.ndarray((max(0, len(w.buffer) - 7),), dtype="<u8", buffer=w.buffer.data, strides=(1,))
    some = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(some):
        chunk = eight[w.start[some] + at] & _MASK[np.minimum(length[some] - at, 8)]
        out[some] = mix((out[some] ^ chunk) * _CHUNK)
        at += 8
        some = some[length[some] > at]
    data = w.buffer.data
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[w.start[i] : w.end[i]], digest_size=8).digest(), "little")
    return out


def _joined(left: np.ndarray, right: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Hash of a run from those of its beginning and its end, which may overlap."""
    return mix(left * _LEFT + mix(right ^ _RIGHT) + np.asarray(size).astype(np.uint64) * _SIZE)


def _half(size: int) -> int:
    """The largest power of two that is at most ``size``."""
    return 1 << (int(size).bit_length() - 1)


class Runs:
    """Hashes of runs of consecutive words: those of 2**k words by doubling, all others from two of these."""

    def __init__(self, hashes: np.ndarray):
        self._doubled = {1: hashes}

    def _power(self, size: int) -> np.ndarray:
        if size not in self._doubled:
            half = self._power(size // 2)
            self._doubled[size] = _joined(half[: max(0, len(half) - size // 2)], half[size // 2 :], size)
        return self._doubled[size]

    def windows(self, size: int) -> np.ndarray:
        """Hash of every run of ``size`` words."""
        part, n = self._power(_half(size)), max(0, len(self._doubled[1]) - size + 1)
        return _joined(part[:n], part[size - _half(size) :][:n], size)

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hash of each run ``lo:hi``, of one word at least; equal to that of ``windows`` for equal words."""
        out, sizes = np.zeros(len(lo), dtype=np.uint64), hi - lo
        half = np.left_shift(1, np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for h in np.unique(half):
            some = half == h
            part = self._power(int(h))
            out[some] = _joined(part[lo[some]], part[hi[some] - h], sizes[some])
        return out


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted within the text, and where each text begins.

    A text of fewer than ``size`` words, but at least one, has the whole sequence as its one shingle.
    """
    runs = Runs(word_hashes(w))
    counts = np.diff(w.first)
    full = runs.windows(size)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), made)
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.arange(first[-1]) - first[owner] + w.first[owner]
    values = np.zeros(first[-1], dtype=np.uint64)
    long_text = counts[owner] >= size
    values[long_text] = full[at[long_text]]
    short = ~long_text
    if short.any():
        lo = w.first[owner[short]]
        values[short] = runs.spans(lo, lo + counts[owner[short]])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))
