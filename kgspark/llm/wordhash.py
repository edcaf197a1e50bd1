"""Hashes of the words of a text, and of runs of them, at array speed."""

from __future__ import annotations

import re

import numpy as np

_P = 0x9E3779B97F4A7C15
_GAP = re.compile(rb"[\t-\r ]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)  # a fixed number for each byte
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p, np.uint64)])) for p in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with every bit depending on all bits; equal ones stay equal."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(_SPACE[np.frombuffer(text, np.uint8)], prepend=True, append=True))
    return edge[::2], edge[1::2]


def word_hashes(text: bytes, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word. A word's hash is a polynomial in its bytes, from differences of one running sum.

    A text of over `most` bytes is taken in parts that end at a space, which bounds the arrays.
    """
    if len(text) > most:
        parts, at = [], 0
        while at < len(text):
            space = _GAP.search(text, min(at + most, len(text)))
            stop = space.end() if space else len(text)
            h, start, end = word_hashes(text[at:stop], stop - at)
            parts.append((h, start + at, end + at))
            at = stop
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    start, end = word_edges(text)
    if not len(start):
        return np.empty(0, np.uint64), start, end
    raw = np.frombuffer(text, np.uint8)
    up, down = powers(len(raw))
    run = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * up[: len(raw)])])
    return mixed((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)), start, end


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, by their hashes; order counts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = powers(k + 1)[0]
    out = h[:n] * factors[1]
    for j in range(1, k):
        out += h[j : j + n] * factors[j + 1]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def portions(texts: list[bytes], most: int = 1 << 21):
    """Ranges of texts that hold about `most` bytes together, at least one text each."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < most):
            size += len(texts[stop]) + 1
            stop += 1
        yield at, stop
        at = stop


def joined_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in one, a line end between them; the hash of each word, and the number of its text."""
    joined = b"\n".join(texts)
    h, start, _ = word_hashes(joined)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return joined, h, np.searchsorted(ends, start, side="right")
