"""Hashed word shingles of many texts at once, in numpy.

Words are the runs of bytes other than space and tab to carriage return of a text
whose A-Z are lower-cased.  A word's hash is a polynomial over a table of random
values, taken from running sums, so one pass serves a whole block of texts.  Such
polynomials agree on some long words that differ (Thue-Morse words of 1,024 bytes),
so words of over ``LONG`` bytes are hashed by XXH3.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

LONG = 256
BLOCK = 1 << 19  # bytes handled at once; a longer text goes through in pieces cut between words

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SEPARATORS = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, name: str) -> np.ndarray:
    if name not in _powers:
        x = np.full(BLOCK + 4096, base, dtype=np.uint64)
        x[0] = 1
        _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers[name]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(raw: bytes):
    """Cuts a long text between words; a word longer than a block is a piece of its own."""
    at = 0
    while len(raw) - at > BLOCK:
        stop = max(raw.rfind(c, at + 1, at + BLOCK) for c in _SEPARATORS)
        if stop <= at:
            end = _SEPARATOR.search(raw, at + BLOCK)
            stop = end.start() if end else len(raw)
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hash of each word of each text."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    block: list[tuple[int, bytes]] = []
    size = 0
    for i, raw in enumerate(texts):
        for piece in _pieces(raw):
            if len(piece) > BLOCK:
                if block:
                    _hash_block(block, out)
                    block, size = [], 0
                out[i].append(_hash_long(piece))
                continue
            if block and size + len(piece) + 1 > BLOCK:
                _hash_block(block, out)
                block, size = [], 0
            block.append((i, piece))
            size += len(piece) + 1
    if block:
        _hash_block(block, out)
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out]


def _hash_long(piece: bytes) -> np.ndarray:
    """The hash of the one word of a piece longer than a block."""
    return np.array([_long(np.frombuffer(piece, dtype=np.uint8)[~_SPACE[np.frombuffer(piece, dtype=np.uint8)]])], dtype=np.uint64)


def _long(word: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(_LOWER[word].tobytes())


def _hash_block(block: list[tuple[int, bytes]], out: list[list[np.ndarray]]) -> None:
    data = np.frombuffer(b" ".join(p for _, p in block) + b" ", dtype=np.uint8)
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    start, stop = edges[0::2], edges[1::2]
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_VALUE[data] * _power(_R, "up")[: len(data)], out=sums[1:])
    hashes = (sums[stop] - sums[start]) * _power(_R_INVERSE, "down")[start]
    hashes = mix(hashes + (stop - start).astype(np.uint64) * np.uint64(_R))
    for i in np.flatnonzero(stop - start > LONG):
        hashes[i] = _long(data[start[i] : stop[i]])
    ends = np.cumsum([len(p) + 1 for _, p in block])
    cuts = np.searchsorted(start, ends)
    at = 0
    for (i, _), cut in zip(block, cuts, strict=True):
        out[i].append(hashes[at:cut])
        at = cut


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of ``k``-word shingles; of fewer words, one shingle of them all."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, k)
    x = np.zeros(n - m + 1, dtype=np.uint64)
    for d in range(m):
        x = mix(x + words[d : d + n - m + 1] + np.uint64(d + 1))
    return np.unique(x)
