"""Vectorised word and shingle hashes of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle, unless an operator says otherwise.
WORDS = 5
#: Bytes of text that are hashed at once.
SLICE = 1 << 19

_BASE = np.uint64(0x100000001B3 * 2 + 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_JOIN = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


def slices(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about SLICE bytes, each with its first index."""
    part, held, first = [], 0, 0
    for i, t in enumerate(texts):
        part.append(t.encode())
        held += len(part[-1]) + 1
        if held >= SLICE:
            yield first, part
            part, held, first = [], 0, i + 1
    if part:
        yield first, part


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, in order, and the offsets of the texts' words (one more than texts)."""
    sizes = np.array([len(t) + 1 for t in raw])
    b = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    before = np.empty(len(b), bool)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    up, down = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    words = mixed((total[ends] - total[starts]) * down[starts])
    return words, np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words of each text, offsets of the texts' shingles, and the place of each shingle's first word.

    A text of fewer than k words, but at least one, has one shingle of all its words.
    """
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], count) + np.repeat(offsets[:-1], count)
    short = np.repeat(n < k, count)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    value = padded[place].copy()
    for j in range(1, k):
        value = value * _JOIN + padded[place + j]
    if short.any():
        lengths = np.repeat(n, count)
        for i in np.flatnonzero(short):
            x = np.uint64(0x5348)
            for w in words[place[i] : place[i] + lengths[i]]:
                x = np.array([x], np.uint64) * _JOIN + w
                x = x[0]
            value[i] = x
    return mixed(value), out_offsets, place


def shingles(texts: list[str], k: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By slices of texts: the first index, the shingles' hashes and their offsets."""
    for first, raw in slices(texts):
        words, offsets = word_hashes(raw)
        value, out, _ = shingle_hashes(words, offsets, k)
        yield first, value, out


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and addends of `count` universal hash functions on 32 bits, from one rule."""
    x = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(seed))
    return (x[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[count:] >> np.uint64(32)).astype(np.uint32)


def minhash(values: np.ndarray, offsets: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """The least value of each hash function over each text's shingles: uint32 [texts, count]; all ones for an empty text."""
    a, b = permutations(count, seed)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(offsets) - 1, count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    # runs of texts of about 16 thousand shingles, which stay in the processor's cache
    run, at, begins = [], 0, np.asarray(offsets)[some]
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + 16384)))
        run.append((at, min(end, len(some))))
        at = end
    for at, end in run:
        docs = some[at:end]
        lo, hi = offsets[docs[0]], offsets[docs[-1] + 1]
        part, first = x[lo:hi], offsets[docs] - lo
        for k in range(count):
            out[docs, k] = np.minimum.reduceat(part * a[k] + b[k], first)
    return out
